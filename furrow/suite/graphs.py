"""Entities, triples and the ranking of both."""

from __future__ import annotations

from pyspark.sql import functions as F

from furrow.functions import text as TX
from furrow.operators import graph as G
from furrow.operators import topk as K
from furrow.session import cut_lineage, shuffled_for
from furrow.suite import query
from furrow.suite.views import view, with_views

NAMES = with_views("names")
TRI = with_views("triples")
AUX = rf"^(?:(?:{'|'.join(TX.BE_HAVE_FORMS)})\b ?)+"
LOW = rf"(regexp_matches(lower(trim(v)), '{'|'.join(TX.DEFINITIONAL_PHRASES)}') OR (regexp_matches(lower(trim(v)), '{AUX}') AND NOT regexp_matches(regexp_replace(lower(trim(v)), '{AUX}', ''), '^\w+(ed|en)\b')))"
NOISE = ", ".join(f"'{n}'" for n in TX.NOISE_ENTITIES)


@query("valid_entities__flt15", NAMES + r""" SELECT p_partkey, entity FROM names WHERE length(trim(entity)) >= 2 AND NOT regexp_matches(regexp_replace(trim(entity), '[.\-]', '', 'g'), '^[0-9]+$') AND regexp_matches(trim(entity), '[\p{L}\p{N}]')""")
def _(spark, sf):
    return view(spark, sf, "names").where(TX.is_valid_entity(F.col("entity")))


@query("ranked_entity_filter__flt16", NAMES + rf""" SELECT p_partkey, entity FROM names WHERE (NOT regexp_matches(entity, '[0-9]') OR (length(entity) <= 30 AND regexp_matches(trim(entity), '^[A-Za-z0-9]+(-[A-Za-z0-9]+)*$'))) AND lower(entity) NOT IN ({NOISE})""")
def _(spark, sf):
    return view(spark, sf, "names").where(TX.is_ranked_entity(F.col("entity")))


@query("low_weight_verbs__flt17", TRI + f" SELECT v, CASE WHEN {LOW} THEN 1 ELSE 0 END AS low, count(*) AS n FROM triples GROUP BY v, CASE WHEN {LOW} THEN 1 ELSE 0 END")
def _(spark, sf):
    marked = view(spark, sf, "triples").withColumn("low", TX.is_low_weight_verb(F.col("v")).cast("int"))
    return marked.groupBy("v", "low").agg(F.count(F.lit(1)).alias("n"))


def _item(c):
    e = rf"replace({c}, '\', '\\')"
    return f"CASE WHEN contains({c}, '''') AND NOT contains({c}, '\"') THEN '\"' || {e} || '\"' WHEN contains({c}, '''') THEN '''' || replace({e}, '''', '\\''') || '''' ELSE '''' || {e} || '''' END"


@query("triple_text__fn12", NAMES + f" SELECT p_partkey, '[' || {_item('entity')} || ', ' || {_item(chr(39) + 'sells' + chr(39))} || ', ' || {_item('entity')} || ']' AS triple_text FROM names")
def _(spark, sf):
    e = F.col("entity")
    return view(spark, sf, "names").select("p_partkey", TX.triple_text(e, F.lit("sells"), e).alias("triple_text"))


def _lemma(c):
    return (f"CASE WHEN regexp_matches({c}, '^(.*[^aeiou])ies$') THEN regexp_replace({c}, '^(.*[^aeiou])ies$', '\\1y') WHEN regexp_matches({c}, '^(.*(?:s|x|z|ch|sh))es$') THEN regexp_replace({c}, '^(.*(?:s|x|z|ch|sh))es$', '\\1') "
            f"WHEN regexp_matches({c}, '^(.*(?:ss|us|is))$') THEN {c} WHEN regexp_matches({c}, '^(.{{2,}})s$') THEN regexp_replace({c}, '^(.{{2,}})s$', '\\1') ELSE {c} END")


def _norm(c):
    return f"CASE WHEN length(trim({c})) BETWEEN 2 AND 4 AND upper(trim({c})) = trim({c}) AND lower(trim({c})) <> trim({c}) THEN trim({c}) ELSE array_to_string(list_transform(regexp_split_to_array(lower(trim({c})), ' +'), lambda w: {_lemma('w')}), ' ') END"


@query("normalised_entities__fn13", NAMES + f" SELECT p_partkey, {_norm('entity')} AS normalised FROM names")
def _(spark, sf):
    return view(spark, sf, "names").select("p_partkey", TX.normalise_entity(F.col("entity")).alias("normalised"))


LINES = r"""WITH pieces AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents), w AS (SELECT doc_id, regexp_split_to_array(trim(line), ' +') AS ws FROM pieces),
places AS (SELECT ws, unnest(range(0, len(ws) // 3)) AS i FROM w),
raw AS (SELECT ws[3 * i + 1] AS s, ws[3 * i + 2] AS v, ws[3 * i + 3] AS o, count(*) AS n FROM places GROUP BY ALL)"""
ENDS = f"CASE WHEN upper({{0}}) = {{0}} AND lower({{0}}) <> {{0}} AND length({{0}}) > 1 THEN {{0}} ELSE {_norm('{0}').replace('{2,}', '{{2,}}')} END"
VALID = r"length(trim({0})) >= 2 AND NOT regexp_matches(regexp_replace(trim({0}), '[.\-]', '', 'g'), '^[0-9]+$') AND regexp_matches(trim({0}), '[\p{{L}}\p{{N}}]')"
NORMAL = LINES + f""", nt AS (SELECT s AS raw_s, v, o AS raw_o, n, {ENDS.format('s')} AS s, {ENDS.format('o')} AS o FROM raw WHERE {VALID.format('s')} AND {VALID.format('o')}),
ents AS (SELECT s AS entity FROM nt UNION SELECT o FROM nt), pl AS (SELECT entity, substring(entity, 1, length(entity) - 1) AS singular FROM ents WHERE NOT contains(entity, ' ') AND NOT contains(entity, '''') AND ends_with(entity, 's') AND length(entity) > 3 AND substring(entity, 1, length(entity) - 1) IN (SELECT entity FROM ents)),
fin AS (SELECT coalesce(a.singular, nt.s) AS s, nt.v, coalesce(b.singular, nt.o) AS o, raw_s, raw_o, n FROM nt LEFT JOIN pl a ON a.entity = nt.s LEFT JOIN pl b ON b.entity = nt.o)"""


def line_threes(spark, sf):
    """Every three words of every document line, from its start on."""
    words = F.split(F.trim("line"), " +")
    lines = view(spark, sf, "documents").select(F.explode(F.split("text", "\n")).alias("line")).select(words.alias("w")).where(F.size("w") >= 3)
    threes = F.transform(F.sequence(F.lit(0), F.floor(F.size("w") / 3).cast("int") - 1), lambda i: F.slice("w", 3 * i + 1, 3))
    return lines.select(F.explode(threes).alias("w")).select(*[F.get("w", F.lit(i)).alias(n) for i, n in enumerate("svo")])


def about_threes(spark, sf):
    """About how many threes the documents hold, at six characters a word."""
    return (view(spark, sf, "documents").agg(F.sum(F.length("text"))).first()[0] or 0) // 18


def line_triples(spark, sf):
    return line_threes(spark, sf).groupBy("s", "v", "o").agg(F.count(F.lit(1)).alias("n"))


@query("plural_merge__jn15", NORMAL + " SELECT entity, singular FROM pl")
def _(spark, sf):
    raw = line_threes(spark, sf)
    valid = raw.where(TX.is_valid_entity(F.col("s")) & TX.is_valid_entity(F.col("o")))
    # Names are made once for each different word, not for each triple, and are needed twice.
    with shuffled_for(spark, about_threes(spark, sf)):
        named = cut_lineage(G.entities_of(valid).select(TX.graph_entity(F.col("entity")).alias("entity")).distinct())
    return G.plural_map(named)


@query("normalised_triples__gr5_jn14", NORMAL + " SELECT s, v, o, raw_s, raw_o, n FROM fin")
def _(spark, sf):
    with shuffled_for(spark, about_threes(spark, sf)):
        return G.normalised_triples(line_triples(spark, sf)).select("s", "v", "o", "raw_s", "raw_o", "n")


WEIGHT = f"CASE WHEN {LOW} THEN 0.05 WHEN v = 'was reduced by' THEN 1.0 WHEN v = 'prices rise' THEN 0.8 ELSE 1.0 END"
EDGES = TRI + f", edges AS (SELECT s AS src, o AS dst, max_by(v, pos) AS verb, CAST(max_by({WEIGHT}, pos) AS DOUBLE) AS weight FROM triples GROUP BY s, o), nodes AS (SELECT src AS id FROM edges UNION SELECT dst FROM edges), cnt AS (SELECT count(*) AS n FROM nodes), ow AS (SELECT src, sum(weight) AS w FROM edges GROUP BY src)"


def _rounds(k):
    text = ", r0 AS (SELECT id, 1.0 / n AS rank FROM nodes, cnt)"
    for i in range(1, k + 1):
        text += (f", r{i} AS MATERIALIZED (SELECT nd.id, 0.85 * (coalesce(f.inflow, 0) + coalesce((SELECT sum(p.rank) FROM r{i - 1} p WHERE p.id NOT IN (SELECT src FROM ow)), 0) / n) + 0.15 / n AS rank FROM nodes nd, cnt "
                 f"LEFT JOIN (SELECT e.dst, sum(p.rank * e.weight / ow.w) AS inflow FROM edges e JOIN r{i - 1} p ON p.id = e.src JOIN ow ON ow.src = e.src GROUP BY e.dst) f ON f.dst = nd.id)")
    return text + f", ranks AS (SELECT id, rank FROM r{k})"


RANKS = EDGES + _rounds(25)


def edges_of(triples):
    weight = G.edge_weight(F.col("v"), F.col("v") == "was reduced by", F.col("v") == "prices rise")
    return cut_lineage(G.build_edges(triples, weight))  # read several times by every ranking


@query("weighted_edges__gr1", EDGES + " SELECT src, dst, verb, weight FROM edges")
def _(spark, sf):
    return edges_of(view(spark, sf, "triples"))


@query("entity_rank__gr2", RANKS + " SELECT id, round(rank, 6) AS rank FROM ranks")
def _(spark, sf):
    return G.pagerank(edges_of(view(spark, sf, "triples"))).select("id", F.round("rank", 6).alias("rank"))


@query("verb_contribution__agg16", RANKS + " SELECT verb, round(avg(a.rank + b.rank), 6) AS score FROM edges JOIN ranks a ON a.id = src JOIN ranks b ON b.id = dst GROUP BY verb")
def _(spark, sf):
    edges = edges_of(view(spark, sf, "triples"))
    return G.verb_contribution(edges, G.pagerank(edges)).select("verb", F.round("score", 6).alias("score"))


@query("top_entities__top1", RANKS + " SELECT id, round(rank, 4) AS score FROM ranks ORDER BY rank DESC, id LIMIT 20")
def _(spark, sf):
    ranks = G.pagerank(edges_of(view(spark, sf, "triples"))).where(TX.is_ranked_entity(F.col("id")))
    return K.top_rows(ranks, [F.col("rank").desc(), F.col("id")], 20).select("id", F.round("rank", 4).alias("score"))


@query("graph_statistics__agg21", EDGES + " SELECT (SELECT count(*) FROM nodes) AS nodes, (SELECT count(*) FROM edges) AS edges, (SELECT count(*) FROM triples) AS triples")
def _(spark, sf):
    triples = view(spark, sf, "triples")
    edges = edges_of(triples)
    return G.graph_stats(edges, G.nodes_of(edges), triples)


TOUCH = RANKS + f""", topn AS (SELECT id FROM ranks ORDER BY round(rank, 9) DESC, id LIMIT 5), touch AS (SELECT t.s, t.v, t.o, t.pos, e.weight * (a.rank + b.rank) AS importance, t.s IN (SELECT id FROM topn) AS ts, t.o IN (SELECT id FROM topn) AS ot
FROM triples t JOIN edges e ON e.src = t.s AND e.dst = t.o JOIN ranks a ON a.id = t.s JOIN ranks b ON b.id = t.o WHERE (t.s IN (SELECT id FROM topn) OR t.o IN (SELECT id FROM topn)) AND NOT {LOW})"""


def touching(spark, sf):
    triples = view(spark, sf, "triples")
    edges = edges_of(triples)
    ranks = G.pagerank(edges)
    top = K.top_rows(ranks, [F.round("rank", 9).desc(), F.col("id")], 5)
    return G.touching_triples(triples, top, edges, ranks)


@query("triple_importance__jn16_top7", TOUCH + " SELECT s, v, o, pos, round(importance, 6) AS importance FROM touch")
def _(spark, sf):
    return touching(spark, sf).select("s", "v", "o", "pos", F.round("importance", 6).alias("importance"))


@query("triple_keywords__agg17", TOUCH + """, k AS (SELECT s || ' ' || v || ' ' || o AS triple_text, s AS entity FROM touch WHERE ts UNION SELECT s || ' ' || v || ' ' || o, o FROM touch WHERE ot)
SELECT triple_text, string_agg(entity, ',' ORDER BY entity) AS keywords FROM k GROUP BY triple_text""")
def _(spark, sf):
    named = touching(spark, sf).withColumn("triple_text", F.concat_ws(" ", "s", "v", "o"))
    return G.triple_keywords(named).select("triple_text", F.array_join("keywords", ",").alias("keywords"))
