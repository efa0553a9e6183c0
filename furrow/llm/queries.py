"""The operators as registered queries over the given tables, with SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from furrow.llm import (
    bpe, hard_negatives, line_dedup, near_copies, near_vectors, neighbours, packing, periodic_runs, quality_model, quality_rules, sharding,
    token_counts, url_filters,
)
from furrow.llm.common import read, small_batches, with_results, words
from furrow.session import cut_lineage, prepare

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def query(name: str, oracle: str | None = None):
    def register(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            small_batches(prepare(spark))
            return fn(spark, sf_dir)

        QUERIES[name] = run
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return register


def hosts_sql() -> str:
    """Prior and verdict of the hosts, as in quality_rules.prior."""
    rules = list(quality_rules.RULES)
    low, high = quality_rules.STRENGTH
    sums = ", ".join(f"sum(CAST(failed_{r} AS INT))::DOUBLE AS f_{r}" for r in rules)
    fits = ", ".join(f"sum(f_{r}) / sum(n) AS m_{r}, sum(f_{r} * f_{r} / n) AS fit_{r}" for r in rules)
    between = {r: f"((fit_{r} - docs * m_{r} * m_{r} - m_{r} * (1 - m_{r}) * (k - 1)) / (m_{r} * (1 - m_{r}) * free))" for r in rules}
    strength = ", ".join(
        f"CASE WHEN m_{r} * (1 - m_{r}) > 0 AND free > 0 THEN CASE WHEN {between[r]} > 0"
        f" THEN greatest({low}, least({high}, 1 / {between[r]} - 1)) ELSE {high} END ELSE {low} END AS s_{r}" for r in rules)
    worst = ", ".join(f"(f_{r} + m_{r} * s_{r}) / (n + s_{r})" for r in rules)
    return f"""hosts AS (SELECT source, count(*)::DOUBLE AS n, {sums} FROM judged WHERE source IS NOT NULL GROUP BY source),
moments AS (SELECT *, docs - squares / docs - (k - 1) AS free FROM (
    SELECT count(*) AS k, sum(n) AS docs, sum(n * n) AS squares, {fits} FROM hosts)),
priors AS (SELECT *, {strength} FROM moments),
verdicts AS (SELECT source, greatest({worst}) <= {quality_rules.MOST} AS host_kept FROM hosts, priors)"""


@query("op1_quality_rules", rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
each AS (SELECT rid, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS i FROM w),
spans AS (SELECT rid, i, concat_ws(' ', word, lead(word, 1) OVER o, lead(word, 2) OVER o, lead(word, 3) OVER o, lead(word, 4) OVER o) AS span
          FROM each WINDOW o AS (PARTITION BY rid ORDER BY i) QUALIFY lead(word, 4) OVER o IS NOT NULL),
twice AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, span) AS c FROM spans) WHERE c > 1),
covered AS (SELECT rid, count(DISTINCT i + j) AS n FROM twice, range(0, 5) AS r(j) GROUP BY rid),
measured AS (SELECT rid, doc_id, source, len(ws) AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
                    length(t) - length(translate(t, '#*$%&|<>', '')) AS n_symbols, len(ls) AS n_lines,
                    len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(covered.n, 0) AS n_repeat_words
             FROM w LEFT JOIN covered USING (rid)),
judged AS (SELECT *, {", ".join(f"({c}) AS failed_{r}" for r, c in quality_rules.RULES.items())} FROM measured),
{hosts_sql()}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed_base AS base_failed,
       NOT failed_base AND coalesce(host_kept, true) AS kept
FROM judged LEFT JOIN verdicts USING (source)""")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", "text")
    rows = cut_lineage(quality_rules.measured(docs).drop("text"))
    return quality_rules.judged(rows).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _fits(rule: str) -> str:
    host, _, path = rule.partition("/")
    return f"(host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '/{path}')"


@query("op2_url_filters", rf"""
WITH p AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                  regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path FROM pages),
parts AS (SELECT *, string_split(array_to_string(list_transform(regexp_extract_all(path, '%[0-9A-Fa-f]{{2}}|[^%]+|%'),
    lambda t: CASE WHEN regexp_full_match(t, '{url_filters.ESCAPE.pattern}') THEN chr(CAST('0x' || substr(t, 2) AS INT)) ELSE t END), ''), '/')[2:] AS part FROM p),
q AS (SELECT page_id, host, path, regexp_replace(regexp_replace(regexp_replace(host, '^.*@', '', 's'), ':[0-9]*$', ''), '\.+$', '') ||
             CASE WHEN path = '' THEN '' ELSE '/' || array_to_string(list_reduce(list_prepend(CAST([] AS VARCHAR[]), list_transform(part, lambda s: [s])),
                 lambda kept, s: CASE s[1] WHEN '.' THEN kept WHEN '..' THEN list_slice(kept, 1, len(kept) - 1) ELSE list_concat(kept, s) END) ||
                 CASE WHEN part[-1] IN ('.', '..') THEN [''] ELSE [] END, '/') END AS address FROM parts),
ruled AS (SELECT *, CASE {" ".join(f"WHEN {_fits(r)} THEN '{r}'" for _, r in sorted(url_filters.HOST_RULES, key=lambda x: -len(x[1])))} END AS rule FROM q)
SELECT page_id, host, path, rule,
       CASE {" ".join(f"WHEN rule = '{r}' THEN '{v}'" for v, r in url_filters.HOST_RULES)}
            WHEN regexp_matches(address, '(?s)^adult[^/]*/|^[^/]*\.adult[^/]*/|/login[^/]*$|/signin[^/]*$|/ads/|/[^/]*\.exe$') THEN 'block'
            ELSE 'allow' END AS verdict
FROM ruled""")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.judged(read(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


def _number(text: str) -> str:
    return f"CAST('0x' || substr(md5({text}), 1, 15) AS BIGINT)"


@query("op3_sharding", f"""
WITH RECURSIVE shards AS (SELECT i, 'shard-' || lpad(i::VARCHAR, 2, '0') AS shard FROM range(0, {len(sharding.SHARDS)}) AS r(i)),
orders AS (SELECT i, list_transform(range(0, {sharding.SLOTS}), lambda k: (o + k * s) % {sharding.SLOTS}) AS slots FROM (
    SELECT i, {_number("shard || '/offset'")} % {sharding.SLOTS} AS o, {_number("shard || '/skip'")} % {sharding.SLOTS - 1} + 1 AS s FROM shards)),
filled(claim, i, slot, taken) AS (
    SELECT 0::BIGINT, 0::BIGINT, slots[1], list_transform(range(0, {sharding.SLOTS}), lambda x: x = slots[1]) FROM orders WHERE i = 0
    UNION ALL
    SELECT claim + 1, o.i, n.slot, list_transform(range(0, {sharding.SLOTS}), lambda x: taken[x + 1] OR x = n.slot)
    FROM filled f JOIN orders o ON o.i = (f.claim + 1) % {len(sharding.SHARDS)},
         LATERAL (SELECT list_filter(o.slots, lambda x: NOT f.taken[x + 1])[1] AS slot) n
    WHERE claim + 1 < {sharding.SLOTS}),
placed AS (SELECT doc_id, {_number("coalesce(doc_id::VARCHAR, '')")} % {sharding.SLOTS} AS slot FROM documents)
SELECT doc_id, slot, shard FROM placed JOIN filled USING (slot) JOIN shards USING (i)""")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.placed(read(spark, sf_dir, "documents").select("doc_id"), "doc_id").select("doc_id", "slot", "shard")


@query("op4_quality_classifier")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "n_chars")
    model = quality_model.trained(docs, read(spark, sf_dir, "labels"))
    rows = quality_model.scored(docs, model)
    return rows.select("doc_id", quality_model.held_out().alias("held_out"), "score", "predicted")


@query("op5_token_counts")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.counted(read(spark, sf_dir, "documents").select("doc_id", "text"), PIECES).select("doc_id", "n_tokens")


@query("op6_nearest_neighbours")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(read(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)


@query("op7_line_dedup", r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
s AS (SELECT rid, doc_id, string_split(t, chr(10)) AS ls FROM d),
l AS (SELECT rid, doc_id, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS place FROM s),
k AS (SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
                          'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
repeated AS (SELECT key, min(doc_id) AS owner FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
j AS (SELECT k.*, repeated.owner IS NOT NULL AND repeated.owner <> doc_id AS gone FROM k LEFT JOIN repeated USING (key))
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (NOT gone), '')) AS kept_sha256
FROM j GROUP BY rid""")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = line_dedup.deduplicated(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


@query("op8_bpe_encoding")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bpe.digests(read(spark, sf_dir, "documents").select("doc_id", "text"), RANKS)
    return rows.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


@query("op9_best_fit_packing")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(read(spark, sf_dir, "documents"), VOCABULARY)


@query("op10_simhash_near_dedup")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = near_copies.judged(read(spark, sf_dir, "documents"))
    return rows.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


REAL = "len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"


@query("op11_hard_negatives", f"""
WITH e AS (SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                  list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
           FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND {REAL}),
s AS (SELECT a.r AS ar, a.vec_id AS anchor_id, b.r, b.vec_id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score
      FROM e a JOIN e b ON a.r <> b.r WHERE a.vec_id % 100 = 0),
p AS (SELECT ar, anchor_id, r AS pr, vec_id AS positive_id, score AS positive_score FROM s WHERE same
      QUALIFY row_number() OVER (PARTITION BY ar ORDER BY score DESC, vec_id, r) <= 5),
n AS (SELECT p.anchor_id, positive_id, row_number() OVER (PARTITION BY p.ar, pr ORDER BY score DESC, vec_id, r) AS rank,
             vec_id AS negative_id, positive_score, score AS negative_score
      FROM p JOIN s ON s.ar = p.ar AND NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score)
SELECT anchor_id, positive_id, rank::INT AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5""")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mined(rows.withColumn("label", moved), F.col("id") % 100 == 0)


@query("op12_embedding_near_dedup", f"""
WITH RECURSIVE e AS (SELECT row_number() OVER () AS r, vec_id, label, embedding::DOUBLE[] AS v,
    label IS NOT NULL AND coalesce({REAL} AND len(list_filter(embedding, lambda x: x <> 0)) > 0, false) AS able FROM embeddings),
links AS (SELECT a.r AS a, b.r AS b FROM e a JOIN e b ON a.label = b.label AND a.r <> b.r WHERE a.able AND b.able
          AND list_cosine_similarity(a.v, b.v) >= {near_vectors.SIMILAR}),
reach AS (SELECT r, r AS other FROM e UNION SELECT reach.r, links.b FROM reach JOIN links ON links.a = reach.other),
least AS (SELECT reach.r, min(e.vec_id) AS component_id FROM reach JOIN e ON e.r = other GROUP BY reach.r),
counts AS (SELECT a AS r, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, coalesce(vec_id = component_id, false) AS kept
FROM e JOIN least USING (r) LEFT JOIN counts USING (r)""")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors.deduplicated(read(spark, sf_dir, "embeddings"))


def _repeating(rows: list) -> list[tuple]:
    """Texts whose words from some place on go round; the place and the period follow from a number."""
    out = []
    for row in rows:
        said = words(row["text"] or "") if row else []
        if said:
            n, g = len(said), row["g"]
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            said = said[:a] + [said[a + (i - a) % p] for i in range(a, n)]
        out.append((b" ".join(said).decode() if said else None,))
    return out


#: Window lengths of the SQL form: each holds runs whose period it does not fall short of.
SPANS = [1 << k for k in range(4, 18)]


def _spans_sql() -> str:
    """Tables w1, w2, w4 ... of window hashes, each of two of the one before, and s16 ... of the next equal window."""
    parts = ["w1 AS (SELECT rid, i, word AS h FROM e)"]
    for m in (1 << k for k in range(1, 18)):
        parts.append(f"w{m} AS MATERIALIZED (SELECT rid, i, md5(h || chr(10) || lead(h, {m // 2}) OVER o) AS h FROM w{m // 2} WINDOW o AS (PARTITION BY rid ORDER BY i) "
                     f"QUALIFY lead(h, {m // 2}) OVER o IS NOT NULL)")
    for m in SPANS:
        parts.append(f"s{m} AS (SELECT rid, i, {m} AS m, lead(i) OVER (PARTITION BY rid, h ORDER BY i) - i AS q FROM w{m} QUALIFY q <= {m})")
    return ",\n".join(parts)


def _islands_sql() -> str:
    """Stretches in which every window's next equal one is `q` words on."""
    each = " UNION ALL ".join(f"SELECT * FROM s{m}" for m in SPANS)
    return f"SELECT rid, m, q, i, i - row_number() OVER (PARTITION BY rid, m, q ORDER BY i) AS island FROM ({each})"


@query("op13_periodic_runs", rf"""
WITH t AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)) AS bytes FROM documents),
c AS (SELECT rid, doc_id, w, len(w) AS n, xor(list_reduce(bytes, lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)),
    lambda x, k: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384::BIGINT) ELSE x // 2 END)), 4294967295::BIGINT) AS h FROM t),
g AS (SELECT *, coalesce(h % 10 = 0 AND n > 0, false) AS going, (h // 10) % n AS a, h // 10 AS g FROM c),
d AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM g),
e AS MATERIALIZED (SELECT rid, i, CASE WHEN going AND i >= a THEN w[a + (i - a) % p + 1] ELSE w[i + 1] END AS word
                   FROM (SELECT *, unnest(range(n)) AS i FROM d)),
{_spans_sql()},
found AS MATERIALIZED (SELECT DISTINCT rid, start, length, q AS period FROM (
    SELECT rid, q, min(i) AS start, max(i) + m + q - min(i) AS length FROM ({_islands_sql()}) GROUP BY rid, m, q, island)
    WHERE length >= greatest(24, 3 * q)),
best AS (SELECT * FROM found QUALIFY row_number() OVER (PARTITION BY rid ORDER BY length / period::DOUBLE DESC, start, period) = 1),
told AS (SELECT rid, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS runs FROM found GROUP BY rid),
dropped AS (SELECT DISTINCT rid, unnest(range(start + period, start + length)) AS i FROM found),
kept AS (SELECT rid, string_agg(word, ' ' ORDER BY i) AS text FROM e ANTI JOIN dropped USING (rid, i) GROUP BY rid)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, start, length, period, 1000 * length // period AS exponent_milli,
       sha256(coalesce(runs, '')) AS runs_sha256, sha256(coalesce(kept.text, '')) AS collapsed_sha256
FROM c LEFT JOIN told USING (rid) LEFT JOIN best USING (rid) LEFT JOIN kept USING (rid)""")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    number = F.floor(h / 10).cast("long")
    asked = F.when(h % 10 == 0, F.struct(number.alias("g"), "text"))
    rows = with_results(docs, asked, {"repeating": "string"}, _repeating).select("doc_id", F.coalesce("repeating", "text").alias("text"))
    found = periodic_runs.with_runs(rows).select("doc_id", "runs", F.sha2("collapsed", 256).alias("collapsed_sha256"))
    # Exact ratios: a run is better if its length times the other's period is larger. Runs come by start, then period.
    better = lambda best, r: F.when(best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"]), r).otherwise(best)
    best = F.aggregate("runs", F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>"), better)
    line = lambda r: F.concat(F.concat_ws(",", *(r[c].cast("string") for c in ("start", "length", "period"))), F.lit("\n"))
    found = found.withColumns({"n_runs": F.size("runs").cast("long"), "best": best, "runs_sha256": F.sha2(F.array_join(F.transform("runs", line), ""), 256)})
    return found.select("doc_id", "n_runs", "best.start", "best.length", "best.period",
                        F.expr("1000 * best.length div best.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


query("pipeline", corpus_pipeline.ORACLE_SQL)(corpus_pipeline.run)
