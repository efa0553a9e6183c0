"""Vector lookups, neighbours, similar pairs and clusters."""

from __future__ import annotations

from pyspark.sql import functions as F

from furrow.functions import text as TX
from furrow.functions import vectors as V
from furrow.operators import aggregates as A
from furrow.operators import graph as G
from furrow.operators import joins as J
from furrow.operators import similarity as S
from furrow.operators import topk as K
from furrow.suite import query
from furrow.suite.views import view, with_views

# The generated vectors are nearly orthogonal, so the thresholds here lie below the defaults.
THRESHOLD = 0.3
EMB = "WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"
PAIRS = EMB + f", pairs AS (SELECT a.vec_id AS id_a, b.vec_id AS id_b, round(list_cosine_similarity(a.v, b.v), 9) AS sim FROM e a JOIN e b ON a.vec_id < b.vec_id WHERE round(list_cosine_similarity(a.v, b.v), 9) >= {THRESHOLD})"


@query("embedding_lookup__jn7", """WITH texts AS (SELECT DISTINCT 'vector ' || CAST(doc_id % (SELECT count(*) * 7 // 5 FROM embeddings) AS STRING) AS text FROM documents), stored AS (SELECT 'vector ' || CAST(vec_id AS STRING) AS text, md5(CAST(vec_id AS STRING)) AS hash_id, embedding FROM embeddings)
SELECT t.text, s.hash_id, round(CAST(s.embedding[1] AS DOUBLE), 6) AS first_value FROM texts t LEFT JOIN stored s ON s.text = t.text""")
def _(spark, sf):
    total = max(1, view(spark, sf, "embeddings").count() * 7 // 5)  # some are not stored
    texts = view(spark, sf, "documents").select(F.concat(F.lit("vector "), (F.col("doc_id") % total).cast("string")).alias("text"))
    stored = view(spark, sf, "embeddings").select(
        F.concat(F.lit("vector "), F.col("vec_id").cast("string")).alias("text"), F.md5(F.col("vec_id").cast("string")).alias("hash_id"), "embedding")
    return J.embedding_lookup(texts, stored).select("text", "hash_id", F.round(F.get("embedding", F.lit(0)).cast("double"), 6).alias("first_value"))


@query("nearest_to_one__jn8", EMB + """, d AS (SELECT e.vec_id AS hash_id, round(1 - list_cosine_similarity(q.v, e.v), 9) + 0.0 AS distance FROM e, (SELECT v FROM e WHERE vec_id = 7) q)
SELECT hash_id, round(distance, 6) AS distance, row_number() OVER (ORDER BY d.distance, hash_id) AS rank FROM d QUALIFY rank <= 5""")
def _(spark, sf):
    corpus = view(spark, sf, "embeddings").select(F.col("vec_id").alias("hash_id"), "embedding")
    asked = corpus.where("hash_id = 7").select(F.lit(0).alias("idx"), "embedding")
    return S.top_k(corpus, asked, 5).select("hash_id", F.round("distance", 6).alias("distance"), "rank")


@query("nearest_to_each__jn9", EMB + """, d AS (SELECT q.vec_id AS idx, e.vec_id AS hash_id, round(1 - list_cosine_similarity(q.v, e.v), 9) + 0.0 AS distance FROM e q, e)
SELECT idx, hash_id, round(distance, 6) AS distance, row_number() OVER (PARTITION BY idx ORDER BY d.distance, hash_id) AS rank FROM d QUALIFY rank <= 3""")
def _(spark, sf):
    corpus = view(spark, sf, "embeddings").select(F.col("vec_id").alias("hash_id"), "embedding")
    asked = corpus.withColumnRenamed("hash_id", "idx")
    # Blocks smaller than the table, so that the block-by-block way runs.
    out = S.top_k(corpus, asked, 3, broadcast_queries=256, shard_rows=2048)
    return out.select("idx", "hash_id", F.round("distance", 6).alias("distance"), "rank")


@query("cosine_to_label_mean__fn37", EMB + """, x AS (SELECT label, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM e), m AS (SELECT label, list(a ORDER BY i) AS mean FROM (SELECT label, i, avg(x) AS a FROM x GROUP BY label, i) GROUP BY label)
SELECT vec_id, e.label, round(list_cosine_similarity(e.v, m.mean), 6) + 0.0 AS similarity FROM e JOIN m ON m.label = e.label""")
def _(spark, sf):
    vectors = view(spark, sf, "embeddings")
    means = A.vector_mean(vectors, ["label"], "embedding").select("label", "mean_vector")
    joined = vectors.join(means, "label")
    return joined.select("vec_id", "label", (F.round(V.cosine(F.col("embedding"), F.col("mean_vector")), 6) + 0.0).alias("similarity"))


@query("similar_pairs__jn13", PAIRS + " SELECT id_a, id_b, round(sim, 6) AS similarity FROM pairs")
def _(spark, sf):
    out = S.similar_pairs(view(spark, sf, "embeddings"), THRESHOLD, "vec_id", shard_rows=256, copies=True)
    return out.select("id_a", "id_b", F.round("similarity", 6).alias("similarity"))


@query("described_classes__jn17", EMB + """, q AS (SELECT v FROM e WHERE vec_id < 4)
SELECT e.vec_id, round(max(round(list_cosine_similarity(e.v, q.v), 9)), 6) + 0.0 AS similarity, CASE WHEN max(round(list_cosine_similarity(e.v, q.v), 9)) >= 0.3 THEN 1 ELSE 0 END AS matches FROM e, q GROUP BY e.vec_id""")
def _(spark, sf):
    vectors = view(spark, sf, "embeddings")
    described = [r["embedding"] for r in vectors.where("vec_id < 4").select("embedding").collect()]  # four fixed descriptions
    best = F.round(V.best_similarity(F.col("embedding"), described), 9)
    return vectors.select("vec_id", (F.round(best, 6) + 0.0).alias("similarity"), (best >= THRESHOLD).cast("int").alias("matches"))


def _components(spark, sf):
    vectors = view(spark, sf, "embeddings")
    return G.connected_components(S.similar_links(vectors, THRESHOLD, "vec_id", shard_rows=2048), vectors, id_col="vec_id")


COMPONENTS = PAIRS.replace("WITH e", "WITH RECURSIVE e", 1) + """, both_ways AS (SELECT id_a AS u, id_b AS w FROM pairs UNION SELECT id_b, id_a FROM pairs),
reach AS (SELECT vec_id AS id, vec_id AS other FROM e UNION SELECT r.id, b.w FROM reach r JOIN both_ways b ON b.u = r.other), comp AS (SELECT id AS vec_id, min(other) AS component FROM reach GROUP BY id)"""


@query("similarity_components__gr3", COMPONENTS + " SELECT vec_id, component FROM comp")
def _(spark, sf):
    return _components(spark, sf)


@query("cluster_heads__top4", COMPONENTS + """, imp AS (SELECT c.component, c.vec_id, e.label, e.v[1] AS importance FROM comp c JOIN e ON e.vec_id = c.vec_id),
h AS (SELECT *, row_number() OVER (PARTITION BY component ORDER BY importance DESC, vec_id) AS place FROM imp)
SELECT vec_id, round(importance, 6) AS importance FROM h WHERE place = 1 ORDER BY h.importance DESC, vec_id LIMIT 10""")
def _(spark, sf):
    vectors = view(spark, sf, "embeddings")
    weighted = vectors.select("vec_id", F.get("embedding", F.lit(0)).cast("double").alias("importance"))
    joined = _components(spark, sf).join(weighted, "vec_id")
    heads = joined.groupBy("component").agg(F.max_by(F.struct("vec_id", "importance"), F.struct("importance", -F.col("vec_id"))).alias("h")).select("h.*")
    return K.top_rows(heads, [F.col("importance").desc(), F.col("vec_id")], 10).select("vec_id", F.round("importance", 6).alias("importance"))


@query("leader_clusters__gr4", PAIRS.replace("WITH e", "WITH RECURSIVE e", 1) + """, o AS (SELECT vec_id, 'w' || vec_id AS word, row_number() OVER (ORDER BY md5(CAST(vec_id AS STRING))) AS place FROM embeddings),
b AS (SELECT greatest(x.place, y.place) AS place, list(least(x.place, y.place)) AS befores FROM pairs JOIN o x ON x.vec_id = id_a JOIN o y ON y.vec_id = id_b GROUP BY 1),
step(place, leads) AS (SELECT 0::BIGINT, []::BIGINT[] UNION ALL SELECT step.place + 1, CASE WHEN list_has_any(leads, coalesce(befores, []::BIGINT[])) THEN leads ELSE list_append(leads, step.place + 1) END
FROM step LEFT JOIN b ON b.place = step.place + 1 WHERE step.place < (SELECT count(*) FROM o)),
l AS (SELECT leads FROM step ORDER BY place DESC LIMIT 1), f AS (SELECT o.*, coalesce(list_min(list_intersect(leads, coalesce(befores, []::BIGINT[]))), o.place) AS leader FROM o CROSS JOIN l LEFT JOIN b ON b.place = o.place),
r AS (SELECT leader, arg_min(word, length(word) * 100000000 + vec_id) AS representative FROM f GROUP BY leader) SELECT word, representative FROM f JOIN r USING (leader)""")
def _(spark, sf):
    vectors = view(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.concat(F.lit("w"), F.col("vec_id").cast("string")).alias("word"), "embedding")
    vectors = vectors.withColumn("turn", G.free_order(F.col("id")))
    leaders = S.similar_leaders(vectors, THRESHOLD, "id", order="turn")
    return G.representatives(vectors.drop("embedding"), leaders, "word")


@query("new_text_hashes__jn12_fn2", """WITH ex AS (SELECT vec_id, label FROM embeddings), docs AS (SELECT unnest(string_split(text, chr(10))) AS piece FROM documents), h AS (SELECT DISTINCT 'entity-' || md5(trim(piece)) AS hash_id, trim(piece) AS text FROM docs WHERE trim(piece) <> ''),
known AS (SELECT DISTINCT 'entity-' || md5(trim(x)) AS hash_id FROM (SELECT unnest(string_split(text, chr(10))) AS x FROM benchmark)) SELECT h.hash_id, length(h.text) AS n FROM h WHERE h.hash_id NOT IN (SELECT hash_id FROM known)""")
def _(spark, sf):
    piece = lambda t: t.select(F.explode(F.split("text", "\n")).alias("piece")).select(F.trim("piece").alias("text")).where("text <> ''")
    hashed = lambda t: piece(t).withColumn("hash_id", TX.content_hash(F.col("text"), "entity"))
    fresh = hashed(view(spark, sf, "documents")).dropDuplicates(["hash_id"])
    return fresh.join(hashed(view(spark, sf, "benchmark")).select("hash_id").distinct(), "hash_id", "left_anti").select(
        "hash_id", F.length("text").cast("long").alias("n"))


NAME_THRESHOLD = 0.65


@query("similar_names__gr6_jn13", with_views("names") + f""", t AS (SELECT text, row_number() OVER (ORDER BY text) AS id FROM (SELECT entity AS text FROM names UNION SELECT p_name FROM part UNION SELECT n_name FROM nation) x WHERE text IS NOT NULL),
g AS (SELECT id, gram, count(*) AS n FROM (SELECT id, unnest(list_transform(range(1, greatest(length(text), 1) + 1), lambda i: substring(' ' || text || ' ', i, 3))) AS gram FROM t) x GROUP BY id, gram),
z AS (SELECT id, sum(n * n) AS size FROM g GROUP BY id), d AS (SELECT a.id AS ia, b.id AS ib, sum(a.n * b.n) AS dot FROM g a JOIN g b ON a.gram = b.gram AND a.id < b.id GROUP BY a.id, b.id)
SELECT x.text AS id_a, y.text AS id_b, round(dot / sqrt(CAST(p.size * q.size AS DOUBLE)), 6) AS similarity FROM d JOIN z p ON p.id = ia JOIN z q ON q.id = ib JOIN t x ON x.id = ia JOIN t y ON y.id = ib
WHERE round(dot / sqrt(CAST(p.size * q.size AS DOUBLE)), 9) >= {NAME_THRESHOLD}""")
def _(spark, sf):
    names = view(spark, sf, "names").select(F.col("entity").alias("text")).unionByName(
        view(spark, sf, "part").select(F.col("p_name").alias("text"))).unionByName(view(spark, sf, "nation").select(F.col("n_name").alias("text")))
    return S.similar_texts(names, NAME_THRESHOLD, "text").select("id_a", "id_b", F.round("similarity", 6).alias("similarity"))
