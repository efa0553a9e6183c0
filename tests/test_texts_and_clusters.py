"""Similar short texts, leader clusters in free order and evidence of the agent log."""

import itertools
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from furrow.functions import reports as R
from furrow.operators import graph as G
from furrow.operators import similarity as SIM
from furrow.plans import keywords as KW


def _gram_cosine(a, b, n=3):
    grams = lambda t: Counter(f" {t} "[i:i + n] for i in range(max(1, len(t) + 2 - n + 1)))
    x, y = grams(a), grams(b)
    return round(sum(c * y[g] for g, c in x.items()) / math.sqrt(sum(c * c for c in x.values()) * sum(c * c for c in y.values())), 9)


@pytest.mark.parametrize("hot", [4, 2048])
def test_similar_texts_equal_all_pairs(spark, hot):
    rng = random.Random(4)
    names = {"".join(rng.choices("abc", k=rng.randint(0, 9))) for _ in range(90)} | {"corn", "corn price", "corn prices", "price of corn", "수출", "수출 제한", ""}
    rows = [(t,) for t in [*names, *list(names)[:20], None]]
    got = SIM.similar_texts(spark.createDataFrame(rows, "t string").repartition(3), 0.65, "t", hot=hot).collect()
    expected = {(a, b): _gram_cosine(a, b) for a in names for b in names if a < b and _gram_cosine(a, b) >= 0.65}
    assert len(expected) > 20 and {(r.id_a, r.id_b): r.similarity for r in got} == expected and len(got) == len(expected)
    assert SIM.similar_texts(spark.createDataFrame([], "t string"), 0.65, "t").count() == 0


def test_unrelated_names_stay_apart(spark):
    """Far more one-word names than a hashed encoder has slots."""
    rng = random.Random(6)
    names = sorted({"".join(rng.choices("bcdfghjklmnpqrstvwxz", k=9)) for _ in range(20_000)})
    rows = [(n,) for n in [*names, names[0] + "s"]]
    got = SIM.similar_texts(spark.createDataFrame(rows, "t string").repartition(4), 0.65, "t")
    assert [(r.id_a, r.id_b) for r in got.collect() if r.similarity > 0.8] == [(names[0], names[0] + "s")]
    assert got.count() < 20


def test_leaders_of_a_long_chain_in_free_order(spark):
    n = 2000
    items = spark.range(n).select("id", G.free_order(F.col("id")).alias("turn"))
    pairs = spark.range(n - 1).select(F.col("id").alias("id_a"), (F.col("id") + 1).alias("id_b"))
    got = {r.id: r.leader for r in G.cluster_leaders(items, pairs, order="turn").collect()}
    turn = {r.id: r.turn for r in items.collect()}
    expected = {}
    for i in sorted(turn, key=turn.get):
        before = [j for j in (i - 1, i + 1) if j in expected and expected[j] == j]
        expected[i] = min(before, key=turn.get) if before else i
    assert got == expected


def test_evidence_rows_of_odd_results(spark):
    tool = "news_sentiment_analyzer"
    long_text = "x" * 300
    rows = [(1, 1, tool, '{"evidence_news": [{"title": "a", "all_text": "%s", "price_impact_score": -0.4}, {}, null]}' % long_text),
            (2, 1, tool, '{"error": null, "evidence_news": [{"title": "b"}]}'), (3, 1, tool, "{broken"), (4, 1, tool, None), (5, 1, tool, "[]"),
            (6, 1, tool, '{"evidence_news": []}'), (7, 1, "decision_meta", '{"evidence_news": [{"title": "c"}]}'),
            (8, 2, tool, '{"evidence_news": [{"title": "d", "price_impact_score": 2}]}'), (9, 1, tool, "{}")]
    got = R.evidence_rows(spark.createDataFrame(rows, "conv_id long, turn long, name string, text string")).collect()
    assert sorted(map(tuple, got)) == [
        (1, 1, 0, f"[a] {'x' * 200}...", "negative", 0.1, 0.4, 0.5), (1, 1, 1, "[제목없음] ...", "neutral", 0.1, 0.1, 0.5),
        (8, 2, 0, "[d] ...", "positive", 2.0, 0.1, 0.5)]


@pytest.mark.parametrize("depth, longest, hot", [(2, 2, 3), (3, 12, 4096), (3, 3, 5)])
def test_sparse_pairs_equal_all_pairs(spark, depth, longest, hot):
    rng = np.random.default_rng(depth)
    bags = [(k, i, sorted(rng.choice(9, rng.integers(1, 6), replace=False).tolist())) for k in "ab" for i in range(60)]
    rows = [(k, f"{k}{i}", terms, [float(rng.integers(1, 4)) for _ in terms]) for k, i, terms in bags]
    df = spark.createDataFrame(rows, "key STRING, id STRING, terms ARRAY<BIGINT>, weights ARRAY<DOUBLE>").withColumn(
        "size", F.expr("aggregate(weights, 0D, (t, x) -> t + x * x)")).repartition(3)
    want = set()
    for (k, a, s, v), (j, b, t, w) in itertools.combinations(rows, 2):
        x, y = dict(zip(s, v)), dict(zip(t, w))
        dot = sum(n * y.get(i, 0) for i, n in x.items())
        if k == j and round(dot / math.sqrt(sum(n * n for n in v) * sum(n * n for n in w)), 9) >= 0.68:
            want.add((k, *sorted((a, b))))
    got = [(r.key, *sorted((r.id_a, r.id_b))) for r in SIM.sparse_pairs(df, 0.68, depth, longest, hot=hot).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    links = [(r.id_a, r.id_b) for r in SIM.sparse_pairs(df, 0.68, depth, longest, forest=True, hot=hot).collect()]

    def groups(pairs):
        of = {r[1]: r[1] for r in rows}
        for a, b in [*pairs] * 60:
            of[a] = of[b] = min(of[a], of[b])
        return of

    assert groups(links) == groups([(a, b) for _, a, b in want]) and len(links) <= len(want)


def test_triples_meet_in_their_words(spark):
    number = lambda n: F.col("id") * n % 40
    texts = spark.range(400).select(F.lit("c").alias("commodity"), F.col("id").cast("string").alias("id"),
                                    F.format_string("['a%d', 'b%d c', 'd%d']", number(7), number(11), number(F.col("id"))).alias("triple_text"))
    found = KW._similar_triples(texts, None, 0.68)
    assert "_bucket" in found._jdf.queryExecution().optimizedPlan().toString()  # not every shard with every shard
    links = SIM.similar_links(KW.default_encoder(texts, "triple_text"), 0.68, "id")
    got, want = ({r.id: r.component for r in G.connected_components(e, texts).collect()} for e in (found, links))
    assert got == want and 1 < len(set(got.values())) < 400
