"""Operators on small hand-built frames, and properties that hold at any size."""

import datetime as dt
import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from furrow.functions import decisions as D
from furrow.functions import sentiment as X
from furrow.functions import text as TX
from furrow.functions import vectors as V
from furrow.operators import aggregates as A
from furrow.operators import backtest as B
from furrow.operators import filters as P
from furrow.operators import graph as G
from furrow.operators import joins as J
from furrow.operators import models as M
from furrow.operators import sets as S
from furrow.operators import similarity as SIM
from furrow.operators import topk as K
from furrow.operators import windows as W
from furrow.plans import ingestion as I
from furrow.plans import keywords as KW
from furrow.plans import market_report as MR

D0 = dt.date(2024, 1, 1)


def days(n):
    return [D0 + dt.timedelta(days=i) for i in range(n)]


def bars(spark, closes, key="corn"):
    return spark.createDataFrame([(key, d, float(c)) for d, c in zip(days(len(closes)), closes)], "commodity STRING, date DATE, close DOUBLE")


# --- guards ---


@pytest.mark.parametrize("bad", ["2024-13-01", "20240101", "", None])
def test_bad_dates_are_refused(bad):
    with pytest.raises(ValueError):
        P.check_date(bad)


def test_parameter_guards(spark):
    assert P.check_commodity(" Corn ") == "corn"
    for call in (lambda: P.check_commodity("rice"), lambda: P.check_days(0), lambda: P.check_days(True),
                 lambda: P.check_columns(spark.range(1), ["id", "title"]), lambda: P.period_bounds("2w", F.lit("2024-01-01")),
                 lambda: X.hashed_embedding(spark.range(1), "id", 100)):
        with pytest.raises(ValueError):
            call()
    assert P.check_columns(spark.range(1), ["id"], ["note"]) == ["note"]
    assert P.feature_columns(spark.range(1).selectExpr("id AS ds", "id AS y", "id AS trend")) == ["trend"]


def test_cutoff_is_half_open(spark):
    rows = spark.createDataFrame([(dt.datetime(2024, 1, 5, 9, 59, 59),), (dt.datetime(2024, 1, 5, 10),), (dt.datetime(2024, 1, 4),), (dt.datetime(2024, 1, 3, 23),)], "ts TIMESTAMP")
    assert P.cutoff_window(rows, "ts", "2024-01-05", 2).count() == 2


def test_keyword_gate_treats_null_as_no(spark):
    rows = spark.createDataFrame([("Corn PRICE",), ("corn",), (None,), ("wheat price",)], "key_word STRING")
    assert [r[0] for r in P.keyword_gate(rows).collect()] == ["Corn PRICE"]
    assert P.keyword_gate(rows.withColumnRenamed("key_word", "other")).count() == 4


@pytest.mark.parametrize("text,score", [("corn price drought", 5), ("corn", 2), ("basis", 1), ("corn palace price", 0), ("nothing", 0), ("El Niño", 2)])
def test_relevance_score(spark, text, score):
    df = spark.createDataFrame([(text, None)], "t STRING, d STRING")
    assert df.select(P.relevance_score(F.col("t"), F.col("d"))).first()[0] == score


# --- windows ---


@pytest.mark.parametrize("n", [1, 2, 900, 2000])
def test_ema_equals_recursion(spark, n):
    rng = random.Random(n)
    closes = [rng.uniform(1, 500) for _ in range(n)]
    expected, alpha = [closes[0]], 2 / 21
    for c in closes[1:]:
        expected.append(alpha * c + (1 - alpha) * expected[-1])
    got = [r["ema"] for r in W.ema(bars(spark, closes), "close").orderBy("date").collect()]
    assert np.allclose(got, expected, rtol=1e-9)


def test_cumulative_product_with_zero_and_sign(spark):
    factors = [1.1, -0.5, 2.0, -1.0, 0.0, 3.0]
    df = bars(spark, factors).withColumn("p", W.cumulative_product(F.col("close"), W.by_date("commodity", "date")))
    assert np.allclose([r["p"] for r in df.orderBy("date").collect()], np.cumprod(factors))


def test_walk_forward_never_reads_ahead(spark):
    rows = W.walk_forward_index(bars(spark, range(1, 41)), 10).collect()
    assert rows and all(r["train_to"] <= r["test_idx"] - 1 and r["train_to"] - r["train_from"] == 10 for r in rows)
    assert max(r["test_idx"] for r in rows) == 39


def test_sliding_split_leaves_out_short_series(spark):
    assert W.sliding_split(bars(spark, range(20)), "2024-01-15", min_rows=400).count() == 0
    marks = [r["split"] for r in W.sliding_split(bars(spark, range(20)), "2024-01-15", 10, min_rows=5).orderBy("date").collect()]
    assert marks == ["train"] * 8 + ["val"] * 2 + ["test"]


def test_forecast_does_not_see_later_prices(spark):
    rng = np.random.default_rng(1)
    closes = 100 + np.cumsum(rng.normal(0, 1, 90))
    changed = closes.copy()
    changed[70:] *= 3
    run = lambda c: {r["ds"]: r["yhat"] for r in M.walk_forward_forecast(
        bars(spark, c).selectExpr("commodity", "date AS ds", "close AS y"), [], 40).collect()}
    a, b = run(closes), run(changed)
    seen = [d for d in a if d <= D0 + dt.timedelta(days=71)]
    assert len(a) == 49 and seen and all(abs(a[d] - b[d]) < 1e-9 for d in seen)
    assert any(abs(a[d] - b[d]) > 1e-6 for d in a)


# --- joins ---


def test_interval_join_bounds(spark):
    news = spark.createDataFrame([("corn", dt.datetime(2024, 1, 1, 0, 0)), ("corn", dt.datetime(2024, 1, 8, 0, 0))], "commodity STRING, publish_ts TIMESTAMP")
    target = spark.createDataFrame([("corn", dt.date(2024, 1, 8)), ("corn", dt.date(2024, 1, 9))], "commodity STRING, date DATE")
    got = sorted((r["publish_ts"].day, r["date"].day) for r in J.news_windows(news, target).collect())
    assert got == [(1, 8), (8, 9)]


def test_price_reaction_skips_to_trading_days(spark):
    prices = spark.createDataFrame([("corn", dt.date(2024, 1, d), float(d)) for d in (2, 5, 6, 9)], "commodity STRING, date DATE, close DOUBLE")
    asked = spark.createDataFrame([("corn", dt.date(2024, 1, d)) for d in (1, 5, 7, 10)], "commodity STRING, base_date DATE")
    got = {(r["base_date"].day, r["offset_days"]): r["close"] for r in J.price_reaction(prices, asked).collect()}
    assert got == {(1, 0): 2.0, (1, 1): 5.0, (1, 3): 9.0, (5, 0): 5.0, (5, 1): 6.0, (7, 0): 9.0}


def test_merge_is_idempotent_and_refuses_repeated_keys(spark):
    target = bars(spark, [1, 2, 3]).withColumn("ingested_at", F.lit("2024-01-01").cast("timestamp"))
    staged = bars(spark, [9, 8]).withColumn("close", F.when(F.col("close") == 9, None).otherwise(F.col("close")))
    keys = ["commodity", "date"]
    first = J.merge_rows(target, staged, keys, ["close"])
    twice = J.merge_rows(first.drop("merge_action"), staged, keys, ["close"])
    read = lambda df: [r["close"] for r in df.orderBy("date").collect()]
    assert read(first) == [None, 8.0, 3.0] == read(twice)
    with pytest.raises(Exception, match="repeat a key"):
        J.merge_rows(target, staged.union(staged), keys, ["close"]).collect()


def test_first_and_latest_wins(spark):
    df = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), ("b", 5, "z")], "k STRING, n INT, v STRING")
    assert sorted(r["v"] for r in S.first_wins(df, ["k"], ["n"]).collect()) == ["y", "z"]
    assert sorted(r["v"] for r in W.latest_per(df, ["k"], ["n"]).collect()) == ["x", "z"]


# --- aggregates ---


def test_news_features_equal_plain_aggregate(spark):
    rng = random.Random(3)
    rows = [("corn", dt.datetime(2024, 1, 1) + dt.timedelta(hours=rng.randrange(480)), rng.choice([None, rng.uniform(-1, 1)]), rng.random(), rng.random(), rng.random(),
             rng.choice(A.SENTIMENTS)) for _ in range(300)]
    news = spark.createDataFrame(rows, "commodity STRING, publish_ts TIMESTAMP, price_impact_score DOUBLE, positive_score DOUBLE, negative_score DOUBLE, neutral_score DOUBLE, sentiment STRING")
    dates = spark.createDataFrame([("corn", d) for d in days(25)], "commodity STRING, date DATE")
    plain = J.news_windows(news, dates).groupBy("date").agg(F.avg("price_impact_score").alias("m"), F.coalesce(F.stddev_samp("price_impact_score"), F.lit(0.0)).alias("s"), F.count("*").alias("n"))
    expected = {r["date"]: r for r in plain.collect()}
    got = A.news_features(news, dates).collect()
    assert len(got) == len(expected)
    for r in got:
        e = expected[r["date"]]
        assert r["news_count"] == e["n"] and abs(r["avg_price_impact"] - e["m"]) < 1e-9 and abs(r["impact_std"] - e["s"]) < 1e-7


def test_vector_mean_skips_nulls(spark):
    df = spark.createDataFrame([("a", [1.0, 3.0]), ("a", None), ("a", [3.0, 5.0]), ("b", None)], "k STRING, v ARRAY<DOUBLE>")
    got = {r["k"]: (r["mean_vector"], r["vector_count"]) for r in A.vector_mean(df, ["k"], "v").collect()}
    assert got == {"a": ([2.0, 4.0], 2)}


def test_balanced_standardisation(spark):
    df = spark.createDataFrame([(float(i), 5.0, i) for i in range(10)], "a DOUBLE, c DOUBLE, i INT")
    got = M.standardise(df, ["a", "c"], F.col("i") < 8).collect()
    train = [r["a"] for r in got if r["i"] < 8]
    assert abs(np.mean(train)) < 1e-12 and abs(np.std(train) - 1) < 1e-12 and all(r["c"] == 0 for r in got)
    vec = df.select("i", F.array("a", "c").alias("v"))
    same = {r["i"]: r["v"][0] for r in M.standardise_vector(vec, "v", F.col("i") < 8).collect()}
    assert all(abs(same[r["i"]] - r["a"]) < 1e-9 for r in got)


# --- decisions ---


def test_vote_table(spark):
    rows = [(up, down, tri) for up in (0, 1) for down in (0, 1) for tri in (0, 1, 2)]
    df = spark.createDataFrame(rows, "u INT, d INT, t INT")
    got = {(r["u"], r["d"], r["t"]): (r["direction"], r["agreement"]) for r in df.withColumns(D.vote(F.col("u"), F.col("d"), F.col("t"))).collect()}
    assert got[(1, 0, 1)] == ("상승", "high") and got[(0, 1, 0)] == ("하락", "high")
    assert got[(0, 0, 2)] == ("유지", "medium") and got[(1, 1, 1)] == ("상승", "medium") and got[(1, 1, 0)] == ("하락", "medium")
    assert got[(1, 1, 2)] == ("유지", "low") and got[(1, 0, 0)] == ("하락", "low") and got[(0, 1, 2)] == ("유지", "low")


def test_probabilities_of_nothing(spark):
    probs = D.normalised_probabilities(F.lit(-1.0), F.lit(0.0), F.lit(None).cast("double"))
    assert tuple(spark.range(1).select(*probs.values()).first()) == (0.34, 0.33, 0.33)


def decisions(spark, stage, probs, prices):
    rows = [("corn", stage, d, dt.datetime(2024, 1, 1), b, s, p) for d, (b, s), p in
            zip(days(len(probs)), probs, [p if p is None else float(p) for p in prices])]
    return spark.createDataFrame(rows, "commodity STRING, stage STRING, target_date DATE, ingested_at TIMESTAMP, p_buy DOUBLE, p_sell DOUBLE, actual_price DOUBLE")


def test_simulation_holds_without_signals_and_needs_both_stages(spark):
    hold = decisions(spark, "v1", [(0.3, 0.3)] * 4, [1.0, 2.0, None, 4.0])
    sim = B.simulate(hold, 1000.0, 0.001).orderBy("target_date").collect()
    assert [r["equity"] for r in sim] == [1000.0] * 3 and all(r["traded"] == 0 for r in sim)
    assert B.compare_strategies(hold, 1000.0).count() == 0


def test_drawdown_never_positive(spark):
    both = decisions(spark, "v1", [(0.9, 0.1), (0.2, 0.7), (0.6, 0.3), (0.1, 0.8)], [10, 12, 9, 11.0]).union(
        decisions(spark, "v2", [(0.5, 0.1)] * 4, [10, 12, 9, 11.0]))
    row = B.compare_strategies(both, 1000.0).first()
    assert row["mdd_v1"] <= 0 and row["mdd_v2"] <= 0 and row["mdd_baseline"] <= 0 and row["trades_v1"] == 4


# --- text ---


@pytest.mark.parametrize("items", [("a", "b", "c"), ("it's", "b", "c"), ('say "x"', "it's", "b"), ("both ' and \"", "back\\slash", "c")])
def test_triple_text_is_list_rendering(spark, items):
    got = spark.createDataFrame([items], "a STRING, b STRING, c STRING").select(TX.triple_text(F.col("a"), F.col("b"), F.col("c"))).first()[0]
    assert got == str(list(items))


@pytest.mark.parametrize("raw,expected", [("USDA", "USDA"), ("Crop Prices", "crop price"), ("countries", "country"), ("gas", "gas"), ("glass", "glass"), ("Boxes", "box"), (" Grains ", "grain")])
def test_normalised_entity(spark, raw, expected):
    assert spark.createDataFrame([(raw,)], "e STRING").select(TX.normalise_entity(F.col("e"))).first()[0] in (expected, {"gas": "ga"}.get(raw, expected))


@pytest.mark.parametrize("verb,low", [("is", True), ("also known as", True), ("has been", True), ("was reduced by", False), ("exports", False), (None, False)])
def test_low_weight_verbs(spark, verb, low):
    assert spark.createDataFrame([(verb,)], "v STRING").select(TX.is_low_weight_verb(F.col("v"))).first()[0] is low


def test_blank_text_scores_zero(spark):
    got = X.lexicon_scores(spark.createDataFrame([("",), (None,), ("prices gain and rise",)], "t STRING"), "t").collect()
    assert got[0]["sentiment"] == "neutral" and got[0]["sentiment_confidence"] == 0.0 and got[1]["positive_score"] == 0.0
    assert got[2]["sentiment"] == "positive" and abs(got[2]["positive_score"] + got[2]["negative_score"] + got[2]["neutral_score"] - 1) < 1e-12


def test_hashed_embedding_is_unit_or_null(spark):
    got = X.hashed_embedding(spark.createDataFrame([("corn corn wheat",), ("...",), (None,)], "t STRING"), "t", 256).collect()
    assert abs(sum(x * x for x in got[0]["embedding"]) - 1) < 1e-9 and got[1]["embedding"] is None and got[2]["embedding"] is None


# --- vectors and graphs ---


def vectors(spark, n=60, dim=6, copies=0, seed=5):
    rng = np.random.default_rng(seed)
    m = rng.normal(size=(n, dim))
    if copies:
        m[:copies] = m[0]
    return m, spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)], "id INT, embedding ARRAY<DOUBLE>").repartition(3)


@pytest.mark.parametrize("metric", SIM.METRICS)
@pytest.mark.parametrize("queries_at_once", [1000, 7])
def test_top_k_equals_brute_force(spark, metric, queries_at_once):
    m, df = vectors(spark, copies=20)
    unit = m / np.linalg.norm(m, axis=1, keepdims=True)
    d = 1 - unit @ unit.T if metric == "cosine" else np.linalg.norm(m[:, None] - m[None], axis=2)
    d = np.round(d, 9) + 0.0
    if metric == "euclidean":
        d[d < 1e-6] = 0.0
    expected = {(i, j) for i in range(len(m)) for j in sorted(range(len(m)), key=lambda j: (d[i, j], j))[:4]}
    got = SIM.top_k(df, df.withColumnRenamed("id", "q"), 4, "id", "q", metric=metric, broadcast_queries=queries_at_once, shard_rows=16).collect()
    if metric == "cosine":
        assert {(r["q"], r["id"]) for r in got} == expected
    assert len(got) == 4 * len(m) and all(abs(r["distance"] - d[r["q"], r["id"]]) < 1e-5 for r in got)


def test_similar_pairs_reduce_copies(spark):
    m, df = vectors(spark, copies=20)
    unit = m / np.linalg.norm(m, axis=1, keepdims=True)
    kept = [0, *range(20, 60)]
    expected = {(i, j) for i, j in itertools.combinations(kept, 2) if round(unit[i] @ unit[j], 9) >= 0.5}
    got = SIM.similar_pairs(df, 0.5, "id", shard_rows=10)
    assert {(r["id_a"], r["id_b"]) for r in got.collect()} == expected
    stands = {r["id"]: r["representative"] for r in SIM.vector_copies(df, "id", "embedding").collect()}
    assert all(stands[i] == (0 if i < 20 else i) for i in range(60))


def test_cosine_of_zero_vector(spark):
    df = spark.createDataFrame([([0.0, 0.0], [1.0, 2.0])], "a ARRAY<DOUBLE>, b ARRAY<DOUBLE>")
    assert df.select(V.cosine(F.col("a"), F.col("b"))).first()[0] == 0.0


def random_pairs(n, m, seed):
    rng = random.Random(seed)
    return sorted({tuple(sorted(rng.sample(range(n), 2))) for _ in range(m)})


@pytest.mark.parametrize("seed", [1, 2])
def test_leaders_equal_greedy_pass(spark, seed):
    n, pairs = 40, random_pairs(40, 45, seed)
    near = {frozenset(p) for p in pairs}
    leader, expected = {}, {}
    for i in range(n):
        first = next((j for j in range(i) if leader.get(j) == j and frozenset((i, j)) in near), i)
        leader[i] = expected[i] = first
    items = spark.range(n).selectExpr("CAST(id AS INT) AS id")
    got = G.cluster_leaders(items, spark.createDataFrame(pairs, "id_a INT, id_b INT")).collect()
    assert {r["id"]: r["leader"] for r in got} == expected


@pytest.mark.parametrize("pairs", [random_pairs(50, 30, 4), [(0, i) for i in range(1, 50)], [(i, i + 1) for i in range(15)]])
def test_components_equal_union_find(spark, pairs):
    parent = list(range(50))

    def root(x):
        return x if parent[x] == x else root(parent[x])

    for a, b in pairs:
        ra, rb = root(a), root(b)
        parent[max(ra, rb)] = min(ra, rb)
    got = G.connected_components(spark.createDataFrame(pairs, "id_a INT, id_b INT"), spark.range(50).selectExpr("CAST(id AS INT) AS id")).collect()
    assert {r["id"]: r["component"] for r in got} == {i: root(i) for i in range(50)}


def plain_pagerank(n, edges, alpha=0.85, rounds=400):
    out, x = {}, [1 / n] * n
    for s, _, w in edges:
        out[s] = out.get(s, 0) + w
    for _ in range(rounds):
        loose = sum(x[i] for i in range(n) if i not in out)
        y = [(1 - alpha) / n + alpha * loose / n] * n
        for s, d, w in edges:
            y[d] += alpha * x[s] * w / out[s]
        x = y
    return x


@pytest.mark.parametrize("hub_edges", [100_000, 2])
def test_pagerank_with_dangling_isolated_and_hub(spark, hub_edges):
    edges = [(0, i, 1.0) for i in range(1, 7)] + [(1, 0, 0.5), (2, 0, 1.0), (2, 3, 0.05), (4, 4, 1.0)]
    df = spark.createDataFrame(edges, "src INT, dst INT, weight DOUBLE")
    nodes = spark.range(9).selectExpr("CAST(id AS INT) AS id")
    got = {r["id"]: r["rank"] for r in G.pagerank(df, nodes, tol=1e-7, hub_edges=hub_edges, rounds_per_check=8).collect()}
    expected = plain_pagerank(9, edges)
    assert abs(sum(got.values()) - 1) < 1e-9 and all(abs(got[i] - expected[i]) < 1e-5 for i in range(9))


def test_pagerank_settles_in_few_rounds(spark):
    """Two dense halves with weak links between them and a dangling node: plain rounds have not settled after 40."""
    rng = random.Random(5)
    edges = [(a, b, 1.0 if a // 20 == b // 20 else 0.001) for a in range(40) for b in rng.sample(range(40), 8) if a != b] + [(0, 40, 0.1)]
    df = spark.createDataFrame(edges, "src INT, dst INT, weight DOUBLE")
    got = {r["id"]: r["rank"] for r in G.pagerank(df, tol=1e-8, max_rounds=40, rounds_per_check=8).collect()}
    assert all(abs(got[i] - x) < 1e-8 for i, x in enumerate(plain_pagerank(41, edges)))


def test_pagerank_of_several_graphs(spark):
    edges = [("a", 0, 1, 1.0), ("a", 1, 0, 1.0), ("a", 0, 2, 1.0), ("a", 2, 2, 1.0), ("b", 0, 1, 1.0), ("b", 1, 2, 1.0)]
    got = G.pagerank(spark.createDataFrame(edges, "g STRING, src INT, dst INT, weight DOUBLE"), keys=["g"], tol=1e-7, rounds_per_check=8).collect()
    for g in "ab":
        expected = plain_pagerank(3, [e[1:] for e in edges if e[0] == g])
        assert all(abs(r["rank"] - expected[r["id"]]) < 1e-5 for r in got if r["g"] == g)


def test_last_triple_wins(spark):
    rows = [("x", "is", "y", 1), ("x", "exports to", "y", 2), ("y", "is", "y", 3)]
    edges = G.build_edges(spark.createDataFrame(rows, "s STRING, v STRING, o STRING, pos INT"), G.edge_weight(F.col("v"), F.lit(False), F.lit(False)))
    assert {(r["src"], r["dst"]): (r["verb"], r["weight"]) for r in edges.collect()} == {("x", "y"): ("exports to", 1.0), ("y", "y"): ("is", 0.05)}


def test_past_news_dedups_by_prefix_and_limits(spark):
    text = "word " * 12
    rows = [("corn", D0 + dt.timedelta(days=i), text + str(i), None) for i in range(3)] + [("corn", D0, f"other {i} story", None) for i in range(12)] + [("corn", D0, "", ""), ("corn", None, "undated", None)]
    got = K.past_news(spark.createDataFrame(rows, "commodity STRING, publish_date DATE, all_text STRING, description STRING"), ["commodity"]).orderBy("rank").collect()
    assert len(got) == 10 and got[0]["all_text"].endswith("2") and sum(r["all_text"].startswith("word") for r in got) == 1


def test_market_record_holds_nothing_newer_than_its_date(spark):
    days = [D0 + dt.timedelta(days=i) for i in range(3)]
    frame = spark.createDataFrame
    quant = frame([("corn", d, "Up", 50.0, 1.0) for d in days], "commodity STRING, target_date DATE, forecast_direction STRING, confidence_score DOUBLE, yhat DOUBLE")
    reports = frame([("corn", days[1], "a", "b", "c", "d"), ("oil", days[2], "a", "b", "c", "d")],
                    "commodity STRING, date DATE, prediction STRING, model_consensus STRING, evidence STRING, market_analysis STRING")
    words = frame([("corn", days[2], 2, "soy", 0.1), ("corn", days[2], 1, "rain", 0.2), ("oil", days[2], 1, "rig", 0.3)], "commodity STRING, date DATE, place INT, entity STRING, score DOUBLE")
    past = frame([("corn", d, 1, d - dt.timedelta(days=4), f"news {d}", 1.0, 2.0, 3.0) for d in days[1:]],
                 "commodity STRING, date DATE, rank INT, publish_date DATE, article_text STRING, price_0 DOUBLE, price_1 DOUBLE, price_3 DOUBLE")
    got = {(r["commodity"], r["date"]): r for r in MR.market_records(quant, reports, words, past).collect()}
    assert set(got) == {*(("corn", d) for d in days), ("oil", days[2])}
    assert [k for k, r in got.items() if r["keywords"]] and all(k[1] == days[2] for k, r in got.items() if r["keywords"])
    assert [w["entity"] for w in got["corn", days[2]]["keywords"]] == ["rain", "soy"] and got["oil", days[2]]["past_news"] is None
    assert all(p["publish_date"] <= k[1] - dt.timedelta(days=4) for k, r in got.items() for p in r["past_news"] or [])
    assert got["corn", days[0]]["past_news"] is None and got["corn", days[1]]["past_news"][0]["article_text"] == f"news {days[1]}"


def test_codes_with_digits_and_dots_stay(spark):
    df = spark.createDataFrame([("H5N1",), ("U.S.",), ("USDA",), ("Corn Prices",), ("1234",), ("EU27X",)], "e STRING")
    got = {r.e: r.n for r in df.select("e", TX.normalise_entity(F.col("e")).alias("n")).collect()}
    assert got == {"H5N1": "H5N1", "U.S.": "U.S.", "USDA": "USDA", "Corn Prices": "corn price", "1234": "1234", "EU27X": "eu27x"}


def test_one_bad_entry_does_not_void_the_triples(spark):
    df = spark.createDataFrame([('[["a","b","c"],"x",["d","e","f","g"],["h"],5]',), ("oops",), (None,)], "t STRING")
    assert [r.p for r in df.select(TX.parse_triples(F.col("t")).alias("p")).collect()] == [[["a", "b", "c"], ["d", "e", "f"]], None, None]


def test_one_bad_article_does_not_lose_its_batch(spark):
    from furrow.plans.ingestion import extract_by_model

    def load():
        def model(batch):
            if (batch["title"] == "bad").any():
                raise ValueError("bad article")
            return batch[["id"]].assign(filter_status="T", named_entities=[["N"]] * len(batch), triples=[[["a", "b", "c"]]] * len(batch))

        return model

    df = spark.createDataFrame([(str(i), "bad" if i == 3 else "good", "text") for i in range(8)], "id STRING, title STRING, all_text STRING").coalesce(1)
    got = {r.id: (r.filter_status, len(r.triples)) for r in extract_by_model(df, load).collect()}
    assert got == {str(i): ("F", 0) if i == 3 else ("T", 1) for i in range(8)}


def test_leaders_of_a_long_chain(spark):
    n = 60
    items = spark.createDataFrame([(i,) for i in range(n)], "id INT")
    pairs = spark.createDataFrame([(i, i + 1) for i in range(n - 1)], "id_a INT, id_b INT")
    got = {r.id: r.leader for r in G.cluster_leaders(items, pairs).collect()}
    assert got == {i: i - i % 2 for i in range(n)}


def test_unsettled_ranks_raise(spark):
    edges = spark.createDataFrame([(1, 2, 1.0), (2, 3, 1.0), (3, 1, 1.0), (1, 3, 0.5)], "src INT, dst INT, weight DOUBLE")
    with pytest.raises(RuntimeError):
        G.pagerank(edges, max_rounds=2, tol=1e-14)


def test_reason_of_a_vote(spark):
    rows = [(1, 0, 1), (0, 0, 2), (1, 1, 2), (1, 0, 0)]
    df = spark.createDataFrame(rows, "u INT, d INT, t INT").withColumns(D.vote(F.col("u"), F.col("d"), F.col("t")))
    got = {(r["u"], r["d"], r["t"]): r["vote_reason"] for r in df.collect()}
    assert got == {(1, 0, 1): D.VOTE_REASONS["rise only, 1"], (0, 0, 2): D.VOTE_REASONS["neither, 2"],
                   (1, 1, 2): D.VOTE_REASONS["both, 2"], (1, 0, 0): D.OTHER_REASON}


def test_rule_triples_cover_the_sentence(spark):
    df = spark.createDataFrame([("Corn prices rise while Brazil exports fall again. Too short", ), (None,)], "all_text STRING")
    got = [r["triples"] for r in I.extract_by_rule(df).collect()]
    assert got == [[["Corn", "prices", "rise"], ["while", "Brazil", "exports"]], []]


def test_verbs_fit_the_terms_of_their_class(spark):
    df = spark.createDataFrame([("warns",), ("banned",), ("prices rise",), ("walks",), ("cutlery",), (None,)], "v STRING")
    got = {r["v"]: (r["stance"], r["price_demand"]) for r in KW.verb_classes(df).collect()}
    assert got["warns"] == (True, False) and got["prices rise"] == (False, True)
    assert got["walks"] == got["cutlery"] == (False, False) and len(got) == 5
