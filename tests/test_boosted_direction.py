"""Boosted directions: all commodities in one job, with the operator's own parameters."""

import numpy as np
from pyspark.sql import functions as F

from furrow.operators import models as M
from furrow.operators import windows as W
from furrow.suite import models as queries


def test_trees_learn_what_no_single_feature_tells():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(1500, 6))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.3)).astype(float)
    part = np.where(np.arange(1500) < 1000, "train", np.where(np.arange(1500) < 1250, "val", "test"))
    chance = M.boosted_probability(x, y, part)
    assert ((chance > 0.5) == (y == 1))[part == "test"].mean() > 0.93
    assert (chance == M.boosted_probability(x, y, part)).all()


def test_missing_values_go_where_the_loss_is_less():
    rng = np.random.default_rng(2)
    part = np.where(np.arange(1500) < 1000, "train", np.where(np.arange(1500) < 1250, "val", "test"))
    gone = rng.random((1500, 2)) < 0.4
    x = np.column_stack([np.where(gone, np.nan, rng.normal(size=(1500, 2))), np.full(1500, np.nan)])
    right = lambda y: ((M.boosted_probability(x, y.astype(float), part) > 0.5) == y)[part == "test"].mean()
    # Zero lies in the middle of the present values: put there, missing ones could not be told apart.
    assert right(gone[:, 0]) == 1
    assert right(gone[:, 0] ^ gone[:, 1]) > 0.97
    # Missing like the great ones, and like the small ones.
    assert right(gone[:, 0] | (x[:, 0] > 0.5)) > 0.97 and right(gone[:, 0] | (x[:, 0] < -0.5)) > 0.97


def test_null_features_are_missing(spark):
    rows = spark.range(900).selectExpr("'a' AS commodity", "date_add(DATE '2018-01-01', CAST(id AS INT)) AS ds", "CAST(pmod(xxhash64(id), 2) AS INT) AS direction",
                                       "pmod(xxhash64(id, 'x'), 101) - 50.0 AS noise")
    rows = rows.withColumn("x", F.when(F.col("direction") == 1, F.col("noise")))
    told = rows.orderBy(F.desc("ds")).first()
    got = M.boosted_direction(W.sliding_split(rows, str(told.ds), date_col="ds"), ["x"], ["a"]).first()
    assert got.forecast_direction == ("Up" if told.direction else "Down") and got.confidence_score > 95


def test_every_commodity_is_fitted_in_one_job_on_its_whole_window(spark):
    # What the direction follows changes 700 rows before the end: older rows must be learnt from to know the test day's case.
    rows = spark.range(1400).selectExpr("id", "explode(array('a', 'b', 'c')) AS commodity").selectExpr(
        "commodity", "date_add(DATE '2018-01-01', CAST(id AS INT)) AS ds",
        "CASE WHEN id < 700 OR id = 1399 THEN 1.0 + pmod(xxhash64(id, commodity), 2) ELSE 5.0 + pmod(xxhash64(id), 2) END AS x",
        "CASE WHEN id < 700 OR id = 1399 THEN CAST(pmod(xxhash64(id, commodity), 2) AS INT) ELSE CAST(pmod(xxhash64(id), 2) AS INT) END AS direction")
    rows = rows.withColumn("direction", F.when(F.col("commodity") == "c", 1).otherwise(F.col("direction")))
    split = W.sliding_split(rows, "2021-10-30", date_col="ds")
    got = {r.commodity: r for r in M.boosted_direction(split, ["x"], ["a", "b", "c"]).collect()}
    told = {r.commodity: r.direction for r in rows.where("ds = DATE '2021-10-30'").collect()}
    assert set(got) == {"a", "b"}  # c has one class only
    assert all(r.forecast_direction == ("Up" if told[k] else "Down") and r.confidence_score > 80 for k, r in got.items())


def test_query_uses_the_parameters_of_the_operator(monkeypatch, spark):
    seen = {}
    monkeypatch.setattr(queries.FC, "predict_direction", lambda features, target, keys, **more: seen.update(more) or features)
    monkeypatch.setattr(queries, "_timeseries", lambda *a: spark.sql("SELECT DATE '2020-01-01' AS ds FROM range(3)"))
    queries._directions(spark, "")
    assert seen == {}
