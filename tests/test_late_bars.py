"""Averages of bars that land out of order."""

import datetime as dt

from furrow.operators import windows as W
from furrow.streaming import bars as SB

D0 = dt.date(2024, 1, 1)
SCHEMA = "commodity STRING, date DATE, close DOUBLE"


def landings(spark, tmp_path, parts, **more):
    """The rows given after each landing."""
    landed, path = str(tmp_path / "landed"), str(tmp_path / "out")
    for rows in parts:
        rows = [(k, None if d is None else D0 + dt.timedelta(days=d), p) for k, d, p in rows]
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(landed)
        stream = spark.readStream.schema(SCHEMA).parquet(landed)
        SB.running_ema(stream, 3, **more).writeStream.format("parquet").option("path", path).option(
            "checkpointLocation", str(tmp_path / "state")).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(f"{SCHEMA}, ema DOUBLE, revision BIGINT").parquet(path)


def day(row):
    return (row["date"] - D0).days


def test_late_and_changed_bars_equal_the_batch_average(spark, tmp_path):
    parts = [
        [("corn", d, 10.0 + d * d % 7) for d in (0, 1, 3, 6)] + [("rice", 4, 5.0), ("rice", None, 3.0), ("rice", 5, None), ("rice", 6, float("nan"))],
        [("corn", 2, 30.0), ("corn", 7, 4.0), ("corn", 7, 9.0), ("rice", 1, 2.0)],
        [("corn", 8, 1.0)],
        [("corn", 3, 50.0)],  # another price for a day
    ]
    given = landings(spark, tmp_path, parts)
    final = {("corn", d): 10.0 + d * d % 7 for d in (0, 1, 6)} | {("corn", 2): 30.0, ("corn", 3): 50.0, ("corn", 7): 9.0, ("corn", 8): 1.0, ("rice", 1): 2.0, ("rice", 4): 5.0}
    bars = spark.createDataFrame([(k, D0 + dt.timedelta(days=d), p) for (k, d), p in final.items()], SCHEMA)
    want = {(r["commodity"], day(r)): round(r["ema"], 9) for r in W.ema(bars, "close", 3).collect()}
    assert {(r["commodity"], day(r)): round(r["ema"], 9) for r in SB.latest_revision(given).collect()} == want
    corn = {n: sorted(day(r) for r in given.where(f"commodity = 'corn' AND revision = {n}").collect()) for n in (1, 2, 3, 4)}
    assert corn == {1: [0, 1, 3, 6], 2: [2, 3, 6, 7], 3: [8], 4: [3, 6, 7, 8]}  # only what changed is given again


def test_a_bar_from_before_the_horizon_has_no_average(spark, tmp_path):
    given = landings(spark, tmp_path, [[("corn", d, float(d)) for d in range(10)], [("corn", 10, 1.0), ("corn", 6, 60.0), ("corn", 2, 20.0)]], horizon=4)
    rows = {day(r): r["ema"] for r in given.where("revision = 2").collect()}
    assert sorted(rows) == [2, 6, 7, 8, 9, 10] and rows[2] is None
    bars = spark.createDataFrame([("corn", D0 + dt.timedelta(days=d), {6: 60.0, 10: 1.0}.get(d, float(d))) for d in range(11)], SCHEMA)
    want = {day(r): r["ema"] for r in W.ema(bars, "close", 3).collect()}
    assert all(abs(rows[d] - want[d]) < 1e-9 for d in (6, 7, 8, 9, 10))
