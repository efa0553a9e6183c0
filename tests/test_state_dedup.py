"""Deduplication whose history is in the state store."""

from furrow.streaming import news as SN

SCHEMA = "id STRING, place INT, tags ARRAY<STRING>"


def land(spark, tmp_path, rows):
    """The query of one landing, after it has ended."""
    landed = str(tmp_path / "landed")
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.mode("append").parquet(landed)
    stream = spark.readStream.schema(SCHEMA).parquet(landed)
    query = SN.dedup_in_state(stream, str(tmp_path / "out"), str(tmp_path / "state"), ["id"], ["place"])
    query.awaitTermination()
    assert query.exception() is None
    return query


def written(spark, tmp_path):
    return sorted((r["id"] or "", r["place"], r["tags"]) for r in spark.read.schema(SCHEMA).parquet(str(tmp_path / "out")).collect())


def test_first_row_of_each_key_over_batches(spark, tmp_path):
    provider = spark.conf.get(SN.PROVIDER)
    land(spark, tmp_path, [("a", 3, ["x"]), ("a", 2, ["y"]), ("b", 5, None), (None, 7, []), (None, 6, ["n"])] + [("hot", i, [str(i)]) for i in range(9, 3000)])
    query = land(spark, tmp_path, [("a", 1, ["late"]), ("c", None, ["null first"]), ("c", 0, ["z"]), (None, 1, []), ("hot", 1, [])])
    assert written(spark, tmp_path) == sorted([("", 6, ["n"]), ("a", 2, ["y"]), ("b", 5, None), ("c", None, ["null first"]), ("hot", 9, ["9"])], key=lambda r: r[0])
    progress = [p for p in query.recentProgress if p["numInputRows"]]
    assert [p["numInputRows"] for p in progress] == [5]  # no row of the first landing is read again
    land(spark, tmp_path, [("b", 1, [])])
    assert len(written(spark, tmp_path)) == 5
    assert spark.conf.get(SN.PROVIDER) == provider
