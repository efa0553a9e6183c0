"""Files, tables and streams on temporary folders."""

import hashlib
import json

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from furrow import schemas
from furrow.plans import ingestion as I
from furrow.sources import catalog as C
from furrow.sources import readers as RD
from furrow.sources import writers as WR
from furrow.streaming import news as SN


def article(i, **more):
    return {"id": f"a{i}", "title": f"Corn price {i}", "description": "drought and tariff", "all_text": f"Farmers Union sells corn {i}. Wheat Board buys grain.",
            "publish_date": f"2024-01-0{i % 5 + 1} 10:00:00", "collected_at": "2024-01-09 00:00:00", "filter_status": "F", "unknown": 1, **more}


def land(folder, name, rows):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text(rows if isinstance(rows, str) else json.dumps(rows), encoding="utf-8")


def test_json_arrays_missing_and_broken(spark, tmp_path):
    land(tmp_path / "in", "good.json", [article(1), article(2)])
    land(tmp_path / "in", "bad.json", "[{oops")
    rows = RD.read_json_arrays(spark, str(tmp_path / "in"))
    assert sorted(r["id"] for r in rows.where("id IS NOT NULL").collect()) == ["a1", "a2"] and "unknown" not in rows.columns
    assert RD.read_json_arrays(spark, str(tmp_path / "absent")).count() == 0


def test_dated_files_skip_missing_days(spark, tmp_path):
    for d in ("20240101", "20240103", "20240109"):
        land(tmp_path / "d", f"processed_news_{d}.json", [article(int(d[-1]))])
    got = RD.read_dated_json(spark, str(tmp_path / "d"), "2024-01-01", "2024-01-05").collect()
    assert sorted((r["id"], r["file_day"]) for r in got) == [("a1", "20240101"), ("a3", "20240103")]
    asked = RD.read_dated_json(spark, str(tmp_path / "d"), "2024-01-02", "2024-01-05")
    assert [f.rsplit("/", 1)[1] for f in asked.inputFiles()] == ["processed_news_20240103.json"]
    assert RD.read_dated_json(spark, str(tmp_path / "d"), "2024-01-05", "2024-01-01").count() == 0
    assert RD.read_dated_json(spark, str(tmp_path / "none"), "2024-01-01", "2024-01-05").count() == 0


def test_csv_with_quotes_and_line_breaks(spark, tmp_path):
    head = ",".join(schemas.column_names(schemas.NEWS_CSV))
    land(tmp_path / "c", "n.csv", head + '\n1,2024-01-01 05:00:00,"say ""hi""\nthere",T,corn,,,,,,\n2,broken,t,T,corn,,,,,,\n')
    rows = RD.read_news_csv(spark, str(tmp_path / "c")).orderBy("id").collect()
    assert rows[0]["title"] == 'say "hi"\nthere' and rows[0]["publish_date"].hour == 5 and rows[1]["publish_date"] is None


def test_csv_round_trip_tells_empty_texts_from_nulls(spark, tmp_path):
    texts = ["", None, " ", "a\r\nb", '"', 'say "hi"\n', "\\", '\\"', " lead", "trail \n", "null", ",", "a\0\nb", '\0"', "\ufeffa", "plain"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id BIGINT, text STRING").withColumn("source", F.lit("web")).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, 1), (2, 0)], "doc_id BIGINT, quality INT").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(0,)], "vec_id BIGINT").write.parquet(str(tmp_path / "embeddings.parquet"))
    rows = entry.queries()["news_csv_round_trip__src1"](spark, str(tmp_path)).collect()
    digest = lambda t: hashlib.md5(t.encode()).hexdigest()
    assert {r["id"]: r["digest"] for r in rows} == {digest(str(i)): None if t is None else digest(t) for i, t in enumerate(texts)}
    assert len(rows) == len(texts) and all(r["day"].startswith("2024-01-01") for r in rows)


def test_report_files_listing_and_latest(spark, tmp_path):
    for name in ("corn_report_2024-01-02.txt", "corn_report_2024-02-01.txt", "wheat_report_2023-12-31.txt", "note.txt"):
        land(tmp_path / "r", name, f"text of\n{name}")
    texts = {r["name"]: r["report_text"] for r in RD.read_reports(spark, str(tmp_path / "r")).collect()}
    assert texts["note.txt"] == "text of\nnote.txt"
    latest = {r["commodity"]: str(r["latest_date"]) for r in RD.latest_report_dates(RD.list_files(spark, str(tmp_path / "r"))).collect()}
    assert latest == {"corn": "2024-02-01", "wheat": "2023-12-31"}


def test_staging_refuses_unknown_commodity(spark, tmp_path):
    row = spark.createDataFrame([("rice", None, 1.0, 1.0, 1.0, 1.0, 1.0, 1)], schemas.STAGED_PRICES)
    with pytest.raises(Exception, match="commodity not allowed"):
        WR.load_to_staging(row, str(tmp_path / "s"))
    with pytest.raises(ValueError):
        WR.load_to_staging(row.drop("close"), str(tmp_path / "s"))


def test_replacing_a_slice_leaves_the_others(spark, tmp_path):
    path = str(tmp_path / "t")
    make = lambda rows: spark.createDataFrame(rows, "news_count BIGINT, date STRING, keyword STRING")
    WR.replace_slices(make([(1, "2024-01-01", "corn"), (2, "2024-01-02", "corn")]), path)
    for _ in range(2):
        WR.replace_slices(make([(5, "2024-01-02", "corn")]), path)
    assert sorted(tuple(r) for r in spark.read.parquet(path).select("news_count", F.col("date").cast("string")).collect()) == [(1, "2024-01-01"), (5, "2024-01-02")]


def test_catalog_names_and_bound_parameters(spark):
    catalog = C.default_catalog()
    assert "prices.history" in catalog.names("prices") and not catalog.names("weather")
    for bad in ("history", "a.b.c", ".x"):
        with pytest.raises(ValueError):
            catalog.get(bad)
    with pytest.raises(KeyError):
        catalog.get("prices.unknown")
    table = spark.createDataFrame([("corn", "2024-01-01", 1.0)], "commodity STRING, date STRING, close DOUBLE")
    hostile = "corn' OR '1'='1"
    assert catalog.run(spark, "prices.latest", {"daily_prices": table}, commodity=hostile, n=5).count() == 0
    assert catalog.run(spark, "prices.latest", {"daily_prices": table}, commodity="corn", n=5).count() == 1


def test_failing_model_answers_f(spark):
    def load():
        def model(batch):
            raise RuntimeError("no answer")
        return model

    rows = spark.createDataFrame([("a", "t", "x")], "id STRING, title STRING, all_text STRING")
    got = I.extract_by_model(rows, load).first()
    assert got["filter_status"] == "F" and got["named_entities"] == [] and got["triples"] == []


def test_stream_equals_batch_and_rerun_adds_nothing(spark, tmp_path):
    landed, root = tmp_path / "landed", str(tmp_path / "tables")
    land(landed, "1.json", [article(1), article(2), article(1, title="Corn price again")])
    run = lambda: SN.ingest(SN.landed_news(spark, str(landed)), root, str(tmp_path / "state"), dimensions=256).awaitTermination()
    run()
    land(landed, "2.json", [article(2), article(3)])
    run()
    run()
    ids = sorted(r["id"] for r in spark.read.parquet(f"{root}/articles").select("id").collect())
    assert ids == ["a1", "a2", "a3"]
    hashes = [r[0] for r in spark.read.parquet(f"{root}/entities").select("hash_id").collect()]
    assert hashes and len(hashes) == len(set(hashes))
    batch = I.process(RD.read_json_arrays(spark, str(landed)), spark.createDataFrame([], "id STRING"), "publish_date")
    assert sorted(r["id"] for r in batch.select("id").collect()) == ids


def test_backfill_is_idempotent(spark, tmp_path):
    land(tmp_path / "b", "x.json", [article(1), article(2), article(3)])
    for _ in range(2):
        SN.backfill(spark, str(tmp_path / "b"), "2024-01-02", "2024-01-03", str(tmp_path / "out"))
    assert sorted(r["id"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["a1", "a2"]


def test_ingestion_searches_a_text_once_and_writes_plain_vectors(spark, tmp_path):
    land(tmp_path / "landed", "1.json", [article(1), article(2)])
    rows = RD.read_json_arrays(spark, str(tmp_path / "landed"))
    plan = I.process(rows, spark.createDataFrame([], "id STRING"), "publish_date")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 1
    before, root = spark.conf.get(WR.LEGACY_LISTS), str(tmp_path / "tables")
    SN.ingest(SN.landed_news(spark, str(tmp_path / "landed")), root, str(tmp_path / "state"), dimensions=256).awaitTermination()
    assert spark.conf.get(WR.LEGACY_LISTS) == before
    for name, made in (("entities", I.entity_rows), ("triples", I.triple_rows)):
        files = list((tmp_path / "tables" / name).rglob("*.parquet"))
        assert files and all("repeated double" in str(pq.ParquetFile(f).schema) for f in files)
        want = WR.vector_rows(I.new_vectors(made(I.extract_by_rule(rows)), spark.createDataFrame([], "hash_id STRING")))
        back = spark.read.schema(schemas.TEXT_VECTORS).parquet(f"{root}/{name}").drop("batch_id")
        assert sorted(map(tuple, back.collect())) == sorted(map(tuple, want.collect())) and back.count()
