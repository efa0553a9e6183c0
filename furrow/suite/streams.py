"""Streaming jobs run over the given tables until everything available is processed."""

from __future__ import annotations

from pyspark.sql import functions as F

from furrow import schemas
from furrow.operators import windows as W
from furrow.plans import daily as DL
from furrow.plans import ingestion as I
from furrow.plans import market_report as MR
from furrow.session import scratch_path
from furrow.streaming import bars as SB
from furrow.streaming import news as SN
from furrow.suite import query
from furrow.suite.ingestion import now
from furrow.suite.models import _daily_directions, _voted
from furrow.suite.prices import day
from furrow.suite.views import view, with_views


def _stream(spark, sf, name):
    return spark.readStream.schema(view(spark, sf, name).schema).parquet(f"{sf}/{name}*.parquet")


def _drain(query):
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()


@query("streamed_business_days__str7", """WITH m AS (SELECT max(ts) AS last FROM events), w AS (SELECT CAST(ts + INTERVAL 14 HOUR AS DATE) AS business_date, event_type, count(*) AS events, round(sum(value), 2) AS total FROM events GROUP BY ALL)
SELECT CAST(business_date AS STRING) AS business_date, event_type, events, total FROM w, m WHERE business_date + INTERVAL 10 HOUR <= last - INTERVAL 1 HOUR""")
def _(spark, sf):
    path = scratch_path(spark, "business-days")
    days = SB.cutoff_days(_stream(spark, sf, "events"), "ts", "event_type", "value")
    _drain(days.writeStream.format("parquet").option("path", path).option("checkpointLocation", scratch_path(spark, "state")).outputMode("append").trigger(availableNow=True).start())
    back = spark.read.schema("business_date DATE, event_type STRING, events BIGINT, total DOUBLE").parquet(path)
    return day(back.withColumn("total", F.round("total", 2)), "business_date")


@query("streamed_average__str5", with_views("px_daily").replace("WITH ", "WITH RECURSIVE ", 1) + """, s AS (SELECT commodity, date, close, row_number() OVER (PARTITION BY commodity ORDER BY date) AS i FROM px_daily),
e AS (SELECT commodity, date, i, close AS ema FROM s WHERE i = 1 UNION ALL SELECT s.commodity, s.date, s.i, 2.0/21 * s.close + (1 - 2.0/21) * e.ema FROM e JOIN s ON s.commodity = e.commodity AND s.i = e.i + 1)
SELECT commodity, CAST(date AS STRING) AS date, round(ema, 4) AS ema FROM e""")
def _(spark, sf):
    bars, landed = view(spark, sf, "px_daily").select("commodity", "date", "close"), scratch_path(spark, "bars")
    # Two landings, so that the second batch goes on from the state of the first.
    half = F.lit("2024-01-15").cast("date")
    path, state = scratch_path(spark, "ema"), scratch_path(spark, "state")
    for part in (bars.where(F.col("date") < half), bars.where(F.col("date") >= half)):
        part.write.mode("append").parquet(landed)
        stream = spark.readStream.schema(bars.schema).parquet(landed)
        _drain(SB.running_ema(stream).writeStream.format("parquet").option("path", path).option("checkpointLocation", state).outputMode("append").trigger(availableNow=True).start())
    return day(spark.read.schema("commodity STRING, date DATE, close DOUBLE, ema DOUBLE").parquet(path).select("commodity", "date", F.round("ema", 4).alias("ema")))


@query("late_bars_average__str5", with_views("px_daily").replace("WITH ", "WITH RECURSIVE ", 1) + """, s AS (SELECT commodity, date, close, row_number() OVER (PARTITION BY commodity ORDER BY date) AS i, day(date) % 4 = 3 OR date >= DATE '2024-01-15' AS second FROM px_daily),
e AS (SELECT commodity, date, i, second, close AS ema FROM s WHERE i = 1 UNION ALL SELECT s.commodity, s.date, s.i, s.second, 2.0/21 * s.close + (1 - 2.0/21) * e.ema FROM e JOIN s ON s.commodity = e.commodity AND s.i = e.i + 1),
t AS (SELECT commodity, min(date) AS changed, count(*) FILTER (NOT second) > 0 AS both FROM (SELECT commodity, second, CASE WHEN second THEN date END AS date FROM s) GROUP BY commodity)
SELECT commodity, CAST(date AS STRING) AS date, round(ema, 4) AS ema, CAST(CASE WHEN second THEN 1 WHEN date >= changed THEN 2 ELSE 1 END AS BIGINT) AS times_given FROM e JOIN t USING (commodity)""")
def _(spark, sf):
    bars, landed = view(spark, sf, "px_daily").select("commodity", "date", "close"), scratch_path(spark, "bars")
    # Every fourth day lands with the second half, after days that follow it.
    second = (F.dayofmonth("date") % 4 == 3) | (F.col("date") >= F.lit("2024-01-15").cast("date"))
    path, state = scratch_path(spark, "ema"), scratch_path(spark, "state")
    for part in (bars.where(~second), bars.where(second)):
        part.write.mode("append").parquet(landed)
        stream = spark.readStream.schema(bars.schema).parquet(landed)
        _drain(SB.running_ema(stream).writeStream.format("parquet").option("path", path).option("checkpointLocation", state).outputMode("append").trigger(availableNow=True).start())
    given = spark.read.schema("commodity STRING, date DATE, close DOUBLE, ema DOUBLE, revision BIGINT").parquet(path)
    times = given.groupBy("commodity", "date").agg(F.count(F.lit(1)).alias("times_given"))
    return day(SB.latest_revision(given).join(times, ["commodity", "date"]).select("commodity", "date", F.round("ema", 4).alias("ema"), "times_given"))


@query("merged_daily_bar__str5", with_views("px_daily").replace("WITH ", "WITH RECURSIVE ", 1) + """, s AS (SELECT commodity, date, close, row_number() OVER (PARTITION BY commodity ORDER BY date) AS i FROM px_daily WHERE date <= DATE '2024-01-20'),
e AS (SELECT commodity, date, i, close AS ema FROM s WHERE i = 1 UNION ALL SELECT s.commodity, s.date, s.i, 2.0/21 * s.close + (1 - 2.0/21) * e.ema FROM e JOIN s ON s.commodity = e.commodity AND s.i = e.i + 1)
SELECT commodity, CAST(date AS STRING) AS date, CASE WHEN date = DATE '2024-01-20' THEN round(ema, 4) ELSE 0.0 END AS ema FROM e""")
def _(spark, sf):
    history = view(spark, sf, "px_daily")
    held = history.where("date < DATE '2024-01-20'").select("commodity", "date", "close", F.lit(0.0).alias("ema"), now().alias("ingested_at"))
    return day(SB.daily_bar(history, held, "2024-01-20").select("commodity", "date", F.round("ema", 4).alias("ema")))


@query("streamed_dedup__str2", "SELECT DISTINCT md5(text) AS id FROM documents")
def _(spark, sf):
    path = scratch_path(spark, "dedup")
    stream = _stream(spark, sf, "documents").select(F.md5("text").alias("id"), "doc_id")
    _drain(SN.exact_dedup(stream, path, scratch_path(spark, "state"), ["id"], ["doc_id"], "id STRING, doc_id BIGINT"))
    return spark.read.schema("id STRING, batch_id BIGINT").parquet(path).select("id")


@query("state_dedup__str2", "SELECT md5(text) AS id, doc_id, CAST(length(text) AS INT) AS chars FROM documents QUALIFY row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id % 2, doc_id) = 1")
def _(spark, sf):
    path, state, landed = scratch_path(spark, "dedup"), scratch_path(spark, "state"), scratch_path(spark, "landed")
    rows = view(spark, sf, "documents").select(F.md5("text").alias("id"), "doc_id", F.length("text").alias("chars"))
    for part in (0, 1):  # two landings: copies of a text come in both
        rows.where(F.col("doc_id") % 2 == part).write.mode("append").parquet(landed)
        _drain(SN.dedup_in_state(spark.readStream.schema(rows.schema).parquet(landed), path, state, ["id"], ["doc_id"]))
    return spark.read.schema(rows.schema).parquet(path)


@query("streamed_quarantine__str8", "SELECT event_id, 'value' AS errors FROM events WHERE NOT value > 5")
def _(spark, sf):
    good, bad = scratch_path(spark, "good"), scratch_path(spark, "bad")
    _drain(SB.load_checked(_stream(spark, sf, "events"), {"value": F.col("value") > 5}, good, bad, scratch_path(spark, "state")))
    return spark.read.schema("event_id BIGINT, errors ARRAY<STRING>").parquet(bad).select("event_id", F.array_join("errors", ",").alias("errors"))


@query("streamed_ingestion__str1")
def _(spark, sf):
    root, landed = scratch_path(spark, "ingested"), scratch_path(spark, "landed")
    news = view(spark, sf, "news").select("id", F.col("key_word").alias("title"), F.col("all_text").alias("description"), "all_text", F.col("publish_ts").cast("string").alias("publish_date"), "key_word", "filter_status")
    news.write.parquet(landed)
    stream = spark.readStream.schema(news.schema).parquet(landed)
    _drain(SN.ingest(stream, root, scratch_path(spark, "state"), dimensions=256))
    count = lambda name: spark.read.parquet(f"{root}/{name}").agg(F.lit(name).alias("target_table"), F.count(F.lit(1)).alias("rows"))
    tables = [count(n) for n in ("articles", "entities", "triples", "triple_article_map")]
    return tables[0].union(tables[1]).union(tables[2]).union(tables[3])


@query("backfilled_days__str4", with_views("raw_articles") + """ SELECT substring(published_at, 1, 10) AS day, count(DISTINCT id) AS articles FROM raw_articles WHERE published_at IS NOT NULL AND substring(published_at, 1, 10) BETWEEN '2024-01-03' AND '2024-01-12' GROUP BY ALL""")
def _(spark, sf):
    landed, path = scratch_path(spark, "landed"), scratch_path(spark, "backfill")
    rows = I.standard_rows(view(spark, sf, "raw_articles"), now(), backfill=True)
    rows.select(F.to_json(F.struct("*")).alias("value")).repartition(8).write.text(landed, lineSep="\n")
    stream_rows = spark.read.schema(schemas.RAW_NEWS).json(landed)
    from furrow.sources.writers import replace_slices

    for _ in range(2):
        replace_slices(SN.articles_by_day(stream_rows, "2024-01-03", "2024-01-12").repartition("day"), path, ["day"])
    return day(spark.read.schema("id STRING, day DATE").parquet(path).groupBy("day").agg(F.count(F.lit(1)).alias("articles")), "day")


@query("published_tables__str6")
def _(spark, sf):
    root = scratch_path(spark, "published")
    reports = MR.prediction_reports(_voted(spark, sf), view(spark, sf, "news"), view(spark, sf, "px_daily"))
    forecasts = _daily_directions(spark, sf).drop("yhat")
    DL.publish(forecasts, reports, root)
    # A series too short for a forecast leaves its table without files.
    count = lambda name: spark.read.schema("commodity STRING").parquet(f"{root}/{name}").agg(F.lit(name).alias("target_table"), F.count(F.lit(1)).alias("rows"))
    return count("prediction_timeseries").union(count("prediction_news_sentiment")).union(count("sentiment_result_pos_neg"))
