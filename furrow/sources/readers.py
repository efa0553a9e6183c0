"""Readers of landed files and tables; every schema is declared."""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from furrow import schemas
from furrow.operators.filters import check_date


def _or_empty(spark: SparkSession, schema: str, read) -> DataFrame:
    """What `read` returns, or no rows when nothing lies at its path."""
    try:
        return read()
    except AnalysisException as err:
        if (err.getCondition() or "").startswith("PATH_NOT_FOUND"):
            return spark.createDataFrame([], schema)
        raise


def read_csv(spark: SparkSession, path: str, schema: str, date_col: str | None = None, line_breaks: bool = True, **options: str) -> DataFrame:
    """CSV with a header; texts may hold quotes and, with `line_breaks`, these too: then a file is one task.

    The date column is parsed, bad dates become null."""
    df = spark.read.schema(schema).csv(path, header=True, multiLine=line_breaks, escape='"', **options)
    return df if date_col is None else df.withColumn(date_col, F.expr(f"try_to_timestamp({date_col})"))


def read_news_csv(spark: SparkSession, path: str) -> DataFrame:
    """A quoted empty text is an empty text, nothing between two commas is null: no text can be the mark of nulls made here."""
    return read_csv(spark, path, schemas.NEWS_CSV, "publish_date", nullValue=uuid.uuid4().hex, charToEscapeQuoteEscaping='"')


def read_price_csv(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, schemas.PRICE_CSV, "time", line_breaks=False)


def read_json_arrays(spark: SparkSession, path: str, schema: str = schemas.RAW_NEWS) -> DataFrame:
    """Files that each hold a JSON array. A missing path or a broken file gives no rows; unknown fields are ignored."""
    return _or_empty(spark, schema, lambda: spark.read.schema(schema).json(path, multiLine=True, mode="DROPMALFORMED"))


def read_dated_json(spark: SparkSession, folder: str, start: str, end: str, prefix: str = "processed_news_",
                    schema: str = schemas.RAW_NEWS) -> DataFrame:
    """The files `{prefix}YYYYMMDD.json` of the days in [start, end]; days without a file are skipped.

    The folder is listed once and only files of asked days are opened: the days are part of the path's pattern. The day of a
    row, `file_day`, is taken from its file's name.
    """
    first, last = check_date(start), check_date(end)
    days = [(first + dt.timedelta(days=i)).strftime("%Y%m%d") for i in range((last - first).days + 1)]
    if not days:
        return spark.createDataFrame([], f"{schema}, file_day STRING")

    def read() -> DataFrame:
        files = spark.read.schema(schema).json(f"{folder}/{prefix}{{{','.join(days)}}}.json", multiLine=True, mode="DROPMALFORMED")
        return files.select("*", F.regexp_extract("_metadata.file_name", rf"{prefix}(\d{{8}})\.json", 1).alias("file_day"))

    return _or_empty(spark, f"{schema}, file_day STRING", read)


def read_table(spark: SparkSession, path: str, date_col: str | None = None, start: str | None = None, end: str | None = None,
               where: str | None = None, order: Sequence[str] = ()) -> DataFrame:
    """Parquet table with date and other predicates pushed into the scan."""
    df = spark.read.parquet(path)
    if date_col and start:
        df = df.where(F.col(date_col) >= F.lit(start).cast("date"))
    if date_col and end:
        df = df.where(F.col(date_col) <= F.lit(end).cast("date"))
    if where:
        df = df.where(where)
    return df.orderBy(*order) if order else df


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    """Whole text files: (path, name, report_text)."""
    df = spark.read.text(path, wholetext=True, recursiveFileLookup=True)
    return df.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("name"), F.col("value").alias("report_text"))


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, name, modified, length) of every file below a folder; contents are not read."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return df.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), F.col("modificationTime").alias("modified"), "length")


def latest_report_dates(files: DataFrame, pattern: str = r"^(.+?)_?(?:market_)?report_(\d{4}-\d{2}-\d{2})\.txt$") -> DataFrame:
    """Newest report date per commodity, both taken from the file names."""
    named = files.select(F.regexp_extract("name", pattern, 1).alias("commodity"), F.regexp_extract("name", pattern, 2).alias("date"))
    return named.where("date <> ''").groupBy("commodity").agg(F.max(F.to_date("date")).alias("latest_date"))


def pair_results(files: DataFrame, folder: Sequence[str] = ()) -> DataFrame:
    """Each summary file with the agent result file of the same stem, newest name first.

    `folder` names the columns that tell folders apart: a name may occur in several, and files pair within theirs."""
    summaries = files.where(F.col("name").startswith("summary_")).select(*folder, F.col("name").alias("summary_name"))
    wanted = summaries.withColumn("result_name", F.regexp_replace("summary_name", "^summary_", "agent_result_"))
    results = files.where(F.col("name").startswith("agent_result_")).select(*folder, F.col("name").alias("result_name"), F.lit(1).alias("found")).distinct()
    return wanted.join(results, [*folder, "result_name"], "left").withColumn("found", F.coalesce("found", F.lit(0))).orderBy(F.col("summary_name").desc())
