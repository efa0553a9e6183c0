"""Writers: typed appends, slice replacement, merges, report files and quarantine of bad rows."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from furrow import schemas
from furrow.functions.vectors import coerced
from furrow.operators.filters import DEFAULT_COMMODITIES, check_columns

LEGACY_LISTS = "spark.sql.parquet.writeLegacyFormat"
NESTED = (T.ArrayType, T.MapType, T.StructType)


def to_schema(df: DataFrame, ddl: str) -> DataFrame:
    """Columns of the target schema in its order: nested values for text columns become JSON, absent columns null,
    anything the target does not know is left out."""
    target = df.sparkSession.createDataFrame([], ddl).schema

    def fitted(field: T.StructField) -> Column:
        if field.name not in df.columns:
            return F.lit(None).cast(field.dataType).alias(field.name)
        if isinstance(field.dataType, T.StringType) and isinstance(df.schema[field.name].dataType, NESTED):
            return F.to_json(field.name).alias(field.name)
        return F.col(field.name).cast(field.dataType).alias(field.name)

    return df.select(*[fitted(f) for f in target])


def append(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    df.write.mode("append").partitionBy(*partition_by).parquet(path)


def append_news(df: DataFrame, path: str) -> None:
    append(to_schema(df, schemas.NEWS_TABLE), path)


def vector_rows(df: DataFrame, hash_id: str = "hash_id", text: str = "text", vector: str = "embedding") -> DataFrame:
    return df.select(F.col(hash_id).alias("hash_id"), F.col(text).alias("text"), coerced(F.col(vector)).alias("embedding"))


@contextmanager
def plain_lists(spark: SparkSession) -> Iterator[None]:
    """Arrays without nulls are written as repeated values, not as a group for each value, which takes half the time for
    long vectors. Parquet's rules for such lists make all readers give the same arrays."""
    before = spark.conf.get(LEGACY_LISTS)
    spark.conf.set(LEGACY_LISTS, "true")
    try:
        yield
    finally:
        spark.conf.set(LEGACY_LISTS, before)


def append_vectors(df: DataFrame, path: str) -> None:
    append(vector_rows(df), path)


def split_bad_rows(df: DataFrame, rules: Mapping[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(good, bad): bad rows carry the names of the rules they break."""
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]))
    marked = df.withColumn("errors", broken)
    return marked.where(F.size("errors") == 0).drop("errors"), marked.where(F.size("errors") > 0)


def staged_prices(df: DataFrame, allowed: Sequence[str] = DEFAULT_COMMODITIES) -> DataFrame:
    """Rows ready for staging; the write fails on the first commodity outside the allowed set."""
    names = schemas.column_names(schemas.STAGED_PRICES)
    check_columns(df, names)
    known = F.col("commodity").isin(*allowed)
    checked = F.when(known, F.col("commodity")).otherwise(F.raise_error(F.concat(F.lit("commodity not allowed: "), F.coalesce("commodity", F.lit("null")))))
    return to_schema(df.withColumn("commodity", checked), schemas.STAGED_PRICES)


def load_to_staging(df: DataFrame, path: str, allowed: Sequence[str] = DEFAULT_COMMODITIES) -> None:
    append(staged_prices(df, allowed), path)


def truncate(df: DataFrame, path: str) -> None:
    """Empty the table at the path, keeping its schema."""
    df.limit(0).write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(path)


def timeseries_predictions(df: DataFrame) -> DataFrame:
    held = df.where(F.col("error").isNull()) if "error" in df.columns else df
    if "created_at" not in held.columns:
        held = held.withColumn("created_at", F.current_timestamp())
    return to_schema(held, schemas.TIMESERIES_PREDICTION)


def append_timeseries_predictions(df: DataFrame, path: str) -> None:
    append(timeseries_predictions(df), path, ["target_date"])


DIRECTION_CODES = {"하락": 0, "상승": 1, "유지": 2}


def news_predictions(df: DataFrame) -> DataFrame:
    """Predictions in table form: direction as its class code, nested summaries as JSON."""
    held = df.withColumn("prediction", F.try_element_at(F.create_map(*[F.lit(x) for kv in DIRECTION_CODES.items() for x in kv]), F.col("direction")))
    if "created_at" not in held.columns:
        held = held.withColumn("created_at", F.current_timestamp())
    return to_schema(held, schemas.NEWS_PREDICTION)


def append_news_predictions(df: DataFrame, path: str) -> None:
    append(news_predictions(df), path, ["target_date"])


def replace_slices(df: DataFrame, path: str, keys: Sequence[str] = ("date", "keyword")) -> None:
    """Replace exactly the slices the frame holds; every other slice of the table stays."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)


def write_csv(df: DataFrame, path: str, order: Sequence[str]) -> None:
    df.orderBy(*order).write.mode("overwrite").csv(path, header=True, escape='"')


def decision_rows(df: DataFrame) -> DataFrame:
    """Decision log rows in field order; missing texts are empty."""
    texts = ("recommendation", "rationale_short", "warnings", "stage", "commodity")
    return to_schema(df, schemas.DECISION_META).fillna("", subset=list(texts))


def append_decisions(df: DataFrame, path: str) -> None:
    append(decision_rows(df), path, ["stage"])


def write_json_reports(df: DataFrame, path: str, date_col: str = "date") -> None:
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(date_col).json(path)


def write_text_reports(df: DataFrame, path: str, text: str = "report_text", date_col: str = "date", key: str = "commodity") -> None:
    """Report texts below commodity/year/month folders; empty reports are skipped."""
    held = df.where(F.length(F.trim(F.col(text))) > 0)
    parts = held.select(F.col(text).alias("value"), F.col(key).alias("commodity"), F.date_format(date_col, "yyyy").alias("year"), F.date_format(date_col, "MM").alias("month"))
    parts.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("lineSep", "\n\f\n").partitionBy("commodity", "year", "month").text(path)


def save_clustered(df: DataFrame, path: str, partition: str = "date", cluster: str = "commodity", files_per_slice: int = 1) -> None:
    """Partitioned by date and sorted by commodity inside each file, so that file statistics prune.

    A date's rows go to a set number of tasks, which bounds the number of files whatever the cluster's width.
    """
    spread = F.pmod(F.xxhash64(*[c for c in df.columns if c not in (partition,)]), F.lit(files_per_slice))
    placed = df.withColumn("_slot", spread).repartition(partition, "_slot").drop("_slot")
    placed.sortWithinPartitions(partition, cluster).write.mode("overwrite").partitionBy(partition).parquet(path)
