"""News ingestion as a stream of landed files: exact deduplication, gates, vectors and three table loads per batch."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from furrow import schemas
from furrow.operators.joins import unseen
from furrow.plans import ingestion as I
from furrow.sources import writers as W
from furrow.sources.readers import read_json_arrays


def landed_news(spark: SparkSession, folder: str, schema: str = schemas.RAW_NEWS, files_per_batch: int | None = None) -> DataFrame:
    """Stream over JSON-array files as they land."""
    reader = spark.readStream.schema(schema).option("multiLine", True).option("mode", "DROPMALFORMED")
    return (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).json(folder)


def once_within(stream: DataFrame, time_col: str, keys: list[str], delay: str = "7 days") -> DataFrame:
    """Deduplication with bounded state: a repeat is recognised as long as it comes within the delay."""
    return stream.withWatermark(time_col, delay).dropDuplicatesWithinWatermark(keys)


def table_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except Exception as err:  # nothing written yet
        if "PATH_NOT_FOUND" in str(err):
            return spark.createDataFrame([], schema)
        raise


def write_batch(df: DataFrame, path: str, batch_id: int) -> None:
    """Append as a slice named after the batch: a batch run again after a failure replaces its own slice."""
    df.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(path)


def earlier(df: DataFrame, batch_id: int) -> DataFrame:
    return df.where(F.col("batch_id") < batch_id)


def exact_dedup(stream: DataFrame, path: str, checkpoint: str, keys: list[str], order: list[str], schema: str) -> StreamingQuery:
    """First row per key over the whole stream; the table written so far is the state."""

    def load(batch: DataFrame, batch_id: int) -> None:
        held = earlier(table_or_empty(batch.sparkSession, path, f"{schema}, batch_id BIGINT"), batch_id)
        write_batch(unseen(batch, held, keys, order), path, batch_id)

    return stream.writeStream.foreachBatch(load).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def _first_of_batches(keys: list[str], order: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The first row per key within each Arrow batch, nulls first, so that few rows of a frequent key are shuffled."""

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ordered = batch.take(pc.sort_indices(batch.select(order), [(c, "ascending") for c in order], null_placement="at_start"))
            yield ordered.filter(pa.array(~ordered.select(keys).to_pandas().duplicated().to_numpy()))

    return reduce


class FirstRow(StatefulProcessor):
    """Gives a key's first row by `order` among those of the batch it appears in, and nothing for it afterwards."""

    def __init__(self, order: Sequence[str]):
        self.order = order

    def init(self, handle) -> None:
        self.seen = handle.getValueState("seen", "seen BOOLEAN")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        if not self.seen.exists():
            self.seen.update((True,))
            yield min(rows, key=lambda row: [(row[c] is not None, row[c]) for c in self.order])

    def close(self) -> None:
        pass


def dedup_in_state(stream: DataFrame, path: str, checkpoint: str, keys: list[str], order: list[str]) -> StreamingQuery:
    """The rows of `exact_dedup` without reading what was written: the keys seen are in the state store.

    A batch looks up its own keys only, so its work does not grow with the history; a key takes its bytes and a flag in
    RocksDB, in incremental checkpoints. The state is kept for ever; `once_within` bounds it. Rows of one key with equal
    order are interchangeable. The sink's log makes a batch run again after a failure count once.
    """
    spark = stream.sparkSession
    few = stream.mapInArrow(_first_of_batches(keys, order), stream.schema)
    first = few.groupBy(*keys).transformWithState(FirstRow(order), stream.schema, "Append", "None")
    writer = first.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKS)  # a query takes the settings of its start
    try:
        return writer.trigger(availableNow=True).start()
    finally:
        spark.conf.set(PROVIDER, before)


def ingest(stream: DataFrame, root: str, checkpoint: str, extract: Callable[[DataFrame], DataFrame] = I.extract_by_rule,
           dimensions: int = 512) -> StreamingQuery:
    """Hourly job: new articles through gates and extractor into articles, entities, triples and the triple map."""
    known = f"{schemas.NEWS_TABLE}, batch_id BIGINT"
    vectors = f"{schemas.TEXT_VECTORS}, batch_id BIGINT"

    def load(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        done = earlier(table_or_empty(spark, f"{root}/articles", known), batch_id)
        kept = I.with_vectors(I.process(batch, done, "publish_date", extract), dimensions).persist()
        try:
            write_batch(W.to_schema(kept, schemas.NEWS_TABLE), f"{root}/articles", batch_id)
            for name, rows in (("entities", I.entity_rows(kept)), ("triples", I.triple_rows(kept))):
                held = earlier(table_or_empty(spark, f"{root}/{name}", vectors), batch_id)
                made = I.new_vectors(rows, held).select("hash_id", "text", "embedding")  # made here: doubles, never empty
                with W.plain_lists(spark):
                    write_batch(made, f"{root}/{name}", batch_id)
            write_batch(I.triple_article_map(kept), f"{root}/triple_article_map", batch_id)
        finally:
            kept.unpersist()

    return stream.writeStream.foreachBatch(load).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def articles_by_day(rows: DataFrame, start: str, end: str) -> DataFrame:
    """Articles of a range of days with their day, each id once a day: a day's rows do not depend on the range asked."""
    kept = rows.withColumn("day", F.to_date("publish_date")).where(F.col("day").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    return I.once_per_article(kept, "publish_date", ["day"])


def backfill(spark: SparkSession, folder: str, start: str, end: str, path: str) -> None:
    """Landed articles of a range of days, one slice per day; running a range again replaces its days."""
    W.replace_slices(articles_by_day(read_json_arrays(spark, folder), start, end), path, ["day"])
