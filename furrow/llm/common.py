"""Small helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

#: The six characters that end a word.
WHITE = b"\t\n\x0b\x0c\r "
#: Arrow types of result columns.
ARROW = {"bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary()}


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def texts(column: pa.Array) -> list[str]:
    """The strings of a column, null as the empty text."""
    return [x or "" for x in column.to_pylist()]


def words(text: str) -> list[bytes]:
    """Maximal runs of other characters than the six in WHITE, as UTF-8."""
    return text.encode().split()


def by_size(items: list[str], most: int) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive items of about `most` characters together, so that scratch arrays stay small."""
    start, held = 0, 0
    for at, item in enumerate(items):
        if held and held + len(item) > most:
            yield start, at
            start, held = at, 0
        held += len(item)
    if start < len(items):
        yield start, len(items)


def small_batches(spark: SparkSession) -> None:
    """Bound what a Python task holds at once: rows differ in size by several powers of ten."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


def row_total(df: DataFrame) -> int:
    return df.agg(F.count(F.lit(1))).first()[0]


def unused(df: DataFrame, name: str) -> str:
    """`name`, or a longer one where `df` has a column of that name."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of a column of equally long vectors, in double precision."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if len(column) and len(flat) % len(column):
        raise ValueError("vectors differ in length")
    return flat.reshape(len(column), -1)


def with_results(df: DataFrame, column: str | Column, names: dict[str, str], work: Callable[[list], Sequence[tuple]]) -> DataFrame:
    """`df` with a column for each name (and type) from `work`: values of `column`, in Arrow batches, to rows of results.

    Only that column goes to Python. The function runs once for each row, however many of its results are used.
    """
    fields = pa.schema([(n, ARROW.get(t) or to_arrow_type(DataType.fromDDL(t))) for n, t in names.items()])

    def run(values: pa.Array) -> pa.Array:
        parts = list(zip(*work(values.to_pylist()))) or [()] * len(fields)
        return pa.StructArray.from_arrays([pa.array(p, f.type) for p, f in zip(parts, fields)], fields.names)

    made = F.arrow_udf(run, "struct<" + ",".join(f"`{n}`:{t}" for n, t in names.items()) + ">").asNondeterministic()
    held = unused(df, "__results")
    parts = {n: F.col(f"{held}.{n}") for n in names}
    return df.withColumn(held, made(F.col(column) if isinstance(column, str) else column)).withColumns(parts).drop(held)
