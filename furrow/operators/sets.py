"""Unions, distinct, differences and first-wins deduplication."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def union_tagged(frames: Mapping[str, DataFrame], tag: str = "commodity") -> DataFrame:
    """All frames under one schema with the name of their source as a column."""
    tagged = [df.withColumn(tag, F.lit(name)) for name, df in frames.items()]
    return reduce(lambda a, b: a.unionByName(b), tagged)


def first_occurrences(df: DataFrame, value: str, position: str) -> DataFrame:
    """Distinct values with the place each first appears."""
    return df.groupBy(value).agg(F.min(position).alias(position))


def first_wins(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """The earliest row per key; an aggregate, so copies of a key collapse before the shuffle."""
    whole = F.struct(*df.columns)
    return (
        df.groupBy(*[F.col(k).alias(f"_{k}") for k in keys])
        .agg(F.min_by(whole, F.struct(*order)).alias("_row"))
        .select("_row.*")
    )


def difference(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    return left.join(right.select(*on).distinct(), on=list(on), how="left_anti")


def intersection(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    return left.join(right.select(*on).distinct(), on=list(on), how="left_semi")
