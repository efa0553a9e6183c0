"""Registered queries: each pairs a DataFrame job with equivalent SQL over the same Parquet tables."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from furrow.session import prepare

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
FAMILIES = ("prices", "news", "decisions", "texts", "vectors", "graphs", "ingestion", "models", "streams")


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    """Register `fn(spark, sf_dir)` under `name`, with its SQL where plain SQL can say the same."""

    def register(fn: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(prepare(spark), sf_dir)

        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = run
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return register


def load_all() -> None:
    for family in FAMILIES:
        importlib.import_module(f"furrow.suite.{family}")
