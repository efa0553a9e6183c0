"""Named, parameterised reads: `domain.query` to a function of (spark, params) or SQL text with bound parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Entry = str | Callable[..., DataFrame]


class QueryCatalog:
    def __init__(self) -> None:
        self._entries: dict[str, Entry] = {}

    def add(self, name: str, entry: Entry) -> None:
        self._entries[self._checked(name)] = entry

    @staticmethod
    def _checked(name: str) -> str:
        if name.count(".") != 1 or not all(name.split(".")):
            raise ValueError(f"query name must read domain.query, got {name!r}")
        return name

    def get(self, name: str) -> Entry:
        if self._checked(name) not in self._entries:
            raise KeyError(f"unknown query {name}; known: {', '.join(sorted(self._entries)) or 'none'}")
        return self._entries[name]

    def names(self, domain: str | None = None) -> list[str]:
        return sorted(n for n in self._entries if domain is None or n.split(".")[0] == domain)

    def run(self, spark: SparkSession, name: str, tables: dict[str, DataFrame] | None = None, **params) -> DataFrame:
        """Run the entry; SQL parameters are bound as `:name`, never spliced into the text."""
        entry = self.get(name)
        if callable(entry):
            return entry(spark, **params)
        for table, df in (tables or {}).items():
            df.createOrReplaceTempView(table)
        return spark.sql(entry, args=params)


PRICE_QUERIES = {
    "prices.history": (
        "SELECT commodity, date, open, high, low, close, volume FROM daily_prices "
        "WHERE commodity = :commodity AND date BETWEEN :start AND :end ORDER BY date"
    ),
    "prices.latest": "SELECT commodity, date, close FROM daily_prices WHERE commodity = :commodity ORDER BY date DESC LIMIT :n",
    "prices.at_date": "SELECT commodity, date, close FROM daily_prices WHERE commodity = :commodity AND date = CAST(:date AS DATE)",
    "prices.staging_count": "SELECT commodity, count(*) AS row_count, min(date) AS min_date, max(date) AS max_date FROM stg_prices GROUP BY commodity",
    "news.accepted_between": (
        "SELECT id, publish_ts, title FROM news WHERE filter_status IN ('T', 'true') "
        "AND publish_ts >= CAST(:start AS TIMESTAMP) AND publish_ts < CAST(:end AS TIMESTAMP)"
    ),
}


def default_catalog() -> QueryCatalog:
    catalog = QueryCatalog()
    for name, text in PRICE_QUERIES.items():
        catalog.add(name, text)
    return catalog
