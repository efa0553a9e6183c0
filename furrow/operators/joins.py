"""Equi, interval, as-of, bridge and merge joins."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def other_closes(bars: DataFrame, names: Mapping[str, str], date_col: str = "date", key: str = "commodity") -> DataFrame:
    """Bars with the same-day close of other commodities beside them, `names` mapping key value to column prefix.

    One pivot aggregate instead of a self-join per commodity; its result has one row per day.
    """
    closes = bars.where(F.col(key).isin(*names)).groupBy(date_col).pivot(key, list(names)).agg(F.first("close"))
    closes = closes.select(date_col, *[F.col(f"`{k}`").alias(f"{prefix}_close") for k, prefix in names.items()])
    return bars.join(closes, date_col, "left")


def news_windows(news: DataFrame, dates: DataFrame, days: int = 7, key: str = "commodity", ts: str = "publish_ts",
                 date_col: str = "date") -> DataFrame:
    """Interval join: news with target date d - days <= publish < d.

    d is a midnight, so an article belongs to the `days` dates after its own: those are listed per article and met
    by equality, which keeps the join linear. The date rows carry the hash of nothing but (key, date); a hot key is
    spread over its dates.
    """
    published = F.to_date(ts)
    targets = F.sequence(F.date_add(published, 1), F.date_add(published, days))
    listed = news.withColumn(date_col, F.explode(targets))
    return listed.join(dates.select(key, date_col).distinct(), [key, date_col])


def price_reaction(bars: DataFrame, base_dates: DataFrame, offsets: Sequence[int] = (0, 1, 3), key: str = "commodity",
                   date_col: str = "date", base_col: str = "base_date") -> DataFrame:
    """Close on the first trading day on or after each base date and on later trading rows, one row per offset.

    Each trading row first carries its own later closes; base dates and trading rows are then lined up in one ordered
    pass, where a base date takes the next trading row at or after it. Missing offsets give no row.
    """
    w = Window.partitionBy(key).orderBy(date_col)
    later = F.array(*[
        F.struct(F.lit(n).alias("offset_days"), F.lead(date_col, n).over(w).alias("trade_date"),
                 F.lead("close", n).over(w).alias("close"))
        for n in offsets
    ])
    trading = bars.select(key, F.col(date_col), later.alias("later"), F.lit(1).alias("is_bar"))
    asked = base_dates.select(key, F.col(base_col).alias(date_col)).distinct()
    asked = asked.withColumns({"later": F.lit(None).cast(trading.schema["later"].dataType), "is_bar": F.lit(0)})
    # Walking back in time makes "the next bar" a running last value; at equal dates the bar is met first.
    ahead = Window.partitionBy(key).orderBy(F.col(date_col).desc(), F.col("is_bar").desc())
    ahead = ahead.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        trading.unionByName(asked)
        .withColumn("later", F.last("later", ignorenulls=True).over(ahead))
        .where(F.col("is_bar") == 0)
        .select(key, F.col(date_col).alias(base_col), F.inline("later"))
        .where(F.col("trade_date").isNotNull())
    )


def attach_reaction(articles: DataFrame, reaction: DataFrame, offsets: Sequence[int] = (0, 1, 3), key: str = "commodity",
                    date_col: str = "publish_date") -> DataFrame:
    """Articles with one price column per offset; null where no price is known."""
    wide = reaction.groupBy(key, F.col("base_date").alias(date_col)).agg(
        *[F.max(F.when(F.col("offset_days") == n, F.col("close"))).alias(f"price_{n}") for n in offsets]
    )
    return articles.join(wide, [key, date_col], "left")


def article_dates(bridge: DataFrame, news: DataFrame, hash_ids: DataFrame, target: str, min_age: int = 4) -> DataFrame:
    """Distinct (text, date) of the articles mapped to the wanted hashes and at least `min_age` days old."""
    wanted = bridge.join(hash_ids.select("hash_id").distinct(), "hash_id", "left_semi")
    old = F.col("publish_date") <= F.date_sub(F.lit(target).cast("date"), min_age)
    return (
        wanted.select("article_id").distinct()
        .join(news.where(F.col("publish_date").isNotNull() & old), F.col("article_id") == F.col("id"))
        .select("description", "publish_date").distinct()
    )


def with_daily_sentiment(forecasts: DataFrame, sentiment: DataFrame, on: Sequence[str] = ("commodity", "target_date")) -> DataFrame:
    return forecasts.join(sentiment, list(on), "left")


def decisions_with_prices(decisions: DataFrame, prices: DataFrame, key: str = "commodity", date_col: str = "target_date") -> DataFrame:
    """Decisions that have a price on their day; repeated price rows count once, the lowest wins."""
    once = prices.where(F.col("actual_price").isNotNull()).groupBy(key, date_col).agg(F.min("actual_price").alias("actual_price"))
    return decisions.join(once, [key, date_col])


def embedding_lookup(texts: DataFrame, vectors: DataFrame, text_col: str = "text") -> DataFrame:
    """Vector of each distinct text, null where none is stored; empty vectors do not count."""
    stored = vectors.where(F.size("embedding") > 0)
    one = stored.groupBy(text_col).agg(F.min_by("embedding", "hash_id").alias("embedding"), F.min("hash_id").alias("hash_id"))
    return texts.select(text_col).distinct().join(one, text_col, "left")


def unseen(batch: DataFrame, existing: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Rows of the batch whose key is new, the first of each key."""
    from furrow.operators.sets import first_wins

    return first_wins(batch, keys, order).join(existing.select(*keys), list(keys), "left_anti")


def merge_rows(target: DataFrame, staged: DataFrame, keys: Sequence[str], updated: Sequence[str], stamp: str = "ingested_at") -> DataFrame:
    """Upsert: staged values replace matched rows, unmatched staged rows are added.

    Presence decides, not null: a staged null does overwrite. Staged rows repeating a key are an error, raised
    inside the job rather than by a separate pass over the data.
    """
    source = staged.groupBy(*keys).agg(
        *[F.first(c).alias(f"_s_{c}") for c in updated], F.count(F.lit(1)).alias("_copies")
    )
    source = source.withColumn(
        "_staged", F.when(F.col("_copies") > 1, F.raise_error(F.lit("staged rows repeat a key")).cast("boolean")).otherwise(F.lit(True))
    )
    known = target.withColumn("_known", F.lit(True))
    joined = known.join(source, list(keys), "full_outer")
    took = F.coalesce(F.col("_staged"), F.lit(False))
    columns = [F.col(k) for k in keys]
    columns += [F.when(took, F.col(f"_s_{c}")).otherwise(F.col(c)).alias(c) for c in updated]
    columns += [F.when(took, F.current_timestamp()).otherwise(F.col(stamp)).alias(stamp)]
    action = F.when(~took, "kept").when(F.col("_known").isNull(), "inserted").otherwise("updated")
    return joined.select(*columns, action.alias("merge_action"))
