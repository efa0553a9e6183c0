"""Price events as a stream: days closing at the cut-off hour, running averages and loads with quarantine."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator, Mapping

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from furrow.operators import windows as W
from furrow.operators.joins import merge_rows
from furrow.sources.writers import split_bad_rows
from furrow.streaming.news import write_batch

EPOCH = dt.date(1970, 1, 1)


def cutoff_days(stream: DataFrame, ts: str, key: str, value: str, hour: int = 10, delay: str = "1 hour") -> DataFrame:
    """Count and sum per key and day, a day closing at the cut-off hour; later events count for the next one."""
    timed = stream.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", delay)
    days = F.window("_ts", "1 day", startTime=f"{hour} hours")
    out = timed.groupBy(days, key).agg(F.count(F.lit(1)).alias("events"), F.sum(value).alias("total"))
    return out.select(F.to_date("window.end").alias("business_date"), key, "events", "total")


def running_ema(stream: DataFrame, period: int = 20, key: str = "commodity", date_col: str = "date", value: str = "close",
                horizon: int | None = None) -> DataFrame:
    """EMA of each bar in date order, whatever order the bars arrive in.

    A key's state is its bars by date with their averages. A bar later than all others costs one step. A late bar, or a new
    price for a day, changes the averages from its date on: these rows are given again, with a greater `revision`, and
    `latest_revision` takes the last of each day. The state has a bar a day (a century is 36 500). With `horizon`, only
    the bars of that many days before a key's last are kept; a bar from before them cannot enter any more and is given with a null average.
    Of a day's bars in one batch the greatest price counts; bars without a date or a price are none.
    """
    alpha = 2.0 / (period + 1)
    names = [key, date_col, value, "ema", "revision"]

    def update(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        closed, base, held, revision = state.get if state.exists else (None, None, b"", 0)
        days, prices, emas = np.frombuffer(held).reshape(3, -1)
        revision += 1
        arrived: dict[int, float] = {}
        for pdf in batches:
            for day, price in pdf.groupby("_day")[value].max().items():
                arrived[day] = max(price, arrived.get(day, price))
        new = np.array(sorted(arrived), dtype=float)
        early = new[new <= closed] if closed is not None else new[:0]
        new = new[len(early):]
        if len(new):
            kept = ~np.isin(days, new)
            first = int(np.searchsorted(days, new[0]))  # all averages before it stand
            joined = np.concatenate([days[kept], new])
            order = np.argsort(joined)
            days = joined[order]
            prices = np.concatenate([prices[kept], [arrived[d] for d in new]])[order]
            last = emas[first - 1] if first else base
            emas = np.concatenate([emas[:first], np.empty(len(days) - first)])
            for i in range(first, len(days)):
                last = prices[i] if last is None else alpha * prices[i] + (1 - alpha) * last
                emas[i] = last
        else:
            first = len(days)
        at = np.concatenate([early, days[first:]])
        out = pd.DataFrame({
            key: group[0], date_col: [EPOCH + dt.timedelta(days=int(d)) for d in at],
            value: np.concatenate([[arrived[d] for d in early], prices[first:]]),
            "ema": pd.array([None] * len(early) + emas[first:].tolist(), dtype="Float64"), "revision": revision}, columns=names)
        if horizon is not None and len(days):
            cut = int(np.searchsorted(days, days[-1] - horizon))
            if cut:
                closed, base = float(days[cut - 1]), float(emas[cut - 1])
                days, prices, emas = days[cut:], prices[cut:], emas[cut:]
        state.update((closed, base, np.stack([days, prices, emas]).tobytes(), revision))
        yield out

    whole = stream.where(F.col(date_col).isNotNull() & F.col(value).isNotNull() & ~F.isnan(value))
    dated = whole.select(key, F.col(value).cast("double").alias(value), F.datediff(date_col, F.lit(str(EPOCH)).cast("date")).alias("_day"))
    return dated.groupBy(key).applyInPandasWithState(
        update, f"{key} STRING, {date_col} DATE, {value} DOUBLE, ema DOUBLE, revision BIGINT",
        "closed DOUBLE, base DOUBLE, held BINARY, revision BIGINT", "append", GroupStateTimeout.NoTimeout)


def latest_revision(emitted: DataFrame, key: str = "commodity", date_col: str = "date") -> DataFrame:
    """The last row of each day among those that `running_ema` gave, by a partial aggregate."""
    rest = [c for c in emitted.columns if c not in (key, date_col)]
    last = emitted.groupBy(key, date_col).agg(F.max_by(F.struct(*rest), "revision").alias("_last"))
    return last.select(key, date_col, "_last.*")


def daily_bar(history: DataFrame, bars: DataFrame, date: str, period: int = 20) -> DataFrame:
    """Batch form: the EMA over all history up to the day, and the price table with that day's bar merged in.

    A day without a bar leaves the table as it is.
    """
    upto = W.ema(history.where(F.col("date") <= F.lit(date)), "close", period)
    today = upto.where(F.col("date") == F.lit(date))
    updated = [c for c in bars.columns if c not in ("commodity", "date", "ingested_at")]
    return merge_rows(bars, today, ["commodity", "date"], updated)


def load_checked(stream: DataFrame, rules: Mapping[str, Column], good_path: str, bad_path: str, checkpoint: str) -> StreamingQuery:
    """Rows that keep the rules into one table, the others with what they break into another."""

    def load(batch: DataFrame, batch_id: int) -> None:
        good, bad = split_bad_rows(batch, rules)
        write_batch(good, good_path, batch_id)
        write_batch(bad, bad_path, batch_id)

    return stream.writeStream.foreachBatch(load).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
