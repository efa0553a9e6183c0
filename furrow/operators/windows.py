"""Ordered functions over daily series.

A series is one key's bars, unique per day, so its length is bounded by the calendar; work spreads over keys.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def by_date(key: str | Sequence[str], date_col: str) -> WindowSpec:
    keys = [key] if isinstance(key, str) else list(key)
    return Window.partitionBy(*keys).orderBy(date_col)


def upto_now(w: WindowSpec) -> WindowSpec:
    return w.rowsBetween(Window.unboundedPreceding, Window.currentRow)


# Row lags that feed each commodity's forecast.
LAG_PLAN = {
    "corn": {"soybean_close": 8, "ema": 2, "volume": 5},
    "soybean": {"corn_close": 6, "wheat_close": 1, "ema": 1, "volume": 1},
    "wheat": {"corn_close": 2, "soybean_close": 1, "ema": 1, "volume": 1},
}


def lag_features(df: DataFrame, commodity: str, date_col: str = "date", key: str = "commodity",
                 plan: Mapping[str, Mapping[str, int]] = LAG_PLAN) -> DataFrame:
    """Row-lagged regressors of one commodity; rows without the EMA and volume lags are dropped."""
    w = by_date(key, date_col)
    lags = plan[commodity]
    named = {f"{c}_lag{n}": F.lag(c, n).over(w) for c, n in lags.items()}
    own = [f"{c}_lag{n}" for c, n in lags.items() if c in ("ema", "volume")]
    return df.where(F.col(key) == commodity).withColumns(named).dropna(subset=own)


def next_bar_target(df: DataFrame, threshold: float, classes: int = 2, ahead: int = 1, key: str = "commodity",
                    date_col: str = "date", price: str = "close") -> DataFrame:
    """Label by the move to the bar `ahead` rows on; rows without one are dropped.

    Two classes: 1 above close * (1 + threshold). Three: 1 above, 0 below, 2 within the band.
    """
    w = by_date(key, date_col)
    target, now, band = F.col("target_close"), F.col(price), abs(threshold)
    if classes == 2:
        label = F.when(target > now * (1 + threshold), 1).otherwise(0)
    else:
        label = F.when(target > now * (1 + band), 1).when(target < now * (1 - band), 0).otherwise(2)
    return (
        df.withColumn("target_close", F.lead(price, ahead).over(w))
        .where(target.isNotNull())
        .withColumns({"label": label, "price_change": (target - now) / now})
    )


def down_target(df: DataFrame, threshold: float, compat: bool = False, price: str = "close") -> DataFrame:
    """Label of the drop model: 1 when the next bar falls by the threshold. `compat` gives the inverse coding."""
    fell = F.col("target_close") < F.col(price) * (1 - threshold)
    label = F.when(fell, 0 if compat else 1).otherwise(1 if compat else 0)
    return df.withColumn("label", label)


def direction_target(df: DataFrame) -> DataFrame:
    """Change to the next value, its sign and the forecast band width; flat rows are dropped."""
    change = F.col("y_next") - F.col("y")
    return (
        df.withColumn("y_change", change)
        .where(F.col("y_change") != 0)
        .withColumns({
            "direction": F.when(F.col("y_change") > 0, 1).otherwise(0),
            "volatility": F.col("yhat_upper") - F.col("yhat_lower"),
        })
    )


def ema(df: DataFrame, value: str, period: int = 20, key: str = "commodity", date_col: str = "date",
        out: str = "ema") -> DataFrame:
    """Exponential moving average seeded with the first value, alpha = 2 / (period + 1).

    Solved in blocks so that it stays a running sum: inside a block the recursion is a sum scaled by powers of
    the decay, and a block receives the end value of the one before. A block is long enough that what is older
    weighs less than 1e-35, and short enough that the scaling cannot overflow.
    """
    alpha = 2.0 / (period + 1)
    decay = 1.0 - alpha
    block = math.ceil(80.0 / -math.log(decay))
    w = by_date(key, date_col)
    in_block = upto_now(Window.partitionBy(key, "_block").orderBy(date_col))
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    weight = F.when(F.col("_i") == 0, 1.0).otherwise(alpha)
    return (
        df.withColumn("_i", F.row_number().over(w) - 1)
        .withColumns({"_block": F.floor(F.col("_i") / block), "_pos": F.col("_i") % block})
        .withColumn("_local", F.sum(weight * F.col(value) * F.pow(F.lit(decay), -F.col("_pos"))).over(in_block)
                    * F.pow(F.lit(decay), F.col("_pos")))
        .withColumn("_carry", F.last(F.when(F.col("_pos") == block - 1, F.col("_local")), ignorenulls=True).over(before))
        .withColumn(out, F.col("_local") + F.coalesce(F.col("_carry") * F.pow(F.lit(decay), F.col("_pos") + 1), F.lit(0.0)))
        .drop("_i", "_block", "_pos", "_local", "_carry")
    )


def trailing_mean(df: DataFrame, value: str, rows: int, out: str, key: str = "commodity", date_col: str = "date") -> DataFrame:
    return df.withColumn(out, F.avg(value).over(by_date(key, date_col).rowsBetween(-(rows - 1), 0)))


def returns(df: DataFrame, value: str, key: str | Sequence[str] = "commodity", date_col: str = "date") -> DataFrame:
    """Change from the row before and to the row after, as ratios."""
    w = by_date(key, date_col)
    now, prev, nxt = F.col(value), F.lag(value).over(w), F.lead(value).over(w)
    return df.withColumns({
        "pct_change": F.when(prev != 0, now / prev - 1),
        "next_return": F.when(now != 0, nxt / now - 1),
    })


def cumulative_product(factor: Column, w: WindowSpec) -> Column:
    """Running product; logs carry the size, zero and sign are counted apart so that any factor is allowed."""
    run = upto_now(w)
    zeros = F.sum(F.when(factor == 0, 1).otherwise(0)).over(run)
    negatives = F.sum(F.when(factor < 0, 1).otherwise(0)).over(run)
    size = F.exp(F.sum(F.when(factor != 0, F.ln(F.abs(factor))).otherwise(0.0)).over(run))
    return F.when(zeros > 0, 0.0).otherwise(F.when(negatives % 2 == 1, -size).otherwise(size))


def drawdown(df: DataFrame, equity: str, key: str | Sequence[str], date_col: str, out: str = "drawdown") -> DataFrame:
    peak = F.max(equity).over(upto_now(by_date(key, date_col)))
    return df.withColumn(out, F.when(peak != 0, (F.col(equity) - peak) / peak))


def rebased(df: DataFrame, value: str, out: str, key: str | Sequence[str] = "commodity", date_col: str = "date") -> DataFrame:
    """Index with the first value at 100; a first value of zero counts as one."""
    base = F.first(value).over(upto_now(by_date(key, date_col)))
    return df.withColumn(out, F.col(value) / F.when(base == 0, 1.0).otherwise(base) * 100)


def latest_per(df: DataFrame, keys: Sequence[str], newest: Sequence[str]) -> DataFrame:
    """The newest row per key as one aggregate, so copies of a hot key meet inside their own task first."""
    whole = F.struct(*df.columns)
    return df.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(
        F.max_by(whole, F.struct(*newest)).alias("_row")
    ).select("_row.*")


def walk_forward_index(df: DataFrame, window: int, start: str | None = None, end: str | None = None, gap: int = 1,
                       key: str = "commodity", date_col: str = "date") -> DataFrame:
    """Per test row the row range it trains on: rows [i - window, i) for test row i + gap."""
    w = by_date(key, date_col)
    whole = Window.partitionBy(key)
    origin = F.col("idx") - gap
    bounds = df.select(key, date_col).withColumns({
        "idx": F.row_number().over(w) - 1,
        "n": F.count(F.lit(1)).over(whole),
    })
    first = F.min(F.when(F.col(date_col) >= F.lit(start), F.col("idx"))).over(whole) if start else F.lit(0)
    last = F.max(F.when(F.col(date_col) <= F.lit(end), F.col("idx"))).over(whole) if end else F.col("n") - 1
    return (
        bounds.withColumns({"_first": first, "_last": last})
        .where((origin >= F.greatest(F.lit(window), F.col("_first"))) & (origin <= F.least(F.col("_last"), F.col("n") - 2)))
        .select(
            key, F.col(date_col).alias("test_date"), F.col("idx").alias("test_idx"), origin.alias("origin"),
            F.greatest(F.lit(0), origin - window).alias("train_from"), origin.alias("train_to"),
        )
    )


def sliding_split(df: DataFrame, target: str, window: int = 1500, train_share: float = 0.8, min_rows: int = 400,
                  key: str = "commodity", date_col: str = "date") -> DataFrame:
    """Rows before the target day marked train or val, the target row test. A key with too few rows is left out."""
    w = by_date(key, date_col)
    indexed = df.where(F.col(date_col) <= F.lit(target)).withColumn("idx", F.row_number().over(w) - 1)
    t = F.max(F.when(F.col(date_col) == F.lit(target), F.col("idx"))).over(Window.partitionBy(key))
    start = F.greatest(F.lit(0), F.col("_t") - window)
    cut = start + F.floor((F.col("_t") - start) * train_share)
    split = F.when(F.col("idx") == F.col("_t"), "test").when(F.col("idx") < cut, "train").otherwise("val")
    return (
        indexed.withColumn("_t", t)
        .where(F.col("_t").isNotNull() & (F.col("_t") >= min_rows) & (F.col("idx") >= start))
        .withColumn("split", split)
        .drop("_t")
    )


def sliding_splits(df: DataFrame, targets: DataFrame, window: int = 1500, train_share: float = 0.8, min_rows: int = 400,
                   key: str = "commodity", date_col: str = "date", target_col: str = "target_date") -> DataFrame:
    """`sliding_split` for many target days at once: a row comes once for each target (key, date) whose window it lies in.

    Rows and targets meet in blocks of `window` rows of a key: a target finds its window in its own block and the one before.
    """
    at = by_date(key, date_col)
    indexed = df.withColumn("idx", F.row_number().over(at) - 1)
    asked = indexed.select(key, date_col, F.col("idx").alias("_t")).join(targets.select(key, date_col).distinct(), [key, date_col])
    asked = asked.where(F.col("_t") >= min_rows).select(
        key, F.col(date_col).alias(target_col), "_t", F.floor(F.col("_t") / window).alias("_block"))
    block = F.floor(F.col("idx") / window)
    start = F.greatest(F.lit(0), F.col("_t") - window)
    cut = start + F.floor((F.col("_t") - start) * train_share)
    split = F.when(F.col("idx") == F.col("_t"), "test").when(F.col("idx") < cut, "train").otherwise("val")
    met = indexed.withColumn("_block", F.explode(F.array(block, block + 1))).join(asked, [key, "_block"])
    return met.where((F.col("idx") <= F.col("_t")) & (F.col("idx") >= start)).withColumn("split", split).drop("_t", "_block")


def chronological_split(df: DataFrame, key: str = "commodity", date_col: str = "date", train_share: float = 0.8,
                        val_share: float = 0.0) -> DataFrame:
    """The first rows of a key marked train, the others test; with `val_share`, the last of the training rows are marked val."""
    w, whole = by_date(key, date_col), Window.partitionBy(key)
    position = F.row_number().over(w)
    cut = F.floor(F.count(F.lit(1)).over(whole) * train_share)
    fitted = F.floor(cut * (1 - val_share))
    return df.withColumn("split", F.when(position <= fitted, "train").when(position <= cut, "val").otherwise("test"))


def scaled_size(df: DataFrame, value: str, out: str, key: str = "commodity", span: float = 42, base: float = 8) -> DataFrame:
    """Marker size: share of the key's largest value, scaled to [base, base + span]."""
    top = F.greatest(F.max(value).over(Window.partitionBy(key)).cast("double"), F.lit(1.0))
    return df.withColumn(out, F.col(value) / top * span + base)
