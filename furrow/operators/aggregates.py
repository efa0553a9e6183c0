"""Group aggregates over news, forecasts and price bars.

Everything here is a partial-then-final aggregate: a key holding a third of all rows is reduced inside each task first.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from furrow.operators.windows import by_date

SENTIMENTS = ("positive", "negative", "neutral")


def daily_bars(events: DataFrame, key: str, ts: str, value: str, order: str, volume: Column | None = None) -> DataFrame:
    """Open, high, low, close and volume per key and day."""
    return events.groupBy(F.col(key).alias("commodity"), F.to_date(ts).alias("date")).agg(
        F.min_by(value, order).alias("open"), F.max(value).alias("high"), F.min(value).alias("low"),
        F.max_by(value, order).alias("close"), (volume if volume is not None else F.count(F.lit(1))).alias("volume"),
    )


def daily_news_partials(news: DataFrame, key: str = "commodity", ts: str = "publish_ts") -> DataFrame:
    """Sums per key and publish day from which any window's news features follow."""
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    impact = F.col("price_impact_score")
    return news.groupBy(key, F.to_date(ts).alias("day")).agg(
        F.count(F.lit(1)).alias("n"),
        F.count(impact).alias("n_impact"), F.sum(impact).alias("s_impact"), F.sum(impact * impact).alias("q_impact"),
        F.sum(zero("positive_score")).alias("s_pos"), F.sum(zero("negative_score")).alias("s_neg"),
        F.sum(zero("neutral_score")).alias("s_neu"),
        *[F.count_if(F.col("sentiment") == s).alias(f"n_{s}") for s in SENTIMENTS],
    )


def window_dates(daily: DataFrame, dates: DataFrame, days: int, key: str = "commodity", date_col: str = "date") -> DataFrame:
    """Daily rows paired with each of the target dates whose window [d - days, d) holds their day."""
    listed = daily.withColumn(date_col, F.explode(F.sequence(F.date_add("day", 1), F.date_add("day", days))))
    return listed.join(dates.select(key, date_col).distinct(), [key, date_col])


def news_features(news: DataFrame, dates: DataFrame, days: int = 7, key: str = "commodity", date_col: str = "date") -> DataFrame:
    """News features per target date over the days before it.

    Articles are reduced to one row per key and day before the overlapping windows are formed, so the `days`-fold
    copy is made of daily rows and never of articles.
    """
    w = window_dates(daily_news_partials(news, key), dates, days, key, date_col)
    sums = w.groupBy(key, date_col).agg(*[
        F.sum(c).alias(c) for c in
        ("n", "n_impact", "s_impact", "q_impact", "s_pos", "s_neg", "s_neu", *[f"n_{s}" for s in SENTIMENTS])
    ])
    n, m = F.col("n"), F.col("n_impact")
    mean = F.when(m > 0, F.col("s_impact") / m)
    spread = (F.col("q_impact") - F.col("s_impact") * F.col("s_impact") / m) / (m - 1)
    return sums.select(
        key, date_col, mean.alias("avg_price_impact"),
        (F.col("s_pos") / n).alias("avg_positive"), (F.col("s_neg") / n).alias("avg_negative"),
        (F.col("s_neu") / n).alias("avg_neutral"),
        F.when(m > 1, F.sqrt(F.greatest(spread, F.lit(0.0)))).otherwise(0.0).alias("impact_std"),
        n.alias("news_count"), *[F.col(f"n_{s}").alias(f"{s}_count") for s in SENTIMENTS],
    )


def vector_mean(df: DataFrame, keys: Sequence[str], vector: str, out: str = "mean_vector") -> DataFrame:
    """Element-wise mean per group with its row count; null vectors are skipped, empty groups dropped."""
    held = df.where(F.col(vector).isNotNull()).withColumn("_v", array_to_vector(F.col(vector).cast("array<double>")))
    both = Summarizer.metrics("mean", "count").summary(F.col("_v"))
    return held.groupBy(*keys).agg(both.alias("_m")).select(
        *keys, vector_to_array("_m.mean").alias(out), F.col("_m.count").alias("vector_count")
    )


def windowed_vector_mean(news: DataFrame, dates: DataFrame, vector: str, days: int = 7, key: str = "commodity",
                         ts: str = "publish_ts", date_col: str = "date", out: str = "mean_vector") -> DataFrame:
    """Vector mean over the window before each date: daily means first, then their count-weighted mean."""
    daily = vector_mean(news.withColumn("day", F.to_date(ts)), [key, "day"], vector, "_mean")
    listed = window_dates(daily, dates, days, key, date_col)
    weighted = Summarizer.metrics("mean").summary(array_to_vector("_mean"), F.col("vector_count").cast("double"))
    return listed.groupBy(key, date_col).agg(weighted.alias("_m"), F.sum("vector_count").alias("vector_count")).select(
        key, date_col, vector_to_array("_m.mean").alias(out), "vector_count"
    )


def or_zeros(vector: Column, size: int) -> Column:
    return F.coalesce(vector, F.array_repeat(F.lit(0.0), size))


def sentiment_distribution(df: DataFrame) -> DataFrame:
    """Count and share per class with the overall means beside them."""
    per_class = df.groupBy("sentiment").agg(
        F.count(F.lit(1)).alias("count"), F.count("sentiment_confidence").alias("_nc"), F.sum("sentiment_confidence").alias("_sc"),
        F.count("price_impact_score").alias("_ni"), F.sum("price_impact_score").alias("_si"),
    )
    everything = Window.partitionBy()  # at most one row per class from here on
    total = F.sum("count").over(everything)
    return per_class.select(
        "sentiment", "count", (F.col("count") / total * 100).alias("percentage"),
        (F.sum("_sc").over(everything) / F.sum("_nc").over(everything)).alias("avg_confidence"),
        (F.sum("_si").over(everything) / F.sum("_ni").over(everything)).alias("avg_price_impact"),
        total.alias("total_count"),
    )


def daily_sentiment_trend(df: DataFrame, date_col: str) -> DataFrame:
    return df.groupBy(F.to_date(date_col).alias("date")).agg(
        F.avg("price_impact_score").alias("avg_price_impact"), F.avg("sentiment_confidence").alias("avg_confidence"),
        F.count("title").alias("news_count"),
    )


def summary_ratios(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    n = F.count(F.lit(1))
    return df.groupBy(*keys).agg(
        n.alias("news_count"), *[F.round(F.count_if(F.col("sentiment") == s) / n, 3).alias(f"{s}_ratio") for s in SENTIMENTS]
    )


def dashboard_sentiment(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    pos, neg = F.avg(zero("pos_ratio")), F.avg(zero("neg_ratio"))
    return df.groupBy(*keys).agg(
        F.sum(zero("news_count")).alias("news_count"), pos.alias("pos_ratio"), neg.alias("neg_ratio"),
        ((pos - neg) * 100).alias("sentiment"),
    )


def daily_means(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.dropna(subset=["actual_price", "sentiment"]).groupBy(*keys).agg(
        F.avg("sentiment").alias("sentiment"), F.avg("actual_price").alias("actual_price"),
        F.sum("news_count").alias("news_count"),
    )


def staging_audit(df: DataFrame, key: str = "commodity", date_col: str = "date") -> DataFrame:
    return df.groupBy(key).agg(
        F.count(F.lit(1)).alias("row_count"), F.min(date_col).alias("min_date"), F.max(date_col).alias("max_date")
    )


def forecast_errors(df: DataFrame, key: str = "commodity", date_col: str = "target_date") -> DataFrame:
    """MAE, RMSE and the share of days whose forecast moved the right way from the last actual price."""
    prev = F.lag("actual_price").over(by_date(key, date_col))
    error = F.col("actual_price") - F.col("forecast_price")
    hit = (F.col("actual_price") - F.col("_prev")) * (F.col("forecast_price") - F.col("_prev")) > 0
    n = F.count(F.lit(1))
    return df.withColumn("_prev", prev).groupBy(key).agg(
        F.round(F.avg(F.abs(error)), 2).alias("mae"), F.round(F.sqrt(F.avg(error * error)), 2).alias("rmse"),
        F.round(F.when(n > 1, F.count_if(hit) / (n - 1) * 100).otherwise(0.0), 1).alias("hit_rate"),
    )


def news_alignment(df: DataFrame, key: str = "commodity", date_col: str = "target_date") -> DataFrame:
    """How often the day's sentiment has the sign of the next price move."""
    move = F.lead("actual_price").over(by_date(key, date_col)) - F.col("actual_price")
    tone, nxt = F.col("sentiment"), F.col("next_move")
    decided = (tone != 0) & (nxt != 0)
    up = (tone > 0) & nxt.isNotNull()
    return df.withColumn("next_move", move).groupBy(key).agg(
        F.count_if(decided).alias("days"),
        F.round(F.avg(F.when(decided, F.when(F.signum(tone) == F.signum(nxt), 100.0).otherwise(0.0))), 1).alias("alignment_pct"),
        F.round(F.avg(F.when(up, F.when(nxt > 0, 100.0).otherwise(0.0))), 1).alias("pos_up_pct"),
        F.round(F.avg(F.when(up, F.when(nxt < 0, 100.0).otherwise(0.0))), 1).alias("pos_down_pct"),
    )


def contribution_ranking(df: DataFrame, components: Sequence[str], top: int = 5, key: str = "commodity") -> DataFrame:
    """Components by mean absolute size. One row of averages per key is unpivoted, not the data."""
    means = df.groupBy(key).agg(*[F.avg(F.abs(c)).alias(c) for c in components])
    long = means.unpivot(key, list(components), "component", "score")
    w = Window.partitionBy(key).orderBy(F.col("score").desc(), "component")
    return long.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)


def class_weights(df: DataFrame, label: str, keys: Sequence[str] = ()) -> DataFrame:
    """Rows per class and the balanced weight total / (classes * rows)."""
    counts = df.groupBy(*keys, label).agg(F.count(F.lit(1)).alias("rows"))
    whole = Window.partitionBy(*keys)
    return counts.withColumn("weight", F.sum("rows").over(whole) / (F.count(F.lit(1)).over(whole) * F.col("rows")))


def positive_weight(df: DataFrame, label: str, keys: Sequence[str]) -> DataFrame:
    pos, neg = F.count_if(F.col(label) == 1), F.count_if(F.col(label) == 0)
    return df.groupBy(*keys).agg(F.when(pos > 0, neg / pos).otherwise(1.0).alias("scale_pos_weight"))


def confusion(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    return df.groupBy(actual, predicted).agg(F.count(F.lit(1)).alias("rows"))


def class_scores(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """Precision, recall and F1 per class, with accuracy, from the counts of the confusion table."""
    cells = confusion(df, actual, predicted)
    marks = F.explode(F.array(
        F.struct(F.col(actual).alias("label"), F.when(F.col(actual) == F.col(predicted), F.col("rows")).otherwise(0).alias("tp"),
                 F.col("rows").alias("support"), F.lit(0).cast("long").alias("claimed")),
        F.struct(F.col(predicted).alias("label"), F.lit(0).cast("long").alias("tp"), F.lit(0).cast("long").alias("support"),
                 F.col("rows").alias("claimed")),
    ))
    sums = cells.select(marks.alias("m")).select("m.*").groupBy("label").agg(
        F.sum("tp").alias("tp"), F.sum("support").alias("support"), F.sum("claimed").alias("claimed"))
    everything = Window.partitionBy()  # one row per class
    precision = F.when(F.col("claimed") > 0, F.col("tp") / F.col("claimed")).otherwise(0.0)
    recall = F.when(F.col("support") > 0, F.col("tp") / F.col("support")).otherwise(0.0)
    scored = sums.withColumns({"precision": precision, "recall": recall})
    p, r = F.col("precision"), F.col("recall")
    return scored.select(
        "label", "support", "precision", "recall", F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0).alias("f1"),
        (F.sum("tp").over(everything) / F.sum("support").over(everything)).alias("accuracy"),
    )


def regressor_availability(df: DataFrame, regressor: str, window: int, minimum: float = 0.5, key: str = "commodity",
                           date_col: str = "date") -> DataFrame:
    """Share of the training rows holding the regressor and whether the row may use it."""
    frame = by_date(key, date_col).rowsBetween(-window, -1)
    share = F.avg(F.col(regressor).isNotNull().cast("double")).over(frame)
    return df.withColumn("available", share).withColumn(
        "used", ((F.col("available") > minimum) & F.col(regressor).isNotNull()).cast("int")
    )


def latest_common_date(prices: DataFrame, news: DataFrame, price_date: str, news_date: str) -> DataFrame:
    a = prices.agg(F.max(price_date).alias("last_price"))
    b = news.agg(F.max(news_date).alias("last_news"))
    both = a.select(F.col("last_price").alias("last")).unionByName(b.select(F.col("last_news").alias("last")))
    return both.agg(F.min("last").alias("latest_common_date"))


def message_counts(messages: DataFrame, run: str = "conv_id", role: str = "role") -> DataFrame:
    return messages.groupBy(run).agg(
        F.count(F.lit(1)).alias("messages"),
        *[F.count_if(F.col(role) == r).alias(f"{r}_messages") for r in ("user", "assistant", "system", "tool")],
    )


def run_outcomes(results: DataFrame, start: str, end: str, keys: DataFrame, key: str = "commodity", date_col: str = "date") -> DataFrame:
    """Per key how many days of the range have a result and how many do not."""
    days = F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date")))
    wanted = keys.select(key).distinct().withColumn(date_col, days)
    done = results.select(key, date_col).distinct().withColumn("_done", F.lit(1))
    return wanted.join(done, [key, date_col], "left").groupBy(key).agg(
        F.count("_done").alias("succeeded"), F.count_if(F.col("_done").isNull()).alias("failed")
    )
