"""Daily run: every commodity in one plan, three tables written from one result."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from furrow.plans.market_report import sentiment_ratios
from furrow.session import cut_lineage
from furrow.sources import writers as W


def publish(directions: DataFrame, reports: DataFrame, root: str) -> None:
    """Write time-series predictions, news predictions and sentiment ratios. Days run again replace their slices."""
    reports = cut_lineage(reports)  # feeds two of the three tables
    p = F.col("prediction")
    news = reports.select(
        "commodity", F.col("metadata.prediction_date").alias("target_date"), p["direction"].alias("direction"),
        F.greatest(p["probabilities"]["up"], p["probabilities"]["down"], p["probabilities"]["stable"]).alias("probability"), p["confidence"].alias("confidence"),
        F.col("market_analysis").alias("features_summary"), F.col("evidence").alias("evidence_news"))
    slots = ["target_date"]
    W.replace_slices(W.timeseries_predictions(directions).repartition("target_date"), f"{root}/prediction_timeseries", slots)
    W.replace_slices(W.news_predictions(news).repartition("target_date"), f"{root}/prediction_news_sentiment", slots)
    W.replace_slices(sentiment_ratios(reports).repartition("date"), f"{root}/sentiment_result_pos_neg", ["date", "keyword"])
