"""Declared schemas; nothing is inferred from files."""

from __future__ import annotations

from pyspark.sql import types as T

DAILY_PRICES = (
    "commodity STRING, date DATE, open DOUBLE, high DOUBLE, low DOUBLE, close DOUBLE, "
    "ema DOUBLE, volume BIGINT, ingested_at TIMESTAMP"
)
STAGED_PRICES = (
    "commodity STRING, date DATE, open DOUBLE, high DOUBLE, low DOUBLE, close DOUBLE, ema DOUBLE, volume BIGINT"
)
PRICE_CSV = "time STRING, open DOUBLE, high DOUBLE, low DOUBLE, close DOUBLE, EMA DOUBLE, Volume BIGINT"
NEWS_CSV = (
    "id STRING, publish_date STRING, title STRING, filter_status STRING, key_word STRING, description STRING, "
    "all_text STRING, article_embedding STRING, entity_embedding STRING, triple_embedding STRING, named_entities STRING"
)
RAW_NEWS = (
    "id STRING, title STRING, doc_url STRING, all_text STRING, authors STRING, publish_date STRING, "
    "meta_site_name STRING, description STRING, key_word STRING, collected_at STRING, filter_status STRING, "
    "named_entities ARRAY<STRING>, triples ARRAY<ARRAY<STRING>>, article_embedding ARRAY<DOUBLE>"
)
NEWS_TABLE = (
    "id STRING, title STRING, doc_url STRING, all_text STRING, authors STRING, publish_date STRING, "
    "meta_site_name STRING, key_word STRING, filter_status STRING, description STRING, named_entities STRING, "
    "triples STRING, article_embedding STRING"
)
TEXT_VECTORS = "hash_id STRING, text STRING, embedding ARRAY<DOUBLE>"
TIMESERIES_PREDICTION = (
    "commodity STRING, target_date DATE, forecast_direction STRING, confidence_score DOUBLE, created_at TIMESTAMP"
)
NEWS_PREDICTION = (
    "commodity STRING, target_date DATE, prediction BIGINT, probability DOUBLE, confidence DOUBLE, "
    "features_summary STRING, evidence_news STRING, created_at TIMESTAMP"
)
SENTIMENT_RATIOS = "date DATE, news_count BIGINT, pos_ratio DOUBLE, neg_ratio DOUBLE, keyword STRING"
DECISION_META = (
    "ingested_at TIMESTAMP, target_date DATE, commodity STRING, stage STRING, recommendation STRING, p_buy DOUBLE, "
    "p_hold DOUBLE, p_sell DOUBLE, rationale_short STRING, warnings STRING"
)


def struct(ddl: str) -> T.StructType:
    return T._parse_datatype_string(ddl) if hasattr(T, "_parse_datatype_string") else T.StructType.fromDDL(ddl)


def column_names(ddl: str) -> list[str]:
    """Names in a flat DDL string, in order (no session needed)."""
    names, depth, part = [], 0, ""
    for ch in ddl + ",":
        depth += (ch == "<") - (ch == ">")
        if ch == "," and depth == 0:
            names.append(part.strip().split(" ", 1)[0])
            part = ""
        else:
            part += ch
    return names
