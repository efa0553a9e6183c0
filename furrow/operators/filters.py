"""Projections, predicates and contracts over price bars and news."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from furrow.functions.expressions import once

BAR_COLUMNS = ("commodity", "date", "open", "high", "low", "close", "ema", "volume", "ingested_at")
DEFAULT_COMMODITIES = ("corn", "soybean", "wheat")

# Term lists of the relevance score.
COMMODITY_TERMS = ["corn", "maize", "wheat", "soybean", "soybeans", "grain", "grains", "crop", "crops"]
MARKET_TERMS = [
    "price", "prices", "demand", "supply", "inventory", "stock", "stocks", "export", "import", "shipment", "cargo",
    "basis", "futures", "harvest", "yield", "acreage", "planting",
]
POLICY_CLIMATE_TERMS = [
    "usda", "united states department of agriculture", "policy", "tariff", "subsidy", "sanction", "quota",
    "regulation", "climate", "climate change", "drought", "flood", "heatwave", "el niño", "la niña",
]
EXCLUDED_TERMS = [
    "corn palace", "classic", "tournament", "basketball", "football", "match", "game", "deer", "hummingbird", "ferret",
    "dog", "cat", "pet", "wildlife", "feeder", "vaccine", "cancer", "detox", "miracle", "recipe", "cooking", "kitchen",
    "how to", "diy",
]
KEYWORD_MARKET_TERMS = ["price", "demand", "supply", "inventory"]


# --- guards (before a plan is built) -------------------------------------------------------------------------------


def check_date(value: str) -> dt.date:
    try:
        return dt.datetime.strptime(value, "%Y-%m-%d").date()
    except (TypeError, ValueError) as err:
        raise ValueError(f"date must be YYYY-MM-DD, got {value!r}") from err


def check_commodity(value: str, allowed: Sequence[str] = DEFAULT_COMMODITIES) -> str:
    name = (value or "").strip().lower()
    if name not in allowed:
        raise ValueError(f"unknown commodity {value!r}; known: {', '.join(allowed)}")
    return name


def check_days(value: int) -> int:
    if isinstance(value, bool) or not isinstance(value, int) or value <= 0:
        raise ValueError(f"days must be a positive whole number, got {value!r}")
    return value


def check_columns(df: DataFrame, required: Sequence[str], optional: Sequence[str] = ()) -> list[str]:
    """Fail when a required column is absent; return the optional ones that are."""
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"missing required columns: {', '.join(missing)}")
    return [c for c in optional if c not in df.columns]


def with_defaults(df: DataFrame, defaults: Mapping[str, Column]) -> DataFrame:
    """Add each absent column with its typed default."""
    return df.select("*", *[value.alias(name) for name, value in defaults.items() if name not in df.columns])


NEWS_DEFAULTS = {
    "description": ("", "string"),
    "all_text": ("", "string"),
    "named_entities": ("{}", "string"),
    "article_embedding": (None, "string"),
    "entity_embedding": (None, "string"),
    "triple_embedding": (None, "string"),
}


def with_news_defaults(df: DataFrame) -> DataFrame:
    return with_defaults(df, {c: F.lit(v).cast(t) for c, (v, t) in NEWS_DEFAULTS.items()})


# --- price and time-series reads -----------------------------------------------------------------------------------


def price_history(prices: DataFrame, commodity: str, start: str, end: str) -> DataFrame:
    kept = [c for c in BAR_COLUMNS if c in prices.columns]
    return (
        prices.where((F.col("commodity") == commodity) & F.col("date").between(F.lit(start), F.lit(end)))
        .select(*kept)
        .orderBy("date")
    )


def lookback(df: DataFrame, date_col: str, target: str, days: int) -> DataFrame:
    """Rows dated in [target - days, target]."""
    target_date = F.lit(target).cast("date")
    return df.where(F.col(date_col).between(F.date_sub(target_date, check_days(days)), target_date))


def forecast_frame(prices: DataFrame, commodity: str, target: str, days: int = 60) -> DataFrame:
    """Bars of the lookback renamed to the (ds, y) shape forecasters read."""
    rows = lookback(prices.where(F.col("commodity") == commodity), "date", target, days)
    extra = [c for c in ("open", "high", "low", "ema", "volume") if c in prices.columns]
    return rows.select(F.col("date").alias("ds"), F.col("close").alias("y"), *extra).orderBy("ds")


def timeseries(
    df: DataFrame,
    date_column: str,
    value_columns: str | Sequence[str] | None = None,
    start: str | None = None,
    end: str | None = None,
    where: Column | str | None = None,
    order_by: Sequence[Column | str] | None = None,
    limit: int | None = None,
) -> DataFrame:
    """Generic dated read; every part but the date column is optional."""
    if start is not None:
        df = df.where(F.col(date_column) >= F.lit(start))
    if end is not None:
        df = df.where(F.col(date_column) <= F.lit(end))
    if where is not None:
        df = df.where(where)
    df = df.orderBy(*(order_by or [date_column]))
    if limit is not None:
        df = df.limit(check_days(limit))
    if value_columns is None:
        return df
    names = [value_columns] if isinstance(value_columns, str) else list(value_columns)
    return df.select(*([] if date_column in names else [date_column]), *names)


def ordered_values(df: DataFrame, key: str, date_col: str, value: str) -> DataFrame:
    """One row per key with its values in date order. Meant for bars: one value per key and day."""
    pairs = F.array_sort(F.collect_list(F.struct(F.col(date_col), F.col(value))))
    return df.groupBy(key).agg(F.transform(pairs, lambda p: p[value]).alias("values"))


def latest_rows(df: DataFrame, key: str, order: Sequence[str], n: int) -> DataFrame:
    """The `n` newest rows per key. Spark limits each task's rows before the shuffle."""
    w = Window.partitionBy(key).orderBy(*[F.col(c).desc() for c in order])
    return df.withColumn("recency", F.row_number().over(w)).where(F.col("recency") <= check_days(n))


def price_at(prices: DataFrame, commodity: str, date: str) -> DataFrame:
    return prices.where((F.col("commodity") == commodity) & (F.col("date") == F.lit(date).cast("date")))


def cutoff_window(
    df: DataFrame, ts_col: str, base: str, days: int = 30, hour: int = 10, where: Column | str | None = None
) -> DataFrame:
    """`days` calendar days ending at the cut-off hour (UTC) of the base date."""
    base_date = F.lit(base).cast("date")
    end = F.lit(f"{base} {hour:02d}:00:00").cast("timestamp")
    ts = F.col(ts_col).cast("timestamp")
    df = df.where((ts >= F.date_sub(base_date, check_days(days) - 1).cast("timestamp")) & (ts < end))
    return df if where is None else df.where(where)


def business_day(ts: Column, hour: int = 10) -> Column:
    """Date a row counts for when each day closes at the cut-off hour."""
    return F.to_date(ts.cast("timestamp") + F.expr(f"INTERVAL '{24 - hour}' HOUR"))


def period_bounds(preset: str, as_of: Column) -> tuple[Column, Column]:
    starts = {
        "7d": F.date_sub(as_of, 6),
        "30d": F.date_sub(as_of, 29),
        "ytd": F.trunc(as_of, "year"),
        "1y": F.date_sub(as_of, 365),
    }
    if preset not in starts:
        raise ValueError(f"unknown period {preset!r}")
    return starts[preset], as_of


def in_period(df: DataFrame, date_col: str, preset: str, as_of: str) -> DataFrame:
    start, end = period_bounds(preset, F.lit(as_of).cast("date"))
    return df.where(F.col(date_col).between(start, end))


def decision_log(
    df: DataFrame, start: str, end: str, commodity: str | None = None, stage: str | None = None
) -> DataFrame:
    df = df.where(F.col("target_date").between(F.lit(start), F.lit(end)))
    if commodity:
        df = df.where(F.col("commodity") == commodity)
    if stage:
        df = df.where(F.col("stage") == stage)
    return df.orderBy("target_date", F.col("ingested_at").desc())


def keyword_equals(df: DataFrame, keyword: str, col: str = "keyword") -> DataFrame:
    return df.where(F.lower(F.col(col)) == F.lower(F.lit(keyword)))


# Which lag each commodity's volume and EMA effect is read from.
EFFECT_LAGS = {
    "corn": {"Volume": 5, "EMA": 2},
    "soybean": {"Volume": 1, "EMA": 1},
    "wheat": {"Volume": 1, "EMA": 1},
}


def uniform_effects(df: DataFrame, key: str = "commodity", lags: Mapping[str, Mapping[str, int]] = EFFECT_LAGS) -> DataFrame:
    """`volume_effect` and `ema_effect` under one name whatever lag the commodity uses."""

    def pick(kind: str) -> Column:
        chosen = F.lit(None).cast("double")
        for commodity, by_kind in lags.items():
            source = f"{kind}_lag{by_kind[kind]}_effect"
            if source in df.columns:
                chosen = F.when(F.col(key) == commodity, F.col(source)).otherwise(chosen)
        return chosen

    return df.select("*", pick("Volume").alias("volume_effect"), pick("EMA").alias("ema_effect"))


def coerce_numeric(df: DataFrame, numeric: Sequence[str], required: Sequence[str]) -> DataFrame:
    """Cast, turning what is no number into null, then drop rows lacking a required value."""
    casts = {c: F.col(c).try_cast("double") for c in numeric if c in df.columns}
    return df.withColumns(casts).dropna(subset=[c for c in required if c in df.columns])


FORECAST_OUTPUTS = ("ds", "y", "direction", "y_change", "yhat_lower", "yhat_upper", "EMA", "Volume")


def feature_columns(df: DataFrame, excluded: Sequence[str] = FORECAST_OUTPUTS) -> list[str]:
    return [c for c in df.columns if c not in excluded]


# --- news predicates -----------------------------------------------------------------------------------------------


def accepted(df: DataFrame, col: str = "filter_status") -> DataFrame:
    return df.where(F.col(col).isin("T", "true")) if col in df.columns else df


def any_term(text: Column, terms: Sequence[str]) -> Column:
    """True when a term occurs in the text. Plain searches beat one alternation; a term holding another is implied."""
    needed = [t for t in terms if not any(other != t and other in t for other in terms)]
    return reduce(lambda a, b: a | b, [text.contains(t) for t in needed])


def keyword_gate(df: DataFrame, commodity: str = "corn", pattern: str | None = None, col: str = "key_word") -> DataFrame:
    """Keep rows whose key word names the commodity and a market term, or matches the given pattern."""
    if col not in df.columns:
        return df
    if pattern is not None:
        hit = F.col(col).rlike(f"(?i){pattern}")
    else:
        lowered = F.lower(F.col(col))
        hit = lowered.contains(commodity) & any_term(lowered, KEYWORD_MARKET_TERMS)
    return df.where(F.coalesce(hit, F.lit(False)))


def keyword_any_of(df: DataFrame, expression: str, col: str = "key_word") -> DataFrame:
    """Exact match, ignoring case, with one of the parts between ` OR `."""
    parts = [p.strip().lower() for p in expression.split(" OR ") if p.strip()] or [expression.lower()]
    return df.where(F.lower(F.col(col)).isin(*parts))


def relevance_score(title: Column, description: Column) -> Column:
    text = F.lower(F.concat(F.coalesce(title, F.lit("")), F.lit(" "), F.coalesce(description, F.lit(""))))

    def score(t: Column) -> Column:
        points = (
            F.when(any_term(t, COMMODITY_TERMS), 2).otherwise(0)
            + F.when(any_term(t, MARKET_TERMS), 1).otherwise(0)
            + F.when(any_term(t, POLICY_CLIMATE_TERMS), 2).otherwise(0)
        )
        return F.when(any_term(t, EXCLUDED_TERMS), 0).otherwise(points)

    return once(text, score)  # the lower-cased text is made once, not once per term


def with_relevance_score(df: DataFrame, title: str, description: str, out: str = "score") -> DataFrame:
    """The score as a generated column: filters on it then read the value instead of searching the text again."""
    return df.select("*", F.explode(F.array(relevance_score(F.col(title), F.col(description)))).alias(out))


def relevance_gate(df: DataFrame, score: str = "score", status: str = "filter_status") -> DataFrame:
    """Score 3 passes to the extractor; keep what it accepts or what scores 5, marked T."""
    keep = (F.col(score) >= 3) & ((F.col(status) == "T") | (F.col(score) >= 5))
    return df.where(keep).withColumn(status, F.lit("T"))
