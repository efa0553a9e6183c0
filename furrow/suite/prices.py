"""Price bars: reads, lags, averages, returns, as-of reactions and splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from furrow.operators import aggregates as A
from furrow.operators import filters as P
from furrow.operators import joins as J
from furrow.operators import sets as S
from furrow.operators import topk as K
from furrow.operators import windows as W
from furrow.suite import query
from furrow.suite.views import view, with_views

CORN, SOY, WHEAT = "1-URGENT", "2-HIGH", "3-MEDIUM"
NAMES = {CORN: "corn", SOY: "soybean", WHEAT: "wheat"}
D = "CAST(date AS STRING) AS date"
LONG = with_views("px_long")
DAILY = with_views("px_daily")


def day(df, *cols):
    """Dates as text, so that both engines print them alike."""
    return df.withColumns({c: F.col(c).cast("string") for c in cols or ("date",)})


@query("daily_bars__src9", DAILY + f" SELECT commodity, {D}, open, high, low, close, volume FROM px_daily")
def _(spark, sf):
    bars = A.daily_bars(view(spark, sf, "events"), "event_type", "ts", "value", "event_id")
    return day(bars)


@query("bar_history__src8", LONG + f""", r AS (SELECT *, row_number() OVER (PARTITION BY commodity ORDER BY date DESC) AS recency FROM px_long)
SELECT commodity, {D}, close, recency FROM r WHERE recency <= 60""")
def _(spark, sf):
    period = 20
    bars = P.latest_rows(view(spark, sf, "px_long"), "commodity", ["date"], max(period * 3, 60))
    return day(bars.select("commodity", "date", "close", "recency"))


@query("price_history__flt1", LONG + f""" SELECT commodity, {D}, open, high, low, close, volume FROM px_long
WHERE commodity = '{CORN}' AND date BETWEEN DATE '1996-01-01' AND DATE '1997-12-31'""")
def _(spark, sf):
    return day(P.price_history(view(spark, sf, "px_long"), CORN, "1996-01-01", "1997-12-31"))


@query("forecast_frame__flt2", LONG + f""" SELECT CAST(date AS STRING) AS ds, close AS y, open, high, low, volume FROM px_long
WHERE commodity = '{SOY}' AND date BETWEEN DATE '1997-06-01' - 60 AND DATE '1997-06-01'""")
def _(spark, sf):
    return day(P.forecast_frame(view(spark, sf, "px_long"), SOY, "1997-06-01", 60), "ds")


@query("timeseries_read__flt3", LONG + f""" SELECT {D}, close, volume FROM px_long
WHERE date >= DATE '1995-01-01' AND date <= DATE '1998-12-31' AND volume > 1""")
def _(spark, sf):
    return day(P.timeseries(view(spark, sf, "px_long"), "date", ["close", "volume"], "1995-01-01", "1998-12-31", "volume > 1"))


@query("ordered_values__flt4", LONG + """ SELECT commodity, row_number() OVER (PARTITION BY commodity ORDER BY date) - 1 AS pos, close AS value FROM px_long""")
def _(spark, sf):
    lists = P.ordered_values(view(spark, sf, "px_long"), "commodity", "date", "close")
    return lists.select("commodity", F.posexplode("values").alias("pos", "value")).withColumn("pos", F.col("pos").cast("long"))


@query("latest_bars__flt5", LONG + f""", r AS (SELECT *, row_number() OVER (PARTITION BY commodity ORDER BY date DESC) AS recency FROM px_long)
SELECT commodity, {D}, close, recency FROM r WHERE recency <= 10""")
def _(spark, sf):
    return day(P.latest_rows(view(spark, sf, "px_long"), "commodity", ["date"], 10).select("commodity", "date", "close", "recency"))


@query("price_at_date__flt6", DAILY + f" SELECT commodity, {D}, close FROM px_daily WHERE commodity = 'view' AND date = DATE '2024-01-15'")
def _(spark, sf):
    return day(P.price_at(view(spark, sf, "px_daily"), "view", "2024-01-15").select("commodity", "date", "close"))


@query("lookback_rows__flt7", LONG + f" SELECT commodity, {D}, close FROM px_long WHERE date BETWEEN DATE '1997-03-31' - 30 AND DATE '1997-03-31'")
def _(spark, sf):
    return day(P.lookback(view(spark, sf, "px_long"), "date", "1997-03-31", 30).select("commodity", "date", "close"))


@query("cutoff_window__flt8", """SELECT event_id, event_type, value FROM events
WHERE CAST(ts AS DATE) >= DATE '2024-01-20' - 6 AND ts < TIMESTAMP '2024-01-20 10:00:00' AND value > 5""")
def _(spark, sf):
    rows = P.cutoff_window(view(spark, sf, "events"), "ts", "2024-01-20", 7, where="value > 5")
    return rows.select("event_id", "event_type", "value")


@query("effects_under_one_name__flt23", LONG + """ SELECT CASE commodity WHEN '1-URGENT' THEN 'corn' WHEN '2-HIGH' THEN 'soybean' ELSE 'wheat' END AS commodity,
CAST(date AS STRING) AS date, CASE WHEN commodity = '1-URGENT' THEN open * 0.5 ELSE open * 0.25 END AS volume_effect,
CASE WHEN commodity = '1-URGENT' THEN close * 0.5 ELSE close * 0.25 END AS ema_effect FROM px_long WHERE commodity IN ('1-URGENT', '2-HIGH', '3-MEDIUM')""")
def _(spark, sf):
    bars = view(spark, sf, "px_long").where(F.col("commodity").isin(*NAMES)).replace(NAMES, subset=["commodity"])
    wide = bars.withColumns({
        "Volume_lag5_effect": F.col("open") * 0.5, "EMA_lag2_effect": F.col("close") * 0.5,
        "Volume_lag1_effect": F.col("open") * 0.25, "EMA_lag1_effect": F.col("close") * 0.25,
    })
    return day(P.uniform_effects(wide).select("commodity", "date", "volume_effect", "ema_effect"))


@query("numeric_coercion__flt24", """SELECT event_id, TRY_CAST(regexp_extract(props, '"k": (.)', 1) AS DOUBLE) AS k, value FROM events
WHERE TRY_CAST(regexp_extract(props, '"k": (.)', 1) AS DOUBLE) IS NOT NULL AND value IS NOT NULL""")
def _(spark, sf):
    raw = view(spark, sf, "events").select("event_id", F.regexp_extract("props", '"k": (.)', 1).alias("k"), "value")
    return P.coerce_numeric(raw, ["k", "value"], ["k", "value"])


@query("period_presets__flt25", LONG + """ SELECT 'p7' AS preset, count(*) AS n, round(sum(close), 2) AS total FROM px_long WHERE date BETWEEN DATE '1998-06-30' - 6 AND DATE '1998-06-30'
UNION ALL SELECT 'p30', count(*), round(sum(close), 2) FROM px_long WHERE date BETWEEN DATE '1998-06-30' - 29 AND DATE '1998-06-30'
UNION ALL SELECT 'ytd', count(*), round(sum(close), 2) FROM px_long WHERE date BETWEEN DATE '1998-01-01' AND DATE '1998-06-30'
UNION ALL SELECT 'p1y', count(*), round(sum(close), 2) FROM px_long WHERE date BETWEEN DATE '1998-06-30' - 365 AND DATE '1998-06-30'""")
def _(spark, sf):
    # One scan answers every preset: a bar is listed under each period that holds it.
    bars, as_of = view(spark, sf, "px_long"), F.lit("1998-06-30").cast("date")
    presets = {"p7": "7d", "p30": "30d", "ytd": "ytd", "p1y": "1y"}
    hits = [F.when(F.col("date").between(*P.period_bounds(p, as_of)), F.lit(name)) for name, p in presets.items()]
    listed = bars.select(F.explode(F.array_compact(F.array(*hits))).alias("preset"), "close")
    return listed.groupBy("preset").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("close"), 2).alias("total"))


@query("union_of_commodities__set1", """SELECT 'corn' AS commodity, CAST(CAST(o_orderdate AS DATE) AS STRING) AS date, o_totalprice AS close FROM orders WHERE o_orderpriority = '1-URGENT'
UNION ALL SELECT 'soybean', CAST(CAST(o_orderdate AS DATE) AS STRING), o_totalprice FROM orders WHERE o_orderpriority = '2-HIGH'
UNION ALL SELECT 'wheat', CAST(CAST(o_orderdate AS DATE) AS STRING), o_totalprice FROM orders WHERE o_orderpriority = '3-MEDIUM'""")
def _(spark, sf):
    orders = view(spark, sf, "orders")
    per = {
        name: orders.where(F.col("o_orderpriority") == key).select(F.to_date("o_orderdate").alias("date"), F.col("o_totalprice").alias("close"))
        for key, name in NAMES.items()
    }
    return day(S.union_tagged(per))


@query("offset_rows_with_prices__set2", DAILY + """, offs AS (SELECT 0 AS k UNION ALL SELECT 1 UNION ALL SELECT 3)
SELECT commodity, CAST(date AS STRING) AS date, k, close FROM px_daily, offs""")
def _(spark, sf):
    literal = F.explode(F.array(F.lit(0), F.lit(1), F.lit(3)))
    return day(view(spark, sf, "px_daily").select("commodity", "date", literal.alias("k"), "close"))


@query("first_occurrences__set3", "SELECT l_partkey, min(l_orderkey * 10 + l_linenumber) AS pos FROM lineitem GROUP BY l_partkey")
def _(spark, sf):
    items = view(spark, sf, "lineitem").select("l_partkey", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"))
    return S.first_occurrences(items, "l_partkey", "pos")


@query("set_difference_and_intersection__set4", """SELECT 'only_customers' AS side, c_nationkey AS nation FROM (SELECT c_nationkey FROM customer EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000)
UNION ALL SELECT 'both', c_nationkey FROM (SELECT c_nationkey FROM customer INTERSECT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000)""")
def _(spark, sf):
    left = view(spark, sf, "customer").select(F.col("c_nationkey").alias("nation")).distinct()
    right = view(spark, sf, "supplier").where("s_acctbal > 5000").select(F.col("s_nationkey").alias("nation"))
    only = S.difference(left, right, ["nation"]).select(F.lit("only_customers").alias("side"), "nation")
    return only.unionByName(S.intersection(left, right, ["nation"]).select(F.lit("both").alias("side"), "nation"))


@query("distinct_dates__set5", "SELECT DISTINCT CAST(CAST(o_orderdate AS DATE) AS STRING) AS date, o_orderpriority AS commodity FROM orders")
def _(spark, sf):
    return day(view(spark, sf, "orders").select(F.to_date("o_orderdate").alias("date"), F.col("o_orderpriority").alias("commodity")).distinct())


@query("other_closes__jn1", LONG + f""" SELECT a.commodity, CAST(a.date AS STRING) AS date, a.close, c.close AS corn_close, s.close AS soybean_close, w.close AS wheat_close
FROM px_long a LEFT JOIN px_long c ON c.date = a.date AND c.commodity = '{CORN}'
LEFT JOIN px_long s ON s.date = a.date AND s.commodity = '{SOY}' LEFT JOIN px_long w ON w.date = a.date AND w.commodity = '{WHEAT}'""")
def _(spark, sf):
    wide = J.other_closes(view(spark, sf, "px_long"), NAMES)
    return day(wide.select("commodity", "date", "close", "corn_close", "soybean_close", "wheat_close"))


REACTION = """, days AS (SELECT commodity, date, close, row_number() OVER (PARTITION BY commodity ORDER BY date) AS idx FROM px_long),
base AS (SELECT DISTINCT o_orderpriority AS commodity, CAST(l_shipdate AS DATE) AS base_date FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
first_day AS (SELECT b.commodity, b.base_date, min(d.idx) AS idx FROM base b JOIN days d ON d.commodity = b.commodity AND d.date >= b.base_date GROUP BY ALL),
reaction AS (SELECT f.commodity, f.base_date, o.k AS offset_days, d.date AS trade_date, d.close FROM first_day f, (SELECT 0 AS k UNION ALL SELECT 1 UNION ALL SELECT 3) o, days d
WHERE d.commodity = f.commodity AND d.idx = f.idx + o.k)"""


def _ship_dates(spark, sf):
    items, orders = view(spark, sf, "lineitem"), view(spark, sf, "orders")
    return items.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        "l_orderkey", "l_linenumber", F.col("o_orderpriority").alias("commodity"), F.to_date("l_shipdate").alias("base_date"))


@query("price_reaction__jn3_win5", LONG + REACTION + " SELECT commodity, CAST(base_date AS STRING) AS base_date, offset_days, CAST(trade_date AS STRING) AS trade_date, close FROM reaction")
def _(spark, sf):
    out = J.price_reaction(view(spark, sf, "px_long"), _ship_dates(spark, sf))
    return day(out, "base_date", "trade_date")


@query("attached_price_reaction__jn18", LONG + REACTION + """ SELECT l_orderkey, l_linenumber, o.o_orderpriority AS commodity, CAST(CAST(l_shipdate AS DATE) AS STRING) AS publish_date,
a.close AS price_0, b.close AS price_1, c.close AS price_3 FROM lineitem JOIN orders o ON l_orderkey = o_orderkey
LEFT JOIN reaction a ON a.commodity = o.o_orderpriority AND a.base_date = CAST(l_shipdate AS DATE) AND a.offset_days = 0
LEFT JOIN reaction b ON b.commodity = o.o_orderpriority AND b.base_date = CAST(l_shipdate AS DATE) AND b.offset_days = 1
LEFT JOIN reaction c ON c.commodity = o.o_orderpriority AND c.base_date = CAST(l_shipdate AS DATE) AND c.offset_days = 3""")
def _(spark, sf):
    articles = _ship_dates(spark, sf).withColumnRenamed("base_date", "publish_date")
    reaction = J.price_reaction(view(spark, sf, "px_long"), articles.withColumnRenamed("publish_date", "base_date"))
    return day(J.attach_reaction(articles, reaction), "publish_date")


@query("lag_features__win1", LONG + f""", w AS (SELECT a.commodity, a.date, a.close, a.volume, a.open AS ema, s.close AS soybean_close FROM px_long a
LEFT JOIN px_long s ON s.date = a.date AND s.commodity = '{SOY}' WHERE a.commodity = '{CORN}'),
g AS (SELECT commodity, date, close, lag(soybean_close, 8) OVER o AS soybean_close_lag8, lag(ema, 2) OVER o AS ema_lag2, lag(volume, 5) OVER o AS volume_lag5 FROM w WINDOW o AS (ORDER BY date))
SELECT commodity, {D}, close, soybean_close_lag8, ema_lag2, volume_lag5 FROM g WHERE ema_lag2 IS NOT NULL AND volume_lag5 IS NOT NULL""")
def _(spark, sf):
    wide = J.other_closes(view(spark, sf, "px_long"), NAMES).withColumn("ema", F.col("open"))
    out = W.lag_features(wide, CORN, plan={CORN: W.LAG_PLAN["corn"]})
    return day(out.select("commodity", "date", "close", "soybean_close_lag8", "ema_lag2", "volume_lag5"))


@query("next_bar_target__win2", LONG + f""", n AS (SELECT *, lead(close) OVER (PARTITION BY commodity ORDER BY date) AS target_close FROM px_long)
SELECT commodity, {D}, target_close, CASE WHEN target_close > close * 1.005 THEN 1 ELSE 0 END AS up_label,
CASE WHEN target_close > close * 1.005 THEN 1 WHEN target_close < close * 0.995 THEN 0 ELSE 2 END AS band_label,
CASE WHEN target_close < close * 0.995 THEN 1 ELSE 0 END AS down_label,
round((target_close - close) / close, 6) AS price_change FROM n WHERE target_close IS NOT NULL""")
def _(spark, sf):
    bars = view(spark, sf, "px_long").select("commodity", "date", "close")
    up = W.next_bar_target(bars, 0.005)
    band = W.next_bar_target(bars, 0.005, classes=3).select("commodity", "date", F.col("label").alias("band_label"))
    both = up.withColumnRenamed("label", "up_label").join(band, ["commodity", "date"])
    down = W.down_target(both, 0.005).withColumnRenamed("label", "down_label")
    return day(down.select("commodity", "date", "target_close", "up_label", "band_label", "down_label", F.round("price_change", 6).alias("price_change")))


@query("direction_target__win3", LONG + f""", n AS (SELECT commodity, date, close AS y, lead(close) OVER (PARTITION BY commodity ORDER BY date) AS y_next, low, high FROM px_long)
SELECT commodity, {D}, y, y_next, round(y_next - y, 4) AS y_change, CASE WHEN y_next > y THEN 1 ELSE 0 END AS direction, round(high - low, 4) AS volatility
FROM n WHERE y_next <> y""")
def _(spark, sf):
    w = W.by_date("commodity", "date")
    frame = view(spark, sf, "px_long").select(
        "commodity", "date", F.col("close").alias("y"), F.lead("close").over(w).alias("y_next"),
        F.col("low").alias("yhat_lower"), F.col("high").alias("yhat_upper"))
    out = W.direction_target(frame)
    return day(out.select("commodity", "date", "y", "y_next", F.round("y_change", 4).alias("y_change"), "direction", F.round("volatility", 4).alias("volatility")))


@query("exponential_average__win4", LONG.replace("WITH ", "WITH RECURSIVE ", 1) + f""", s AS (SELECT commodity, date, close, row_number() OVER (PARTITION BY commodity ORDER BY date) AS i FROM px_long),
e AS (SELECT commodity, date, i, close AS ema FROM s WHERE i = 1
UNION ALL SELECT s.commodity, s.date, s.i, 2.0/21 * s.close + (1 - 2.0/21) * e.ema FROM e JOIN s ON s.commodity = e.commodity AND s.i = e.i + 1)
SELECT commodity, {D}, round(ema, 3) AS ema FROM e""")
def _(spark, sf):
    out = W.ema(view(spark, sf, "px_long"), "close", 20)
    return day(out.select("commodity", "date", F.round("ema", 3).alias("ema")))


@query("trailing_mean__win6", LONG + f""" SELECT commodity, {D}, round(avg(close) OVER (PARTITION BY commodity ORDER BY date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), 3) AS mean_7 FROM px_long""")
def _(spark, sf):
    out = W.trailing_mean(view(spark, sf, "px_long"), "close", 7, "mean_7")
    return day(out.select("commodity", "date", F.round("mean_7", 3).alias("mean_7")))


@query("returns__win7", LONG + f""" SELECT commodity, {D}, round(close / lag(close) OVER o - 1, 6) AS pct_change, round(lead(close) OVER o / close - 1, 6) AS next_return
FROM px_long WINDOW o AS (PARTITION BY commodity ORDER BY date)""")
def _(spark, sf):
    out = W.returns(view(spark, sf, "px_long"), "close")
    return day(out.select("commodity", "date", F.round("pct_change", 6).alias("pct_change"), F.round("next_return", 6).alias("next_return")))


@query("rebased_index__win13", LONG + f""" SELECT commodity, {D}, round(close / first_value(close) OVER (PARTITION BY commodity ORDER BY date) * 100, 5) AS close_index FROM px_long""")
def _(spark, sf):
    out = W.rebased(view(spark, sf, "px_long"), "close", "close_index")
    return day(out.select("commodity", "date", F.round("close_index", 5).alias("close_index")))


@query("walk_forward_index__win17", LONG + """, s AS (SELECT commodity, date, row_number() OVER (PARTITION BY commodity ORDER BY date) - 1 AS idx, count(*) OVER (PARTITION BY commodity) AS n FROM px_long),
f AS (SELECT commodity, min(CASE WHEN date >= DATE '1996-01-01' THEN idx END) AS a, max(CASE WHEN date <= DATE '1997-12-31' THEN idx END) AS b FROM s GROUP BY commodity)
SELECT s.commodity, CAST(s.date AS STRING) AS test_date, s.idx AS test_idx, s.idx - 1 AS origin, greatest(0, s.idx - 1 - 250) AS train_from, s.idx - 1 AS train_to
FROM s JOIN f ON s.commodity = f.commodity WHERE s.idx - 1 >= greatest(250, f.a) AND s.idx - 1 <= least(f.b, s.n - 2)""")
def _(spark, sf):
    out = W.walk_forward_index(view(spark, sf, "px_long"), 250, "1996-01-01", "1997-12-31")
    return day(out.withColumns({c: F.col(c).cast("long") for c in ("test_idx", "origin", "train_from", "train_to")}), "test_date")


@query("sliding_split__win18", LONG + f""", s AS (SELECT commodity, date, close, row_number() OVER (PARTITION BY commodity ORDER BY date) - 1 AS idx FROM px_long WHERE date <= DATE '1998-03-02'),
t AS (SELECT commodity, idx AS t, greatest(0, idx - 300) AS st FROM s WHERE date = DATE '1998-03-02' AND idx >= 50)
SELECT s.commodity, {D}, s.idx, CASE WHEN s.idx = t.t THEN 'test' WHEN s.idx < t.st + floor((t.t - t.st) * 0.8) THEN 'train' ELSE 'val' END AS split
FROM s JOIN t ON s.commodity = t.commodity WHERE s.idx >= t.st""")
def _(spark, sf):
    out = W.sliding_split(view(spark, sf, "px_long"), "1998-03-02", window=300, min_rows=50)
    return day(out.select("commodity", "date", F.col("idx").cast("long").alias("idx"), "split"))


@query("chronological_split__win19", LONG + f""", s AS (SELECT commodity, date, row_number() OVER (PARTITION BY commodity ORDER BY date) AS i, count(*) OVER (PARTITION BY commodity) AS n FROM px_long)
SELECT commodity, {D}, CASE WHEN i <= floor(n * 0.8) THEN 'train' ELSE 'test' END AS split FROM s""")
def _(spark, sf):
    return day(W.chronological_split(view(spark, sf, "px_long")).select("commodity", "date", "split"))


@query("scaled_marker_size__win21", DAILY + f""" SELECT commodity, {D}, round(volume / greatest(max(volume) OVER (PARTITION BY commodity), 1) * 42 + 8, 6) AS size FROM px_daily""")
def _(spark, sf):
    out = W.scaled_size(view(spark, sf, "px_daily"), "volume", "size")
    return day(out.select("commodity", "date", F.round("size", 6).alias("size")))


@query("staging_audit__agg8", LONG + " SELECT commodity, count(*) AS row_count, CAST(min(date) AS STRING) AS min_date, CAST(max(date) AS STRING) AS max_date FROM px_long GROUP BY commodity")
def _(spark, sf):
    return day(A.staging_audit(view(spark, sf, "px_long")), "min_date", "max_date")


FORECASTS = with_views("forecasts")


@query("forecast_errors__agg9", FORECASTS + """, p AS (SELECT *, lag(actual_price) OVER (PARTITION BY commodity ORDER BY target_date) AS prev FROM forecasts)
SELECT commodity, round(avg(abs(actual_price - forecast_price)), 2) AS mae, round(sqrt(avg((actual_price - forecast_price) * (actual_price - forecast_price))), 2) AS rmse,
round(CASE WHEN count(*) > 1 THEN CAST(sum(CASE WHEN (actual_price - prev) * (forecast_price - prev) > 0 THEN 1 ELSE 0 END) AS DOUBLE) / (count(*) - 1) * 100 ELSE 0.0 END, 1) AS hit_rate
FROM p GROUP BY commodity""")
def _(spark, sf):
    return A.forecast_errors(view(spark, sf, "forecasts"))


@query("recent_forecast_log__top6", FORECASTS + """ SELECT CAST(target_date AS STRING) AS target_date, commodity, actual_price, round(forecast_price, 6) AS forecast_price, CASE WHEN direction = 1 THEN '상승' ELSE '하락' END AS trend
FROM forecasts ORDER BY forecasts.target_date DESC, commodity LIMIT 10""")
def _(spark, sf):
    out = K.recent_log(view(spark, sf, "forecasts"))
    return day(out.select("target_date", "commodity", "actual_price", F.round("forecast_price", 6).alias("forecast_price"), "trend"), "target_date")


@query("contribution_ranking__agg15", FORECASTS + """, m AS (SELECT commodity, avg(abs(trend)) AS a, avg(abs(yearly)) AS b, avg(abs(weekly)) AS c, avg(abs(extra_regressors_multiplicative)) AS d, avg(abs(volume_effect)) AS e, avg(abs(ema_effect)) AS f FROM forecasts GROUP BY commodity),
l AS (SELECT commodity, 'trend' AS component, a AS score FROM m UNION ALL SELECT commodity, 'yearly', b FROM m UNION ALL SELECT commodity, 'weekly', c FROM m
UNION ALL SELECT commodity, 'extra_regressors_multiplicative', d FROM m UNION ALL SELECT commodity, 'volume_effect', e FROM m UNION ALL SELECT commodity, 'ema_effect', f FROM m),
r AS (SELECT *, row_number() OVER (PARTITION BY commodity ORDER BY score DESC, component) AS rank FROM l)
SELECT commodity, component, round(score, 6) AS score, rank FROM r WHERE rank <= 5""")
def _(spark, sf):
    parts = ["trend", "yearly", "weekly", "extra_regressors_multiplicative", "volume_effect", "ema_effect"]
    out = A.contribution_ranking(view(spark, sf, "forecasts"), parts)
    return out.select("commodity", "component", F.round("score", 6).alias("score"), "rank")


@query("regressor_availability__agg20", LONG + f""", g AS (SELECT a.commodity, a.date, s.close AS soybean_close FROM px_long a LEFT JOIN px_long s ON s.date = a.date AND s.commodity = '{SOY}' WHERE a.commodity <> '{SOY}'),
h AS (SELECT *, avg(CASE WHEN soybean_close IS NULL THEN 0.0 ELSE 1.0 END) OVER (PARTITION BY commodity ORDER BY date ROWS BETWEEN 250 PRECEDING AND 1 PRECEDING) AS available FROM g)
SELECT commodity, {D}, round(available, 6) AS available, CASE WHEN available IS NULL THEN NULL WHEN available > 0.5 AND soybean_close IS NOT NULL THEN 1 ELSE 0 END AS used FROM h WHERE available IS NOT NULL""")
def _(spark, sf):
    wide = J.other_closes(view(spark, sf, "px_long"), NAMES).where(F.col("commodity") != SOY)
    out = A.regressor_availability(wide, "soybean_close", 250).where(F.col("available").isNotNull())
    return day(out.select("commodity", "date", F.round("available", 6).alias("available"), "used"))
