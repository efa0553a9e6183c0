"""Decisions and back-tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from furrow.functions import decisions as DF
from furrow.operators import backtest as B
from furrow.operators import filters as P
from furrow.operators import joins as J
from furrow.operators import windows as W
from furrow.suite import query
from furrow.suite.news import rounded
from furrow.suite.prices import day
from furrow.suite.views import view, with_views

DEC = with_views("decisions", "px_daily")
SIGNAL_SQL = """, sig AS (SELECT d.*, p.close AS actual_price, CASE WHEN upper(trim(recommendation)) IN ('BUY','UP','LONG','상승','매수') THEN 1 WHEN upper(trim(recommendation)) IN ('SELL','DOWN','SHORT','하락','매도') THEN -1
WHEN p_buy = greatest(p_buy, p_hold, p_sell) THEN 1 WHEN p_hold = greatest(p_buy, p_hold, p_sell) THEN 0 ELSE -1 END AS signal
FROM decisions d JOIN px_daily p ON p.commodity = d.commodity AND p.date = d.target_date)"""


def _priced(spark, sf):
    prices = view(spark, sf, "px_daily").select("commodity", F.col("date").alias("target_date"), F.col("close").alias("actual_price"))
    return J.decisions_with_prices(view(spark, sf, "decisions"), prices)


@query("decision_log_filter__flt21", DEC + """ SELECT event_id, CAST(target_date AS STRING) AS target_date, commodity, stage FROM decisions
WHERE target_date BETWEEN DATE '2024-01-05' AND DATE '2024-01-12' AND commodity = 'view' AND stage = 'v2'""")
def _(spark, sf):
    out = P.decision_log(view(spark, sf, "decisions"), "2024-01-05", "2024-01-12", "view", "v2")
    return day(out.select("event_id", "target_date", "commodity", "stage"), "target_date")


@query("decision_signals__jn6_fn15_fn16", DEC + SIGNAL_SQL + " SELECT event_id, commodity, CAST(target_date AS STRING) AS target_date, actual_price, signal, round(actual_price * (1 + signal * 0.01), 6) AS forecast_price FROM sig")
def _(spark, sf):
    signal = DF.signal_with_fallback(F.col("recommendation"), F.col("p_buy"), F.col("p_hold"), F.col("p_sell"))
    out = _priced(spark, sf).withColumn("signal", signal)
    price = F.round(DF.synthetic_forecast(F.col("actual_price"), F.col("signal")), 6)
    return day(out.select("event_id", "commodity", "target_date", "actual_price", "signal", price.alias("forecast_price")), "target_date")


@query("normalised_probabilities__fn17", DEC + """, q AS (SELECT event_id, greatest(p_buy - 0.3, 0) AS b, greatest(p_hold - 0.2, 0) AS h, greatest(p_sell - 0.2, 0) AS s FROM decisions)
SELECT event_id, round(CASE WHEN b + h + s > 0 THEN b / (b + h + s) ELSE 0.34 END, 6) AS p_buy, round(CASE WHEN b + h + s > 0 THEN h / (b + h + s) ELSE 0.33 END, 6) AS p_hold,
round(CASE WHEN b + h + s > 0 THEN s / (b + h + s) ELSE 0.33 END, 6) AS p_sell FROM q""")
def _(spark, sf):
    probs = DF.normalised_probabilities(F.col("p_buy") - 0.3, F.col("p_hold") - 0.2, F.col("p_sell") - 0.2)
    return view(spark, sf, "decisions").select("event_id", *[F.round(c, 6).alias(n) for n, c in probs.items()])


@query("trade_plan__fn18", DEC + """ SELECT event_id, CAST(sign(p_buy - p_sell) AS INTEGER) AS signal, round(least(1.0, greatest(0.06, 0.06 + 0.94 * power(abs(greatest(-1.0, least(1.0, p_buy - p_sell))), 2.0))), 9) AS intensity FROM decisions""")
def _(spark, sf):
    return B.trade_plan(view(spark, sf, "decisions")).select("event_id", "signal", F.round("intensity", 9).alias("intensity"))


@query("intraday_volatility__fn19", DEC + " SELECT commodity, CAST(date AS STRING) AS date, round(CASE WHEN close = 0 THEN 0 ELSE (high - low) / close END, 6) AS volatility FROM px_daily")
def _(spark, sf):
    v = DF.intraday_volatility(F.col("high"), F.col("low"), F.col("close"))
    return day(view(spark, sf, "px_daily").select("commodity", "date", F.round(v, 6).alias("volatility")))


LATEST = """, latest AS (SELECT * FROM (SELECT d.*, row_number() OVER (PARTITION BY commodity, stage, target_date ORDER BY ingested_at DESC, event_id DESC) AS rn FROM decisions d) WHERE rn = 1)"""


@query("latest_decisions__win12", DEC + LATEST + " SELECT event_id, commodity, stage, CAST(target_date AS STRING) AS target_date FROM latest")
def _(spark, sf):
    return day(B.latest_decisions(view(spark, sf, "decisions")).select("event_id", "commodity", "stage", "target_date"), "target_date")


FC = with_views("forecasts")
RET = """, r AS (SELECT *, coalesce(lead(actual_price) OVER o / actual_price - 1, 0) * CASE WHEN forecast_price > actual_price THEN 1 ELSE -1 END AS strategy_return FROM forecasts WINDOW o AS (PARTITION BY commodity ORDER BY target_date)),
e AS (SELECT *, product(1 + strategy_return) OVER (PARTITION BY commodity ORDER BY target_date) * 10000 AS equity FROM r),
f AS (SELECT *, (equity - max(equity) OVER o) / max(equity) OVER o AS drawdown FROM e WINDOW o AS (PARTITION BY commodity ORDER BY target_date))"""


@query("signal_returns__win8", FC + RET + " SELECT commodity, CAST(target_date AS STRING) AS target_date, round(strategy_return, 6) + 0.0 AS strategy_return FROM r")
def _(spark, sf):
    out = B.signal_returns(view(spark, sf, "forecasts")).select("commodity", "target_date", (F.round("strategy_return", 6) + 0.0).alias("strategy_return"))
    return day(out, "target_date")


@query("equity_and_drawdown__win9_win10", FC + RET + " SELECT commodity, CAST(target_date AS STRING) AS target_date, round(equity, 4) + 0.0 AS equity, round(drawdown, 6) + 0.0 AS drawdown FROM f")
def _(spark, sf):
    out = B.equity_curve(B.signal_returns(view(spark, sf, "forecasts")), 10000.0)
    return day(out.select("commodity", "target_date", (F.round("equity", 4) + 0.0).alias("equity"), (F.round("drawdown", 6) + 0.0).alias("drawdown")), "target_date")


@query("backtest_scorecard__agg11_agg12", FC + RET + """, a AS (SELECT commodity, count(*) AS n, max_by(equity, target_date) AS final, CASE WHEN coalesce(stddev_samp(strategy_return), 0) = 0 THEN 0 ELSE avg(strategy_return) / stddev_samp(strategy_return) * sqrt(252) END AS sharpe,
min(drawdown) AS mdd, sum(CASE WHEN strategy_return > 0 THEN strategy_return ELSE 0 END) AS gain, abs(sum(CASE WHEN strategy_return < 0 THEN strategy_return ELSE 0 END)) AS loss, CAST(count(*) FILTER (strategy_return > 0) AS DOUBLE) / count(*) AS win FROM f GROUP BY commodity)
SELECT commodity, round((power(final / 10000, 365.0 / n) - 1) * 100, 2) AS cagr, round(sharpe, 2) AS sharpe, round(mdd * 100, 2) AS mdd, round(CASE WHEN loss <> 0 THEN gain / loss ELSE CAST('inf' AS DOUBLE) END, 2) AS profit_factor, round(win * 100, 1) AS win_rate,
CAST(trunc(final) AS BIGINT) AS final_value, round(least(greatest((sharpe * 0.4 + (1 - abs(mdd)) * 0.3 + win * 0.3) * 20, 0), 100), 1) AS score FROM a""")
def _(spark, sf):
    return B.scorecard(view(spark, sf, "forecasts"), 10000.0)


SIM = DEC.replace("WITH ", "WITH RECURSIVE ", 1) + LATEST + """, plan AS (SELECT l.commodity, l.stage, l.target_date, p.close AS price, sign(p_buy - p_sell) AS signal,
  least(1.0, greatest(0.06, 0.06 + 0.94 * power(abs(greatest(-1.0, least(1.0, p_buy - p_sell))), 2.0))) AS k, row_number() OVER (PARTITION BY l.commodity, l.stage ORDER BY l.target_date) AS i
  FROM latest l JOIN px_daily p ON p.commodity = l.commodity AND p.date = l.target_date),
walk AS (SELECT commodity, stage, CAST(NULL AS DATE) AS target_date, CAST(0 AS DOUBLE) AS price, CAST(0 AS DOUBLE) AS signal, CAST(0 AS BIGINT) AS i, CAST(10000 AS DOUBLE) AS cash, CAST(0 AS DOUBLE) AS units, 0 AS traded FROM plan WHERE i = 1
UNION ALL SELECT commodity, stage, target_date, price, signal, i,
  CASE WHEN d > 1e-9 THEN cash - least(cash, d / 0.999) WHEN d < -1e-9 THEN cash + least(units * price, -d) * 0.999 ELSE cash END,
  CASE WHEN d > 1e-9 THEN units + least(cash, d / 0.999) * 0.999 / price WHEN d < -1e-9 THEN units - least(units * price, -d) / price ELSE units END,
  CASE WHEN d > 1e-9 AND signal > 0 THEN 1 WHEN d < -1e-9 AND signal < 0 THEN -1 ELSE 0 END
 FROM (SELECT p.commodity, p.stage, p.target_date, p.price, CAST(p.signal AS DOUBLE) AS signal, p.i, w.cash, w.units, (w.cash + w.units * p.price) * CASE WHEN p.signal > 0 THEN least(1.0, w.units * p.price / (w.cash + w.units * p.price) + p.k * (1 - w.units * p.price / (w.cash + w.units * p.price)))
   WHEN p.signal < 0 THEN greatest(0.0, w.units * p.price / (w.cash + w.units * p.price) * (1 - p.k)) ELSE w.units * p.price / (w.cash + w.units * p.price) END - w.units * p.price AS d
   FROM walk w JOIN plan p ON p.commodity = w.commodity AND p.stage = w.stage AND p.i = w.i + 1)),
sim AS (SELECT commodity, stage, target_date, price, signal, cash + units * price AS equity, units * price / (cash + units * price) AS weight, traded FROM walk WHERE i > 0)"""


@query("portfolio_simulation__win14", SIM + " SELECT commodity, stage, CAST(target_date AS STRING) AS target_date, round(equity, 4) AS equity, round(weight, 6) AS weight, traded FROM sim")
def _(spark, sf):
    out = B.simulate(_priced(spark, sf), 10000.0, 0.001)
    return day(rounded(out, 6, "weight").select("commodity", "stage", "target_date", F.round("equity", 4).alias("equity"), "weight", "traded"), "target_date")


CURVES = SIM + """, base AS (SELECT commodity, 'baseline' AS stage, target_date, price, 0.0 AS signal, 10000 * 0.999 / first_value(price) OVER (PARTITION BY commodity ORDER BY target_date) * price AS equity, 1.0 AS weight, 0 AS traded FROM sim WHERE stage = 'v2'),
curves AS (SELECT * FROM sim UNION ALL SELECT * FROM base),
daily AS (SELECT *, coalesce(equity / lag(equity) OVER o - 1, 0) AS ret, (equity - max(equity) OVER o) / max(equity) OVER o AS fall, lead(price) OVER o / price - 1 AS nr FROM curves WINDOW o AS (PARTITION BY commodity, stage ORDER BY target_date)),
stats AS (SELECT commodity, stage, max_by(equity, target_date) / 10000 - 1 AS final_return, CASE WHEN coalesce(stddev_samp(ret), 0) = 0 THEN 0 ELSE avg(ret) / stddev_samp(ret) * sqrt(252) END AS sharpe, min(fall) AS mdd,
  coalesce(avg(CASE WHEN signal <> 0 AND nr IS NOT NULL THEN CASE WHEN signal * nr > 0 THEN 100.0 ELSE 0.0 END END), 0) AS hit_rate, count(*) FILTER (traded <> 0) AS trade_count FROM daily GROUP BY commodity, stage),
cmp AS (SELECT v2.commodity, round((v2.final_return - b.final_return) * 100, 2) AS alpha_pct, round(v2.sharpe - v1.sharpe, 3) AS v2_improvement, round(v2.hit_rate, 1) AS hit_rate_pct,
  round(v1.final_return * 100, 2) AS return_v1, round(v2.final_return * 100, 2) AS return_v2, round(b.final_return * 100, 2) AS return_baseline, round(v1.sharpe, 3) AS sharpe_v1, round(v2.sharpe, 3) AS sharpe_v2, round(b.sharpe, 3) AS sharpe_baseline,
  round(v1.mdd * 100, 2) AS mdd_v1, round(v2.mdd * 100, 2) AS mdd_v2, round(b.mdd * 100, 2) AS mdd_baseline, v1.trade_count AS trades_v1, v2.trade_count AS trades_v2
  FROM stats v2 JOIN stats v1 ON v1.commodity = v2.commodity AND v1.stage = 'v1' JOIN stats b ON b.commodity = v2.commodity AND b.stage = 'baseline' WHERE v2.stage = 'v2')"""


@query("buy_and_hold__win15", CURVES + " SELECT commodity, CAST(target_date AS STRING) AS target_date, round(equity, 4) AS equity FROM base")
def _(spark, sf):
    curves = B.all_curves(_priced(spark, sf), 10000.0, 0.001).where("stage = 'baseline'")
    return day(curves.select("commodity", "target_date", F.round("equity", 4).alias("equity")), "target_date")


@query("curve_statistics__win16", CURVES + " SELECT commodity, stage, round(final_return, 6) AS final_return, round(sharpe, 5) AS sharpe, round(mdd, 6) AS mdd, round(hit_rate, 4) AS hit_rate, trade_count FROM stats")
def _(spark, sf):
    stats = B.curve_stats(B.all_curves(_priced(spark, sf), 10000.0, 0.001), 10000.0, ["commodity", "stage"])
    return rounded(rounded(stats, 6, "final_return", "mdd"), 5, "sharpe").withColumn("hit_rate", F.round("hit_rate", 4))


@query("strategy_comparison__agg13", CURVES + " SELECT * FROM cmp")
def _(spark, sf):
    return B.compare_strategies(_priced(spark, sf), 10000.0)


@query("defence_against_baseline__agg14", CURVES + """ SELECT commodity, round(CASE WHEN return_baseline < 0 AND return_v2 < 0 THEN (abs(return_baseline) - abs(return_v2)) / abs(return_baseline) * 100 WHEN return_baseline < 0 AND return_v2 >= 0 THEN 100.0 END, 1) AS loss_reduction_pct,
round(CASE WHEN abs(mdd_baseline) > 1e-9 THEN (1 - abs(mdd_v2) / abs(mdd_baseline)) * 100 END, 1) AS defence_score FROM cmp""")
def _(spark, sf):
    return B.defence(B.compare_strategies(_priced(spark, sf), 10000.0))


@query("strategy_chart_rows__win20", CURVES + """ SELECT commodity, stage, CAST(target_date AS STRING) AS target_date, round((equity / 10000 - 1) * 100, 4) + 0.0 AS return_pct, round(weight * 100, 4) AS weight_pct,
CASE WHEN traded = 1 THEN 1 ELSE 0 END AS bought, CASE WHEN traded = -1 THEN 1 ELSE 0 END AS sold FROM curves""")
def _(spark, sf):
    rows = B.chart_rows(B.all_curves(_priced(spark, sf), 10000.0, 0.001), 10000.0)
    return day(rows.withColumn("return_pct", F.round("return_pct", 4) + 0.0).withColumn("weight_pct", F.round("weight_pct", 4)), "target_date")


VOTES = with_views("news") + """, m AS (SELECT id, doc_id, doc_id % 2 AS up, (doc_id // 2) % 2 AS down, (doc_id // 4) % 3 AS tri, 0.5 + (doc_id % 50) / 100.0 AS c1, 0.4 + (doc_id % 57) / 100.0 AS c2, 0.3 + (doc_id % 61) / 100.0 AS c3,
0.1 + (doc_id % 5) / 10.0 AS pd, 0.2 + (doc_id % 3) / 10.0 AS pu, 0.15 AS ps FROM news)"""


def votes(spark, sf):
    """Three model outputs per article, arithmetic on its number."""
    n = F.col("doc_id")
    return view(spark, sf, "news").select(
        "id", (n % 2).cast("int").alias("up"), (F.floor(n / 2) % 2).cast("int").alias("down"), (F.floor(n / 4) % 3).cast("int").alias("tri"),
        (0.5 + (n % 50) / 100).alias("c1"), (0.4 + (n % 57) / 100).alias("c2"), (0.3 + (n % 61) / 100).alias("c3"),
        (0.1 + (n % 5) / 10).alias("pd"), (0.2 + (n % 3) / 10).alias("pu"), F.lit(0.15).alias("ps"))


@query("three_model_vote__fn20_fn21", VOTES + """, d AS (SELECT *, CASE WHEN up = 1 AND down = 0 AND tri = 1 THEN '상승' WHEN up = 0 AND down = 1 AND tri = 0 THEN '하락' WHEN up = 0 AND down = 0 THEN CASE tri WHEN 0 THEN '하락' WHEN 1 THEN '상승' ELSE '유지' END
 WHEN up = 1 AND tri = 1 THEN '상승' WHEN down = 1 AND tri = 0 THEN '하락' WHEN up = 1 AND down = 1 THEN '유지' ELSE CASE tri WHEN 0 THEN '하락' WHEN 1 THEN '상승' ELSE '유지' END END AS direction,
 CASE WHEN up = 1 AND down = 0 AND tri = 1 THEN 'high' WHEN up = 0 AND down = 1 AND tri = 0 THEN 'high' WHEN up = 0 AND down = 0 THEN 'medium' WHEN up = 1 AND tri = 1 THEN 'medium' WHEN down = 1 AND tri = 0 THEN 'medium' ELSE 'low' END AS agreement,
 CASE up * 100 + down * 10 + tri WHEN 101 THEN '3개 모델 모두 상승 예측 (강한 합의)' WHEN 10 THEN '3개 모델 모두 하락 예측 (강한 합의)' WHEN 1 THEN 'Bi 모델들 중립, Tri 모델 상승 예측' WHEN 0 THEN 'Bi 모델들 중립, Tri 모델 하락 예측' WHEN 2 THEN '모든 모델이 중립적 신호'
 WHEN 111 THEN 'Negative와 Tri 모델 상승 예측하나 Positive는 하락 예측 (부분 충돌)' WHEN 110 THEN 'Positive와 Tri 모델 하락 예측하나 Negative는 상승 예측 (부분 충돌)' WHEN 112 THEN '모델 간 강한 충돌 (Negative 상승, Positive 하락, Tri 유지)' ELSE '모델 간 불일치, Tri 모델 예측 우선 적용' END AS vote_reason FROM m),
p AS (SELECT *, CASE WHEN up = 1 AND c1 > 0.8 THEN least(pu * 1.2, 0.95) ELSE pu END AS qu, CASE WHEN down = 1 AND c2 > 0.8 THEN least(pd * 1.2, 0.95) ELSE pd END AS qd, CAST((c1 + c2 + c3) AS DOUBLE) / 3 AS mean FROM d),
z AS (SELECT *, sqrt(((c1 - mean) * (c1 - mean) + (c2 - mean) * (c2 - mean) + (c3 - mean) * (c3 - mean)) / 3) AS sd FROM p)
SELECT id, direction, agreement, vote_reason, round(least(mean * CASE agreement WHEN 'high' THEN 1.0 WHEN 'medium' THEN 0.85 ELSE 0.7 END * CASE WHEN sd > 0.2 THEN 0.9 ELSE 1.0 END, 0.95), 6) AS confidence,
round(CAST(qu AS DOUBLE) / (qu + qd + ps), 6) AS p_up, round(CAST(qd AS DOUBLE) / (qu + qd + ps), 6) AS p_down, round(CAST(ps AS DOUBLE) / (qu + qd + ps), 6) AS p_stable FROM z""")
def _(spark, sf):
    df = votes(spark, sf)
    c = F.col
    result = DF.vote(c("up"), c("down"), c("tri"))
    probs = DF.vote_probabilities(c("pd"), c("pu"), c("ps"), c("up"), c("c1"), c("down"), c("c2"))
    voted = df.withColumns(result)
    return voted.select("id", "direction", "agreement", "vote_reason", F.round(DF.ensemble_confidence(c("agreement"), c("c1"), c("c2"), c("c3")), 6).alias("confidence"),
                        *[F.round(p, 6).alias(n) for n, p in probs.items()])


@query("evidence_scores__fn36", with_views("news") + """ SELECT id, round(CASE WHEN price_impact_score > 0 THEN price_impact_score ELSE 0.1 END, 6) AS positive, round(CASE WHEN price_impact_score < 0 THEN abs(price_impact_score) ELSE 0.1 END, 6) AS negative,
CAST(0.5 AS DOUBLE) AS neutral, CASE WHEN price_impact_score > 0 THEN 'positive' WHEN price_impact_score < 0 THEN 'negative' ELSE 'neutral' END AS sentiment FROM news""")
def _(spark, sf):
    scores = DF.evidence_scores(F.col("price_impact_score"))
    out = view(spark, sf, "news").select("id", *[c.alias(n) for n, c in scores.items()])
    return rounded(out, 6, "positive", "negative")
