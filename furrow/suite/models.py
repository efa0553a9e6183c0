"""Features, classifiers, forecasts and reports."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from furrow.functions import sentiment as X
from furrow.operators import aggregates as A
from furrow.operators import models as M
from furrow.operators import windows as W
from furrow.plans import forecasts as FC
from furrow.plans import ingestion as I
from furrow.plans import keywords as KW
from furrow.plans import market_report as MR
from furrow.plans import news_model as NM
from furrow.plans import past_news as PN
from furrow.session import cut_lineage
from furrow.suite import query
from furrow.suite.news import FEATURE_SQL, NEWS_PX, rounded
from furrow.suite.prices import LONG, NAMES, day
from furrow.suite.views import view, with_views

LABELS = """, l AS (SELECT commodity, date, CASE WHEN lead(close) OVER o > close * 1.005 THEN 1 WHEN lead(close) OVER o < close * 0.995 THEN 0 ELSE 2 END AS label, CASE WHEN close > lag(close) OVER o * 1.005 THEN 1 WHEN close < lag(close) OVER o * 0.995 THEN 0 ELSE 2 END AS predicted,
lead(close) OVER o AS nx FROM px_long WINDOW o AS (PARTITION BY commodity ORDER BY date)), k AS (SELECT * FROM l WHERE nx IS NOT NULL)"""


def _labelled(spark, sf):
    bars = view(spark, sf, "px_long").select("commodity", "date", "close")
    prev = F.lag("close").over(W.by_date("commodity", "date"))
    guess = F.when(F.col("close") > prev * 1.005, 1).when(F.col("close") < prev * 0.995, 0).otherwise(2)
    return W.next_bar_target(bars.withColumn("predicted", guess), 0.005, classes=3)


@query("class_weights__agg18", LONG + LABELS + """, c AS (SELECT commodity, label, count(*) AS n FROM k GROUP BY commodity, label)
SELECT commodity, label, n AS rows, round(CAST(sum(n) OVER (PARTITION BY commodity) AS DOUBLE) / (count(*) OVER (PARTITION BY commodity) * n), 6) AS weight FROM c""")
def _(spark, sf):
    return rounded(A.class_weights(_labelled(spark, sf), "label", ["commodity"]), 6, "weight")


@query("positive_weight__agg18", LONG + LABELS + " SELECT commodity, round(CAST(count(*) FILTER (label = 0) AS DOUBLE) / count(*) FILTER (label = 1), 6) AS scale_pos_weight FROM k GROUP BY commodity")
def _(spark, sf):
    return rounded(A.positive_weight(_labelled(spark, sf), "label", ["commodity"]), 6, "scale_pos_weight")


@query("confusion_table__agg19", LONG + LABELS + " SELECT label, predicted, count(*) AS rows FROM k GROUP BY label, predicted")
def _(spark, sf):
    return A.confusion(_labelled(spark, sf), "label", "predicted")


@query("class_scores__agg19", LONG + LABELS + """, s AS (SELECT label AS c, count(*) AS support, count(*) FILTER (predicted = label) AS tp FROM k GROUP BY label), p AS (SELECT predicted AS c, count(*) AS claimed FROM k GROUP BY predicted),
m AS (SELECT s.c, support, CAST(tp AS DOUBLE) / claimed AS pr, CAST(tp AS DOUBLE) / support AS re FROM s JOIN p ON p.c = s.c)
SELECT c AS label, support, round(pr, 6) AS "precision", round(re, 6) AS recall, CASE WHEN pr + re > 0 THEN round(2 * pr * re / (pr + re), 6) ELSE 0 END AS f1, round((SELECT CAST(count(*) FILTER (predicted = label) AS DOUBLE) / count(*) FROM k), 6) AS accuracy FROM m""")
def _(spark, sf):
    return rounded(A.class_scores(_labelled(spark, sf), "label", "predicted"), 6, "precision", "recall", "f1", "accuracy")


@query("standardised_features__ml1", NEWS_PX + FEATURE_SQL + """, s AS (SELECT avg(avg_positive) AS m, stddev_pop(avg_positive) AS d, avg(news_count) AS mn, stddev_pop(news_count) AS dn FROM feat WHERE date < DATE '2024-01-20')
SELECT commodity, CAST(date AS STRING) AS date, round((avg_positive - m) / d, 5) + 0.0 AS avg_positive, round((news_count - mn) / dn, 5) + 0.0 AS news_count FROM feat, s""")
def _(spark, sf):
    features = A.news_features(view(spark, sf, "news"), view(spark, sf, "px_daily"))
    out = M.standardise(features, ["avg_positive", "news_count"], F.col("date") < F.lit("2024-01-20").cast("date"))
    return day(out.select("commodity", "date", *[(F.round(c, 5) + 0.0).alias(c) for c in ("avg_positive", "news_count")]))


def _features(spark, sf):
    # The given vectors are 64 long. Every third article has no entity vector.
    news, vectors = view(spark, sf, "news"), view(spark, sf, "embeddings")
    stored = lambda name: vectors.select(F.col("vec_id").alias(f"at_{name}"), F.col("embedding").alias(name))
    n = F.col("doc_id")
    total = max(1, vectors.count())
    news = news.withColumns({"at_embedding": F.col("vec_id"), "at_triple_vector": (n * 7 + 2) % total, "at_entity_vector": F.when(n % 3 > 0, (n * 3 + 1) % total)})
    for name in NM.VECTORS:
        news = news.join(stored(name), f"at_{name}", "left")
    return NM.feature_rows(news, view(spark, sf, "px_daily"), dict.fromkeys(NM.VECTORS, 64))


@query("assembled_features__ml2", NEWS_PX + FEATURE_SQL.replace("JOIN news n ON", "JOIN news n ON n.filter_status = 'T' AND") + """, held AS (SELECT commodity, date, 0 AS part, vec_id AS k FROM win UNION ALL SELECT commodity, date, 1, (doc_id * 3 + 1) % (SELECT count(*) FROM embeddings) FROM win WHERE doc_id % 3 > 0 UNION ALL SELECT commodity, date, 2, (doc_id * 7 + 2) % (SELECT count(*) FROM embeddings) FROM win),
v AS (SELECT commodity, date, part, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS pos FROM held JOIN embeddings e ON e.vec_id = k), a AS (SELECT commodity, date, part, pos, avg(CAST(x AS DOUBLE)) AS m FROM v GROUP BY ALL),
t AS (SELECT commodity, date, sum(m * (1 + part)) AS total, bool_or(part = 0) AS told FROM a GROUP BY ALL)
SELECT f.commodity, CAST(f.date AS STRING) AS date, 3 * 64 + 9 AS dimensions, round(t.total + coalesce(avg_price_impact, 0) + avg_positive + avg_negative + avg_neutral + impact_std + news_count + positive_count + negative_count + neutral_count, 4) AS total FROM feat f JOIN t ON t.commodity = f.commodity AND t.date = f.date WHERE told""")
def _(spark, sf):
    # Each vector has its own weight in the sum, so that their order shows.
    total = lambda a, n: F.aggregate(F.slice("features", a, n), F.lit(0.0), lambda acc, x: acc + x)
    total = total(1, 64) + 2 * total(65, 64) + 3 * total(129, 64) + total(193, 9)
    return day(_features(spark, sf).select("commodity", "date", F.size("features").alias("dimensions"), F.round(total, 4).alias("total")))


def _trained(spark, sf):
    return NM.train(NM.training_rows(_features(spark, sf), view(spark, sf, "px_daily")))


def _voted(spark, sf):
    training = _trained(spark, sf)
    return NM.predict(training.models, training.scaled)


@query("model_rounds__ml3")
def _(spark, sf):
    told = [F.round(c, 6).alias(c) for c in ("train_accuracy", "val_accuracy")]
    return NM.rounds_table(_trained(spark, sf)).select("model", "round", "max_iter", *told, "chosen")


@query("model_evaluation__ml3")
def _(spark, sf):
    told = [F.round(c, 6).alias(c) for c in ("precision", "recall", "f1", "accuracy")]
    return NM.evaluation(_voted(spark, sf)).select("model", "label", "support", *told)


@query("ensemble_predictions__ml3_ml4")
def _(spark, sf):
    return day(_voted(spark, sf).select("commodity", "date", "direction", "agreement", F.round("confidence", 6).alias("confidence"),
                                        F.round(F.col("p_up") + F.col("p_down") + F.col("p_stable"), 6).alias("total_probability")))


@query("prediction_reports__ml7")
def _(spark, sf):
    reports = MR.prediction_reports(_voted(spark, sf), _named_news(spark, sf), view(spark, sf, "px_daily"))
    return day(reports.select("commodity", "date", F.to_json(F.struct("metadata", "prediction", "model_consensus", "evidence", "market_analysis")).alias("report")))


# The given series are shorter than the window of 1 825 rows at small scales: their origins take all rows before them, a year of
# trading days at least.
LEAST_WINDOW = 250


def _timeseries(spark, sf, start=None):
    return FC.timeseries_features(view(spark, sf, "px_long"), NAMES, start=start, least_window=LEAST_WINDOW)


@query("walk_forward_forecast__ml5")
def _(spark, sf):
    series = FC.forecast_series(view(spark, sf, "px_long"), NAMES)
    out = M.walk_forward_forecast(series, ["volume_lag", "ema_lag", *[f"{p}_close_lag" for p in NAMES.values()]], FC.WINDOW_ROWS, least_window=LEAST_WINDOW)
    return day(out.select("commodity", "ds", "y", "y_next", F.round("yhat", 2).alias("yhat"), F.round("trend", 2).alias("trend")), "ds")


@query("timeseries_features__ml10")
def _(spark, sf):
    return day(_timeseries(spark, sf).select("commodity", "ds", "y", "y_next", "y_change", "direction", F.round("volatility", 2).alias("volatility")), "ds")


def _directions(spark, sf):
    features = cut_lineage(_timeseries(spark, sf))
    last = features.groupBy("ds").agg(F.count(F.lit(1)).alias("n")).where("n >= 3").agg(F.max("ds")).first()[0]
    return FC.predict_direction(features, str(last), list(NAMES))


@query("boosted_direction__ml6")
def _(spark, sf):
    return day(_directions(spark, sf).select("commodity", "ds", "forecast_direction", F.round("confidence_score", 4).alias("confidence_score")), "ds")


def _named_news(spark, sf):
    """All columns of the news, with the names and triples that the rules find; the given status stays."""
    found = I.extract_by_rule(view(spark, sf, "news").withColumn("_status", F.col("filter_status")))
    return found.withColumn("filter_status", F.col("_status")).drop("_status")


def _extracted(spark, sf):
    return _named_news(spark, sf).select("id", "commodity", "publish_ts", "title", "all_text", "filter_status", "named_entities", "triples")


@query("keyword_analysis__gr6")
def _(spark, sf):
    found = KW.analyse(_extracted(spark, sf), "2024-01-20", days=20)
    kinds = {"entity": (found.entities, "entity", "score"), "verb": (found.verbs, "verb", "score"), "triple": (found.triples, "triple_text", "importance")}
    parts = [df.select("commodity", F.lit(k).alias("kind"), "place", F.col(c).alias("item"), F.col(s).alias("score")) for k, (df, c, s) in kinds.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


PAST = NEWS_PX + r""", asked AS (SELECT DISTINCT commodity, date, 'vector ' || ((day(date) * 131 + place * 17 + length(commodity) * 7) * 7919 % (SELECT count(*) * 6 // 5 FROM embeddings)) AS triple_text FROM px_daily, range(1, 8) AS r(place)),
e AS (SELECT vec_id, 'vector ' || vec_id AS triple_text, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), q AS (SELECT DISTINCT triple_text, e.v FROM asked JOIN e USING (triple_text)),
near AS (SELECT q.triple_text, e.vec_id FROM q, e QUALIFY row_number() OVER (PARTITION BY q.triple_text ORDER BY round(1 - list_cosine_similarity(q.v, e.v), 9) + 0.0, e.vec_id) <= 2),
h AS (SELECT DISTINCT commodity, date, vec_id FROM asked JOIN near USING (triple_text)),
k AS (SELECT h.commodity, h.date, CAST(publish_ts AS DATE) AS publish_date, all_text AS article_text, substring(trim(regexp_replace(all_text, '[ \t\n\x0B\f\r]+', ' ', 'g')), 1, 50) AS text_prefix
  FROM h JOIN news n ON n.vec_id = h.vec_id WHERE all_text <> '' AND CAST(publish_ts AS DATE) <= h.date - 4),
u AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY commodity, date, text_prefix ORDER BY publish_date DESC, article_text COLLATE "C" DESC) = 1),
r AS (SELECT *, row_number() OVER (PARTITION BY commodity, date ORDER BY publish_date DESC, article_text COLLATE "C") AS rank FROM u QUALIFY rank <= 10),
b AS (SELECT commodity, date, close AS c0, lead(close, 1) OVER o AS c1, lead(close, 3) OVER o AS c3 FROM px_daily WINDOW o AS (PARTITION BY commodity ORDER BY date))
SELECT r.commodity, CAST(r.date AS STRING) AS date, rank, CAST(publish_date AS STRING) AS publish_date, text_prefix, c0 AS price_0, c1 AS price_1, c3 AS price_3
FROM r ASOF LEFT JOIN b ON b.commodity = r.commodity AND r.publish_date <= b.date"""


def _past_news(spark, sf):
    news, bars = view(spark, sf, "news"), view(spark, sf, "px_daily")
    place = F.explode(F.sequence(F.lit(1), F.lit(9)))  # more than are looked up
    total = max(1, view(spark, sf, "embeddings").count() * 6 // 5)  # some are not stored
    number = (F.dayofmonth("date") * 131 + F.col("place") * 17 + F.length("commodity") * 7) * 7919 % total
    triples = bars.select("commodity", "date", place.alias("place")).withColumn("triple_text", F.concat(F.lit("vector "), number.cast("string")))
    vectors = view(spark, sf, "embeddings").select(F.concat(F.lit("vector "), F.col("vec_id").cast("string")).alias("triple_text"), F.col("vec_id").alias("hash_id"), "embedding")
    bridge = news.select(F.col("vec_id").alias("hash_id"), F.col("id").alias("article_id"))
    dated = news.select("id", F.to_date("publish_ts").alias("publish_date"), "all_text", F.col("title").alias("description"))
    return PN.past_news(triples, vectors, bridge, dated, bars)


@query("past_news_retrieval__jn7_jn9_jn4_top5_jn18", PAST)
def _(spark, sf):
    past = _past_news(spark, sf)
    return day(day(past.select("commodity", "date", "rank", "publish_date", "text_prefix", "price_0", "price_1", "price_3")), "publish_date")


#: The series of the orders stand for the prices of these news; their last day becomes this one.
SERIES = {"1-URGENT": "click", "2-HIGH": "error", "3-MEDIUM": "purchase", "4-NOT SPECIFIED": "signup", "5-LOW": "view"}
LAST_DAY = datetime.date(2024, 1, 30)


def _daily_directions(spark, sf, first="2024-01-01"):
    """(commodity, target_date, forecast_direction, confidence_score, yhat): the direction forecast of every day from `first` on."""
    features = cut_lineage(_timeseries(spark, sf))
    last = features.agg(F.max("ds")).first()[0] or LAST_DAY
    names = F.create_map(*[F.lit(x) for pair in SERIES.items() for x in pair])
    moved = features.withColumns({"commodity": F.element_at(names, F.col("commodity")), "ds": F.date_add("ds", (LAST_DAY - last).days)})
    targets = moved.where(F.col("ds") >= F.lit(first).cast("date")).select("commodity", "ds")
    return FC.predict_directions(moved, targets, [SERIES[n] for n in NAMES]).select("commodity", "target_date", "forecast_direction", "confidence_score", "yhat")


@query("daily_directions__ml6")
def _(spark, sf):
    out = _daily_directions(spark, sf)
    return day(out.select("commodity", "target_date", "forecast_direction", F.round("confidence_score", 4).alias("confidence_score")), "target_date")


@query("market_records__ml8")
def _(spark, sf):
    news, bars = cut_lineage(_named_news(spark, sf)), view(spark, sf, "px_daily")
    reports = MR.prediction_reports(_voted(spark, sf), news, bars)
    found = KW.analyse_days(news, bars.select("commodity", "date"))
    vectors = X.hashed_embedding(I.triple_rows(news).withColumnRenamed("text", "triple_text"), "triple_text", 256)
    bridge = I.triple_article_map(news.withColumn("publish_date", F.col("publish_ts")))
    dated = news.select("id", F.to_date("publish_ts").alias("publish_date"), "all_text", F.col("title").alias("description"))
    past = PN.past_news(found.triples, cut_lineage(vectors.where(F.col("embedding").isNotNull())), bridge, dated, bars)
    records = MR.market_records(_daily_directions(spark, sf), reports, found.entities, past)
    return day(records.select("commodity", "date", F.to_json(F.struct("timeseries", "news", "keywords", "past_news")).alias("record")))
