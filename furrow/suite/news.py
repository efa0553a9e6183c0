"""News: gates, windows before each trading date, features, evidence and dashboards."""

from __future__ import annotations

from pyspark.sql import functions as F

from furrow.functions import reasons as RS
from furrow.functions import sentiment as X
from furrow.functions import text as TX
from furrow.operators import aggregates as A
from furrow.operators import filters as P
from furrow.operators import joins as J
from furrow.operators import topk as K
from furrow.operators import windows as W
from furrow.suite import query
from furrow.suite.prices import day
from furrow.suite.views import view, with_views

NEWS = with_views("news")
NEWS_PX = with_views("news", "px_daily")


def rounded(df, places, *cols):
    return df.withColumns({c: F.round(c, places) for c in cols})


FEATURE_SQL = """, win AS (SELECT p.commodity, p.date, n.* EXCLUDE (commodity) FROM px_daily p JOIN news n ON n.commodity = p.commodity
  AND n.publish_ts >= CAST(p.date - 7 AS TIMESTAMP) AND n.publish_ts < CAST(p.date AS TIMESTAMP)),
feat AS (SELECT commodity, date, avg(price_impact_score) AS avg_price_impact, avg(coalesce(positive_score, 0)) AS avg_positive, avg(coalesce(negative_score, 0)) AS avg_negative,
  avg(coalesce(neutral_score, 0)) AS avg_neutral, coalesce(stddev_samp(price_impact_score), 0) AS impact_std, count(*) AS news_count,
  count(*) FILTER (sentiment = 'positive') AS positive_count, count(*) FILTER (sentiment = 'negative') AS negative_count, count(*) FILTER (sentiment = 'neutral') AS neutral_count
  FROM win GROUP BY commodity, date)"""
# Means of short decimals end in exact halves at six places, so they are compared at ten.
FEATURE_COLUMNS = """round(avg_price_impact, 10) + 0.0 AS avg_price_impact, round(avg_positive, 10) AS avg_positive, round(avg_negative, 10) AS avg_negative,
round(avg_neutral, 10) AS avg_neutral, round(impact_std, 6) AS impact_std, news_count, positive_count, negative_count, neutral_count"""
FEATURE_MEANS = ("avg_price_impact", "avg_positive", "avg_negative", "avg_neutral")


def rounded_features(df):
    return rounded(rounded(df, 10, *FEATURE_MEANS), 6, "impact_std")


@query("news_window_join__jn2", NEWS_PX + FEATURE_SQL + " SELECT commodity, CAST(date AS STRING) AS date, id FROM win")
def _(spark, sf):
    return day(J.news_windows(view(spark, sf, "news"), view(spark, sf, "px_daily")).select("commodity", "date", "id"))


@query("news_window_features__agg1", NEWS_PX + FEATURE_SQL + f" SELECT commodity, CAST(date AS STRING) AS date, {FEATURE_COLUMNS} FROM feat")
def _(spark, sf):
    out = A.news_features(view(spark, sf, "news"), view(spark, sf, "px_daily"))
    return day(rounded_features(out))


@query("news_features_with_direction__agg10", NEWS_PX + FEATURE_SQL + f""", t AS (SELECT commodity, date, close, lead(close) OVER (PARTITION BY commodity ORDER BY date) AS target_close FROM px_daily)
SELECT t.commodity, CAST(t.date AS STRING) AS date, close, target_close, CASE WHEN target_close > close THEN 1 ELSE 0 END AS label, {FEATURE_COLUMNS},
CASE WHEN round(avg_price_impact, 9) = 0 OR target_close = close THEN -1 WHEN sign(round(avg_price_impact, 9)) = sign(target_close - close) THEN 1 ELSE 0 END AS agrees
FROM t JOIN feat f ON t.commodity = f.commodity AND t.date = f.date WHERE target_close IS NOT NULL AND avg_price_impact IS NOT NULL""")
def _(spark, sf):
    bars = view(spark, sf, "px_daily")
    labelled = W.next_bar_target(bars.select("commodity", "date", "close"), 0.0).drop("price_change")
    out = labelled.join(A.news_features(view(spark, sf, "news"), bars), ["commodity", "date"]).where(F.col("avg_price_impact").isNotNull())
    move = F.col("target_close") - F.col("close")
    tone = F.round("avg_price_impact", 9)
    agrees = F.when((tone == 0) | (move == 0), -1).when(F.signum(tone) == F.signum(move), 1).otherwise(0)
    return day(rounded_features(out.withColumn("agrees", agrees)))


@query("news_alignment__agg10", with_views("ratios", "px_daily") + """, s AS (SELECT date, keyword AS commodity, sum(news_count) AS news_count, (avg(pos_ratio) - avg(neg_ratio)) * 100 AS sentiment FROM ratios GROUP BY date, keyword),
d AS (SELECT p.commodity, p.date, round(s.sentiment, 6) AS sentiment, lead(p.close) OVER (PARTITION BY p.commodity ORDER BY p.date) - p.close AS mv FROM px_daily p JOIN s ON s.commodity = p.commodity AND s.date = p.date)
SELECT commodity, count(*) FILTER (sentiment <> 0 AND mv <> 0) AS days, round(avg(CASE WHEN sentiment <> 0 AND mv <> 0 THEN CASE WHEN sign(sentiment) = sign(mv) THEN 100.0 ELSE 0.0 END END), 1) AS alignment_pct,
round(avg(CASE WHEN sentiment > 0 AND mv IS NOT NULL THEN CASE WHEN mv > 0 THEN 100.0 ELSE 0.0 END END), 1) AS pos_up_pct,
round(avg(CASE WHEN sentiment > 0 AND mv IS NOT NULL THEN CASE WHEN mv < 0 THEN 100.0 ELSE 0.0 END END), 1) AS pos_down_pct FROM d GROUP BY commodity""")
def _(spark, sf):
    ratios = view(spark, sf, "ratios").withColumnsRenamed({"keyword": "commodity", "date": "target_date"})
    sentiment = rounded(A.dashboard_sentiment(ratios, ["commodity", "target_date"]), 6, "sentiment")
    prices = view(spark, sf, "px_daily").select("commodity", F.col("date").alias("target_date"), F.col("close").alias("actual_price"))
    return A.news_alignment(prices.join(sentiment, ["commodity", "target_date"]))


@query("windowed_vector_mean__agg2_udaf1", NEWS_PX + FEATURE_SQL + """, v AS (SELECT commodity, date, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS pos FROM win JOIN embeddings e ON e.vec_id = win.vec_id)
SELECT commodity, CAST(date AS STRING) AS date, pos, round(avg(CAST(x AS DOUBLE)), 5) + 0.0 AS value, count(*) AS vector_count FROM v GROUP BY commodity, date, pos""")
def _(spark, sf):
    news = view(spark, sf, "news").select("commodity", "publish_ts", "vec_id").join(view(spark, sf, "embeddings"), "vec_id")
    mean = A.windowed_vector_mean(news, view(spark, sf, "px_daily"), "embedding")
    cells = mean.select("commodity", "date", "vector_count", F.posexplode("mean_vector").alias("pos", "value"))
    return day(cells.select("commodity", "date", F.col("pos").cast("long").alias("pos"), (F.round("value", 5) + 0.0).alias("value"), "vector_count"))


@query("sentiment_distribution__agg3", NEWS + """, t AS (SELECT count(*) AS n, avg(sentiment_confidence) AS ac, avg(price_impact_score) AS ai FROM news)
SELECT sentiment, count(*) AS count, round(count(*) * 100.0 / any_value(n), 6) AS percentage, round(any_value(ac), 6) AS avg_confidence, round(any_value(ai), 6) AS avg_price_impact, any_value(n) AS total_count
FROM news, t GROUP BY sentiment""")
def _(spark, sf):
    return rounded(A.sentiment_distribution(view(spark, sf, "news")), 6, "percentage", "avg_confidence", "avg_price_impact")


@query("daily_sentiment_trend__agg4", NEWS + """ SELECT CAST(CAST(publish_ts AS DATE) AS STRING) AS date, round(avg(price_impact_score), 6) AS avg_price_impact, round(avg(sentiment_confidence), 6) AS avg_confidence, count(title) AS news_count
FROM news GROUP BY CAST(publish_ts AS DATE)""")
def _(spark, sf):
    return day(rounded(A.daily_sentiment_trend(view(spark, sf, "news"), "publish_ts"), 6, "avg_price_impact", "avg_confidence"))


@query("summary_ratios__agg5", NEWS + """ SELECT commodity, CAST(CAST(publish_ts AS DATE) AS STRING) AS date, count(*) AS news_count, round(CAST(count(*) FILTER (sentiment = 'positive') AS DOUBLE) / count(*), 3) AS positive_ratio,
round(CAST(count(*) FILTER (sentiment = 'negative') AS DOUBLE) / count(*), 3) AS negative_ratio, round(CAST(count(*) FILTER (sentiment = 'neutral') AS DOUBLE) / count(*), 3) AS neutral_ratio
FROM news GROUP BY commodity, CAST(publish_ts AS DATE)""")
def _(spark, sf):
    news = view(spark, sf, "news").withColumn("date", F.to_date("publish_ts"))
    return day(A.summary_ratios(news, ["commodity", "date"]))


RATIOS = with_views("ratios")


@query("dashboard_sentiment__agg6", RATIOS + """ SELECT CAST(date AS STRING) AS date, keyword, CAST(sum(news_count) AS BIGINT) AS news_count, round(avg(pos_ratio), 6) AS pos_ratio, round(avg(neg_ratio), 6) AS neg_ratio,
round((avg(pos_ratio) - avg(neg_ratio)) * 100, 4) + 0.0 AS sentiment FROM ratios GROUP BY date, keyword""")
def _(spark, sf):
    out = A.dashboard_sentiment(view(spark, sf, "ratios"), ["date", "keyword"])
    out = rounded(out, 6, "pos_ratio", "neg_ratio").withColumn("sentiment", F.round("sentiment", 4) + 0.0)
    return day(out)


@query("keyword_case_insensitive__flt22", RATIOS + " SELECT CAST(date AS STRING) AS date, keyword, source, news_count FROM ratios WHERE lower(keyword) = lower('VIEW')")
def _(spark, sf):
    return day(P.keyword_equals(view(spark, sf, "ratios"), "VIEW").select("date", "keyword", "source", "news_count"))


JOINED = with_views("forecasts", "ratios") + """, s AS (SELECT date AS target_date, keyword AS commodity, CAST(sum(news_count) AS BIGINT) AS news_count, avg(pos_ratio) AS pos_ratio, avg(neg_ratio) AS neg_ratio, (avg(pos_ratio) - avg(neg_ratio)) * 100 AS sentiment
FROM ratios GROUP BY date, keyword), j AS (SELECT f.*, s.news_count, s.pos_ratio, s.neg_ratio, s.sentiment FROM forecasts f LEFT JOIN s ON s.commodity = f.commodity AND s.target_date = f.target_date)"""


def _joined(spark, sf):
    ratios = view(spark, sf, "ratios").withColumnsRenamed({"keyword": "commodity", "date": "target_date"})
    return J.with_daily_sentiment(view(spark, sf, "forecasts"), A.dashboard_sentiment(ratios, ["commodity", "target_date"]))


@query("forecasts_with_sentiment__jn5", JOINED + " SELECT commodity, CAST(target_date AS STRING) AS target_date, actual_price, news_count, round(pos_ratio, 6) AS pos_ratio, round(sentiment, 4) + 0.0 AS sentiment FROM j")
def _(spark, sf):
    out = _joined(spark, sf).select("commodity", "target_date", "actual_price", "news_count", F.round("pos_ratio", 6).alias("pos_ratio"), (F.round("sentiment", 4) + 0.0).alias("sentiment"))
    return day(out, "target_date")


@query("daily_means__agg7", JOINED + """ SELECT CAST(target_date AS STRING) AS target_date, round(avg(sentiment), 4) + 0.0 AS sentiment, round(avg(actual_price), 4) AS actual_price, CAST(sum(news_count) AS BIGINT) AS news_count
FROM j WHERE actual_price IS NOT NULL AND sentiment IS NOT NULL GROUP BY target_date""")
def _(spark, sf):
    out = A.daily_means(_joined(spark, sf), ["target_date"])
    return day(out.withColumn("sentiment", F.round("sentiment", 4) + 0.0).withColumn("actual_price", F.round("actual_price", 4)), "target_date")


@query("latest_common_date__agg22", NEWS_PX + " SELECT CAST(least((SELECT max(date) FROM px_daily), (SELECT CAST(max(publish_ts) AS DATE) FROM news)) AS STRING) AS latest_common_date")
def _(spark, sf):
    news = view(spark, sf, "news").withColumn("publish_date", F.to_date("publish_ts"))
    return day(A.latest_common_date(view(spark, sf, "px_daily"), news, "date", "publish_date"), "latest_common_date")


@query("range_run_outcomes__agg24", NEWS_PX + FEATURE_SQL + """, d AS (SELECT CAST(range AS DATE) AS date FROM range(DATE '2024-01-01', DATE '2024-02-10', INTERVAL 1 DAY))
SELECT k.commodity, count(f.date) AS succeeded, count(*) - count(f.date) AS failed FROM (SELECT DISTINCT commodity FROM px_daily) k CROSS JOIN d LEFT JOIN feat f ON f.commodity = k.commodity AND f.date = d.date GROUP BY k.commodity""")
def _(spark, sf):
    bars = view(spark, sf, "px_daily")
    done = A.news_features(view(spark, sf, "news"), bars).select("commodity", "date")
    return A.run_outcomes(done, "2024-01-01", "2024-02-09", bars)


@query("accepted_news__flt9", NEWS + " SELECT id, filter_status FROM news WHERE filter_status IN ('T', 'true')")
def _(spark, sf):
    return P.accepted(view(spark, sf, "news")).select("id", "filter_status")


@query("keyword_gate__flt10", NEWS + """ SELECT id, key_word FROM news WHERE lower(key_word) LIKE '%corn%' AND (lower(key_word) LIKE '%price%' OR lower(key_word) LIKE '%demand%' OR lower(key_word) LIKE '%supply%' OR lower(key_word) LIKE '%inventory%')""")
def _(spark, sf):
    return P.keyword_gate(view(spark, sf, "news")).select("id", "key_word")


@query("keyword_pattern__flt11", NEWS + " SELECT id, key_word FROM news WHERE regexp_matches(key_word, '(?i)(wheat|usda$)')")
def _(spark, sf):
    return P.keyword_gate(view(spark, sf, "news"), pattern="(wheat|usda$)").select("id", "key_word")


@query("keyword_parts__flt12", NEWS + " SELECT id, key_word FROM news WHERE lower(key_word) IN ('corn and (price or demand or supply or inventory)', 'usda')")
def _(spark, sf):
    return P.keyword_any_of(view(spark, sf, "news"), "corn and (price or demand or supply or inventory) OR USDA").select("id", "key_word")


def _hit(terms):
    return f"regexp_matches(txt, '{'|'.join(terms)}')"


SCORED = NEWS + f""", t AS (SELECT *, lower(coalesce(key_word, '') || ' ' || coalesce(all_text, '')) AS txt FROM news),
scored AS (SELECT *, CASE WHEN {_hit(P.EXCLUDED_TERMS)} THEN 0 ELSE CASE WHEN {_hit(P.COMMODITY_TERMS)} THEN 2 ELSE 0 END + CASE WHEN {_hit(P.MARKET_TERMS)} THEN 1 ELSE 0 END
+ CASE WHEN {_hit(P.POLICY_CLIMATE_TERMS)} THEN 2 ELSE 0 END END AS score FROM t)"""


def _scored(spark, sf):
    return P.with_relevance_score(view(spark, sf, "news"), "key_word", "all_text")


@query("relevance_score__flt13", SCORED + " SELECT id, score FROM scored")
def _(spark, sf):
    return _scored(spark, sf).select("id", "score")


@query("relevance_gate__flt14", SCORED + " SELECT id, 'T' AS filter_status, score FROM scored WHERE score >= 3 AND (filter_status = 'T' OR score >= 5)")
def _(spark, sf):
    return P.relevance_gate(_scored(spark, sf)).select("id", "filter_status", "score")


@query("latest_per_prefix__win11", NEWS + r""", k AS (SELECT id, publish_ts, substring(trim(regexp_replace(coalesce(all_text, title), '[ \t\n\x0B\f\r]+', ' ', 'g')), 1, 50) AS text_prefix FROM news),
r AS (SELECT *, row_number() OVER (PARTITION BY text_prefix ORDER BY publish_ts DESC, id DESC) AS i FROM k) SELECT id, text_prefix FROM r WHERE i = 1""")
def _(spark, sf):
    keyed = view(spark, sf, "news").select("id", "publish_ts", TX.prefix_key(F.coalesce("all_text", "title")).alias("text_prefix"))
    return W.latest_per(keyed, ["text_prefix"], ["publish_ts", "id"]).select("id", "text_prefix")


BRIDGE = NEWS + """, bridge AS (SELECT md5(CAST(vec_id AS STRING)) AS hash_id, id AS article_id FROM news),
wanted AS (SELECT md5(CAST(vec_id AS STRING)) AS hash_id FROM embeddings WHERE label = 3)"""


@query("articles_of_hashes__jn4_set5", BRIDGE + """ SELECT DISTINCT n.title AS description, CAST(CAST(n.publish_ts AS DATE) AS STRING) AS publish_date FROM news n WHERE n.id IN (SELECT article_id FROM bridge WHERE hash_id IN (SELECT hash_id FROM wanted))
AND CAST(n.publish_ts AS DATE) <= DATE '2024-01-25' - 4""")
def _(spark, sf):
    news = view(spark, sf, "news").withColumn("publish_date", F.to_date("publish_ts")).withColumnRenamed("title", "description")
    bridge = news.select(F.md5(F.col("vec_id").cast("string")).alias("hash_id"), F.col("id").alias("article_id"))
    wanted = view(spark, sf, "embeddings").where("label = 3").select(F.md5(F.col("vec_id").cast("string")).alias("hash_id"))
    return day(J.article_dates(bridge, news, wanted, "2024-01-25"), "publish_date")


@query("combined_text__fn7", NEWS + """, c AS (SELECT id, trim(coalesce(title, '') || ' ' || coalesce(key_word, '')) AS t, all_text FROM news)
SELECT id, CASE WHEN length(t) < 50 AND all_text IS NOT NULL THEN trim(t || ' ' || substring(all_text, 1, 500)) ELSE t END AS combined_text FROM c""")
def _(spark, sf):
    return view(spark, sf, "news").select("id", TX.combined_text(F.col("title"), F.col("key_word"), F.col("all_text")).alias("combined_text"))


@query("text_prefix__fn8", NEWS + r" SELECT id, substring(trim(regexp_replace(all_text, '[ \t\n\x0B\f\r]+', ' ', 'g')), 1, 50) AS text_prefix FROM news")
def _(spark, sf):
    return view(spark, sf, "news").select("id", TX.prefix_key(F.col("all_text")).alias("text_prefix"))


GOOD, BAD = ("the", "la", "une", "ing"), ("of", "de", "que", "und")
LEXICON_SQL = NEWS + r""", w AS (SELECT id, all_text, len(list_filter(regexp_split_to_array(lower(all_text), '[^\p{L}]+'), lambda x: x IN ('the', 'la', 'une', 'ing'))) * 0.1 AS p,
len(list_filter(regexp_split_to_array(lower(all_text), '[^\p{L}]+'), lambda x: x IN ('of', 'de', 'que', 'und'))) * 0.1 AS n FROM news),
g AS (SELECT *, greatest(p, n, 1.0) AS m FROM w), s AS (SELECT id, CASE WHEN trim(all_text) = '' THEN 0.0 ELSE exp(CAST(p - m AS DOUBLE)) / (exp(CAST(p - m AS DOUBLE)) + exp(CAST(n - m AS DOUBLE)) + exp(CAST(1.0 - m AS DOUBLE))) END AS ps,
CASE WHEN trim(all_text) = '' THEN 0.0 ELSE exp(CAST(n - m AS DOUBLE)) / (exp(CAST(p - m AS DOUBLE)) + exp(CAST(n - m AS DOUBLE)) + exp(CAST(1.0 - m AS DOUBLE))) END AS ns,
CASE WHEN trim(all_text) = '' THEN 0.0 ELSE exp(CAST(1.0 - m AS DOUBLE)) / (exp(CAST(p - m AS DOUBLE)) + exp(CAST(n - m AS DOUBLE)) + exp(CAST(1.0 - m AS DOUBLE))) END AS us, trim(all_text) = '' AS blank FROM g)"""


@query("lexicon_sentiment__fn14_udf1", LEXICON_SQL + """ SELECT id, round(ps, 6) AS positive_score, round(ns, 6) AS negative_score, round(us, 6) AS neutral_score,
CASE WHEN blank THEN 'neutral' WHEN ps >= ns AND ps >= us THEN 'positive' WHEN ns >= us THEN 'negative' ELSE 'neutral' END AS sentiment, round(CASE WHEN blank THEN 0.0 ELSE greatest(ps, ns, us) END, 6) AS sentiment_confidence,
round(ps - ns, 6) + 0.0 AS price_impact_score FROM s""")
def _(spark, sf):
    out = X.lexicon_scores(view(spark, sf, "news").select("id", "all_text"), "all_text", GOOD, BAD, scale=0.1)
    out = rounded(out, 6, "positive_score", "negative_score", "neutral_score", "sentiment_confidence", "price_impact_score")
    return out.drop("all_text").withColumn("price_impact_score", F.col("price_impact_score") + 0.0)


@query("text_embedding__udf2")
def _(spark, sf):
    out = X.hashed_embedding(view(spark, sf, "documents").select("doc_id", "text"), "text", 256)
    norm = F.aggregate("embedding", F.lit(0.0), lambda acc, x: acc + x * x)
    return out.select("doc_id", F.round(norm, 6).alias("squared_norm"), F.size("embedding").alias("dimensions"))


DIRECTED = NEWS_PX + FEATURE_SQL + """, dir AS (SELECT commodity, date, CASE WHEN round(avg_price_impact, 9) > 0.02 THEN 'up' WHEN round(avg_price_impact, 9) < -0.02 THEN 'down' ELSE 'stable' END AS direction FROM feat WHERE avg_price_impact IS NOT NULL),
art AS (SELECT w.commodity, w.date, d.direction, w.id, w.title, coalesce(w.price_impact_score, 0) AS impact FROM win w JOIN dir d ON d.commodity = w.commodity AND d.date = w.date),
strong AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY commodity, date ORDER BY abs(impact) DESC, id) AS strength_rank FROM art) WHERE strength_rank <= 15),
sided AS (SELECT *, CASE WHEN (direction = 'up' AND impact > 0.1) OR (direction = 'down' AND impact < -0.1) OR (direction = 'stable' AND abs(impact) < 0.1) THEN 'supporting' ELSE 'opposing' END AS side FROM strong),
ev AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY commodity, date, side ORDER BY strength_rank) AS side_rank FROM sided) WHERE side_rank <= 3)"""


def directed_articles(spark, sf):
    bars, news = view(spark, sf, "px_daily"), view(spark, sf, "news")
    impact = F.round("avg_price_impact", 9)
    direction = F.when(impact > 0.02, "up").when(impact < -0.02, "down").otherwise("stable")
    features = A.news_features(news, bars).where(F.col("avg_price_impact").isNotNull())
    articles = J.news_windows(news.select("commodity", "publish_ts", "id", "title", "price_impact_score"), bars)
    return articles.join(features.select("commodity", "date", direction.alias("direction")), ["commodity", "date"])


@query("ranked_evidence__top2", DIRECTED + " SELECT commodity, CAST(date AS STRING) AS date, direction, id, side, strength_rank, side_rank, round(impact, 3) AS impact FROM ev")
def _(spark, sf):
    out = K.ranked_evidence(directed_articles(spark, sf), ["commodity", "date"])
    impact = F.round(F.coalesce("price_impact_score", F.lit(0.0)), 3).alias("impact")
    return day(out.select("commodity", "date", "direction", "id", "side", "strength_rank", "side_rank", impact))


@query("merged_evidence__top3", DIRECTED + """, m AS (SELECT *, row_number() OVER (PARTITION BY commodity, date ORDER BY abs(impact) DESC, CASE WHEN side = 'supporting' THEN 0 ELSE 1 END, side_rank) AS evidence_rank FROM ev)
SELECT commodity, CAST(date AS STRING) AS date, id, side, evidence_rank FROM m WHERE evidence_rank <= 5""")
def _(spark, sf):
    ranked = K.ranked_evidence(directed_articles(spark, sf), ["commodity", "date"])
    return day(K.merged_evidence(ranked, ["commodity", "date"]).select("commodity", "date", "id", "side", "evidence_rank"))


@query("past_news__top5", NEWS + r""", k AS (SELECT commodity, CAST(publish_ts AS DATE) AS publish_date, all_text AS article_text, substring(trim(regexp_replace(all_text, '[ \t\n\x0B\f\r]+', ' ', 'g')), 1, 50) AS text_prefix FROM news WHERE all_text <> ''),
u AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY commodity, text_prefix ORDER BY publish_date DESC, article_text COLLATE "C" DESC) AS i FROM k) WHERE i = 1),
r AS (SELECT *, row_number() OVER (PARTITION BY commodity ORDER BY publish_date DESC, article_text COLLATE "C") AS rank FROM u)
SELECT commodity, CAST(publish_date AS STRING) AS publish_date, text_prefix, rank FROM r WHERE rank <= 10""")
def _(spark, sf):
    news = view(spark, sf, "news").select("commodity", F.to_date("publish_ts").alias("publish_date"), "all_text", F.col("title").alias("description"))
    return day(K.past_news(news, ["commodity"]).select("commodity", "publish_date", "text_prefix", "rank"), "publish_date")


@query("report_reasons__fn22", DIRECTED + """, x AS (SELECT f.commodity, f.date, d.direction, round(f.avg_price_impact, 3) AS ai, round(CAST(positive_count AS DOUBLE) / news_count, 3) AS pr, round(CAST(negative_count AS DOUBLE) / news_count, 3) AS nr, round(CAST(neutral_count AS DOUBLE) / news_count, 3) AS ur,
CASE news_count % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS agreement, t.impact AS ti, t.title AS tt FROM feat f JOIN dir d ON d.commodity = f.commodity AND d.date = f.date
LEFT JOIN ev t ON t.commodity = f.commodity AND t.date = f.date AND t.side = 'supporting' AND t.side_rank = 1)
SELECT commodity, CAST(date AS STRING) AS date, concat_ws(' | ',
CASE WHEN direction = 'up' AND pr > 0.5 THEN '긍정 기사 비율 ' || CAST(CAST(round(pr * 100, 1) AS DECIMAL(18,1)) AS STRING) || '%로 시장 낙관론 우세' END,
CASE WHEN direction = 'up' AND ai > 0.1 THEN '평균 가격 영향도 ' || CAST(CAST(round(CAST(ai AS DECIMAL(18,6)), 2) AS DECIMAL(18,2)) AS STRING) || '로 긍정적' END,
CASE WHEN direction = 'down' AND nr > 0.5 THEN '부정 기사 비율 ' || CAST(CAST(round(nr * 100, 1) AS DECIMAL(18,1)) AS STRING) || '%로 시장 비관론 확산' END,
CASE WHEN direction = 'down' AND ai < -0.1 THEN '평균 가격 영향도 ' || CAST(CAST(round(CAST(ai AS DECIMAL(18,6)), 2) AS DECIMAL(18,2)) AS STRING) || '로 부정적' END,
CASE WHEN direction = 'stable' AND ur > 0.4 THEN '중립 기사 비율 ' || CAST(CAST(round(ur * 100, 1) AS DECIMAL(18,1)) AS STRING) || '%로 시장 관망세' END,
CASE WHEN abs(ti) > 0.2 THEN '주요 이슈 (영향도 ' || CAST(CAST(round(CAST(ti AS DECIMAL(18,6)), 2) AS DECIMAL(18,2)) AS STRING) || '): ' || substring(tt, 1, 60) || '...' END,
CASE agreement WHEN 'high' THEN '3개 앙상블 모델 강한 합의' WHEN 'medium' THEN '모델 간 부분 합의, 중간 수준 신뢰도' ELSE '모델 간 의견 차이 존재, 신중한 해석 필요' END) AS reasoning FROM x""")
def _(spark, sf):
    features = A.news_features(view(spark, sf, "news"), view(spark, sf, "px_daily")).where(F.col("avg_price_impact").isNotNull())
    ranked = K.ranked_evidence(directed_articles(spark, sf), ["commodity", "date"])
    best = ranked.where("side = 'supporting' AND side_rank = 1").select("commodity", "date", "title", F.coalesce("price_impact_score", F.lit(0.0)).alias("top_impact"))
    impact = F.round("avg_price_impact", 9)
    direction = F.when(impact > 0.02, RS.UP).when(impact < -0.02, RS.DOWN).otherwise(RS.STABLE)
    agreement = F.when(F.col("news_count") % 3 == 0, "high").when(F.col("news_count") % 3 == 1, "medium").otherwise("low")
    ratio = lambda c: F.round(F.col(c) / F.col("news_count"), 3)
    reasoning = RS.detailed_reasoning(direction, agreement, ratio("positive_count"), ratio("negative_count"), ratio("neutral_count"),
                                      F.round("avg_price_impact", 3), F.col("top_impact"), F.col("title"))
    return day(features.join(best, ["commodity", "date"], "left").select("commodity", "date", reasoning.alias("reasoning")))


@query("interpretation_bands__fn23", with_views("forecasts") + """ SELECT commodity, CAST(target_date AS STRING) AS target_date, CASE WHEN actual_price > 108.88 THEN '상승 추세' WHEN actual_price < 74.58 THEN '하락 추세' ELSE '횡보 추세' END AS trend_band,
CASE WHEN yearly > 50 THEN '높음' WHEN yearly < 40 THEN '낮음' ELSE '중간' END AS volatility_band, CASE WHEN weekly > 0 THEN '긍정적 영향' WHEN weekly < 0 THEN '부정적 영향' ELSE '중립' END AS weekly_band,
CASE WHEN ema_effect > 0 THEN '상승 요인' WHEN ema_effect < 0 THEN '하락 요인' ELSE '중립' END AS ema_band FROM forecasts""")
def _(spark, sf):
    return day(view(spark, sf, "forecasts").select(
        "commodity", "target_date", RS.trend_band(F.col("actual_price")).alias("trend_band"), RS.volatility_band(F.col("yearly")).alias("volatility_band"),
        RS.sign_band(F.col("weekly")).alias("weekly_band"), RS.sign_band(F.col("ema_effect"), "상승 요인", "하락 요인").alias("ema_band")), "target_date")
