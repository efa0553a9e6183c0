"""Reports and agent messages read back into columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from furrow.functions import reports as R
from furrow.operators import aggregates as A
from furrow.suite import query
from furrow.suite.prices import day
from furrow.suite.views import view, with_views

REP = with_views("reports")
CELL = "trim(split_part(split_part(report_text, chr(10), 4), '|', {}))"
WORD = "CASE event_id % 4 WHEN 0 THEN 'BUY' WHEN 1 THEN 'HOLD' WHEN 2 THEN 'SELL' ELSE 'WAIT' END"


@query("report_opinion__fn25", REP + r""" SELECT event_id, CASE WHEN event_id % 7 = 0 THEN regexp_extract(report_text, '(?s)\|\s*어제 종가\s*\|[^|]*\|[^|]*\|[^|]*\|\s*종합 의견\s*\|.*?\n[^\n]*\n\s*\|[^|]*\|[^|]*\|[^|]*\|[^|]*\|\s*(SELL|HOLD|BUY)\s*\|', 1)
ELSE '' END AS opinion FROM reports""")
def _(spark, sf):
    # The five-column layout with the opinion in fourth place ends in the confidence, which the format does not read as an opinion.
    return view(spark, sf, "reports").select("event_id", R.opinion(F.col("report_text")).alias("opinion"))


@query("report_summary_row__fn26", REP + f""" SELECT event_id, {CELL.format(2)} AS close, CASE WHEN event_id % 7 = 0 THEN {CELL.format(3)} ELSE '' END AS ts_forecast, CASE WHEN event_id % 7 = 0 THEN {CELL.format(4)} ELSE {CELL.format(3)} END AS ml_dir,
CASE WHEN event_id % 7 = 0 THEN {CELL.format(5)} ELSE {CELL.format(4)} END AS sentiment, CASE WHEN event_id % 7 = 0 THEN {CELL.format(6)} ELSE {CELL.format(5)} END AS opinion, CASE WHEN event_id % 7 = 0 THEN '' ELSE {CELL.format(6)} END AS confidence FROM reports""")
def _(spark, sf):
    return R.with_summary_row(view(spark, sf, "reports"), "report_text").select("event_id", "summary.*")


@query("report_labels__fn27", REP + f""" SELECT event_id, {WORD} AS opinion, CASE WHEN event_id % 7 = 0 THEN '435.5' END AS ts_forecast, CASE WHEN event_id % 7 = 0 THEN 'Down' ELSE '상승' END AS ml_direction,
CASE WHEN event_id % 7 = 0 THEN -55 ELSE 55 END AS mood_score, CASE WHEN event_id % 7 = 0 THEN '부정적' ELSE '긍정적' END AS mood FROM reports""")
def _(spark, sf):
    df = R.with_summary_row(view(spark, sf, "reports"), "report_text")
    t, s = F.col("report_text"), F.col("summary")
    return df.select("event_id", R.opinion_or_hold(t, s).alias("opinion"), R.forecast_text(t, s).alias("ts_forecast"),
                     R.model_direction(t, s).alias("ml_direction"), R.mood_score(t, s).alias("mood_score"), R.mood_label(t, s).alias("mood"))


@query("report_components__fn28", REP + r""", c AS (SELECT event_id, unnest(['추세', '연간', '주기', '주간', '잔차']) AS component, unnest([regexp_extract(report_text, '추세\s*[:=]\s*(-?\d+\.?\d*)', 1), regexp_extract(report_text, '연간\s*[:=]\s*(-?\d+\.?\d*)', 1), regexp_extract(report_text, '주기\s*[:=]\s*(-?\d+\.?\d*)', 1),
 regexp_extract(report_text, '주간\s*[:=]\s*(-?\d+\.?\d*)', 1), regexp_extract(report_text, '잔차\s*[:=]\s*(-?\d+\.?\d*)', 1)]) AS v FROM reports),
k AS (SELECT event_id, component, CAST(v AS DOUBLE) AS value, count(*) OVER (PARTITION BY event_id) AS n FROM c WHERE v <> '') SELECT event_id, component, value + 0.0 AS value FROM k WHERE n >= 3""")
def _(spark, sf):
    found = view(spark, sf, "reports").select("event_id", R.components(F.col("report_text")).alias("parts"))
    return found.select("event_id", F.explode("parts").alias("component", "value")).withColumn("value", F.col("value") + 0.0)


@query("report_news_counts__fn29", REP + r""" SELECT event_id, CAST(len(regexp_extract_all(regexp_extract(report_text, '(?s)A-1\. 긍정적인 뉴스\n(.*?)A-2\.', 1), '(?m)^\s*\d+\s')) AS INTEGER) AS positive,
CAST(len(regexp_extract_all(regexp_extract(report_text, '(?s)A-2\. 부정적인 뉴스\n(.*?)\nB\. ', 1), '(?m)^\s*\d+\s')) AS INTEGER) AS negative FROM reports""")
def _(spark, sf):
    counts = view(spark, sf, "reports").select("event_id", R.news_counts(F.col("report_text")).alias("c"))
    return counts.select("event_id", "c.positive", "c.negative")


ESCAPED = "replace(replace(replace(replace(replace(report_text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;')"


@query("highlighted_report__fn30", REP + rf""" SELECT event_id, regexp_replace(regexp_replace({ESCAPED}, '({'|'.join(R.POSITIVE_WORDS)})', '<span class=''highlight-pos''>\1</span>', 'g'), '({'|'.join(R.NEGATIVE_WORDS)})', '<span class=''highlight-neg''>\1</span>', 'g') AS html FROM reports""")
def _(spark, sf):
    return view(spark, sf, "reports").select("event_id", R.highlighted(F.col("report_text")).alias("html"))


@query("report_without_meta_line__fn31", REP + r""" SELECT event_id, regexp_replace(report_text, '(?m)^\s*\*\*날짜\*\*:\s*[0-9]{4}-[0-9]{2}-[0-9]{2}\s*\|\s*\*\*종목\*\*:\s*.+?\s*$\n?', '') AS body FROM reports""")
def _(spark, sf):
    return view(spark, sf, "reports").select("event_id", R.without_meta_line(F.col("report_text")).alias("body"))


@query("compressed_text__fn32", with_views("news") + rf""", l AS (SELECT doc_id, list_filter(list_transform(string_split(all_text, chr(10)), lambda x: trim(x)), lambda x: x <> '' AND (starts_with(x, '#') OR ends_with(x, ':') OR regexp_matches(x, '\p{{Nd}}|{'|'.join(R.KEPT_WORDS)}'))) AS k,
substring(trim(regexp_replace(all_text, '[\t\n\f\r\x0B ]+', ' ', 'g')), 1, 120) AS question FROM news) SELECT doc_id, right(coalesce(array_to_string(k, chr(10)), ''), 300) AS compact, question FROM l""")
def _(spark, sf):
    t = F.col("all_text")
    return view(spark, sf, "news").select("doc_id", R.compressed(t).alias("compact"), R.compressed_question(t).alias("question"))


@query("section_keys__fn33", REP + """ SELECT event_id, CASE WHEN event_id % 7 = 0 THEN '| 어제 종가 | 시계열 분석 | 머신러닝 예측 | 시장 심리 | 종합 의견 |' ELSE '| 어제 종가 | 퀀트 예측 | 시장 심리 | 종합 의견 | 확신도 |' END AS quant_line, '3. 종합 의견' AS summary_line,
CAST(len(list_filter(string_split(report_text, chr(10)), lambda x: regexp_matches(x, '^\\s*(?:[-*]\\s*)?(?:#{1,6}\\s*)?(?:\\*\\*)?\\s*(?:\\d+\\.|\\d+\\)|[IVX]+\\.)\\s*.+$|종합 의견|뉴스 분석|뉴스 빅데이터|시장 심리|인사이트|Insight'))) AS INTEGER) AS headers FROM reports""".replace("\\\\", "\\"))
def _(spark, sf):
    t = F.col("report_text")
    return view(spark, sf, "reports").select("event_id", R.header_line(t, "quant").alias("quant_line"), R.header_line(t, "summary").alias("summary_line"), F.size(R.header_lines(t)).alias("headers"))


@query("report_sections__udtf1", REP + r""", b AS (SELECT event_id, string_split(report_text, chr(10)) AS ls FROM reports), x AS (SELECT event_id, unnest(ls) AS l, generate_subscripts(ls, 1) AS i FROM b),
h AS (SELECT *, regexp_matches(l, '^\s*(?:[-*]\s*)?(?:#{1,6}\s*)?(?:\*\*)?\s*(?:\d+\.|\d+\)|[IVX]+\.)\s*.+$|종합 의견|뉴스 분석|뉴스 빅데이터|시장 심리|인사이트|Insight') AS head FROM x),
g AS (SELECT *, sum(CASE WHEN head THEN 1 ELSE 0 END) OVER (PARTITION BY event_id ORDER BY i) AS grp FROM h),
s AS (SELECT event_id, grp, max(CASE WHEN head THEN coalesce(nullif(regexp_extract(trim(l), '^\s*(?:[-*]\s*)?(?:#{1,6}\s*)?(?:\*\*)?\s*(?:\d+\.|\d+\)|[IVX]+\.)\s*(.+?)\s*$', 1), ''), trim(l)) END) AS title, trim(string_agg(CASE WHEN NOT head THEN l END, chr(10) ORDER BY i), chr(10) || ' ') AS body, count(*) FILTER (NOT head) AS n FROM g GROUP BY event_id, grp)
SELECT event_id, row_number() OVER (PARTITION BY event_id ORDER BY grp) - 1 AS section, coalesce(title, '보고서 본문') AS title, body FROM s WHERE n > 0""")
def _(spark, sf):
    out = R.section_rows(view(spark, sf, "reports"), "report_text")
    return out.select("event_id", F.col("section").cast("long").alias("section"), "title", "body")


@query("section_price_rows__udtf2", REP + r""", x AS (SELECT event_id, unnest(string_split(report_text, chr(10))) AS l FROM reports), m AS (SELECT event_id, regexp_extract(l, '^\s*(\d{4}[-./]\d{1,2}[-./]\d{1,2})\s+(-?\d+\.?\d*)\s+(-?\d+\.?\d*)\s+(-?\d+\.?\d*)', ['price_date', 'a', 'b', 'c']) AS r FROM x)
SELECT event_id, r.price_date AS price_date, CAST(r.a AS DOUBLE) AS d0, CAST(r.b AS DOUBLE) AS d1, CAST(r.c AS DOUBLE) AS d3 FROM m WHERE r.price_date <> ''""")
def _(spark, sf):
    return R.price_rows(view(spark, sf, "reports"), "report_text").select("event_id", "price_date", "d0", "d1", "d3")


@query("injected_confidence__fn24", REP + """ SELECT event_id, CASE WHEN event_id % 7 = 0 THEN split_part(report_text, chr(10), 4) ELSE '| ' || trim(split_part(split_part(report_text, chr(10), 4), '|', 2)) || ' | 상승 | 긍정적 | ' || trim(split_part(split_part(report_text, chr(10), 4), '|', 5)) || ' | ' || CAST(event_id % 101 AS STRING) || ' |' END AS data_row,
length(report_text) + CASE WHEN event_id % 7 = 0 THEN 0 ELSE length(CAST(event_id % 101 AS STRING)) - 2 END AS length FROM reports""")
def _(spark, sf):
    changed = R.inject_confidence(F.col("report_text"), (F.col("event_id") % 101) / 100)
    return view(spark, sf, "reports").select("event_id", F.get(F.split(changed, "\n"), F.lit(3)).alias("data_row"), F.length(changed).cast("long").alias("length"))


@query("report_quality_gate__fn38", REP + " SELECT event_id FROM reports WHERE length(trim(report_text)) >= 330")
def _(spark, sf):
    return view(spark, sf, "reports").where(R.passes_quality(F.col("report_text"), 330)).select("event_id")


@query("bucket_and_path__fn34", """, u AS (SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'gs://' || regexp_replace(url, '^https?://', '') WHEN 1 THEN 'https://storage.googleapis.com/' || regexp_replace(url, '^https?://', '') ELSE url END AS address FROM pages)
SELECT page_id, CASE WHEN page_id % 3 = 2 THEN NULL ELSE split_part(regexp_replace(address, '^(gs|https)://(storage.googleapis.com/)?', ''), '/', 1) END AS bucket,
CASE page_id % 3 WHEN 0 THEN regexp_replace(address, '^gs://[^/]*/?', '') WHEN 1 THEN regexp_extract(address, '^https://storage.googleapis.com/[^/?#]*/?([^?#]*)', 1) END AS path FROM u""".replace(", u AS", "WITH u AS", 1))
def _(spark, sf):
    bare = F.regexp_replace("url", "^https?://", "")
    address = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("gs://"), bare)).when(
        F.col("page_id") % 3 == 1, F.concat(F.lit("https://storage.googleapis.com/"), bare)).otherwise(F.col("url"))
    return view(spark, sf, "pages").select("page_id", R.bucket_and_path(address).alias("a")).select("page_id", "a.bucket", "a.path")


MSG = with_views("messages")


@query("message_counts__agg23", MSG + """ SELECT conv_id, count(*) AS messages, count(*) FILTER (role = 'user') AS user_messages, count(*) FILTER (role = 'assistant') AS assistant_messages, count(*) FILTER (role = 'system') AS system_messages, count(*) FILTER (role = 'tool') AS tool_messages FROM messages GROUP BY conv_id""")
def _(spark, sf):
    return A.message_counts(view(spark, sf, "messages"))


@query("message_text__fn35", MSG + " SELECT conv_id, turn, CASE WHEN turn % 3 = 2 THEN text ELSE said END AS content FROM messages")
def _(spark, sf):
    return view(spark, sf, "messages").select("conv_id", "turn", R.message_text(F.col("text")).alias("content"))


@query("tool_results__udtf3", MSG + """, ok AS (SELECT * FROM messages WHERE name IS NOT NULL AND json_valid(text) AND json_extract(text, '$.error') IS NULL)
SELECT conv_id, name, max_by(text, turn) AS result FROM ok GROUP BY conv_id, name""")
def _(spark, sf):
    return R.tool_results(view(spark, sf, "messages"))


@query("final_decisions__udtf3", MSG + """ SELECT conv_id, max_by(text, turn) AS decision FROM messages WHERE name = 'decision_meta' AND json_valid(text) AND json_extract_string(CASE WHEN json_valid(text) THEN text END, '$.stage') = 'v2' GROUP BY conv_id""")
def _(spark, sf):
    return R.final_decision(view(spark, sf, "messages"))


@query("final_summaries__udtf3", MSG + r""" SELECT conv_id, max_by(regexp_replace(trim(said), '\\+$', ''), turn) AS summary FROM messages WHERE role = 'assistant' AND length(regexp_replace(trim(said), '\\+$', '')) > 50 GROUP BY conv_id""")
def _(spark, sf):
    return R.final_summary(view(spark, sf, "messages"))


@query("evidence_rows__udtf3", with_views("news_results") + f""", ok AS (SELECT conv_id, turn, text::JSON AS j FROM news_results WHERE name = 'news_sentiment_analyzer' AND json_valid(text)),
e AS (SELECT conv_id, turn, unnest(json_extract(j, '$.evidence_news[*]')) AS e, generate_subscripts(json_extract(j, '$.evidence_news[*]'), 1) - 1 AS place FROM ok WHERE NOT list_contains(json_keys(j), 'error')),
i AS (SELECT *, coalesce(CAST(e->>'$.price_impact_score' AS DOUBLE), 0) AS impact FROM e)
SELECT conv_id, turn, place::INT AS place, '[' || coalesce(e->>'$.title', '{R.UNTITLED}') || '] ' || substring(coalesce(e->>'$.all_text', ''), 1, 200) || '...' AS text,
CASE WHEN impact > 0 THEN 'positive' WHEN impact < 0 THEN 'negative' ELSE 'neutral' END AS sentiment, CASE WHEN impact > 0 THEN impact ELSE 0.1::DOUBLE END AS positive_score,
CASE WHEN impact < 0 THEN -impact ELSE 0.1::DOUBLE END AS negative_score, 0.5::DOUBLE AS neutral_score FROM i""")
def _(spark, sf):
    return R.evidence_rows(view(spark, sf, "news_results"))
