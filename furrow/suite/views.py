"""Market-shaped views over the given tables.

Each view is one SELECT that Spark SQL and DuckDB both run: Spark binds the `{table}` marks to DataFrames,
the SQL check gets the same text as a common table expression.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
    "embeddings", "pages", "benchmark", "labels", "conversations",
)

VIEWS = {
    "px_long": """
SELECT o_orderpriority AS commodity, CAST(o_orderdate AS DATE) AS date,
       min_by(o_totalprice, o_orderkey) AS open, max(o_totalprice) AS high,
       min(o_totalprice) AS low, max_by(o_totalprice, o_orderkey) AS close, count(*) AS volume
FROM {orders} GROUP BY o_orderpriority, CAST(o_orderdate AS DATE)""",
    "px_daily": """
SELECT event_type AS commodity, CAST(ts AS DATE) AS date,
       min_by(value, event_id) AS open, max(value) AS high,
       min(value) AS low, max_by(value, event_id) AS close, count(*) AS volume
FROM {events} GROUP BY event_type, CAST(ts AS DATE)""",
    "news": """
SELECT md5(CAST(d.doc_id AS STRING)) AS id, d.doc_id,
       CASE d.doc_id % 5 WHEN 0 THEN 'click' WHEN 1 THEN 'error' WHEN 2 THEN 'purchase'
                         WHEN 3 THEN 'signup' ELSE 'view' END AS commodity,
       CAST('2024-01-01 00:00:00' AS TIMESTAMP) + ((d.doc_id * 37) % 43200) * INTERVAL '1' MINUTE AS publish_ts,
       split_part(d.text, chr(10), 1) AS title, d.text AS all_text, d.source AS meta_site_name,
       CASE d.doc_id % 7 WHEN 0 THEN 'Corn AND (price OR demand OR supply OR inventory)'
                         WHEN 1 THEN 'soybean AND (price OR demand OR supply OR inventory)'
                         WHEN 2 THEN 'wheat AND (price OR demand OR supply OR inventory)'
                         WHEN 3 THEN '"United States Department of Agriculture" OR USDA'
                         WHEN 4 THEN 'corn harvest'
                         WHEN 5 THEN NULL ELSE 'USDA' END AS key_word,
       CASE WHEN l.quality = 1 THEN 'T' WHEN l.quality = 0 THEN 'F' ELSE 'E' END AS filter_status,
       CAST((d.doc_id * 7919) % 1000 AS DOUBLE) / 2000 AS positive_score,
       CASE WHEN d.doc_id % 13 = 0 THEN NULL
            ELSE CAST((d.doc_id * 104729) % 1000 AS DOUBLE) / 2000 END AS negative_score,
       CAST((d.doc_id * 31) % 1000 AS DOUBLE) / 1000 AS neutral_score,
       CASE WHEN d.doc_id % 11 = 0 THEN NULL
            ELSE CAST((d.doc_id * 7919) % 1000 - (d.doc_id * 104729) % 1000 AS DOUBLE) / 2000
       END AS price_impact_score,
       CASE WHEN (d.doc_id * 7919) % 1000 > (d.doc_id * 104729) % 1000 + 100 THEN 'positive'
            WHEN (d.doc_id * 7919) % 1000 + 100 < (d.doc_id * 104729) % 1000 THEN 'negative'
            ELSE 'neutral' END AS sentiment,
       CAST((d.doc_id * 17) % 100 AS DOUBLE) / 100 AS sentiment_confidence,
       d.doc_id % nullif((SELECT count(*) FROM {embeddings}), 0) AS vec_id
FROM {documents} d LEFT JOIN {labels} l ON d.doc_id = l.doc_id""",
    "raw_articles": """
SELECT page_id, md5(url) AS id, url AS doc_url, regexp_extract(html, '<title>(.*?)</title>', 1) AS title,
       CASE WHEN page_id % 9 = 0 THEN NULL ELSE html END AS content,
       CASE WHEN page_id % 4 = 0 THEN NULL ELSE 'desc ' || url END AS description,
       CASE WHEN page_id % 6 = 0 THEN NULL ELSE 'author ' || CAST(page_id % 10 AS STRING) END AS author,
       CASE WHEN page_id % 17 = 0 THEN NULL
            ELSE '2024-01-' || lpad(CAST(page_id % 28 + 1 AS STRING), 2, '0') || 'T'
                 || lpad(CAST(page_id % 24 AS STRING), 2, '0') || ':30:00Z' END AS published_at,
       CASE page_id % 4 WHEN 0 THEN 'corn AND (price OR demand OR supply OR inventory)'
                        WHEN 1 THEN 'soybean AND (price OR demand OR supply OR inventory)'
                        WHEN 2 THEN 'wheat AND (price OR demand OR supply OR inventory)'
                        ELSE 'grain trade' END AS query
FROM {pages}""",
    "decisions": """
SELECT event_id, ts AS ingested_at, CAST(ts AS DATE) AS target_date, event_type AS commodity,
       CASE WHEN event_id % 2 = 0 THEN 'v1' ELSE 'v2' END AS stage,
       CASE event_id % 6 WHEN 0 THEN 'BUY' WHEN 1 THEN 'hold' WHEN 2 THEN ' Sell ' WHEN 3 THEN '상승'
                         WHEN 4 THEN NULL ELSE '하락' END AS recommendation,
       CAST(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE) / 100 AS p_buy,
       (100 - CAST(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE)) * (1 + event_id % 3) / 400 AS p_hold,
       (100 - CAST(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE)) * (3 - event_id % 3) / 400 AS p_sell
FROM {events}""",
    "triples": """
SELECT replace(cn.n_name, '_', '-') AS s,
       CASE o.o_orderpriority WHEN '1-URGENT' THEN 'is' WHEN '2-HIGH' THEN 'prices rise' WHEN '3-MEDIUM' THEN 'Is part of'
                              WHEN '4-NOT SPECIFIED' THEN 'was reduced by' ELSE 'exports to' END AS v, replace(sn.n_name, '_', '-') AS o,
       l.l_orderkey * 10 + l.l_linenumber AS pos
FROM {lineitem} l JOIN {orders} o ON l.l_orderkey = o.o_orderkey
JOIN {customer} c ON o.o_custkey = c.c_custkey JOIN {nation} cn ON c.c_nationkey = cn.n_nationkey
JOIN {supplier} s ON l.l_suppkey = s.s_suppkey JOIN {nation} sn ON s.s_nationkey = sn.n_nationkey""",
    "reports": """
SELECT event_type AS commodity, CAST(ts AS DATE) AS date, event_id,
       concat('**날짜**: ', CAST(CAST(ts AS DATE) AS STRING), ' | **종목**: ', event_type, chr(10),
              CASE WHEN event_id % 7 = 0 THEN '| 어제 종가 | 시계열 분석 | 머신러닝 예측 | 시장 심리 | 종합 의견 |'
                   ELSE '| 어제 종가 | 퀀트 예측 | 시장 심리 | 종합 의견 | 확신도 |' END, chr(10),
              '|:---:|:---:|:---:|:---:|:---:|', chr(10),
              CASE WHEN event_id % 7 = 0 THEN concat('| ', CAST(event_id AS STRING), ' | 435.5 | Down | 부정적 | ')
                   ELSE concat('| ', CAST(event_id AS STRING), ' | 상승 | 긍정적 | ') END,
              CASE event_id % 4 WHEN 0 THEN 'BUY' WHEN 1 THEN 'HOLD' WHEN 2 THEN 'SELL' ELSE 'WAIT' END,
              CASE WHEN event_id % 7 = 0 THEN ' |' ELSE ' | 70 |' END, chr(10), chr(10),
              '### 1. 퀀트 기반 기술적 분석', chr(10), '추세: ', CAST(event_id % 90 AS STRING), '.5', chr(10),
              '연간 = -0.', CAST(event_id % 10 AS STRING), chr(10),
              CASE WHEN event_id % 5 = 0 THEN '' ELSE concat('주간: 1.25', chr(10)) END,
              '### 2. 뉴스 빅데이터 기반 시장 심리 분석', chr(10),
              'A-1. 긍정적인 뉴스', chr(10), '1 첫째 기대', chr(10), '2 둘째 개선', chr(10),
              'A-2. 부정적인 뉴스', chr(10), '1 <급락> & 위험', chr(10), 'B. 과거 뉴스', chr(10),
              CAST(CAST(ts AS DATE) AS STRING), ' ', CAST(event_id % 50 AS STRING), '.5 -1.25 3', chr(10),
              '2024/1/5 10 11.5 12', chr(10), '3. 종합 의견', chr(10), '리스크와 하방 압력이 크다.') AS report_text
FROM {events}""",
    "names": """
SELECT p_partkey, CASE p_partkey % 9 WHEN 0 THEN p_name WHEN 1 THEN CAST(p_size AS STRING) || '.5-1' WHEN 2 THEN '--'
       WHEN 3 THEN 'H5N' || CAST(p_size AS STRING) WHEN 4 THEN 'January' WHEN 5 THEN ' ' || p_type || 's '
       WHEN 6 THEN 'USDA' WHEN 7 THEN concat('farmer', chr(39), 's ', p_brand) ELSE concat('"', p_type, '" ', chr(92), chr(39)) END AS entity
FROM {part}""",
    "messages": """
SELECT conv_id, turn, CASE WHEN turn % 3 = 2 THEN 'tool' ELSE role END AS role,
       CASE WHEN turn % 3 <> 2 THEN NULL WHEN conv_id % 3 = 0 THEN 'timeseries_predictor'
            WHEN conv_id % 3 = 1 THEN 'decision_meta' ELSE 'news_sentiment_analyzer' END AS name,
       CASE WHEN turn % 3 = 2 AND conv_id % 7 = 3 THEN concat(chr(123), 'broken')
            WHEN turn % 3 = 2 AND (conv_id + turn) % 5 = 0 THEN concat(chr(123), '"error": "none"', chr(125))
            WHEN turn % 3 = 2 THEN concat(chr(123), '"target_date": "2024-01-05", "forecast_value": ', CAST(turn AS STRING),
                                          ', "stage": "v', CAST(1 + conv_id % 2 AS STRING), '"', chr(125))
            WHEN turn % 2 = 1 THEN concat('[', chr(123), chr(39), 'type', chr(39), ': ', chr(39), 'text', chr(39), ', ',
                 chr(39), 'text', chr(39), ': ', chr(39),
                 replace(replace(replace(text, chr(92), ' '), chr(39), ' '), chr(10), ' '), chr(39), chr(125), ', ', chr(123),
                 chr(39), 'type', chr(39), ': ', chr(39), 'text', chr(39), ', ',
                 chr(39), 'text', chr(39), ': ', chr(39), role, chr(39), chr(125), ']')
            ELSE text END AS text,
       CASE WHEN turn % 3 <> 2 AND turn % 2 = 1
            THEN concat(replace(replace(replace(text, chr(92), ' '), chr(39), ' '), chr(10), ' '), chr(10), role)
            ELSE text END AS said
FROM {conversations}""",
    "news_results": """
SELECT conv_id, turn, CASE WHEN turn % 4 = 3 THEN 'decision_meta' ELSE 'news_sentiment_analyzer' END AS name,
       CASE WHEN conv_id % 7 = 3 THEN concat(chr(123), '"evidence_news": [', clean)
            WHEN (conv_id + turn) % 6 = 0 THEN concat(chr(123), '"error": null, "evidence_news": [', chr(123), '"title": "t"', chr(125), ']', chr(125))
            WHEN (conv_id + turn) % 6 = 1 THEN concat(chr(123), '"target_date": "2024-01-05"', chr(125))
            ELSE concat(chr(123), '"evidence_news": [', chr(123), '"title": "', role, ' ', CAST(turn AS STRING), '", "all_text": "', clean,
                        '", "price_impact_score": ', CAST((conv_id * 7 + turn) % 21 - 10 AS STRING), '.5', chr(125), ', ',
                        chr(123), '"all_text": "', substring(clean, 1, 20), '"', chr(125), ', ',
                        chr(123), '"title": "no text", "price_impact_score": 0', chr(125), ']', chr(125)) END AS text
FROM (SELECT conv_id, turn, role,
             replace(replace(replace(replace(replace(text, chr(92), ' '), chr(34), ' '), chr(10), ' '), chr(13), ' '), chr(9), ' ') AS clean
      FROM {conversations}) c""",
    "forecasts": """
SELECT p.commodity, p.date AS target_date, p.price AS actual_price,
       p.price * (1 + CAST(p.volume % 7 - 3 AS DOUBLE) / 100) AS forecast_price,
       p.low AS yhat_lower, p.high AS yhat_upper,
       CASE WHEN p.volume % 2 = 0 THEN 1 ELSE 0 END AS direction,
       p.price - 48 AS trend, (p.high - p.low) / 5 AS yearly, CAST(p.volume % 5 - 2 AS DOUBLE) AS weekly,
       p.price * 0.001 AS extra_regressors_multiplicative, p.low * 0.002 AS volume_effect, p.high * -0.003 AS ema_effect
FROM (SELECT event_type AS commodity, CAST(ts AS DATE) AS date, round(avg(value), 2) AS price, max(value) AS high,
             min(value) AS low, count(*) AS volume FROM {events} GROUP BY event_type, CAST(ts AS DATE)) p""",
    "ratios": """
SELECT CAST(n.publish_ts AS DATE) AS date, n.commodity AS keyword, n.meta_site_name AS source,
       count(*) AS news_count,
       CAST(sum(CASE WHEN n.sentiment = 'positive' THEN 1 ELSE 0 END) AS DOUBLE) / count(*) AS pos_ratio,
       CAST(sum(CASE WHEN n.sentiment = 'negative' THEN 1 ELSE 0 END) AS DOUBLE) / count(*) AS neg_ratio
FROM {news} n GROUP BY CAST(n.publish_ts AS DATE), n.commodity, n.meta_site_name""",
}

_MARK = re.compile(r"\{(\w+)\}")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The named view (or given table) as a DataFrame."""
    if name in TABLES:
        return table(spark, sf_dir, name)
    inputs = {dep: view(spark, sf_dir, dep) for dep in _MARK.findall(VIEWS[name])}
    return spark.sql(VIEWS[name], **inputs)


def with_views(*names: str) -> str:
    """`WITH ...` header holding the named views and what they read."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        if name in TABLES or name in ordered:
            return
        for dep in _MARK.findall(VIEWS[name]):
            visit(dep)
        ordered.append(name)

    for name in names:
        visit(name)
    return "WITH " + ",\n".join(f"{n} AS ({_MARK.sub(lambda m: m.group(1), VIEWS[n])})" for n in ordered)
