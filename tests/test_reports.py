"""Report parsing on hand-written texts."""

import time

import pytest
from pyspark.sql import functions as F

from furrow.functions import reports as R

HEAD = "| 어제 종가 | 예측 A | 방향 B | 뉴스 심리 | 종합 의견 |\n"
RULE = "|:---:|:---:|:---:|:---:|:---:|\n"


def value(spark, column, text):
    return spark.createDataFrame([(text,)], "t STRING").select(column(F.col("t")).alias("v")).first()["v"]


def row(opinion, mood="부정적"):
    return f"| 441.5 | 435.06 | Down | {mood} | {opinion} |\n"


@pytest.mark.parametrize("text,expected", [
    (HEAD + RULE + row("SELL"), "SELL"),
    (HEAD + RULE + row("HOLD"), "HOLD"),
    (HEAD + RULE + row("BUY"), "BUY"),
    ("", ""),
    ("| 어제 종가 | 예측 A | 방향 B | 뉴스 심리 |\n|:---:|:---:|:---:|:---:|\n| 1 | 2 | Up | 부정적 |\n", ""),
    (HEAD + RULE + row("WAIT"), ""),
    ("표가 없는 글입니다.\n아무 자료도 없습니다.", ""),
    (HEAD.replace("| ", "|  ").replace(" |", "  |") + RULE + row("HOLD").replace("| ", "|  "), "HOLD"),
    (HEAD + "|------|----|----|----|----|\n" + row("SELL"), "SELL"),
    (HEAD + RULE + row("BUY") + "\nother\n\n" + HEAD + RULE + row("SELL"), "BUY"),
    ("글\n" * 100 + HEAD + RULE + row("SELL") + "끝\n" * 100, "SELL"),
    ("# 제목\n**날짜**: 2025-11-14 | **종목**: 옥수수\n\n" + HEAD + RULE + row("SELL") + "\n---\n### 1. 분석\n", "SELL"),
    ("[{'type': 'text', 'text': \"" + (HEAD + RULE + row("HOLD")).replace("\n", "\\n") + "\"}]", "HOLD"),
    ("| 요약 | 종합 의견 |\n|---|---|\n본문\n| a | 강한 BUY 의견 |\n", "BUY"),
])
def test_opinion(spark, text, expected):
    assert value(spark, R.opinion, text) == expected


def test_opinion_of_null_is_empty_and_long_texts_stay_fast(spark):
    assert value(spark, R.opinion, None) == ""
    text = "Some line\n" * 10000 + HEAD + RULE + row("HOLD") + "More lines\n" * 10000
    value(spark, R.opinion, text)
    start = time.time()
    assert value(spark, R.opinion, text) == "HOLD"
    assert time.time() - start < 3


def test_summary_row_without_pipes_and_loose_form(spark):
    texts = [("어제 종가 시계열 머신러닝 시장 심리 종합 의견\n441.5 435.0 Down 부정적 SELL",), ("어제 종가 표\n 441.5 435.06 Down 부정적 SELL",), ("없음",), (None,)]
    rows = R.with_summary_row(spark.createDataFrame(texts, "t STRING"), "t").select("summary").collect()
    assert rows[0][0]["opinion"] == "SELL" and rows[0][0]["ts_forecast"] == "435.0"
    assert rows[1][0]["close"] == "441.5" and rows[1][0]["sentiment"] == "부정적"
    assert rows[2][0] is None and rows[3][0] is None


def test_fallbacks_without_summary_row(spark):
    text = "시계열 분석 예측값: -12.5\n퀀트 예측: 하락세\n시장 심리 = 중립적 흐름\n매수 의견"
    df = R.with_summary_row(spark.createDataFrame([(text,)], "t STRING"), "t")
    t, s = F.col("t"), F.col("summary")
    got = df.select(R.opinion_or_hold(t, s), R.forecast_text(t, s), R.model_direction(t, s), R.mood_score(t, s), R.mood_label(t, s)).first()
    assert tuple(got) == ("BUY", "-12.5", "Down", 0, "중립적")


def test_components_need_three(spark):
    assert value(spark, R.components, "추세: 1.5\n연간=-2\n") is None
    assert value(spark, R.components, "추세: 1.5\n연간=-2\n잔차 : 0.5") == {"추세": 1.5, "연간": -2.0, "잔차": 0.5}


def test_sections_and_header_without_body(spark):
    text = "앞글\n### 1. 첫째\n내용\n2. 빈 머리\n3. 종합 의견\n끝\n"
    got = [tuple(x) for x in value(spark, R.sections, text)]
    assert got == [("보고서 본문", "앞글"), ("첫째", "내용"), ("종합 의견", "끝")]


def test_highlight_escapes_html(spark):
    assert value(spark, R.highlighted, "<b> 상승 & 하락") == (
        "&lt;b&gt; <span class='highlight-pos'>상승</span> &amp; <span class='highlight-neg'>하락</span>")


def test_meta_line_goes_once(spark):
    meta = "**날짜**: 2024-01-05 | **종목**: corn\n"
    assert value(spark, R.without_meta_line, "머리\n" + meta + "본문\n" + meta) == "머리\n본문\n" + meta


def test_confidence_mark_and_cell(spark):
    mark = lambda t: R.inject_confidence(t, F.lit(0.715))
    assert value(spark, mark, "확신도 {{CONFIDENCE_V2}}") == "확신도 72"
    table = "| 어제 종가 | 퀀트 예측 | 시장 심리 | 종합 의견 | 확신도 |\n|---|---|---|---|---|\n| 1 | 상승 | 긍정적 | BUY | 70 |\n끝"
    assert value(spark, mark, table).split("\n")[2] == "| 1 | 상승 | 긍정적 | BUY | 72 |"
    assert value(spark, mark, "표 없음") == "표 없음"


def test_bucket_and_path(spark):
    assert tuple(value(spark, R.bucket_and_path, "gs://b/a/c.txt")) == ("b", "a/c.txt")
    assert tuple(value(spark, R.bucket_and_path, "gs://b")) == ("b", "")
    assert tuple(value(spark, R.bucket_and_path, "https://storage.googleapis.com/b/x.txt?y=1")) == ("b", "x.txt")
    assert tuple(value(spark, R.bucket_and_path, "https://example.com/b/x")) == (None, None)


def test_message_text_keeps_plain_text(spark):
    assert value(spark, R.message_text, "[not a list") == "[not a list"
    assert value(spark, R.message_text, None) == ""
    assert value(spark, R.message_text, "[{'type': 'text', 'text': \"it's\"}, {'type': 'image'}]") == "it's"
