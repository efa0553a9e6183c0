"""Market reports back into columns: opinion, summary row, sections, price rows and counts.

Column expressions only; a report is read once per expression and never leaves the JVM.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from furrow.functions.expressions import once

# --- fixed values: labels and patterns of the report format ----------------------------------------------------------
OPINIONS = ["SELL", "HOLD", "BUY"]
PREVIOUS_CLOSE, MARKET_MOOD, OPINION = "어제 종가", "시장 심리", "종합 의견"
OPINION_TABLE = (
    r"(?s)\|\s*어제 종가\s*\|(?:[^|]*\|){3}\s*종합 의견\s*\|.*?\n[^\n]*\n\s*\|(?:[^|]*\|){4}\s*(SELL|HOLD|BUY)\s*\|"
)
RULE_LINE = r"^\s*\|[\s:|\-]+\|\s*$"
SEPARATOR_LINE = r"^\s*[\-|:\s]+\s*$"
LOOSE_SUMMARY = (
    r"(?s)어제 종가.*?\n\s*([0-9]+(?:\.[0-9]+)?)\s+([0-9]+(?:\.[0-9]+)?)\s+([A-Za-z가-힣]+)\s+([가-힣]+)\s+(BUY|SELL|HOLD)"
)
NUMBERED_HEADER = r"[ \t]*(?:[-*][ \t]*)?(?:#{1,6}[ \t]*)?(?:\*\*)?[ \t]*(?:\d+\.|\d+\)|[IVX]+\.)[ \t]*"
PLAIN_HEADERS = ["종합 의견", "뉴스 분석", "뉴스 빅데이터", "시장 심리", "인사이트", "Insight"]
DEFAULT_TITLE = "보고서 본문"
COMPONENTS = ["추세", "연간", "주기", "주간", "잔차"]
POSITIVE_NEWS, NEGATIVE_NEWS = "A-1. 긍정적인 뉴스", "A-2. 부정적인 뉴스"
NEGATIVE_WORDS = ["하방 압력", "부정적", "급락", "하락", "위험", "리스크", "불확실", "약세"]
POSITIVE_WORDS = ["상방 압력", "긍정적", "급등", "상승", "강세", "호재", "개선", "기대"]
KEPT_WORDS = ["종합", "결론", "요약", "전망", "리스크", "상승", "하락", "확률", "신뢰도", "예측", "뉴스", "감성", "지표", "가격", "%"]
SECTION_WORDS = [
    ("quant", ["퀀트", "quant", "기술적", "모델", "예측"]),
    ("news", ["뉴스", "news", "심리", "빅데이터", "인사이트", "insight"]),
    ("summary", ["종합", "결론", "의견", "summary", "outlook"]),
]
FIXED_HEADERS = {
    "quant": "1. 📈 [Quant] 퀀트 기반 기술적 분석",
    "news": "2. 📰 [Insight] 뉴스 빅데이터 기반 시장 심리 분석",
    "summary": "3. 종합 의견",
}
HEADER_WORDS = {
    "quant": ["퀀트", "Quant", "기술적", "모델", "예측"],
    "news": ["뉴스", "News", "심리", "빅데이터", "Insight", "인사이트"],
    "summary": ["종합 의견", "종합", "결론", "의견", "Summary", "Outlook"],
}
META_LINE = r"^\s*\*\*날짜\*\*:\s*[0-9]{4}-[0-9]{2}-[0-9]{2}\s*\|\s*\*\*종목\*\*:\s*.+?\s*$\n?"
PRICE_LINE = r"^\s*(\d{4}[-./]\d{1,2}[-./]\d{1,2})\s+(-?\d+\.?\d*)\s+(-?\d+\.?\d*)\s+(-?\d+\.?\d*)"
CONFIDENCE_MARK = "{{CONFIDENCE_V2}}"
# ---------------------------------------------------------------------------------------------------------------------

BREAK = "\u0001"  # set before each section header, then split on


def found(text: Column, pattern: str, group: int = 1) -> Column:
    """First match of the group, or null."""
    return once(F.regexp_extract(text, pattern, group), lambda m: F.nullif(m, F.lit("")))


def lines_of(text: Column) -> Column:
    return F.split(text, r"\r?\n")


def contains_any(text: Column, words: list[str]) -> Column:
    return text.rlike("|".join(words))


def first_match(items: Column, keep: Callable[[Column], Column]) -> Column:
    """First element that passes, or null."""
    return F.get(F.filter(items, keep), F.lit(0))


def after_first(items: Column, is_start: Callable[[Column], Column], count: int) -> Column:
    """Up to `count` elements after the first that passes; empty when none does."""

    def tail(held: Column) -> Column:
        at = F.array_position(F.transform(held, is_start), True).cast("int")
        return once(at, lambda i: F.when(i > 0, F.slice(held, i + 1, F.lit(count))))

    return once(items, tail)


# --- opinion ---------------------------------------------------------------------------------------------------------


def opinion(text: Column) -> Column:
    """SELL, HOLD or BUY out of the summary table, else the empty string.

    Serialised reports carry their line breaks as backslash-n; these count as line breaks.
    """
    last_cell = lambda x: F.regexp_extract(x, r"([^|]*[^|\s][^|]*)[|\s]*$", 1)

    def scanned(plain: Column) -> Column:
        rows = after_first(lines_of(plain), lambda x: x.contains(OPINION) & x.contains("|"), 5)
        named = F.transform(
            F.filter(rows, lambda x: x.contains("|") & ~x.rlike(RULE_LINE)),
            lambda x: F.regexp_extract(last_cell(x), f"({'|'.join(OPINIONS)})", 1),
        )
        return first_match(named, lambda x: x != "")

    return once(F.replace(text, F.lit("\\n"), F.lit("\n")),
                lambda plain: F.coalesce(found(plain, OPINION_TABLE), scanned(plain), F.lit("")))


# --- summary row and what falls back on it ---------------------------------------------------------------------------


def _cells(line: Column) -> Column:
    return F.transform(F.split(F.regexp_replace(line, r"^\|+|\|+$", ""), r"\|"), lambda c: F.trim(c))


def with_summary_row(df: DataFrame, text: str, out: str = "summary") -> DataFrame:
    """Add a struct of close, ts_forecast, ml_dir, sentiment, opinion, confidence; null when no summary is found."""

    def is_header(x: Column) -> Column:
        return x.contains("어제") & x.contains(MARKET_MOOD) & x.contains(OPINION) & contains_any(x, ["머신러닝", "퀀트"])

    lines = F.filter(F.transform(lines_of(F.col(text)), lambda x: F.rtrim(x)), lambda x: F.trim(x) != "")
    head, piped = F.col("_head"), F.col("_head").contains("|")
    words = lambda x: F.split(x, r"\s+")

    def usable(x: Column) -> Column:
        table = (F.size(F.col("_names")) >= 4) & (F.size(_cells(x)) >= F.size(F.col("_names")))
        in_table = x.contains("|") & piped
        return ~x.rlike(SEPARATOR_LINE) & F.when(in_table, table).otherwise(F.size(words(x)) >= 5)

    staged = (
        df.withColumn("_lines", lines)
        .withColumn("_head", first_match(F.col("_lines"), is_header))
        .withColumn("_names", _cells(head))
        .withColumn("_row", first_match(after_first(F.col("_lines"), is_header, 3), usable))
    )
    row = F.col("_row")
    staged = staged.withColumn("_values", F.when(row.contains("|") & piped, _cells(row)))

    staged = staged.withColumn("_pairs", F.arrays_zip("_names", "_values"))

    def cell(keep: Callable[[Column], Column]) -> Column:
        hit = first_match(F.col("_pairs"), lambda p: keep(p["_names"]))
        return F.coalesce(hit["_values"], F.lit(""))

    squeezed = lambda c: F.replace(c, F.lit(" "), F.lit(""))
    none = F.lit(None).cast("string")
    fields = ("close", "ts_forecast", "ml_dir", "sentiment", "opinion", "confidence")
    table = F.struct(*[c.alias(n) for n, c in zip(fields, (
        cell(lambda h: h.contains("어제")), cell(lambda h: h.contains("시계열")),
        cell(lambda h: contains_any(h, ["퀀트", "머신러닝"]) & h.contains("예측")),
        squeezed(cell(lambda h: h.contains(MARKET_MOOD))), squeezed(cell(lambda h: h.contains(OPINION))),
        cell(lambda h: h.contains("확신도")),
    ))])
    parts = words(row)
    plain = F.struct(*[F.get(parts, F.lit(i)).alias(n) for i, n in enumerate(fields[:5])], none.alias("confidence"))
    loose = F.struct(*[F.regexp_extract(text, LOOSE_SUMMARY, i + 1).alias(n) for i, n in enumerate(fields[:5])], none.alias("confidence"))
    chosen = (
        F.when(row.isNotNull() & F.col("_values").isNotNull(), table)
        .when(row.isNotNull(), plain)
        .when(F.col(text).rlike(LOOSE_SUMMARY), loose)
    )
    return staged.withColumn(out, chosen).drop("_lines", "_head", "_names", "_row", "_values", "_pairs")


def opinion_or_hold(text: Column, summary: Column) -> Column:
    upper = F.upper(text)
    guess = (
        F.when(upper.contains("SELL") | text.contains("매도"), "SELL")
        .when(upper.contains("BUY") | text.contains("매수"), "BUY").otherwise("HOLD")
    )
    return F.coalesce(F.nullif(F.upper(summary["opinion"]), F.lit("")), guess)


def forecast_text(text: Column, summary: Column) -> Column:
    return F.coalesce(F.nullif(summary["ts_forecast"], F.lit("")), found(text, r"시계열 분석 예측값[^0-9\-]*(-?\d+\.?\d*)"))


def model_direction(text: Column, summary: Column) -> Column:
    word = found(text, r"(?:머신러닝|퀀트) (?:방향 )?예측[^가-힣a-zA-Z]*([가-힣a-zA-Z]+)")
    read = (
        F.when(word.contains("상승") | F.upper(word).contains("UP"), "Up")
        .when(word.contains("하락") | F.upper(word).contains("DOWN"), "Down")
    )
    return F.coalesce(F.nullif(summary["ml_dir"], F.lit("")), read)


def _mood(text: Column, summary: Column) -> Column:
    return F.coalesce(F.nullif(summary["sentiment"], F.lit("")), found(text, r"시장 심리[^가-힣]*([가-힣]+)"), F.lit(""))


def mood_score(text: Column, summary: Column) -> Column:
    mood = _mood(text, summary)
    return F.when(mood.contains("부정"), -55).when(mood.contains("긍정"), 55).otherwise(0)


def mood_label(text: Column, summary: Column) -> Column:
    mood = _mood(text, summary)
    neutral = contains_any(mood, ["중립", "유지"])
    return F.when(mood.contains("부정"), "부정적").when(mood.contains("긍정"), "긍정적").when(neutral, "중립적").otherwise("N/A")


# --- parts of the text -----------------------------------------------------------------------------------------------


def components(text: Column, minimum: int = 3) -> Column:
    """Map of component label to value; null with fewer than `minimum` of them."""
    values = [F.regexp_extract(text, rf"{name}\s*[:=]\s*(-?\d+\.?\d*)", 1).try_cast("double") for name in COMPONENTS]
    pairs = F.create_map(*[x for name, v in zip(COMPONENTS, values) for x in (F.lit(name), v)])
    return once(F.map_filter(pairs, lambda _, v: v.isNotNull()), lambda known: F.when(F.size(known) >= minimum, known))


def news_counts(text: Column) -> Column:
    """Numbered lines under the positive and the negative news heading, as struct(positive, negative)."""
    start = F.struct(F.lit("").alias("mode"), F.lit(0).alias("positive"), F.lit(0).alias("negative"))

    def step(acc: Column, line: Column) -> Column:
        heading = F.when(line.contains(POSITIVE_NEWS), "p").when(line.contains(NEGATIVE_NEWS), "n")
        mode = F.coalesce(heading, F.when(line.rlike(r"^\s*[A-C]\.\s"), "").otherwise(acc["mode"]))
        counted = heading.isNull() & line.rlike(r"^\s*\d+\s+")
        return F.struct(
            mode.alias("mode"),
            (acc["positive"] + F.when(counted & (mode == "p"), 1).otherwise(0)).alias("positive"),
            (acc["negative"] + F.when(counted & (mode == "n"), 1).otherwise(0)).alias("negative"),
        )

    return F.aggregate(lines_of(F.coalesce(text, F.lit(""))), start, step,
                       lambda acc: F.struct(acc["positive"].alias("positive"), acc["negative"].alias("negative")))


def highlighted(text: Column) -> Column:
    """Text safe for HTML with market words marked by side."""
    safe = text
    for raw, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        safe = F.replace(safe, F.lit(raw), F.lit(entity))
    for words, css in ((POSITIVE_WORDS, "highlight-pos"), (NEGATIVE_WORDS, "highlight-neg")):
        safe = F.regexp_replace(safe, f"({'|'.join(words)})", f"<span class='{css}'>$1</span>")
    return F.coalesce(safe, F.lit(""))


def without_meta_line(text: Column) -> Column:
    """Drop the first date-and-commodity line, leaving every other line break as it is."""
    return F.regexp_replace(text, rf"(?s:\A(.*?))(?m:{META_LINE})(?s:(.*)\z)", "$1$2")


def compressed(text: Column, length: int = 300) -> Column:
    """Headings and lines holding a number or a key word, of which the last `length` characters."""
    trimmed = F.filter(F.transform(lines_of(text), lambda x: F.trim(x)), lambda x: x != "")
    kept = F.filter(trimmed, lambda x: x.startswith("#") | x.endswith(":") | x.rlike(r"\p{Nd}|" + "|".join(KEPT_WORDS)))
    return F.right(F.array_join(kept, "\n"), F.lit(length))


def compressed_question(text: Column, length: int = 120) -> Column:
    return F.substring(F.trim(F.regexp_replace(text, r"\s+", " ")), 1, length)


def section_key(title: Column, body: Column) -> Column:
    text = F.lower(F.concat(title, F.lit("\n"), body))
    chosen = F.lit(None).cast("string")
    for key, words in reversed(SECTION_WORDS):
        chosen = F.when(contains_any(text, words), key).otherwise(chosen)
    return chosen


def _is_header(line: Column) -> Column:
    return line.rlike(f"^{NUMBERED_HEADER}.+$") | contains_any(line, PLAIN_HEADERS)


def header_lines(text: Column) -> Column:
    return F.transform(F.filter(lines_of(text), _is_header), lambda x: F.trim(x))


def header_line(text: Column, key: str) -> Column:
    fixed = FIXED_HEADERS[key]
    named = first_match(lines_of(text), lambda x: contains_any(x, HEADER_WORDS[key]))
    return F.when(text.contains(fixed), F.lit(fixed)).otherwise(F.coalesce(F.trim(named), F.lit("")))


def sections(text: Column) -> Column:
    """Array of struct(title, body). A header without a line below it opens no section."""
    header = rf"(?m)^(?:{NUMBERED_HEADER}\S[^\n]*|[^\n]*(?:{'|'.join(PLAIN_HEADERS)})[^\n]*)$"
    pieces = F.split(F.regexp_replace(text, header, f"{BREAK}$0"), BREAK)

    def section(piece: Column, i: Column) -> Column:
        return once(F.regexp_replace(piece, r"\r?\n\z", ""), lambda whole: parts(piece, whole, i == 0))

    def parts(piece: Column, whole: Column, first: Column) -> Column:
        head = F.trim(F.substring_index(whole, "\n", 1))
        title = once(head, lambda h: F.coalesce(found(h, f"^{NUMBERED_HEADER}(.+?)\\s*$"), h))
        below = F.regexp_extract(whole, r"(?s)^[^\n]*\n(.*)$", 1)
        return F.struct(
            F.when(first, F.lit(DEFAULT_TITLE)).otherwise(title).alias("title"),
            F.regexp_replace(F.when(first, whole).otherwise(below), r"^\s+|\s+$", "").alias("body"),
            F.when(first, F.length(piece) > 0).otherwise(whole.contains("\n")).alias("kept"),
        )

    kept = F.filter(F.transform(pieces, section), lambda s: s["kept"])
    return F.transform(kept, lambda s: F.struct(s["title"].alias("title"), s["body"].alias("body")))


def section_rows(df: DataFrame, text: str) -> DataFrame:
    """One row per section, in order."""
    return df.select("*", F.posexplode(sections(F.col(text))).alias("section", "_s")).select("*", "_s.*").drop("_s")


def price_rows(df: DataFrame, text: str) -> DataFrame:
    """One row per line that starts with a date and three prices."""
    listed = df.select("*", F.explode(F.filter(lines_of(F.col(text)), lambda x: x.rlike(PRICE_LINE))).alias("_line"))
    fields = [F.regexp_extract("_line", PRICE_LINE, 1).alias("price_date")]
    fields += [F.regexp_extract("_line", PRICE_LINE, i + 2).cast("double").alias(n) for i, n in enumerate(("d0", "d1", "d3"))]
    return listed.select("*", *fields).drop("_line")


def inject_confidence(text: Column, probability: Column) -> Column:
    """Put the decision's probability, in percent, at the mark or into the fifth cell of the summary row."""
    clipped = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(probability, F.lit(0.0))))
    score = F.round(clipped * 100).cast("int").cast("string")
    cell = r"\|[ \t]*([^|\n]*?)[ \t]*"
    head = r"([ \t]*\|[^\n]*어제 종가[^\n]*확신도[^\n]*\n[^\n]*\n)"
    row = rf"(?s:\A(.*?))(?m:^{head}[ \t]*{cell * 4}\|[^|\n]*(?:\|[^\n]*)?$)"
    refilled = F.regexp_replace(text, F.lit(row), F.concat(F.lit("$1$2| $3 | $4 | $5 | $6 | "), score, F.lit(" |")))
    return F.when(text.contains(CONFIDENCE_MARK), F.replace(text, F.lit(CONFIDENCE_MARK), score)).otherwise(refilled)


def passes_quality(text: Column, minimum: int = 100) -> Column:
    return F.coalesce(F.length(F.trim(text)) >= minimum, F.lit(False))


def bucket_and_path(url: Column) -> Column:
    """struct(bucket, path) of a storage address; nulls for any other address."""
    own = r"^gs://([^/]*)/?(.*)$"
    web = r"^https?://storage\.(?:googleapis|cloud\.google)\.com/+([^/?#]*)/?([^?#]*)"
    pick = lambda g: F.when(url.startswith("gs://"), F.regexp_extract(url, own, g)).when(
        url.rlike(web), F.regexp_extract(url, web, g))
    return F.struct(pick(1).alias("bucket"), pick(2).alias("path"))


# --- agent message log -----------------------------------------------------------------------------------------------


def message_text(content: Column) -> Column:
    """Plain text of a message that may be a serialised list of parts, in either quote style."""
    parts = F.from_json(content, "array<struct<type:string,text:string>>", {"allowSingleQuotes": "true", "allowUnquotedControlChars": "true"})
    texts = F.transform(F.filter(parts, lambda p: (p["type"] == "text") & p["text"].isNotNull()), lambda p: p["text"])
    joined = F.when(F.trim(content).startswith("[") & (F.size(texts) > 0), F.array_join(texts, "\n"))
    return F.coalesce(joined, content, F.lit(""))


def tool_results(messages: DataFrame, first: bool = False) -> DataFrame:
    """Last (or first) usable JSON result per run and tool; results naming an error and broken JSON do not count."""
    usable = F.from_json("text", "map<string,string>").isNotNull() & F.get_json_object("text", "$.error").isNull()
    pick = F.min_by if first else F.max_by
    held = messages.where(F.col("name").isNotNull() & usable)
    return held.groupBy("conv_id", "name").agg(pick("text", "turn").alias("result"))


def final_decision(messages: DataFrame) -> DataFrame:
    """Last decision record of stage v2 per run."""
    stage = F.get_json_object("text", "$.stage")
    return messages.where((F.col("name") == "decision_meta") & (stage == "v2")).groupBy("conv_id").agg(
        F.max_by("text", "turn").alias("decision"))


def final_summary(messages: DataFrame, longer_than: int = 50) -> DataFrame:
    """Last assistant message of some length per run."""
    text = F.regexp_replace(F.trim(message_text(F.col("text"))), r"\\+$", "")
    said = messages.where(F.col("role") == "assistant").withColumn("_t", text).where(F.length("_t") > longer_than)
    return said.groupBy("conv_id").agg(F.max_by("_t", "turn").alias("summary"))


# Scores that an entry has where its impact says nothing, and the name of an entry without a title.
WEAK_SCORE, NEUTRAL_SCORE, UNTITLED = 0.1, 0.5, "제목없음"


def evidence_rows(messages: DataFrame, most: int = 200) -> DataFrame:
    """(conv_id, turn, place, text, sentiment, positive_score, negative_score, neutral_score): a row for each entry of the
    `evidence_news` array of the news tool's results.

    Results that are no JSON object or name an error have none. An entry without a title gets a fixed one, one without an
    impact counts as neutral; entries that are no objects are left out.
    """
    kind = "evidence_news array<struct<title:string,all_text:string,price_impact_score:double>>"
    usable = ~F.coalesce(F.map_contains_key(F.from_json("text", "map<string,string>"), "error"), F.lit(True))
    held = messages.where((F.col("name") == "news_sentiment_analyzer") & usable).select(
        "conv_id", "turn", F.posexplode(F.from_json("text", kind)["evidence_news"]).alias("place", "e")).where(F.col("e").isNotNull())
    impact = F.coalesce("e.price_impact_score", F.lit(0.0))
    said = F.concat(F.lit("["), F.coalesce("e.title", F.lit(UNTITLED)), F.lit("] "), F.substring(F.coalesce("e.all_text", F.lit("")), 1, most), F.lit("..."))
    return held.select(
        "conv_id", "turn", "place", said.alias("text"), F.when(impact > 0, "positive").when(impact < 0, "negative").otherwise("neutral").alias("sentiment"),
        F.when(impact > 0, impact).otherwise(WEAK_SCORE).alias("positive_score"),
        F.when(impact < 0, -impact).otherwise(WEAK_SCORE).alias("negative_score"), F.lit(NEUTRAL_SCORE).alias("neutral_score"))
