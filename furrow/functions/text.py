"""Text and identifier expressions for articles, entities and triples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANK = r"[ \t\n\x0B\f\r]+"


def article_id(url: Column) -> Column:
    return F.md5(url)


def content_hash(text: Column, kind: str) -> Column:
    """`entity-` or `triple-` with the digest of the trimmed text."""
    return F.concat(F.lit(f"{kind}-"), F.md5(F.trim(text)))


def iso_to_stamp(value: Column, default: Column) -> Column:
    """`YYYY-MM-DD HH:MM:SS` of an ISO-8601 text in UTC; empty takes the default."""
    parsed = F.try_to_timestamp(F.nullif(value, F.lit("")))
    return F.date_format(F.coalesce(parsed, default), "yyyy-MM-dd HH:mm:ss")


def day_start(date: Column) -> Column:
    return F.date_format(date, "yyyy-MM-dd'T'00:00:00'Z'")


def day_end(date: Column) -> Column:
    return F.date_format(date, "yyyy-MM-dd'T'23:59:59'Z'")


# Query text per canonical keyword, by priority.
CANONICAL_KEYWORDS = [
    (("usda", "united states department of agriculture"), '"United States Department of Agriculture" OR USDA'),
    (("soybean", "soybeans"), "soybean AND (price OR demand OR supply OR inventory)"),
    (("wheat",), "wheat AND (price OR demand OR supply OR inventory)"),
    (("corn", "maize"), "corn AND (price OR demand OR supply OR inventory)"),
]


def canonical_keyword(query: Column, *texts: Column) -> Column:
    searched = F.lower(F.concat_ws(" ", query, *texts))
    chosen = query
    for terms, keyword in reversed(CANONICAL_KEYWORDS):
        chosen = F.when(searched.rlike("|".join(terms)), F.lit(keyword)).otherwise(chosen)
    return chosen


def combined_text(title: Column, description: Column, body: Column | None = None, short: int = 50, taken: int = 500) -> Column:
    """Title and description; a short result is followed by the opening of the body."""
    empty = F.lit("")
    text = F.trim(F.concat(F.coalesce(title, empty), F.lit(" "), F.coalesce(description, empty)))
    if body is None:
        return text
    longer = F.trim(F.concat(text, F.lit(" "), F.substring(body, 1, taken)))
    return F.when((F.length(text) < short) & body.isNotNull(), longer).otherwise(text)


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, BLANK, " "))


def prefix_key(text: Column, length: int = 50) -> Column:
    """Opening of the text with runs of blanks as one space; the key that tells repeated articles apart."""
    return F.substring(squeeze(text), 1, length)


def parse_embedding(text: Column) -> Column:
    """Vector from its JSON text; null where the text is no array of numbers."""
    return F.from_json(text, "array<float>")


def parse_triples(text: Column) -> Column:
    """Triples of a JSON array of arrays: entries with three or more items, first three kept.

    Each entry is parsed for itself, so one that is no list does not void the others.
    """
    entries = F.transform(F.from_json(text, "array<string>"), lambda e: F.from_json(e, "array<string>"))
    return F.transform(F.filter(entries, lambda t: F.size(t) >= 3), lambda t: F.slice(t, 1, 3))


def key_entities(text: Column, k: int = 5) -> Column:
    return F.slice(F.map_keys(F.from_json(text, "map<string,string>")), 1, k)


def triple_text(*items: Column) -> Column:
    """List rendering used as lookup key: single quotes, double quotes when an item holds only single ones."""

    def quoted(item: Column) -> Column:
        escaped = F.replace(item, F.lit("\\"), F.lit("\\\\"))
        has_single, has_double = item.contains("'"), item.contains('"')
        return (
            F.when(has_single & ~has_double, F.concat(F.lit('"'), escaped, F.lit('"')))
            .when(has_single, F.concat(F.lit("'"), F.replace(escaped, F.lit("'"), F.lit("\\'")), F.lit("'")))
            .otherwise(F.concat(F.lit("'"), escaped, F.lit("'")))
        )

    return F.concat(F.lit("["), F.concat_ws(", ", *[quoted(i) for i in items]), F.lit("]"))


# --- entities --------------------------------------------------------------------------------------------------------

# Names left out of the ranking and phrases that only define.
NOISE_ENTITIES = [
    "january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december",
    "monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday",
    "data", "week", "month", "year", "midday", "daily", "quarter", "half", "name", "brands",
    "last year", "month off", "time period", "cents", "percent", "digit losses", "name brands", "private labels",
]
DEFINITIONAL_PHRASES = [
    "also known as", "known as", "refers to", "refer to", "is defined as", "defined as", "called", "is called",
    "means", "is equivalent to", "equivalent to", "abbreviated as", "is part of", "part of", "is a member of",
    "member of", "belongs to", "is one of", "one of",
]
BE_HAVE_FORMS = ["be", "am", "is", "are", "was", "were", "been", "being", "have", "has", "had", "having"]


def is_valid_entity(entity: Column) -> Column:
    name = F.trim(entity)
    digits_only = F.regexp_replace(name, r"[.\-]", "").rlike(r"^[0-9]+$")
    ok = (F.length(name) >= 2) & ~digits_only & name.rlike(r"[\p{L}\p{N}]")
    return F.coalesce(ok, F.lit(False))


def is_ranked_entity(entity: Column) -> Column:
    """Not a noise name, and free of digits unless it reads like a code such as H5N1."""
    code = (F.length(entity) <= 30) & F.trim(entity).rlike(r"^[A-Za-z0-9]+(-[A-Za-z0-9]+)*$")
    return (~entity.rlike("[0-9]") | code) & ~F.lower(entity).isin(*NOISE_ENTITIES)


def is_low_weight_verb(verb: Column) -> Column:
    """Definitional phrase, or be/have forms that no participle follows (`is`, `has been`, but not `was reduced by`)."""
    text = F.lower(F.trim(verb))
    auxiliaries = rf"^(?:(?:{'|'.join(BE_HAVE_FORMS)})\b ?)+"
    bare = text.rlike(auxiliaries) & ~F.regexp_replace(text, auxiliaries, "").rlike(r"^\w+(ed|en)\b")
    return F.coalesce(text.rlike("|".join(DEFINITIONAL_PHRASES)) | bare, F.lit(False))


# Rules that take a plural or inflected English noun to its base, first match wins.
LEMMA_RULES: Sequence[tuple[str, str]] = (
    (r"(.*[^aeiou])ies$", "$1y"),
    (r"(.*(?:s|x|z|ch|sh))es$", "$1"),
    (r"(.*(?:ss|us|is))$", "$1"),
    (r"(.{2,})s$", "$1"),
)


def lemma(word: Column) -> Column:
    result = word
    for pattern, replacement in reversed(LEMMA_RULES):
        result = F.when(word.rlike(f"^{pattern}"), F.regexp_replace(word, f"^{pattern}", replacement)).otherwise(result)
    return result


def normalise_entity(entity: Column) -> Column:
    """Codes of two to four characters whose letters are all capitals stay; other names become lower case with each word reduced to its base."""
    name = F.trim(entity)
    words = F.transform(F.split(F.lower(name), " +"), lemma)
    base = F.array_join(words, " ")
    code = F.length(name).between(2, 4) & (F.upper(name) == name) & (F.lower(name) != name)
    return F.when(code, name).otherwise(base)


def graph_entity(entity: Column) -> Column:
    """Normalised name, except that an all-capitals original is kept as written."""
    capitals = (F.upper(entity) == entity) & (F.lower(entity) != entity) & (F.length(entity) > 1)
    return F.when(capitals, entity).otherwise(normalise_entity(entity))
