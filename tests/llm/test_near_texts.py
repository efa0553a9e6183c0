"""Near copies by five-word shingles against plain Python."""

import random

import pytest

import corpus_pipeline
from furrow.llm import near_texts

DDL = "doc_id long, text string, lang string, source string, n_chars long"


def shingles(text):
    w = (text or "").lower().split()
    return frozenset(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def similar(a, b):
    return a == b or 5 * len(a & b) >= 4 * len(a | b)


def components_of(rows):
    """Component of each row (place in the list), by comparing all pairs."""
    sets, root = [shingles(r[1]) for r in rows], list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if similar(sets[i], sets[j]):
                root[top(i)] = top(j)
    return [top(i) for i in range(len(rows))]


def edited_rows():
    """Texts of 100 words with one, two or more words changed, chains of them, short and empty ones."""
    rng, rows = random.Random(3), []
    word = lambda: f"w{rng.randrange(5000)}"
    for base in range(30):
        text = [word() for _ in range(100)]
        for _ in range(8):
            rows.append(" ".join(text))
            start = text if base % 2 else rows[-1].split()
            text = list(start)
            for at in rng.sample(range(100), rng.choice((1, 2, 2, 3, 5))):
                text[at] = word()
    rows += ["", None, " \n", "one two", "One  TWO", "one two three four five six", "one two three four five seven"]
    rng.shuffle(rows)
    return [(i, t, "en", "s", 1) for i, t in enumerate(rows)]


@pytest.mark.parametrize("block", [400, near_texts.BLOCK])
def test_components_are_those_of_all_similar_pairs(spark, block):
    rows = edited_rows()
    got = {r.doc_id: bytes(r.component) for r in near_texts.components(spark.createDataFrame(rows, DDL), block=block).collect()}
    expected = components_of(rows)
    assert len(set(expected)) < len(rows) - 50
    assert len({(got[i], c) for i, c in enumerate(expected)}) == len(set(expected)) == len(set(got.values()))


def test_pipeline_stage_drops_texts_with_edited_words(spark):
    rows = edited_rows()
    kept = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, DDL), "")
    groups = {}
    for i, c in enumerate(components_of(rows)):
        groups.setdefault(c, i)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(groups.values())


def test_repeated_and_null_ids_keep_one_row_of_each_component(spark):
    text = lambda word: " ".join(f"{word}{i}" for i in range(20))
    rows = [(1, text("a")), (2, text("b")), (2, text("a")), (2, text("c")), (2, text("c")), (None, text("b")), (None, text("d")), (None, text("d")), (None, text("e"))]
    rows = [(i, t, "en", "s", 1) for i, t in rows]
    for parts in (1, 4):
        kept = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, DDL).repartition(parts), "").collect()
        assert sorted(((r.doc_id, r.text[0]) for r in kept), key=repr) == [(1, "a"), (2, "b"), (2, "c"), (None, "d"), (None, "e")]
