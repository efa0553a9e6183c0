"""Hard negatives, near-duplicate vectors and periodic runs against plain Python."""

import hashlib
import random
import zlib
from collections import defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from furrow.llm import hard_negatives, near_vectors, periodic_runs, queries

VECTORS = "vec_id long, embedding array<float>, label int"


def whole(vector):
    return vector is not None and len(vector) > 0 and None not in vector and bool(np.isfinite(vector).all())


# --- hard negatives ---------------------------------------------------------------------------------------------------


def mined(rows, anchor):
    """(anchor, positive, rank, negative, scores) by comparing all rows."""
    real = [(i, np.floor(256 * np.array(v, np.float64)).astype(np.int64), label) for i, v, label in rows if i is not None and label is not None and whole(v)]
    out = []
    for at, (i, v, label) in enumerate(real):
        if not anchor(i):
            continue
        scored = sorted((-int(v @ w), j, k) for k, (j, w, _) in enumerate(real) if k != at)
        for s, j, _ in [x for x in scored if real[x[2]][2] == label][:5]:
            fits = [(t, n) for t, n, k in scored if real[k][2] != label and 80 * s >= 100 * t >= 100 * s]
            out += [(i, j, rank + 1, n, -s, -t) for rank, (t, n) in enumerate(fits[:5])]
    return sorted(out)


def vector_rows(width, seed=3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, width))
    rows = [(i, [float(np.float32(x)) for x in centres[i % 6] * (i % 4 > 0) + rng.normal(size=width) * 0.3], i % 3) for i in range(240)]
    rows[40] = (40, rows[41][1], 1)  # equal vectors under two labels, and twice under one
    rows += [rows[41], (41, rows[41][1], 2), (20, rows[8][1], 2), (20, rows[9][1], 0), (20, rows[9][1], 0)]
    rows += [(300, None, 1), (320, [0.0] * width, 1), (321, [0.0] * width, 2), (322, [float("nan")] * width, 1), (323, [1.0] * (width - 1) + [None], 0),
             (324, [float("inf")] * width, 0), (325, rows[3][1], None), (None, rows[3][1], 1), (340, [-x for x in rows[3][1]], 0), (326, [], 1)]
    return rows


@pytest.mark.parametrize("width", [1, 12, 70])
def test_hard_negatives_equal_brute_force(spark, width):
    rows = vector_rows(width)
    df = spark.createDataFrame([(*r, 1.5, "x") for r in rows], VECTORS + ", score double, row string").repartition(3)
    expected = mined(rows, lambda i: i % 20 == 0)
    assert len(expected) > 100
    for pack, codes in ((16, 2), (hard_negatives.PACK, hard_negatives.CODES)):
        got = hard_negatives.mined(df, F.col("id") % 20 == 0, pack=pack, codes=codes)
        assert sorted(map(tuple, got.collect())) == expected


def test_score_intervals_hold_and_narrow():
    rng = np.random.default_rng(1)
    rows = np.floor(256 * rng.normal(size=(500, 64))).astype(np.int32)
    widths = []
    for codes in (1, 3, 6):
        low, high = hard_negatives.Anchor(rows[0], codes).bounds(hard_negatives.encode(rows, codes))
        exact = hard_negatives.scores(rows, rows[0])
        assert (low <= exact).all() and (exact <= high).all()
        widths.append((high - low).mean())
    assert widths[2] < widths[1] / 2 < widths[0] / 4
    big = np.full((1, 4), 2**30, np.int32)
    assert hard_negatives.scores(big, big[0]).tolist() == [4 * 2**60]


def test_hard_negatives_of_odd_tables(spark):
    empty = spark.createDataFrame([], VECTORS)
    assert hard_negatives.mined(empty, F.col("id") % 20 == 0).count() == 0
    same = spark.createDataFrame([(i, [0.5, 1.0], 0) for i in range(30)], VECTORS)
    assert hard_negatives.mined(same, F.col("id") % 20 == 0).count() == 0  # no other label
    ties = spark.createDataFrame([(i, [0.5, 1.0], i % 2) for i in range(30)], VECTORS)
    got = hard_negatives.mined(ties, F.col("id") == 0).collect()
    assert sorted((r.positive_id, r["rank"], r.negative_id) for r in got) == [(p, k + 1, 2 * k + 1) for p in (2, 4, 6, 8, 10) for k in range(5)]


# --- near-duplicate vectors -------------------------------------------------------------------------------------------


def linked(rows, similar):
    """(id, links, component, kept) of each row by comparing all rows."""
    unit = [np.array(v, np.float64) / np.linalg.norm(v) if label is not None and whole(v) and any(v) else None for _, v, label in rows]
    root, count = list(range(len(rows))), [0] * len(rows)

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if unit[i] is not None and unit[j] is not None and rows[i][2] == rows[j][2] and unit[i] @ unit[j] >= similar:
                count[i] += 1
                count[j] += 1
                root[top(i)] = top(j)
    least = defaultdict(list)
    for i, r in enumerate(rows):
        least[top(i)].append(r[0])
    number = [min((x for x in least[top(i)] if x is not None), default=None) for i in range(len(rows))]
    return [(r[0], count[i], number[i], r[0] is not None and r[0] == number[i]) for i, r in enumerate(rows)]


def near_rows(width, seed=4):
    """Chains, copies and one hot group, under two labels."""
    rng, rows = np.random.default_rng(seed), []
    for base in range(40):
        at = rng.normal(size=width)
        for _ in range(6):
            rows.append(at)
            at = at + rng.normal(size=width) * np.linalg.norm(at) / np.sqrt(width) * rng.choice([0.1, 0.3, 0.36, 0.5])
    hot = rng.normal(size=width)
    rows += [hot + rng.normal(size=width) * 0.08 for _ in range(120)] + [hot] * 20
    out = [(i, [float(np.float32(x)) for x in v], i // 6 % 2 if i < 240 else 1) for i, v in enumerate(rows)]
    out += [(5, out[30][1], 1), (None, out[31][1], out[31][2]), (None, None, 1), (None, [9.0] + [0.0] * (width - 1), 5), (400, None, 0), (401, out[0][1], None),
            (402, [0.0] * width, 0), (403, [float("nan")] * width, 0), (404, [1.0] * (width - 1) + [None], 0), (405, [], 0), (406, [float("-inf")] * width, 1),
            (407, [1e-30 * x for x in out[2][1]], out[2][2])]
    order = random.Random(1).sample(range(len(out)), len(out))
    return [out[i] for i in order]


@pytest.mark.parametrize("pack", [16, near_vectors.PACK])
def test_near_vectors_equal_all_pairs(spark, pack):
    rows = near_rows(24)
    df = spark.createDataFrame([(*r, 0, "clash") for r in rows], VECTORS.replace("float", "double") + ", n_links int, spot string").repartition(3)
    got = near_vectors.deduplicated(df, pack=pack)
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"]
    expected = linked(rows, near_vectors.SIMILAR)
    assert max(x[1] for x in expected) >= 139 and sum(x[1] > 0 for x in expected) > 150
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(expected, key=repr)


def test_lists_hold_the_best_directions():
    rng = np.random.default_rng(2)
    unit = near_vectors.unit_rows(rng.normal(size=(50, 10)))
    made = near_vectors.code(10, 32, 40)
    turned = unit @ made.turn
    every = (turned[:, :5] @ made.halves[0].T)[:, :, None] + (turned[:, 5:] @ made.halves[1].T)[:, None, :]
    best = np.sort(np.argsort(-every.reshape(50, -1), axis=1)[:, :40], axis=1)
    assert (made.lists(unit) == best).all()


def test_recall_of_filters_at_the_threshold():
    rng = np.random.default_rng(5)
    for vectors in (2_000, 100_000):
        words, held, _ = near_vectors.code_size(vectors)
        made = near_vectors.code(64, words, held)
        a = near_vectors.unit_rows(rng.normal(size=(2000, 64)))
        side = rng.normal(size=a.shape)
        side = near_vectors.unit_rows(side - (side * a).sum(axis=1, keepdims=True) * a)
        b = near_vectors.SIMILAR * a + np.sqrt(1 - near_vectors.SIMILAR**2) * side
        met = [len(np.intersect1d(x, y)) > 0 for x, y in zip(made.lists(a), made.lists(b))]
        assert np.mean(met) >= 0.998


def test_near_vectors_of_odd_tables(spark):
    assert near_vectors.deduplicated(spark.createDataFrame([], VECTORS)).count() == 0
    none = spark.createDataFrame([(2, None, 1), (1, [0.0], 1), (1, [0.0], 1)], VECTORS)
    assert sorted(map(tuple, near_vectors.deduplicated(none).collect())) == [(1, 0, 1, True), (1, 0, 1, True), (2, 0, 2, True)]
    one = spark.createDataFrame([(i, [-2.0 + i], 1) for i in range(5)], VECTORS)  # one component: the sign decides
    assert sorted(map(tuple, near_vectors.deduplicated(one).collect())) == [(0, 1, 0, True), (1, 1, 0, False), (2, 0, 2, True), (3, 1, 3, True), (4, 1, 3, False)]


# --- periodic runs ----------------------------------------------------------------------------------------------------


def runs(said, least=24, times=3):
    """(start, length, period) by trying all periods."""
    out, n = [], len(said)
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            if said[i] != said[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and said[j] == said[j + q]:
                j += 1
            stretch = said[i:j + q]
            if len(stretch) >= max(least, times * q) and not any(all(x == y for x, y in zip(stretch, stretch[p:])) for p in range(1, q)):
                out.append((i, len(stretch), q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def left(said, found):
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(said) if i not in gone)


def looping(rng, most, kinds):
    said = [rng.choice(kinds) for _ in range(rng.randint(0, most))]
    for _ in range(rng.randint(0, 3) if said else 0):
        a = rng.randrange(len(said))
        p = rng.randint(1, max(1, (len(said) - a) // 3))
        for i in range(a, min(len(said), a + p * rng.randint(2, 9))):
            said[i] = said[a + (i - a) % p]
    return said


def test_runs_equal_brute_force():
    rng, total = random.Random(1), 0
    for _ in range(1500):
        said = looping(rng, 140, "abcde"[:rng.choice([1, 2, 3, 5])])
        least, times = rng.choice([(24, 3), (6, 2), (10, 3), (1, 2)])
        expected = runs(said, least, times)
        total += len(expected)
        assert [tuple(r) for r in periodic_runs.runs([w.encode() for w in said], least, times).tolist()] == expected
    assert total > 5000


def test_extensions_are_longest_common_ones():
    rng = random.Random(2)
    for _ in range(30):
        said = [rng.randint(1, 3) for _ in range(rng.randint(2, 60))]
        ahead = periodic_runs.Extensions(*periodic_runs.SuffixTree(said, 3).tour())
        a, b = np.array([(i, j) for i in range(len(said)) for j in range(len(said)) if i != j]).T
        for i, j, found in zip(a.tolist(), b.tolist(), ahead.of(a, b).tolist()):
            same = next((k for k, (x, y) in enumerate(zip(said[i:], said[j:])) if x != y), len(said) - max(i, j))
            assert found == same


def test_runs_of_documents(spark):
    rng = random.Random(3)
    texts = [" ".join(looping(rng, 120, ["a", "é", "日本", "A"])) for _ in range(40)]
    texts += [None, "", " \n\t", "a " * 23, "a " * 24, "x\n" * 50_000, "a\u00a0b " * 30, " ".join(f"w{i % 500}" for i in range(4000)), texts[3], texts[3]]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in enumerate(texts)], "doc_id long, text string, runs int, start string").repartition(3)
    for r in periodic_runs.with_runs(df).collect():
        said = [w.decode() for w in (texts[r.doc_id] or "").encode().split()]  # a no-break space ends no word
        found = [tuple(x) for x in r.runs]
        assert found == (runs(said) if len(said) < 4000 else [(0, len(said), 1 if r.doc_id == 45 else 500)])
        assert r.collapsed == left(said, found) and r.start == "x"
    assert periodic_runs.with_runs(df.limit(0)).count() == 0


def test_registered_runs_equal_brute_force(spark, tmp_path):
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice("abc") if i % 7 else f"w{rng.randrange(90)}" for _ in range(rng.randint(0, 200)))) for i in range(300)]
    rows += [(700, None), (701, ""), (None, "a " * 30), (3, "b " * 30)]
    folder = str(tmp_path)
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
    got = [tuple(r) for r in queries.QUERIES["op13_periodic_runs"](spark, folder).collect()]
    digest = lambda text: hashlib.sha256(text.encode()).hexdigest()
    expected = []
    for i, text in rows:
        said = (text or "").split()
        h, n = zlib.crc32(str(i).encode()) if i is not None else 1, len(said)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            said = said[:a] + [said[a + (k - a) % p] for k in range(a, n)]
        found = runs(said)
        top = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None,) * 3)
        lines = "".join(f"{s},{length},{q}\n" for s, length, q in found)
        expected.append((i, len(found), *top, 1000 * top[1] // top[2] if found else None, digest(lines), digest(left(said, found))))
    assert sorted(got, key=repr) == sorted(expected, key=repr)
