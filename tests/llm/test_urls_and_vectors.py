"""URL filters and neighbour search against plain Python."""

import random
import re

import duckdb
import numpy as np
from pyspark.sql import functions as F

from furrow.llm import neighbours, queries, url_filters


def glob_regex(pattern):
    kinds = {"**": ".*", "*": "[^/]*", "?": "[^/]"}
    return re.compile("".join(kinds.get(t) or re.escape(t) for t in re.findall(r"\*\*|\*|\?|[^*?]", pattern)), re.S)


def test_machine_matches_like_regular_expressions():
    rng = random.Random(2)
    patterns = ["".join(rng.choices(["a", "b", "/", "*", "**", "?", ".", "é"], k=rng.randint(0, 7))) for _ in range(150)]
    patterns = [p for p in patterns if "***" not in p]
    urls = ["".join(rng.choices("ab/.éx\U0001F600", k=rng.randint(0, 12))) for _ in range(400)] + ["a" * 5000]
    found = url_filters.Machine(patterns).match(urls)
    assert url_filters.Machine(patterns).words > 2
    for j, p in enumerate(patterns):
        expected = [bool(glob_regex(p).fullmatch(u)) for u in urls]
        assert found[:, j].tolist() == expected, p


def test_url_verdicts(spark):
    cases = {
        "http://A.ORG/x?y": ("a.org", "/x", "org/", "allow"), "https://example.org/es/": ("example.org", "/es/", "example.org/es/", "block"),
        "http://x.example.org/en/12": ("x.example.org", "/en/12", "example.org/en/1", "block"), "http://a.com/fr/1#z": ("a.com", "/fr/1", "com/fr/", "allow"),
        "http://notcom/fr/": ("notcom", "/fr/", None, "allow"), "http://a.com/de/x#y": ("a.com", "/de/x", "com/de/", "block"),
        "http://foo.net/x.org/y": ("foo.net", "/x.org/y", None, "allow"), "http://adult-x.net/1": ("adult-x.net", "/1", None, "block"),
        "http://b.org": ("b.org", "", None, "allow"), "http://É.org/": ("É.org", "/", "org/", "allow"), "http://u://v/w": ("u:", "//v/w", None, "allow"),
        "http://myexample.org/es/": ("myexample.org", "/es/", "org/", "allow"), "": ("", "", None, "allow"), "no scheme": ("", "", None, "allow"),
        "http://a.net/" + "p" * 30_000 + "/login": ("a.net", "/" + "p" * 30_000 + "/login", None, "block"), "x://h?a/b": ("h", "", None, "allow"),
    }
    rows = [(i, u, "clash") for i, u in enumerate([*cases, *cases, None])]
    df = spark.createDataFrame(rows, "page_id long, url string, verdict string").repartition(2)
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filters.judged(df).collect()}
    assert got == {i: ("", "", None, "allow") if u is None else cases[u] for i, u, _ in rows}
    assert url_filters.judged(df.limit(0)).count() == 0
    assert url_filters.judged(df, host_rules=(), blocked=()).where("verdict = 'allow' AND rule IS NULL").count() == len(rows)


def test_globs_see_canonical_addresses(spark):
    assert url_filters.canonical("u:p@adult.net.:80", "/%6Cog%69n/%2F/a/../b/./%25%36c%zz/..") == "adult.net/login/%2F/b/"
    assert url_filters.canonical("a@b@c:x", "") == "c:x" and url_filters.canonical("h", "/../../.a/...") == "h/.a/..."
    cases = {
        "http://b.net/%6Cogin": "block", "http://b.net/%4cogin": "allow", "http://b.net/x/../login": "block", "http://b.net/login/..": "allow",
        "http://u@adult.net/x": "block", "http://adult@b.net/x": "allow", "http://adult.net./x": "block", "http://b.net/a%2Fads/x": "allow",
        "http://b.net/%61d%73/x": "block", "http://b.net/x%2Eexe": "block", "http://b.net/%256cogin": "allow", "http://b.net/ads/../x": "allow",
        "http://b.net/./ads/x": "block", "http://b.net/%": "allow", "http://b.net/..\n/login%0A": "block", "http://com:80/de/": "allow", "http://:7/login": "block",
        "http://a.com/de/../fr/": "block",  # rules see host and path as given
    }
    pieces = ["/", "..", ".", "%2e", "%2F", "login", "%6Cogin", "ads", "%", "a", "é", "@", ":8", "adult", ".exe", "?", "\n", "com/fr/", "%%36c"]
    rng = random.Random(4)
    urls = [*cases, *("http://" + "".join(rng.choices(pieces, k=rng.randint(0, 9))) for _ in range(1500))]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").repartition(3)
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filters.judged(df).collect()}
    assert [got[i][3] for i in range(len(cases))] == list(cases.values())
    con = duckdb.connect()
    con.register("pages", df.toPandas())
    want = {r[0]: r[1:] for r in con.execute(f"SELECT page_id, host, path, rule, verdict FROM ({queries.ORACLES['op2_url_filters']})").fetchall()}
    assert got == want and {v[3] for v in got.values()} == {"allow", "block"}


def exact(rows, k):
    """Nearest of the queries by brute force."""
    good = {i: np.array(v, np.float64) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(v).all() and any(v)}
    out = {}
    for q in (i for i in good if i % 20 == 0):
        scored = sorted((-float(sum(a * b for a, b in zip(good[q], v))), i) for i, v in good.items() if i != q)
        out[q] = [(i, -s) for s, i in scored[:k]]
    return out


def vectors(n, seed=1, width=12):
    rng = np.random.default_rng(seed)
    rows = [(i, [float(x) for x in rng.normal(size=width).astype(np.float32)]) for i in range(n)]
    rows = [(i, rows[3][1] if 40 <= i < 120 else v) for i, v in rows]  # many equal ones
    rows[5], rows[20], rows[60], rows[7] = (5, None), (20, [0.0] * width), (60, [float("nan")] * width), (7, [1.0] * (width - 1) + [None])
    return rows + [(None, [1.0] * width), (300, [float("inf")] + [1.0] * (width - 1))]


def test_nearest_is_exact_when_all_leaves_open(spark):
    rows = vectors(260)
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, rank int").repartition(3)
    found = neighbours.nearest(df, F.col("id") % 20 == 0, opened=10**6, leaf=8, trees=3).collect()
    got = {}
    for r in sorted(found, key=lambda r: (r.query_id, r["rank"])):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert got == exact(rows, 20)
    assert neighbours.nearest(df.limit(0), F.col("id") % 20 == 0).count() == 0
    few = df.where("vec_id IN (0, 1, 2)")
    assert neighbours.nearest(few, F.col("id") % 20 == 0).count() == 2


def test_each_row_of_a_repeated_id_asks_for_itself(spark):
    rng = np.random.default_rng(6)
    new = lambda: [float(x) for x in rng.normal(size=8)]
    rows = [(i, new()) for i in range(90)]
    rows += [(20, new()), (40, rows[40][1])] + [(60, rows[60][1])] * 26 + [(33, new()), (33, new()), (80, rows[12][1])]
    score = lambda a, b: float(np.cumsum(np.array(a) * np.array(b))[-1])
    expected = []
    for at, (i, v) in enumerate(rows):
        if i % 20 == 0:
            near = sorted((-score(v, w), j) for k, (j, w) in enumerate(rows) if k != at)
            expected += [(i, n + 1, j, -s) for n, (s, j) in enumerate(near[:20])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = neighbours.nearest(df, F.col("id") % 20 == 0, opened=10**6, leaf=8, trees=2)
    assert sorted(map(tuple, got.collect())) == sorted(expected)


def test_recall_of_the_registered_query(spark):
    folder = "/root/testdata/sf0.1"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    matrix = np.array([v for _, v in rows], np.float64)
    ids = np.array([i for i, _ in rows])
    got = {}
    for r in queries.QUERIES["op6_nearest_neighbours"](spark, folder).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hits = []
    for q in ids[ids % 20 == 0]:
        score = matrix @ matrix[ids == q][0]
        score[ids == q] = -np.inf
        best = ids[np.lexsort((ids, -score))[:20]]
        hits.append(len(got[q] & set(best.tolist())) / 20)
    assert len(got) == len(hits) and np.mean(hits) >= 0.9
