"""Near-duplicate vectors by spherical-cap filters with exact verification.

Filters are the directions of a random product code: turned vectors are cut in two halves, each half has `words` random
unit vectors, and every pair of them is a direction. A vector's list is all directions whose inner product with it
exceeds its own threshold, the score of its `held`-th best: only sums on the staircase of the two sorted halves can be
among these, so the list is decoded without a look at the other directions. Directions with one first word and
neighbouring second words are one join key, so that a vector goes to each key once; the ranges narrow as the table grows.
Vectors of one label with a common key meet, and each pair is verified by its cosine in double precision. The words grow with
the square root of the largest label's vectors, so that what meets by chance stays bounded for each key. Which pairs meet
is the only approximation: of pairs at a cosine of just 0.93 fewer than one in two thousand have no common direction
(simulated for 64 components), closer pairs have more.

A pair may meet at several keys and counts at the least common one only: each vector brings its keys. Pairs are counted
where they meet and do not leave; a meeting yields a count for each vector and edges of a spanning forest.

Equal vectors of a label are one, with a weight. Hot groups of near copies are balls: a bounded sample shows dense places,
and every vector whose angle to such a centre is less than half the linking angle is in its ball. By the triangle
inequality all of a ball link, so they are counted by its weight and never compared with each other. Keys with many
vectors are cut in packs by ball and hash, and pairs of packs are dealt out singly; a pair of one ball is not made. The sample
steers the work only, never the result.

Null labels, null, empty and zero vectors and those with null or non-finite components link with nothing: their rows have no
links and stand for themselves. Rows may repeat, and ids too. Rows without an id are linked like others, give no component its
number and are not kept; a component of such rows only has a null number. Vectors of other lengths than most raise.
Other columns stay out. An empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from furrow.llm.common import matrix, row_total
from furrow.operators.graph import connected_components
from furrow.session import cut_lineage

SIMILAR = 0.93
#: Vectors that show where hot groups are, centres at most, and members in the sample from which on a place is hot.
SAMPLE, CENTRES, DENSE = 8192, 256, 16
#: Vectors of a key that are compared as one pack, and those that a key should bring together by chance.
PACK, MEET = 1024, 256
#: Results (some 30 bytes and a vector each) and large keys (20 bytes each) that are sent to every task; more are joined by shuffle.
SENT, SENT_KEYS = 20_000, 200_000
SEED = 12


@dataclass(frozen=True)
class Code:
    """Rotation and the words of both halves; `held` directions are a vector's list."""

    turn: np.ndarray
    halves: tuple[np.ndarray, np.ndarray]
    held: int

    def lists(self, unit: np.ndarray) -> np.ndarray:
        """Sorted numbers of the directions that exceed each vector's threshold."""
        turned = np.pad(unit, ((0, 0), (0, len(self.turn) - unit.shape[1]))) @ self.turn
        cut, words = len(self.turn) // 2, len(self.halves[0])
        best = []
        for part, half in zip((turned[:, :cut], turned[:, cut:]), self.halves):
            score = part @ half.T
            near = np.argpartition(-score, self.held - 1, axis=1)[:, :self.held] if self.held < words else np.tile(np.arange(words), (len(score), 1))
            value = np.take_along_axis(score, near, 1)
            order = np.argsort(-value, axis=1, kind="stable")
            best.append((np.take_along_axis(near, order, 1), np.take_along_axis(value, order, 1)))
        # The k-th best sum has at most k-1 pairs that are no worse in both halves.
        i, j = np.array([(i, j) for i in range(best[0][0].shape[1]) for j in range(best[1][0].shape[1]) if (i + 1) * (j + 1) <= self.held]).T
        total = best[0][1][:, i] + best[1][1][:, j]
        chosen = np.argpartition(-total, self.held - 1, axis=1)[:, :self.held] if len(i) > self.held else np.tile(np.arange(len(i)), (len(total), 1))
        number = best[0][0].astype(np.int64)[:, i] * words + best[1][0][:, j]
        return np.sort(np.take_along_axis(number, chosen, 1), axis=1)


def code_size(vectors: int) -> tuple[int, int, int]:
    """Words of a half, directions of a list and second words of a key, for so many vectors of a label."""
    bits = max(5, (max(1, vectors) - 1).bit_length() + 1 >> 1)
    words, held = 1 << bits, 6 * bits
    wide = words * words * MEET // (max(1, vectors) * held)
    return words, held, min(words, 1 << max(0, wide.bit_length() - 1))


@lru_cache(4)
def code(width: int, words: int, held: int) -> Code:
    rng = np.random.default_rng(SEED)
    size = max(2, width + width % 2)
    turn = np.linalg.qr(rng.standard_normal((size, size)))[0]
    halves = []
    for _ in range(2):
        half = rng.standard_normal((words, size // 2))
        halves.append(half / np.sqrt((half * half).sum(axis=1, keepdims=True)))
    return Code(turn, (halves[0], halves[1]), held)


def unit_rows(rows: np.ndarray) -> np.ndarray:
    """Rows of length one; the largest component goes first, so that no square leaves the range of doubles."""
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def usable(vector: Column) -> Column:
    """True for vectors that can link."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


# --- hot groups -----------------------------------------------------------------------------------------------------


def half_angle(similar: float) -> float:
    """Cosine of a little less than half the linking angle."""
    return float(np.cos(np.arccos(similar) / 2 - 1e-6))


def centres(labels: np.ndarray, unit: np.ndarray, similar: float) -> list[tuple[int, np.ndarray]]:
    """Centres of the dense places of a sample, the densest first."""
    near, found = half_angle(similar), []
    for label in np.unique(labels).tolist():
        rows = unit[labels == label]
        count = np.concatenate([(rows[s:s + 512] @ rows.T >= near).sum(axis=1) for s in range(0, len(rows), 512)])
        free = np.ones(len(rows), bool)
        for at in np.argsort(-count, kind="stable").tolist():
            if count[at] < DENSE:
                break
            if free[at]:
                mine = free & (rows @ rows[at] >= near)
                free &= ~mine
                if mine.sum() >= DENSE:
                    found.append((int(mine.sum()), label, rows[at]))
    return [(label, row) for _, label, row in sorted(found, key=lambda f: -f[0])[:CENTRES]]


# --- meetings -------------------------------------------------------------------------------------------------------


def _decoded(vectors: DataFrame, words: int, held: int, wide: int, hot: list[tuple[int, np.ndarray]], similar: float) -> DataFrame:
    """(key, label, weight, vector, ball, spots) of each vector; ball is the number of its centre, or -1, spots are its join keys."""
    near = half_angle(similar)
    labels, rows = np.array([h[0] for h in hot]), np.array([h[1] for h in hot])
    kind = vectors.schema["vector"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in range(0, batch.num_rows, 512):
                some = batch.slice(s, 512)
                unit = unit_rows(matrix(some.column(3)))
                found = code(unit.shape[1], words, held).lists(unit) // wide  # sorted: equal ones are neighbours
                new = np.concatenate([np.ones((len(found), 1), bool), found[:, 1:] != found[:, :-1]], axis=1)
                ball = np.full(len(unit), -1)
                if len(hot):
                    if rows.shape[1] != unit.shape[1]:
                        raise ValueError("vectors differ in length")
                    close = np.where(some.column(1).to_numpy()[:, None] == labels, unit @ rows.T, -2.0)
                    best = close.argmax(axis=1)
                    ball = np.where(close[np.arange(len(unit)), best] >= near, best, -1)
                ends = np.concatenate([[0], np.cumsum(new.sum(axis=1))]).astype(np.int32)
                spots = pa.ListArray.from_arrays(pa.array(ends), pa.array(found[new]))
                yield pa.RecordBatch.from_arrays([*some.columns, pa.array(ball.astype(np.int32)), spots], ["key", "label", "weight", "vector", "ball", "spots"])

    return vectors.select("key", "label", "weight", "vector").mapInArrow(
        run, f"key long, label long, weight long, vector {kind}, ball int, spots array<bigint>")


@dataclass(frozen=True)
class Members:
    """Vectors that meet: keys, weights, balls, unit vectors, and join keys with the place of each."""

    key: np.ndarray
    weight: np.ndarray
    ball: np.ndarray
    unit: np.ndarray
    spot: np.ndarray
    place: np.ndarray

    @classmethod
    def of(cls, packs: list[pa.StructArray]) -> Members:
        rows = pa.concat_arrays(packs)
        spots = rows.field("spots")
        key, weight, ball = (rows.field(c).to_numpy() for c in ("key", "weight", "ball"))
        place = np.repeat(np.arange(len(rows)), spots.value_lengths().to_numpy())
        return cls(key, weight, ball, unit_rows(matrix(rows.field("vector"))), spots.flatten().to_numpy(), place)


def compare(spot: int, rows: Members, split: int, similar: float) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Links at one key: each row's linked weight, and edges (places) that connect what the links connect.

    With `split`, the rows before it meet only those from it on; without, all rows meet. Rows of one ball are not compared.
    """
    unit, ball, weight, n = rows.unit, rows.ball, rows.weight, len(rows.key)
    left, right = (np.arange(split), np.arange(split, n)) if split else (np.arange(n), np.arange(n))
    close = np.zeros((len(left), len(right)), bool)
    for s in range(0, len(left), 256):
        close[s:s + 256] = unit[left[s:s + 256]] @ unit[right].T >= similar - 1e-9
    close &= ~((ball[left][:, None] == ball[right][None, :]) & (ball[left] >= 0)[:, None])
    if not split:
        close &= left[:, None] < right[None, :]
    a, b = np.nonzero(close)
    total = np.zeros(n, np.int64)
    if not len(a):
        return total, []
    a, b = left[a], right[b]
    for s in range(0, len(a), 1 << 16):  # near the edge the sum over components decides, in their order
        exact = np.zeros(len(a[s:s + (1 << 16)]))
        x, y = unit[a[s:s + (1 << 16)]], unit[b[s:s + (1 << 16)]]
        for d in range(unit.shape[1]):
            exact += x[:, d] * y[:, d]
        a[s:s + (1 << 16)] = np.where(exact >= similar, a[s:s + (1 << 16)], -1)
    a, b = a[a >= 0], b[a >= 0]
    if not len(a):
        return total, []
    # Keys before this one that both have: the pair has met there.
    part = np.unique(np.concatenate([a, b]))
    of = np.full(n, -1)
    of[part] = np.arange(len(part))
    before = (rows.spot < spot) & (of[rows.place] >= 0)
    names, at = np.unique(rows.spot[before], return_inverse=True)
    has = np.zeros((len(part), len(names)), np.float32)
    has[of[rows.place[before]], at] = 1
    has = has[:, has.sum(axis=0) > 1]
    i, j = np.searchsorted(part, a), np.searchsorted(part, b)
    if has.shape[1]:
        common = np.empty(len(a), bool)
        rows_of = np.unique(i)
        for s in range(0, len(rows_of), 256):
            some = rows_of[s:s + 256]
            mine = np.flatnonzero((i >= some[0]) & (i <= some[-1]))
            both = has[some] @ has.T > 0.5
            common[mine] = both[np.searchsorted(some, i[mine]), j[mine]]
        a, b = a[~common], b[~common]
    np.add.at(total, a, weight[b])
    np.add.at(total, b, weight[a])
    # A forest over the counted links.
    root, edges = list(range(n)), []

    def top(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for x, y in zip(a.tolist(), b.tolist()):
        p, q = top(x), top(y)
        if p != q:
            root[p] = q
            edges.append((x, y))
    return total, edges


def _links(pairs: DataFrame, similar: float) -> DataFrame:
    """(key, other, n): a count of each vector's links (other null), and edges (n null)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for spot, members, more in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                two = more.is_valid
                rows = Members.of([members.values, more.values] if two else [members.values])
                total, edges = compare(spot, rows, len(members.values) if two else 0, similar)
                key, at = rows.key, np.flatnonzero(total)
                a, b = (np.array([e[c] for e in edges], np.int64) for c in (0, 1))
                if len(at) or len(a):
                    none = lambda n: pa.nulls(n, pa.int64())
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.concatenate([key[at], key[a]])), pa.concat_arrays([none(len(at)), pa.array(key[b])]),
                         pa.concat_arrays([pa.array(total[at]), none(len(a))])], ["key", "other", "n"])

    return pairs.select("spot", "members", "more").mapInArrow(run, "key long, other long, n long")


def linked(vectors: DataFrame, similar: float = SIMILAR, pack: int = PACK) -> tuple[DataFrame, DataFrame]:
    """Links of different vectors (key, label, weight, vector): (key, n) of the weight linked, and edges (id_a, id_b)."""
    largest = vectors.groupBy("label").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    sample = vectors.orderBy(F.xxhash64("vector"), "key").limit(SAMPLE).select("label", "vector").collect()
    if len({len(r[1]) for r in sample}) > 1:
        raise ValueError("vectors differ in length")
    hot = centres(np.array([r[0] for r in sample]), unit_rows(np.array([r[1] for r in sample], np.float64)), similar) if sample else []
    rows = cut_lineage(_decoded(vectors, *code_size(largest), hot, similar))
    size = rows.select("label", F.explode("spots").alias("spot")).groupBy("label", "spot").agg(F.count(F.lit(1)).alias("n"))
    large = cut_lineage(size.where(F.col("n") > pack).select("label", "spot", F.ceil(F.col("n") / pack).cast("int").alias("packs")))
    if row_total(large) <= SENT_KEYS:
        large = F.broadcast(large)
    member = F.struct("key", "weight", "vector", "ball", "spots").alias("member")
    dealt = rows.select("label", "key", "ball", F.explode("spots").alias("spot"), member).join(large, ["label", "spot"], "left")
    whole = F.col("packs").isNull()
    place = ["label", "spot", "of_ball", "part"]
    dealt = dealt.select("label", "spot", F.when(whole, -2).otherwise(F.col("ball")).alias("of_ball"),
                         F.when(whole, 0).otherwise(F.pmod(F.xxhash64("key"), F.col("packs"))).cast("int").alias("part"), "member")
    # Placed by the pack, not by the key alone, so that no task gets all packs of a key.
    packs = cut_lineage(dealt.repartition(*place).groupBy(*place).agg(F.collect_list("member").alias("members")))
    alone = packs.where("of_ball < 0 AND size(members) > 1").select("spot", "members", F.lit(None).cast(packs.schema["members"].dataType).alias("more"))
    # Pairs of packs are made of their names; the packs follow, one join key each.
    named = packs.where("of_ball > -2").select("label", "spot", F.struct("of_ball", "part").alias("name"), "members")
    a, b = (named.select("label", "spot", F.col("name").alias(x)) for x in "ab")
    two = a.join(b, ["label", "spot"]).where((F.col("a") < F.col("b")) & ((F.col("a.of_ball") != F.col("b.of_ball")) | (F.col("a.of_ball") < 0)))
    met = two.join(named.withColumnsRenamed({"name": "a"}), ["label", "spot", "a"]).join(
        named.withColumnsRenamed({"name": "b", "members": "more"}), ["label", "spot", "b"]).select("spot", "members", "more")
    found = cut_lineage(_links(alone.unionByName(met), similar))
    # All of a ball link with each other.
    balls = rows.where("ball >= 0").groupBy("ball").agg(F.sum("weight").alias("all"), F.min("key").alias("least"))
    held = rows.where("ball >= 0").join(F.broadcast(balls), "ball")  # CENTRES rows at most
    counts = found.where("n IS NOT NULL").select("key", "n").unionByName(held.select("key", (F.col("all") - F.col("weight")).alias("n")))
    edges = found.where("other IS NOT NULL").select(F.col("key").alias("id_a"), F.col("other").alias("id_b")).unionByName(
        held.where("key <> least").select(F.col("key").alias("id_a"), F.col("least").alias("id_b")))
    return counts.groupBy("key").agg(F.sum("n").alias("n")), edges


def deduplicated(rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", similar: float = SIMILAR,
                 pack: int = PACK) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row: other rows linked, the smallest id that links lead to, and
    whether that is the row's own."""
    taken = rows.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).cast("long").alias("label"), F.col(vector).alias("vector"))
    links = F.col("label").isNotNull() & usable(F.col("vector"))
    valid = taken.where(links)
    groups = valid.groupBy("label", "vector").agg(F.count(F.lit(1)).alias("weight"), F.min("vec_id").alias("least"))
    vectors = cut_lineage(groups.withColumn("key", F.monotonically_increasing_id()))
    counts, edges = linked(vectors, similar, pack)
    edges = cut_lineage(edges)
    nodes = edges.select(F.col("id_a").alias("id")).union(edges.select(F.col("id_b").alias("id")))
    component = connected_components(edges, nodes).withColumnRenamed("id", "key")
    named = vectors.select("key", "label", "vector", "weight", "least")
    joined = named.join(component, "key", "left").join(counts, "key", "left").withColumn("component", F.coalesce("component", "key"))
    number = joined.groupBy("component").agg(F.min("least").alias("number"))
    told = cut_lineage(joined.where((F.col("weight") > 1) | F.col("n").isNotNull()).join(number, "component").select(
        "label", "vector", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n"), "number", F.lit(True).alias("told")))
    if row_total(told) <= SENT:
        told = F.broadcast(told)
    out = valid.join(told, ["label", "vector"], "left").unionByName(
        taken.where(~links).withColumns({"n": F.lit(0).cast("long"), "number": F.col("vec_id"), "told": F.lit(True)}))
    number = F.when(F.col("told"), F.col("number")).otherwise(F.col("vec_id"))
    return out.select("vec_id", F.coalesce("n", F.lit(0)).alias("n_links"), number.alias("component_id"),
                      F.coalesce(F.col("vec_id") == number, F.lit(False)).alias("kept"))
