"""Hard negatives of anchors: rotated one-bit codes, deterministic score intervals, exact scores of what is left.

Components become whole numbers, floor(256 x), and a score is the inner product of whole numbers. A vector is coded in
rounds: what is left of it is turned by the round's rotation and its signs are the round's code, one bit for each
component. Beside each code its alignment is stored, the share of the remainder along the code vector, and at the end
the length of what no code explains. An anchor is turned by the same rotations and cut into bit planes, so that a
popcount for each plane gives the inner product with a code vector up to a rounding error that is known for each
anchor. The score lies within that estimate, give or take the rounding errors and, by Cauchy-Schwarz, the product of the
remainder's length and the anchor's. The bounds are certain, so intervals only ever exclude what cannot be in the result;
all others are scored in whole numbers.

Rows are held in packs of bounded size. Each pack of anchors meets each pack of rows, the anchors being copied; only the
best rows of each meeting leave it. The first pass finds the anchors' positives, the second their negatives.

Rows with a null id, a null label, a null or empty vector, or a null or non-finite component take no part; zero vectors
do. Vectors of other lengths than most raise, and so do components of 2^23 and more. Rows may repeat, and ids too: each
row is a row of its own, and an anchor's others are all rows but its own. An empty table gives an empty one. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from furrow.llm.common import matrix, row_total
from furrow.session import cut_lineage

#: A component is so many steps.
SCALE = 256
#: Positives of an anchor, negatives of a positive, and what a negative's score is of the positive's, in percent.
POSITIVES, NEGATIVES = 5, 5
BAND = (80, 100)
#: Rounds of codes, and bit planes of an anchor.
CODES, PLANES = 6, 8
#: Rows and anchors of a pack.
PACK, ANCHORS = 4096, 256
SEED = 11
#: More than the rounding of sums in double precision, as a share of the lengths' product.
SLACK = 1e-9
LIMIT = 1 << 31


@lru_cache(4)
def rotations(width: int, codes: int) -> np.ndarray:
    rng = np.random.default_rng(SEED)
    return np.stack([np.linalg.qr(rng.standard_normal((width, width)))[0] for _ in range(codes)])


def _padded(whole: np.ndarray) -> np.ndarray:
    """Rows with zeros up to a multiple of 64 components."""
    return np.pad(whole.astype(np.float64), ((0, 0), (0, -whole.shape[1] % 64)))


def _bits(signs: np.ndarray) -> np.ndarray:
    return np.packbits(signs, axis=1, bitorder="little").view("<u8")


@dataclass(frozen=True)
class Codes:
    """Codes of rows: words (round, row, word), alignments (round, row), remainder (row)."""

    words: np.ndarray
    aligned: np.ndarray
    rest: np.ndarray


def encode(whole: np.ndarray, codes: int = CODES) -> Codes:
    left = _padded(whole)
    size = left.shape[1]
    words, aligned = [], []
    for turn in rotations(size, codes):
        turned = left @ turn.T
        up = turned > 0
        along = np.abs(turned).sum(axis=1) / size
        left = left - along[:, None] * ((2.0 * up - 1) @ turn)
        words.append(_bits(up))
        aligned.append(along)
    return Codes(np.stack(words), np.stack(aligned), np.sqrt((left * left).sum(axis=1)))


class Anchor:
    """An anchor's bit planes for each round, and the bounds of its scores."""

    def __init__(self, whole: np.ndarray, codes: int = CODES):
        q = _padded(whole[None])[0]
        self.length = float(np.sqrt(q @ q))
        self.rounds = []
        for turn in rotations(len(q), codes):
            u = turn @ q
            low, step = float(u.min()), float((u.max() - u.min()) / ((1 << PLANES) - 1))
            level = np.rint((u - low) / step).astype(np.uint64) if step else np.zeros(len(u), np.uint64)
            error = float(np.abs(u - (low + step * level)).sum())
            planes = np.stack([_bits((level >> np.uint64(p) & np.uint64(1)).astype(bool)[None])[0] for p in range(PLANES)])
            self.rounds.append((low, step, int(level.sum()), error, planes, len(q)))

    def bounds(self, rows: Codes) -> tuple[np.ndarray, np.ndarray]:
        """Least and largest whole score that each row can have."""
        middle, around = np.zeros(len(rows.rest)), rows.rest * self.length
        for words, aligned, (low, step, levels, error, planes, size) in zip(rows.words, rows.aligned, self.rounds):
            ones = np.bitwise_count(words).sum(axis=1, dtype=np.int64)
            held = np.zeros(len(words), np.int64)
            for p, plane in enumerate(planes):
                held += np.bitwise_count(words & plane).sum(axis=1, dtype=np.int64) << p
            # Sum of sign times component: ones count twice, less all.
            middle += aligned * (low * (2 * ones - size) + step * (2 * held - levels))
            around += aligned * error
        slack = SLACK * (1 + self.length * (aligned_total(rows) + rows.rest))
        return np.ceil(middle - around - slack), np.floor(middle + around + slack)


@lru_cache(2048)
def anchor_of(raw: bytes, codes: int) -> Anchor:
    """An anchor of a pack; it meets many."""
    return Anchor(np.frombuffer(raw, np.int32), codes)


def aligned_total(rows: Codes) -> np.ndarray:
    return rows.aligned.sum(axis=0) * np.sqrt(rows.words.shape[2] * 64)


def scores(rows: np.ndarray, anchor: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers; through doubles where these hold each sum exactly."""
    most = int(np.abs(rows).max(initial=0)) * int(np.abs(anchor).max(initial=0)) * max(1, rows.shape[1])
    if most < 1 << 53:
        return (rows.astype(np.float64) @ anchor.astype(np.float64)).astype(np.int64)
    if most >= 1 << 63:
        raise OverflowError("a score does not fit a long")
    return (rows.astype(np.int64) * anchor.astype(np.int64)).sum(axis=1)


def first(score: np.ndarray, ids: np.ndarray, rows: np.ndarray, most: int) -> np.ndarray:
    """Places of the first `most`: higher scores first, then smaller ids, then rows."""
    if len(score) > most:
        edge = -np.partition(-score, most - 1)[most - 1]
        near = np.flatnonzero(score >= edge)
    else:
        near = np.arange(len(score))
    return near[np.lexsort((rows[near], ids[near], -score[near]))[:most]]


def _whole(column: pa.Array) -> np.ndarray:
    scaled = np.floor(SCALE * matrix(column))
    if scaled.size and np.abs(scaled).max() >= LIMIT:
        raise OverflowError("components are too large")
    return scaled.astype(np.int32)


def _packs(rows: DataFrame, most: int, coded: bool, codes: int) -> DataFrame:
    """Rows (row, id, label, vector, scores) in packs of at most `most`, with their codes if asked for."""
    names = ["rows", "ids", "labels", "whole", "n", "words", "aligned", "rest", "wanted"]

    def made(batch: pa.RecordBatch) -> pa.RecordBatch:
        whole = _whole(batch.column(3))
        values: list = [*(batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64).tobytes() for c in range(3)), whole.tobytes(), len(whole)]
        found = encode(whole, codes) if coded else None
        values += [found.words.tobytes(), found.aligned.tobytes(), found.rest.tobytes()] if coded else [None] * 3
        values.append(None if coded else batch.column(4).to_pylist())
        kinds = [pa.binary()] * 4 + [pa.int64()] + [pa.binary()] * 3 + [pa.list_(pa.list_(pa.int64()))]
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, most):
                some = batch.slice(at, most)
                if n + some.num_rows > most:
                    yield made(pa.concat_batches(held))
                    held, n = [], 0
                held.append(some)
                n += some.num_rows
        if n:
            yield made(pa.concat_batches(held))

    return rows.select("row", "id", "label", "vector", "scores").mapInArrow(
        run, "rows binary, ids binary, labels binary, whole binary, n long, words binary, aligned binary, rest binary, wanted array<array<bigint>>")


def _read(pack: dict, codes: int) -> tuple:
    ids = [np.frombuffer(pack[c], np.int64) for c in ("rows", "ids", "labels")]
    whole = np.frombuffer(pack["whole"], np.int32).reshape(pack["n"], -1)
    if pack["words"] is None:
        return *ids, whole, None
    n = pack["n"]
    return *ids, whole, Codes(np.frombuffer(pack["words"], "<u8").reshape(codes, n, -1), np.frombuffer(pack["aligned"], np.float64).reshape(codes, n),
                              np.frombuffer(pack["rest"], np.float64))


def _positives(low, high, own, most, score) -> tuple[np.ndarray, np.ndarray]:
    """Places among `own` (and scores) that hold the first `most` by score."""
    floor_ = np.partition(low[own], -most)[-most] if len(own) > most else -np.inf
    live = own[high[own] >= floor_]
    return live, score(live)


def _within(low, high, other, wanted, most, score) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each wanted positive score: (it, places in its band, their scores)."""
    bands = [(w, -(-BAND[0] * w // 100), BAND[1] * w // 100) for w in wanted]
    live = np.zeros(len(low), bool)
    for _, least, largest in bands:
        may = other[(high[other] >= least) & (low[other] <= largest)]
        sure = may[(low[may] >= least) & (high[may] <= largest)]
        if len(sure) > most:
            may = may[high[may] >= np.partition(low[sure], -most)[-most]]
        live[may] = True
    at = np.flatnonzero(live)
    found = score(at)
    for w, least, largest in bands:
        fits = (found >= least) & (found <= largest)
        yield w, at[fits], found[fits]


def _met(pairs: DataFrame, most: int, codes: int, negatives: bool) -> DataFrame:
    """(anchor, wanted, other, id, score): the first rows of each meeting of an anchor with a pack."""

    def meet(asked: tuple, wanted: list, held: tuple) -> Iterator[tuple]:
        a_rows, a_labels, a_whole = asked[0], asked[2], asked[3]
        rows, ids, labels, whole, coded = held
        if len(a_whole) and a_whole.shape[1] != whole.shape[1]:
            raise ValueError("vectors differ in length")
        for i in range(len(a_rows)):
            low, high = anchor_of(a_whole[i].tobytes(), codes).bounds(coded)
            score = lambda at, q=a_whole[i]: scores(whole[at], q)
            same = labels == a_labels[i]
            if negatives:
                lists = _within(low, high, np.flatnonzero(~same), sorted(set(wanted[i])), most, score)
            else:
                lists = [(0, *_positives(low, high, np.flatnonzero(same & (rows != a_rows[i])), most, score))]
            for w, at, found in lists:
                best = first(found, ids[at], rows[at], most)
                n = len(best)
                yield np.repeat(a_rows[i], n), np.repeat(w, n), rows[at[best]], ids[at[best]], found[best]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for pair in batch.to_pylist():
                parts = list(meet(_read(pair["asked"], codes), pair["asked"]["wanted"], _read(pair["held"], codes)))
                if parts:
                    columns = [pa.array(np.concatenate(c).astype(np.int64)) for c in zip(*parts)]
                    yield pa.RecordBatch.from_arrays(columns, ["anchor", "wanted", "other", "id", "score"])

    return pairs.select("asked", "held").mapInArrow(run, "anchor long, wanted long, other long, id long, score long")


def _pairs(anchors: DataFrame, index: DataFrame, slots: int) -> DataFrame:
    """Each pack of anchors beside each pack of rows. Packs of rows have their slots; anchors are copied to all."""
    every = F.explode(F.sequence(F.lit(0), F.lit(slots - 1))).alias("slot")
    return anchors.select(F.struct("*").alias("asked"), every).join(index.select("slot", F.struct(*[c for c in index.columns if c != "slot"]).alias("held")), "slot")


def mined(rows: DataFrame, is_anchor: Column, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", positives: int = POSITIVES,
          negatives: int = NEGATIVES, codes: int = CODES, pack: int = PACK) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for rows where `is_anchor` (of column `id`) is true.

    Rank is a negative's place among those of its anchor and positive. Positives of one score and id share a place in the
    order, yet each has its own negatives.
    """
    real = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    taken = rows.select(F.col(vec_id).cast("long").alias("id"), F.col(label).cast("long").alias("label"), F.col(vector).alias("vector")).where(
        F.col("id").isNotNull() & F.col("label").isNotNull() & F.coalesce((F.size("vector") > 0) & real, F.lit(False)))
    valid = cut_lineage(taken.withColumn("row", F.monotonically_increasing_id()).withColumn("scores", F.array().cast("array<bigint>")))
    n = row_total(valid)
    slots = max(1, -(-n // pack))
    index = _packs(valid, pack, True, codes).withColumn("slot", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(slots)).cast("int"))
    index = cut_lineage(index.drop("wanted"))
    anchors = cut_lineage(valid.where(is_anchor))
    parts = max(1, -(-row_total(anchors) // ANCHORS))
    # First pass: positives.
    asked = cut_lineage(_packs(anchors.repartition(parts, "row"), ANCHORS, False, codes))
    near = _met(_pairs(asked, index, slots), positives, codes, False)
    order = Window.partitionBy("anchor").orderBy(F.desc("score"), "id", "other")
    best = cut_lineage(near.withColumn("place", F.row_number().over(order)).where(F.col("place") <= positives).select(
        "anchor", F.col("other").alias("positive"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")))
    # Second pass: negatives, once for each different score of an anchor's positives.
    lists = best.groupBy(F.col("anchor").alias("row")).agg(F.collect_set("positive_score").alias("scores"))
    again = cut_lineage(_packs(anchors.drop("scores").join(lists, "row").repartition(parts, "row"), ANCHORS, False, codes))
    below = _met(_pairs(again, index, slots), negatives, codes, True)
    order = Window.partitionBy("anchor", "wanted").orderBy(F.desc("score"), "id", "other")
    chosen = below.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    named = best.join(anchors.select(F.col("row").alias("anchor"), F.col("id").alias("anchor_id")), "anchor")
    return named.join(chosen.select("anchor", F.col("wanted").alias("positive_score"), "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score")),
                      ["anchor", "positive_score"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
