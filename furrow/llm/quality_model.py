"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

A text is a sparse vector: its hashed words with damped frequencies, one-hot classes of its structure (shares of
symbols, capitals, digits, repeated lines and words, lengths) and of its metadata. The score is the logistic of a bias, a
weight for each feature, and low-rank interactions of all pairs of features. The pairs are never formed: their sum is
half the square of the factors' sum less the sum of their squares, so scoring is linear in the features.

The model is learnt in one task on a bounded sample of labelled rows, chosen by hash, in a fixed order with a fixed seed:
the same tables give the same model. Ids, languages, sources and labels are no inputs. With only one label in the sample,
or none, there is nothing to learn: every score is the share of label 1 with one row of each label added.

Null texts are empty; empty texts have a score from their structure. Texts are taken whole. Of repeated ids in the labels
the least label counts, of repeated documents one is learnt from, and all are scored. Null labels and ids are not learnt
from; null metadata is a class of its own. An empty table gives an empty one. Columns of the input are carried; one with
the name of a result column is replaced.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from furrow.llm.common import with_results

#: Word buckets, classes of a statistic, rank of the interactions, labelled rows learnt from.
BUCKETS = 1 << 14
CLASSES = 16
RANK = 6
SAMPLE = 4000
#: Passes, rows of a step, step size, weight decay.
EPOCHS, STEP, RATE, DECAY = 12, 32, 0.08, 2e-5
#: A text is accepted from this score on.
ACCEPTED = 0.7
SEED = 11
STATISTICS = 12
SYMBOLS = b"#*$%&|<>!@^~_=+\\{}[]"
CAPITALS = bytes(range(65, 91))
DIGITS = b"0123456789"
MARKS = b".,;:?"


def _class(share: float) -> int:
    """Class of a share: finer towards zero."""
    return min(CLASSES - 1, int(share**0.5 * CLASSES))


def statistics(raw: bytes, tokens: list[bytes], seen: Counter) -> list[int]:
    """A class for each structure statistic."""
    size, n = max(1, len(raw)), max(1, len(tokens))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    without = lambda some: (len(raw) - len(raw.translate(None, some))) / size
    inner = list(zip(tokens, tokens[1:], tokens[2:]))
    return [
        _class(without(SYMBOLS)), _class(without(CAPITALS)), _class(without(DIGITS)), _class(without(MARKS)),
        _class(1 - len(set(lines)) / max(1, len(lines))), _class(1 - len(seen) / n), _class(1 - len(set(inner)) / max(1, len(inner))),
        _class(max(seen.values(), default=0) / n), min(CLASSES - 1, int(np.log2(len(tokens) + 1))),
        min(CLASSES - 1, int(sum(map(len, tokens)) / n)), min(CLASSES - 1, int(np.log2(len(tokens) / max(1, len(lines)) + 1) * 2)),
        _class(sum(seen[t] for t in seen if not t[:1].isalnum() and t[0] < 128) / n),
    ]


def features(text: str, metadata: list[int | None]) -> tuple[np.ndarray, np.ndarray]:
    """Indices (each once) and values of a text's vector."""
    raw = text.encode()
    tokens = raw.split()
    seen = Counter(tokens)
    hashed: dict[int, float] = {}
    for word, times in seen.items():
        at = zlib.crc32(word) % BUCKETS
        hashed[at] = hashed.get(at, 0.0) + times
    index = np.fromiter(hashed, np.int64, len(hashed))
    value = np.log1p(np.fromiter(hashed.values(), np.float64, len(hashed)))
    if len(value):
        value /= np.sqrt((value * value).sum())
    classes = statistics(raw, tokens, seen)
    classes += [CLASSES - 1 if m is None else min(CLASSES - 2, int(np.log2(max(0, m) + 1))) for m in metadata]
    more = BUCKETS + CLASSES * np.arange(len(classes)) + classes
    return np.concatenate([index, more]), np.concatenate([value, np.full(len(classes), 0.5)])


@dataclass
class Model:
    """Bias, weights and factors."""

    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def raw(self, index: np.ndarray, value: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Log odds of the vectors that begin at `starts` in the flat features (each has at least one)."""
        part = self.factors[index] * value[:, None]
        total = np.add.reduceat(part, starts)
        squares = np.add.reduceat((part * part).sum(axis=1), starts)
        return self.bias + np.add.reduceat(self.weights[index] * value, starts) + ((total * total).sum(axis=1) - squares) / 2

    def scores(self, rows: list[tuple[np.ndarray, np.ndarray]]) -> list[float]:
        if not rows:
            return []
        sizes = [len(i) for i, _ in rows]
        index, value = (np.concatenate(p) for p in zip(*rows))
        odds = self.raw(index, value, np.cumsum([0, *sizes[:-1]]))
        return (1 / (1 + np.exp(-np.clip(odds, -500, 500)))).tolist()

    def packed(self) -> bytes:
        return np.concatenate([[self.bias], self.weights, self.factors.ravel()]).astype(np.float32).tobytes()

    @classmethod
    def unpacked(cls, raw: bytes, rank: int = RANK) -> Model:
        flat = np.frombuffer(raw, np.float32).astype(np.float64)
        size = (len(flat) - 1) // (rank + 1)
        return cls(float(flat[0]), flat[1:1 + size], flat[1 + size:].reshape(size, rank))


def fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, size: int, rank: int = RANK) -> Model:
    """Adaptive gradient steps on the logistic loss."""
    share = (labels.sum() + 1) / (len(labels) + 2)
    model = Model(float(np.log(share / (1 - share))), np.zeros(size), np.zeros((size, rank)))
    if len(set(labels.tolist())) < 2:
        return model
    rng = np.random.default_rng(SEED)
    model.factors = rng.normal(0, 0.05, (size, rank))
    held_w, held_f, held_b = np.full(size, 1e-3), np.full((size, rank), 1e-3), 1e-3
    for _ in range(EPOCHS):
        order = rng.permutation(len(rows))
        for s in range(0, len(order), STEP):
            some = order[s:s + STEP]
            sizes = np.array([len(rows[i][0]) for i in some])
            index, value = np.concatenate([rows[i][0] for i in some]), np.concatenate([rows[i][1] for i in some])
            starts = np.cumsum(sizes) - sizes
            part = model.factors[index] * value[:, None]
            total = np.add.reduceat(part, starts)
            odds = model.raw(index, value, starts)
            error = (1 / (1 + np.exp(-np.clip(odds, -500, 500))) - labels[some]) / len(some)
            each = np.repeat(error, sizes) * value
            used, at = np.unique(index, return_inverse=True)
            g_w = np.bincount(at, each) + DECAY * model.weights[used]
            slope = each[:, None] * (np.repeat(total, sizes, axis=0) - part)
            g_f = np.stack([np.bincount(at, slope[:, d]) for d in range(rank)], axis=1) + DECAY * model.factors[used]
            held_w[used] += g_w * g_w
            held_f[used] += g_f * g_f
            held_b += error.sum() ** 2
            model.weights[used] -= RATE * g_w / np.sqrt(held_w[used])
            model.factors[used] -= RATE * g_f / np.sqrt(held_f[used])
            model.bias -= RATE * error.sum() / np.sqrt(held_b)
    return model


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def trained(docs: DataFrame, labels: DataFrame, label: str = "quality", doc_id: str = "doc_id", text: str = "text",
            metadata: tuple[str, ...] = ("n_chars",), sample: int = SAMPLE) -> bytes:
    """The packed model. Labels of held-out ids are not read; at most `sample` labelled rows, the first by hash, are."""
    known = labels.where(~held_out(doc_id) & F.col(doc_id).isNotNull() & F.col(label).isNotNull()).groupBy(
        F.col(doc_id).alias("id")).agg(F.min(label).cast("int").alias("label"))
    chosen = known.orderBy(F.xxhash64("id"), "id").limit(sample)  # a few bytes a row: small enough to send everywhere
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"), *(F.col(m).cast("long").alias(f"m{i}") for i, m in enumerate(metadata)))
    joined = rows.join(F.broadcast(chosen), "id")
    kinds = rows.schema["id"].dataType.simpleString()

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            meta = list(zip(*(batch.column(f"m{i}").to_pylist() for i in range(len(metadata))))) or [()] * batch.num_rows
            made = [features(t or "", list(m)) for t, m in zip(batch.column("text").to_pylist(), meta)]
            yield pa.RecordBatch.from_arrays([
                batch.column("id"), batch.column("label"), pa.array([i.astype(np.int32).tobytes() for i, _ in made], pa.binary()),
                pa.array([v.astype(np.float32).tobytes() for _, v in made], pa.binary())], ["id", "label", "at", "value"])

    size = BUCKETS + CLASSES * (STATISTICS + len(metadata))

    def learn(table: pa.Table) -> pa.Table:
        ordered = sorted(zip(*(table.column(c).to_pylist() for c in ("id", "label", "at", "value"))))
        model = fit([(np.frombuffer(a, np.int32).astype(np.int64), np.frombuffer(v, np.float32).astype(np.float64)) for _, _, a, v in ordered],
                    np.array([y for _, y, _, _ in ordered], np.float64), size)
        return pa.table({"model": pa.array([model.packed()], pa.binary())})

    made = joined.mapInArrow(vectors, f"id {kinds}, label int, at binary, value binary")
    # Of repeated documents one stays before the rows meet in a task: at most `sample`.
    once = made.groupBy("id").agg(F.min(F.struct("label", "at", "value")).alias("one")).select("id", "one.*")
    found = once.withColumn("all", F.lit(1)).groupBy("all").applyInArrow(learn, "model binary").collect()
    return bytes(found[0]["model"]) if found else fit([], np.zeros(0), size).packed()


def learnt(model: bytes) -> bool:
    """Whether the model comes from rows of both labels: otherwise its scores do not depend on the text."""
    return bool(Model.unpacked(model).factors.any())


def scored(docs: DataFrame, model: bytes, text: str = "text", metadata: tuple[str, ...] = ("n_chars",), accepted: float = ACCEPTED) -> DataFrame:
    """`docs` with score (0 to 1) and predicted (1 from `accepted` on)."""

    def work(rows: list) -> list[tuple]:
        learnt, out = Model.unpacked(model), []
        for s in range(0, len(rows), 64):
            found = learnt.scores([features(r["text"] or "", [r[f"m{i}"] for i in range(len(metadata))]) for r in rows[s:s + 64]])
            out += [(x, int(x >= accepted)) for x in found]
        return out

    given = F.struct(F.col(text).alias("text"), *(F.col(m).cast("long").alias(f"m{i}") for i, m in enumerate(metadata)))
    return with_results(docs, given, {"score": "double", "predicted": "int"}, work)
