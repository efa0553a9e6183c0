"""Approximate nearest neighbours: a forest of random-projection trees with exact reranking.

The trees are fitted on a bounded sample: each inner node splits by the bisector of two of its points. Every vector is
then routed through every tree, so all rows are indexed. A query walks all trees with one priority queue, which always
opens the node whose worst margin on the way is best, until the leaves reached hold enough of the sample. Query
and candidates meet by leaf, in blocks of bounded size, and are ranked by the exact inner product in double precision,
added up component by component. A candidate below the query's k-th best score among the sample cannot be in the result,
so it does not leave its meeting; those of the sample are candidates without one.

Equal vectors are one: they are compared once, and keep as many of their smallest ids as any result can show. Vectors
that are null, zero, or hold null or non-finite components take no part. Rows without an id take no part. Vectors of
other lengths than most raise. Repeated rows are rows, and so are rows that share an id: each asking row has its own
result, and its candidates are all rows but itself. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from furrow.llm.common import matrix
from furrow.session import cut_lineage

#: Neighbours, trees, sample that the trees are fitted on and sample points of a leaf.
NEAREST = 20
TREES = 12
SAMPLE = 8192
LEAF = 24
#: Leaves opened for each query, over all trees.
OPENED = 320
#: Vectors and queries that are compared in one step.
BLOCK = 2048
SEED = 7


class Forest:
    """Flat arrays of all trees: normal, offset and children of each inner node; negative children are leaves."""

    def __init__(self, sample: np.ndarray, trees: int, leaf: int, seed: int = SEED):
        rng = np.random.default_rng(seed)
        normals, offsets, children, self.roots = [], [], [], []
        self.leaves = 0

        def grow(points: np.ndarray) -> int:
            if len(points) <= leaf:
                self.leaves += 1
                return -self.leaves
            for _ in range(8):
                a, b = points[rng.choice(len(points), 2, replace=False)]
                normal = a - b
                size = np.sqrt(normal @ normal)
                if size == 0:
                    continue
                normal = normal / size
                at = points @ normal
                cut = float(normal @ (a + b) / 2)
                share = float((at > cut).mean())
                if 0.05 < share < 0.95:
                    break
            else:  # no fair split found: halve along a random direction
                normal = rng.standard_normal(points.shape[1])
                normal /= np.sqrt(normal @ normal)
                at = points @ normal
                cut = float(np.median(at))
            right = at > cut
            if right.all() or not right.any():
                self.leaves += 1
                return -self.leaves
            node = len(normals)
            normals.append(normal)
            offsets.append(cut)
            children.append([0, 0])
            children[node] = [grow(points[~right]), grow(points[right])]
            return node

        for _ in range(trees):
            self.roots.append(grow(sample))
        width = sample.shape[1]
        self.normals = np.array(normals).reshape(-1, width)
        self.offsets, self.children = np.array(offsets), np.array(children, np.int64).reshape(-1, 2)

    def route(self, vectors: np.ndarray) -> np.ndarray:
        """Leaf of each vector in each tree, numbered from 0 over all trees."""
        out = np.empty((len(vectors), len(self.roots)), np.int64)
        for tree, root in enumerate(self.roots):
            at = np.full(len(vectors), root)
            while (live := np.flatnonzero(at >= 0)).size:
                node = at[live]
                right = (vectors[live] * self.normals[node]).sum(axis=1) > self.offsets[node]
                at[live] = self.children[node, right.astype(np.int64)]
            out[:, tree] = -at - 1
        return out

    def search(self, query: np.ndarray, opened: int) -> list[int]:
        """The leaves that the shared queue opens first."""
        margin = (self.normals @ query - self.offsets).tolist()
        children, found = self.children, []
        queue = [(-np.inf, root) for root in self.roots]
        heapq.heapify(queue)
        while queue and len(found) < opened:
            worst, node = heapq.heappop(queue)
            if node < 0:
                found.append(-node - 1)
                continue
            m = margin[node]
            left, right = children[node]
            heapq.heappush(queue, (max(worst, m), int(left)))
            heapq.heappush(queue, (max(worst, -m), int(right)))
        return found


def usable(vector: Column) -> Column:
    """True for vectors that take part."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def distinct_vectors(rows: DataFrame, keep: int) -> DataFrame:
    """(key, vector, ids): each vector once, with its `keep` smallest ids. The keys hold once the rows are stored."""
    order = Window.partitionBy("vector").orderBy("id")
    first = rows.withColumn("n", F.row_number().over(order)).where(F.col("n") <= keep)
    made = first.groupBy("vector").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    return made.withColumn("key", F.monotonically_increasing_id())


def products(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Inner products, added up in the order of the components."""
    out = np.zeros((len(queries), len(vectors)))
    for d in range(queries.shape[1]):
        out += queries[:, d, None] * vectors[None, :, d]
    return out


def _leaf_rows(vectors: DataFrame, forest: Forest, opened: int | None, sample: np.ndarray, keep: int) -> DataFrame:
    """(leaf, key, vector, least): a row for each tree, or for each leaf that a query opens; `least` is a score that the first
    `keep` of a query do not fall short of."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = matrix(batch.column(1))
            for s in range(0, len(found), 256):
                some = found[s:s + 256]
                least = np.full(len(some), -np.inf)
                if opened is None:
                    leaves = list(forest.route(some))
                else:
                    leaves = [np.array(forest.search(v, opened), np.int64) for v in some]
                    if len(sample) >= keep:
                        least = -np.partition(-products(some, sample), keep - 1, axis=1)[:, keep - 1]
                each = np.repeat(np.arange(len(some)), [len(x) for x in leaves])
                at = pa.array(each + s)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(leaves), pa.int64()), batch.column(0).take(at), batch.column(1).take(at),
                                                  pa.array(least[each])], ["leaf", "key", "vector", "least"])

    kind = vectors.schema["vector"].dataType.simpleString()
    return vectors.select("key", "vector").mapInArrow(run, f"leaf long, key long, vector {kind}, least double")


def _shown(queries: DataFrame, sample: np.ndarray, keys: np.ndarray, keep: int) -> DataFrame:
    """(query, key, score): the best of each query among the sample."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = matrix(batch.column(1))
            for s in range(0, len(found), 256):
                score = products(found[s:s + 256], sample)
                best = np.argpartition(-score, min(keep, len(sample)) - 1, axis=1)[:, :keep]
                asked = np.repeat(batch.column(0).to_numpy()[s:s + 256], best.shape[1])
                yield pa.RecordBatch.from_arrays([pa.array(asked), pa.array(keys[best].ravel()), pa.array(np.take_along_axis(score, best, 1).ravel())],
                                                 ["query", "key", "score"])

    return queries.select("key", "vector").mapInArrow(run, "query long, key long, score double")


def _blocks(rows: DataFrame) -> DataFrame:
    """(leaf, members): the rows of a leaf in packs of about BLOCK."""
    size = rows.groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    cut = rows.join(size, "leaf").withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")))
    return cut.groupBy("leaf", "block").agg(F.collect_list(F.struct("key", "vector", "least")).alias("members"))


def _best(pairs: DataFrame, keep: int) -> DataFrame:
    """(query, key, score): the best of each query in each pair of packs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                (q, qv), (k, kv) = (((m := batch.column(c)[at].values).field("key").to_numpy(), matrix(m.field("vector"))) for c in ("asked", "members"))
                score = products(qv, kv)
                edge = batch.column("asked")[at].values.field("least").to_numpy()
                if score.shape[1] > keep:
                    edge = np.maximum(edge, -np.partition(-score, keep - 1, axis=1)[:, keep - 1])
                r, c = np.nonzero(score >= edge[:, None])
                yield pa.RecordBatch.from_arrays([pa.array(q[r]), pa.array(k[c]), pa.array(score[r, c])], ["query", "key", "score"])

    return pairs.select("asked", "members").mapInArrow(run, "query long, key long, score double")


def nearest(rows: DataFrame, is_query: Column, vec_id: str = "vec_id", vector: str = "embedding", nearest: int = NEAREST, trees: int = TREES,
            sample: int = SAMPLE, leaf: int = LEAF, opened: int = OPENED) -> DataFrame:
    """(query_id, rank, vec_id, score): the best found for every row for which `is_query` (of column `id`) is true."""
    valid = rows.select(F.col(vec_id).cast("long").alias("id"), F.col(vector).alias("vector")).where(F.col("id").isNotNull() & usable(F.col("vector")))
    keep = nearest + 1  # an asking row may be among its own first
    vectors = cut_lineage(distinct_vectors(valid, keep))
    points = vectors.orderBy(F.xxhash64("vector"), "key").limit(sample).select("vector", "key").collect()
    schema = "query_id long, rank int, vec_id long, score double"
    if not points:
        return rows.sparkSession.createDataFrame([], schema)
    shown, keys = np.array([r[0] for r in points], np.float64), np.array([r[1] for r in points], np.int64)
    forest = Forest(shown, trees, leaf)
    asking = cut_lineage(valid.where(is_query).withColumn("row", F.monotonically_increasing_id()))
    asked = asking.join(vectors.select("vector", "key"), "vector").select("row", "id", "key")
    query_vectors = vectors.join(asked.select("key").distinct(), "key", "left_semi")
    index = _blocks(_leaf_rows(vectors, forest, None, shown, keep))
    probes = _blocks(_leaf_rows(query_vectors, forest, opened, shown, keep)).select("leaf", F.col("members").alias("asked"))
    met = _best(probes.join(index, "leaf"), keep).unionByName(_shown(query_vectors, shown, keys, keep)).groupBy("query", "key").agg(F.max("score").alias("score"))
    by_score = Window.partitionBy("query").orderBy(F.desc("score"), F.col("ids")[0], "key")
    top = met.join(vectors.select("key", "ids"), "key").withColumn("n", F.row_number().over(by_score)).where(F.col("n") <= keep)
    listed = top.select("query", "key", "score", F.explode("ids").alias("vec_id"))
    # The first rows of each vector that asks, with the asking ones; rows of one id and vector are told apart by number.
    best = listed.withColumn("n", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id", "key"))).where(
        F.col("n") <= keep).withColumn("copy", F.row_number().over(Window.partitionBy("query", "key", "vec_id").orderBy("n")))
    each = asked.join(best.select(F.col("query").alias("key"), F.col("key").alias("near"), "vec_id", "score", "copy"), "key")
    itself = (F.col("near") == F.col("key")) & (F.col("vec_id") == F.col("id")) & (F.col("copy") == 1)
    rank = F.row_number().over(Window.partitionBy("row").orderBy(F.desc("score"), "vec_id"))
    return each.where(~itself).withColumn("rank", rank).where(F.col("rank") <= nearest).select(
        F.col("id").alias("query_id"), "rank", "vec_id", "score")
