"""Near-duplicate documents by SimHash and the generalised pigeonhole principle.

A document's fingerprint has a bit for each bit of the hashes of its word shingles: one if over half the hashes have it.
Two fingerprints link if they differ in few bits. To find the links, correlated bits are grouped into partitions; each
partition gets a threshold of its own (or is left out) such that the thresholds, each plus one, sum to the allowed
distance plus one. Whatever the split, linked fingerprints agree up to a partition's threshold in at least one
partition. Dynamic programming picks the thresholds, and the number of partitions, by the candidates and keys that a
bounded sample of fingerprints foretells; the sample steers the cost only, never the result. A threshold of t makes a key
for every choice of t bits of the partition that may differ. Fingerprints with equal keys are verified; a bucket yields
edges of a spanning forest of its links, not its pairs. Buckets above a fixed size are split in blocks that are
compared two by two.

Copies are one fingerprint before anything is compared. Null and empty texts have fingerprint zero and link like any
other. Shorter texts than a shingle are one shingle. Rows may repeat. Documents without an id are linked like others but
give no component its number; a component of such documents only has a null number. An empty table gives an empty one.
Other columns are not read. Components that do not settle within the rounds of `connected_components` raise.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from furrow.llm.common import row_total, with_results
from furrow.operators.graph import connected_components
from furrow.session import cut_lineage

BITS = 64
SHINGLE = 3
SEED = 42
DISTANCE = 3
#: Fingerprints whose statistics steer the plan.
SAMPLE = 4096
#: Fingerprints compared in one block.
BLOCK = 32_768
#: Partitions that are tried.
PARTITIONS = (2, 3, 4, 5, 6)
#: Labels (some 20 bytes) that are sent to every task, and join keys over which the rows of a hot fingerprint are spread.
SENT, SPREAD = 200_000, 64
#: Cost of a key that is shuffled, in comparisons.
KEY_COST = 100.0


def fingerprint(text: str) -> int:
    """SimHash of the lower-cased text's word shingles, unsigned."""
    tokens = text.encode().lower().split()
    if not tokens:
        return 0
    line = b" ".join(tokens)
    if len(tokens) <= SHINGLE:
        return xxhash.xxh64_intdigest(line, SEED)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    begins = [0, *(ends[:-SHINGLE] + 1).tolist()]
    ends = ends[SHINGLE - 1:].tolist()
    digest, count = xxhash.xxh64_intdigest, np.zeros(BITS, np.int64)
    for s in range(0, len(ends), 1 << 16):
        some = [digest(line[a:b], SEED) for a, b in zip(begins[s:s + (1 << 16)], ends[s:s + (1 << 16)])]
        bits = np.unpackbits(np.array(some, "<u8").view(np.uint8), bitorder="little").reshape(-1, BITS)
        count += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * count > len(ends), bitorder="little").view("<u8")[0])


def signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def fingerprints(docs: DataFrame, text: str = "text", out: str = "fp") -> DataFrame:
    """`docs` with the fingerprint as a signed long."""
    return with_results(docs, text, {out: "bigint"}, lambda values: [(signed(fingerprint(t or "")),) for t in values])


# --- plan -----------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Partition:
    bits: tuple[int, ...]
    threshold: int

    def masks(self) -> list[int]:
        """A mask of the partition's bits for each choice of `threshold` bits left out."""
        return [sum(1 << b for b in self.bits if b not in out) for out in itertools.combinations(self.bits, self.threshold)]


def bit_groups(bits: np.ndarray, parts: int) -> list[tuple[int, ...]]:
    """Equal groups of bits that go together in the sample (rows: fingerprints, columns: bits)."""
    centred = bits - bits.mean(axis=0)
    spread = np.sqrt((centred**2).sum(axis=0))
    spread[spread == 0] = np.inf
    near = np.abs(centred.T @ centred) / np.outer(spread, spread)
    np.fill_diagonal(near, 0)
    free, groups = set(range(BITS)), []
    for part in range(parts):
        size = BITS // parts + (part < BITS % parts)
        order = sorted(free)
        group = [max(order, key=lambda b: near[b, order].sum())]
        free.discard(group[0])
        while len(group) < size:
            group.append(max(sorted(free), key=lambda b: near[b, group].sum()))
            free.discard(group[-1])
        groups.append(tuple(sorted(group)))
    return groups


def agreement(bits: np.ndarray, group: tuple[int, ...], most: int) -> np.ndarray:
    """Estimated share of pairs that differ in at most 0..most bits of the group: what the sample shows plus what
    independent bits would give, so that no estimate is zero."""
    differ = 2 * bits.mean(axis=0)[list(group)] * (1 - bits.mean(axis=0)[list(group)])
    chance = np.zeros(most + 1)
    chance[0] = 1.0
    for p in differ:
        chance[1:] = chance[1:] * (1 - p) + chance[:-1] * p
        chance[0] *= 1 - p
    seen, n = np.zeros(most + 1), len(bits)
    words = (bits[:, list(group)].astype(np.uint64) << np.arange(len(group), dtype=np.uint64)).sum(axis=1)
    for s in range(0, n, 256):
        apart = np.bitwise_count(words[s:s + 256, None] ^ words[None, :])
        seen += [(apart == t).sum() for t in range(most + 1)]
    seen[0] -= n
    return np.cumsum(chance) + np.cumsum(seen) / max(1, n * (n - 1))


def thresholds(costs: list[np.ndarray], total: int) -> tuple[float, list[int]]:
    """Cheapest thresholds (-1: left out) whose sum, each plus one, is `total`. costs[i][t + 1]: of partition i with t."""
    best: list[tuple[float, list[int]] | None] = [(0.0, [])] + [None] * total
    for cost in costs:
        following: list[tuple[float, list[int]] | None] = [None] * (total + 1)
        for used, held in enumerate(best):
            for more in range(total - used + 1) if held else ():
                sum_ = held[0] + float(cost[more])
                if following[used + more] is None or sum_ < following[used + more][0]:
                    following[used + more] = (sum_, [*held[1], more - 1])
        best = following
    return best[total]


def plan(sample: list[int], rows: int, distance: int = DISTANCE) -> list[Partition]:
    """Partitions of the bits with their thresholds, for `rows` different fingerprints like those of the sample."""
    rows = max(rows, 1)  # of nothing, every plan would cost the same
    raw = np.array([s & (1 << 64) - 1 for s in sample] or [0], "<u8")
    bits = np.unpackbits(raw.view(np.uint8), bitorder="little").reshape(-1, BITS).astype(np.float64)
    choices = []
    for parts in PARTITIONS:
        groups = bit_groups(bits, parts)
        costs = [np.array([0.0, *(KEY_COST * rows * comb(len(g), t) + rows * rows / 2 * share
                                  for t, share in enumerate(agreement(bits, g, distance)))]) for g in groups]
        cost, chosen = thresholds(costs, distance + 1)
        choices.append((cost, [Partition(g, t) for g, t in zip(groups, chosen) if t >= 0]))
    return min(choices, key=lambda c: c[0])[1]


# --- probe and verify -----------------------------------------------------------------------------------------------


def forest(values: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Edges that connect what links within `distance` connect: each value is compared with those not reached yet."""
    edges, rest = [], np.unique(values)
    while len(rest) > 1:
        reached, rest = [rest[0]], rest[1:]
        while reached and len(rest):
            at = reached.pop()
            near = np.bitwise_count(rest ^ at) <= distance
            if near.any():
                found = rest[near]
                edges += [(int(at), int(x)) for x in found]
                reached += list(found)
                rest = rest[~near]
    return edges


def _verified(packs: DataFrame, distance: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for values in batch.column(0):
                edges = forest(values.values.to_numpy().view(np.uint64), distance)
                if edges:
                    a, b = np.array(edges, np.uint64).view(np.int64).T
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["id_a", "id_b"])

    return packs.mapInArrow(run, "id_a long, id_b long")


def links(values: DataFrame, fp: str = "fp", distance: int = DISTANCE, block: int = BLOCK) -> DataFrame:
    """(id_a, id_b): links between different fingerprints, as many as connect what all links connect."""
    sample = [r[0] for r in values.select(fp).orderBy(F.xxhash64(fp), fp).limit(SAMPLE).collect()]
    masks = [m for p in plan(sample, row_total(values), distance) for m in p.masks()]
    tagged = values.select(F.col(fp).alias("fp"), F.posexplode(F.array(*(F.lit(signed(m)) for m in masks))).alias("tag", "mask"))
    keys = tagged.select("fp", "tag", F.col("fp").bitwiseAND(F.col("mask")).alias("key"))
    size = keys.groupBy("tag", "key").agg(F.count(F.lit(1)).alias("size"))
    large = size.where(F.col("size") > block).select("tag", "key", F.ceil(F.col("size") / block).cast("int").alias("blocks"))
    spread = keys.join(large, ["tag", "key"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    packs = spread.groupBy("tag", "key", "blocks", F.pmod(F.xxhash64("fp"), F.col("blocks")).alias("block")).agg(
        F.collect_list("fp").alias("fps"))
    small = packs.where("blocks = 1 AND size(fps) > 1").select("fps")
    parts = packs.where("blocks > 1")
    other = parts.select("tag", "key", F.col("block").alias("other"), F.col("fps").alias("more"))
    two = parts.join(other, ["tag", "key"]).where("block < other").select(F.concat("fps", "more").alias("fps"))
    return _verified(small.unionByName(two), distance)


def components(rows: DataFrame, doc_id: str = "doc_id", fp: str = "fp", distance: int = DISTANCE, sent: int = SENT) -> DataFrame:
    """Rows (id, fingerprint; narrow, they are read twice) with component_id: the smallest id that links lead to.

    A fingerprint that one row has and nothing links to stands for itself. The labels of the others are counted: few are
    sent to every task; more are joined by fingerprint, the rows of hot ones being spread over several join keys.
    """
    values = cut_lineage(rows.groupBy(fp).agg(F.min(doc_id).alias("least"), F.count(F.lit(1)).alias("n")))
    found = cut_lineage(links(values, fp, distance))
    nodes = found.select(F.col("id_a").alias("id")).union(found.select(F.col("id_b").alias("id")))
    label = connected_components(found, nodes).withColumnRenamed("id", fp)
    linked = values.join(label, fp)
    number = linked.groupBy("component").agg(F.min("least").alias("component_id"))
    shared = linked.join(number, "component").select(fp, "component_id", "n").unionByName(
        values.where("n > 1").join(label, fp, "left_anti").select(fp, F.col("least").alias("component_id"), "n"))
    shared = cut_lineage(shared.withColumn("told", F.lit(True)))
    total = row_total(shared)
    if total <= sent:
        joined = rows.join(F.broadcast(shared.drop("n")), fp, "left")
    else:
        large = shared.agg(F.sum("n")).first()[0] // SPREAD  # so at most SPREAD fingerprints are hot
        hot = F.broadcast(shared.where(F.col("n") > large).select(fp, F.lit(True).alias("hot")))
        salt = F.when(F.col("hot"), F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(SPREAD))).otherwise(0).cast("int")
        copies = F.explode(F.when(F.col("n") > large, F.sequence(F.lit(0), F.lit(SPREAD - 1))).otherwise(F.array(F.lit(0)))).alias("salt")
        joined = rows.join(hot, fp, "left").withColumn("salt", salt).join(shared.select(fp, "component_id", "told", copies), [fp, "salt"], "left")
    component = F.when(F.col("told"), F.col("component_id")).otherwise(F.col(doc_id))
    return joined.select(*rows.columns, component.alias("component_id"))


def judged(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", distance: int = DISTANCE, sent: int = SENT) -> DataFrame:
    """(doc_id, fp, component_id) of every row."""
    rows = cut_lineage(fingerprints(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))).drop("text"))
    return components(rows, distance=distance, sent=sent)
