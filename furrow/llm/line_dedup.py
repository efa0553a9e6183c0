"""Line deduplication with a sharded minimal perfect hash.

A line's key (stripped and lower-cased) is hashed to 128 bits. The first half picks its shard and its place in the
shard's minimal perfect hash, which is built over the distinct hashes of the lines that repeat; the place indexes
compact arrays of fingerprints (the second half), counts and first holders. Documents send the hashes of their lines,
packed in bulk for each shard, to the arrays; a line is dropped if its fingerprint is there and a smaller document holds
it. Lines that are found once have no slot: the fingerprint rejects them. Neither lines nor texts are joined with lines.

Counts are summed within every batch before anything is shuffled, so a line that a third of all documents share is a
row per batch in its shard. Probes lie behind the arrays of their shard in one sorted partition: the arrays are read once
and all probes stream by. A shard with many probes is split, each part with the arrays of its own.

Null and empty texts are one empty line. Texts are taken whole. Rows of one id are one document: none of its lines makes
another of them go. Ids are whole numbers; texts that are none raise. Documents without an id count as one that comes last; what they lose is listed by text. An empty
table gives an empty one. Columns of the input are carried; one with the name of a result column is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from furrow.llm.common import row_total, unused, with_results
from furrow.session import cut_lineage

#: Code points of a key from which on it counts.
LEAST = 10
#: Text bytes of a shard: this fixes how much of the index a task holds.
SHARD_BYTES = 16 << 20
#: Probes (24 bytes each) of a shard that meet one copy of its arrays.
SPLIT = 1 << 17
#: Split shards whose numbers (some ten bytes each) are sent to every task; more are joined by shuffle.
SENT_SHARDS = 200_000
#: Bits of the perfect hash's first level for each key.
GAMMA = 2.0
LAST_ID = np.iinfo(np.int64).max
FOUND = np.dtype([("h", "<u8"), ("fp", "<u8"), ("n", "<u4"), ("owner", "<i8")])
PROBE = np.dtype([("h", "<u8"), ("fp", "<u8"), ("doc", "<i8")])
DROP = np.dtype([("h", "<u8"), ("fp", "<u8")])

# --- lines ----------------------------------------------------------------------------------------------------------


def keys_of(text: str) -> list[bytes]:
    """The key of each line; keys that are too short are empty."""
    raw = [x.strip() for x in text.encode().lower().split(b"\n")]
    return [x if len(x) >= 4 * LEAST or len(x) >= LEAST and len(x.decode()) >= LEAST else b"" for x in raw]


def hashes(keys: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, keys)), DROP)


# --- minimal perfect hash -------------------------------------------------------------------------------------------


def mixed(keys: np.ndarray, level: int) -> np.ndarray:
    """A different hash of the keys for every level."""
    with np.errstate(over="ignore"):
        x = keys + np.uint64((level + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
        x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
        return x ^ x >> np.uint64(31)


class PerfectHash:
    """Levels of bit arrays: a key settles on the first level where it is alone on its bit; its number is the bit's rank."""

    def __init__(self, sizes: np.ndarray, bits: np.ndarray):
        self.sizes, self.bits = sizes, bits
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(bits), dtype=np.int64)])

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        sizes, parts = [], []
        while len(keys):
            size = -(-int(GAMMA * len(keys) + 1) // 64) * 64
            at = (mixed(keys, len(sizes)) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            sizes.append(size)
            parts.append(np.packbits(alone, bitorder="little").view("<u8"))
            keys = keys[~alone[at]]
        return cls(np.array(sizes, np.int64), np.concatenate([np.empty(0, "<u8"), *parts]))

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Number of each key; -1, or that of another key, where the key is not in the set."""
        out, todo, base = np.full(len(keys), -1, np.int64), np.arange(len(keys)), 0
        for level, size in enumerate(self.sizes.tolist()):
            at = (mixed(keys[todo], level) % np.uint64(size)).astype(np.int64) + base
            word, bit = self.bits[at >> 6], (at & 63).astype(np.uint64)
            hit = (word >> bit & np.uint64(1)).astype(bool)
            below = np.bitwise_count(word[hit] & ((np.uint64(1) << bit[hit]) - np.uint64(1)))
            out[todo[hit]] = self.before[at[hit] >> 6] + below
            todo, base = todo[~hit], base + size
            if not len(todo):
                break
        return out


# --- jobs -----------------------------------------------------------------------------------------------------------


def _packed(shard: np.ndarray, last: np.ndarray, entries: np.ndarray) -> pa.RecordBatch:
    """Entries as one binary value for each shard, those of documents without an id (`last`) apart."""
    code = shard.astype(np.int64) * 2 + last
    order = np.argsort(code, kind="stable")
    code, entries = code[order], entries[order]
    edges = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1], [True]])) if len(code) else np.zeros(1, np.int64)
    parts = [entries[a:b].tobytes() for a, b in zip(edges, edges[1:])]
    first = code[edges[:-1]]
    return pa.RecordBatch.from_arrays([pa.array(first >> 1, pa.int32()), pa.array((first & 1).astype(bool)), pa.array(parts, pa.binary())],
                                      ["shard", "last", "entries"])


def summed(entries: np.ndarray) -> np.ndarray:
    """One entry for each key: counts added, the smallest holder."""
    if not len(entries):
        return entries
    entries = entries[np.lexsort((entries["fp"], entries["h"]))]
    new = np.concatenate([[True], (entries["h"][1:] != entries["h"][:-1]) | (entries["fp"][1:] != entries["fp"][:-1])])
    first = np.flatnonzero(new)
    out = entries[first].copy()
    out["n"], out["owner"] = np.add.reduceat(entries["n"], first), np.minimum.reduceat(entries["owner"], first)
    return out


def _rows(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(id, last, text): documents without an id (`last`) are named by their text."""
    number = F.col(doc_id).cast("long")
    return docs.select(F.coalesce(number, F.xxhash64(text)).alias("id"), number.isNull().alias("last"), F.col(text).alias("text"))


def _line_hashes(rows: DataFrame, shards: int, probes: bool) -> DataFrame:
    """(shard, last, entries) of rows as in `_rows`, packed by batch: counted keys, or the keys of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, last = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            sizes, keys = [], []
            for text in batch.column(2).to_pylist():
                own = set(keys_of(text or ""))
                own.discard(b"")
                sizes.append(len(own))
                keys += own
            found = hashes(keys)
            entries = np.empty(len(found), PROBE if probes else FOUND)
            entries["h"], entries["fp"] = found["h"], found["fp"]
            if probes:
                entries["doc"], apart = np.repeat(ids, sizes), np.repeat(last, sizes)
            else:
                entries["n"], entries["owner"] = 1, np.repeat(np.where(last, LAST_ID, ids), sizes)
                entries = summed(entries)
                apart = np.zeros(len(entries), bool)
            yield _packed((entries["h"] % np.uint64(shards)).astype(np.int32), apart, entries)

    return rows.mapInArrow(run, "shard int, last boolean, entries binary")


INDEX = "shard int, probes long, sizes binary, bits binary, fingerprints binary, counts binary, owners binary, others binary"


def _index(table: pa.Table) -> pa.Table:
    """Arrays of one shard. Keys that share the first half with another one (`others`) are kept aside."""
    entries = np.frombuffer(b"".join(table.column("entries").to_pylist()), FOUND)
    entries = summed(entries)
    probes = int(entries["n"].sum(dtype=np.int64))
    entries = entries[entries["n"] >= 2]
    again = np.concatenate([[False], entries["h"][1:] == entries["h"][:-1]])[:len(entries)]
    others, entries = entries[again], entries[~again]
    hashed = PerfectHash.build(entries["h"])
    ordered = np.empty_like(entries)
    ordered[hashed.find(entries["h"])] = entries
    parts = [hashed.sizes, hashed.bits, ordered["fp"], ordered["n"], ordered["owner"], others]
    return pa.table({"shard": table.column("shard")[:1], "probes": pa.array([probes], pa.int64()), **{n: pa.array([np.ascontiguousarray(p).tobytes()], pa.binary()) for n, p in zip(
        ("sizes", "bits", "fingerprints", "counts", "owners", "others"), parts)}})


class Shard:
    """The arrays of one shard, as probed."""

    def __init__(self, row: dict):
        self.hash = PerfectHash(np.frombuffer(row["sizes"], np.int64), np.frombuffer(row["bits"], "<u8"))
        self.fingerprints, self.counts = np.frombuffer(row["fingerprints"], "<u8"), np.frombuffer(row["counts"], "<u4")
        self.owners, self.others = np.frombuffer(row["owners"], "<i8"), np.frombuffer(row["others"], FOUND)

    def repeats(self, probes: np.ndarray, last: bool = False) -> np.ndarray:
        """Whether another, smaller document holds the probe's line."""
        doc = np.full(len(probes), LAST_ID) if last else probes["doc"]
        at = self.hash.find(probes["h"])
        found = np.zeros(len(probes), bool)
        some = np.flatnonzero(at >= 0)
        slot = at[some]
        found[some] = (self.fingerprints[slot] == probes["fp"][some]) & (self.counts[slot] >= 2) & (self.owners[slot] < doc[some])
        for other in self.others:
            found |= (probes["h"] == other["h"]) & (probes["fp"] == other["fp"]) & (other["owner"] < doc)
        return found


def shard_index(docs: DataFrame, shards: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each shard with its number of probes, its perfect hash and its arrays."""
    return _line_hashes(_rows(docs, doc_id, text), shards, False).select("shard", "entries").groupBy("shard").applyInArrow(_index, INDEX)


def repeated_lines(docs: DataFrame, index: DataFrame, shards: int, doc_id: str = "doc_id", text: str = "text", split: int = SPLIT) -> DataFrame:
    """(doc, last, drops): hashes of the lines that a document loses, in one or more rows for each document."""
    parts = (1 + F.floor(F.col("probes") / split)).cast("long")
    many = index.where(F.col("probes") >= split).select("shard", parts.alias("parts"))
    if row_total(many) <= SENT_SHARDS:
        many = F.broadcast(many)
    probes = _line_hashes(_rows(docs, doc_id, text), shards, True).join(many, "shard", "left").withColumn(
        "part", F.pmod(F.xxhash64("entries"), F.coalesce("parts", F.lit(1).cast("long")))).drop("parts")
    arrays = index.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1))).drop("probes")
    # An index row comes before the probes that it answers.
    both = probes.unionByName(arrays, allowMissingColumns=True).withColumn("probing", F.col("entries").isNotNull())
    met = both.repartition("shard", "part").sortWithinPartitions("shard", "part", "probing")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrays = None
        for batch in batches:
            probing, last = batch.column("probing").to_pylist(), batch.column("last").to_pylist()
            for at in range(batch.num_rows):
                if not probing[at]:
                    arrays = Shard({c: batch.column(c)[at].as_py() for c in ("sizes", "bits", "fingerprints", "counts", "owners", "others")})
                    continue
                found = np.frombuffer(batch.column("entries")[at].as_py(), PROBE)
                found = found[arrays.repeats(found, last[at])]
                found = found[np.argsort(found["doc"], kind="stable")]
                doc = found["doc"]
                edges = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1], [True]])) if len(doc) else np.zeros(1, np.int64)
                drops = np.empty(len(found), DROP)
                drops["h"], drops["fp"] = found["h"], found["fp"]
                yield pa.RecordBatch.from_arrays([
                    pa.array(doc[edges[:-1]], pa.int64()), pa.array([last[at]] * (len(edges) - 1), pa.bool_()),
                    pa.array([drops[a:b].tobytes() for a, b in zip(edges, edges[1:])], pa.binary())], ["doc", "last", "drops"])

    return met.mapInArrow(run, "doc long, last boolean, drops binary")


def kept_lines(text: str, drops: list[bytes] | None) -> tuple[str, int, int]:
    """Text without the lines whose hashes are listed; lines before; lines dropped."""
    lines = text.split("\n")
    if not drops:
        return text, len(lines), 0
    gone = {part[i:i + DROP.itemsize] for part in drops for i in range(0, len(part), DROP.itemsize)}
    keys = keys_of(text)
    digest = xxhash.xxh3_128_digest
    kept = [line for line, key in zip(lines, keys) if not key or digest(key) not in gone]
    return "\n".join(kept), len(lines), len(lines) - len(kept)


def drop_lists(found: DataFrame) -> DataFrame:
    """(doc, last, drops): each hash once, so that rows which repeat an id do not lengthen the list that all of them get."""
    each = F.expr(f"transform(sequence(0, length(drops) div {DROP.itemsize} - 1), i -> substring(drops, i * {DROP.itemsize} + 1, {DROP.itemsize}))")
    once = found.select("doc", "last", F.explode(each).alias("drop")).distinct()
    return once.groupBy("doc", "last").agg(F.collect_list("drop").alias("drops"))


def deduplicated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", split: int = SPLIT) -> DataFrame:
    """`docs` with kept_text, n_lines (before) and n_dropped."""
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    shards = 1 + size // SHARD_BYTES
    index = cut_lineage(shard_index(docs, shards, doc_id, text))
    lists = drop_lists(repeated_lines(docs, index, shards, doc_id, text, split))
    doc, none, drops = (unused(docs, n) for n in ("drops_doc", "drops_last", "drops_list"))
    lists = lists.select(F.col("doc").alias(doc), F.col("last").alias(none), F.col("drops").alias(drops))
    number = F.col(doc_id).cast("long")
    same = (F.coalesce(number, F.xxhash64(text)) == F.col(doc)) & (number.isNull() == F.col(none))
    joined = docs.join(lists, same, "left").drop(doc, none)
    return with_results(joined, F.struct(F.col(text).alias("text"), F.col(drops).alias("drops")),
                        {"kept_text": "string", "n_lines": "bigint", "n_dropped": "bigint"},
                        lambda rows: [kept_lines(r["text"] or "", r["drops"]) for r in rows]).drop(drops)
