"""Documents whose sets of five-word shingles are similar: SimHash and MinHash candidates, verified on whole sets.

Two texts link if the Jaccard similarity of their shingle sets (lower-cased words, 64-bit hashes) is 0.8 or more. Texts
of equal words are one content before anything is compared. Contents are candidates in two ways. SimHash fingerprints of
their sets are probed and verified as in `near_copies`, at `DISTANCE` bits; what these links connect is one key. As pairs at
0.8 differ in ten of 64 bits on average, and a distance that holds them all makes every plan compare a share of all pairs, a content
also has `BANDS` keys of `ROWS` minimal hashes each: a pair at 0.8 has none of these in common with a probability of
(1 - 0.8^4)^24, about three in a million, and a more similar one with less: this is the only approximation. Candidates are
compared by their whole sets; a cheap look at the minimal hashes first leaves out pairs that fall short by more than six
deviations.

Keys travel without texts; only contents that share a key send their sets. A bucket yields edges of a spanning forest of
its links, not its pairs. Buckets with more than `BLOCK` shingles are split in blocks that are compared two by two.

Null and empty texts are one content. Shorter texts than a shingle are one shingle. Rows may repeat, and ids may be null or
repeat: components are of texts, and each keeps one row. Other columns stay, whatever their names. An empty table gives an
empty one. Components that do not settle within the rounds of `connected_components` raise.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from furrow.llm import near_copies
from furrow.llm.common import row_total, unused, with_results
from furrow.operators.graph import connected_components
from furrow.session import cut_lineage

SHINGLE = 5
#: Similarity from which on two texts link, as a fraction.
SIMILAR = (4, 5)
BANDS, ROWS = 24, 4
#: Equal minimal hashes (of BANDS * ROWS, by their last byte) that a pair at 0.8 falls short of about once in 10^9.
LEAST_EQUAL = 52
SEED = 42
#: Bits in which fingerprints differ that are probed.
DISTANCE = 6
#: Shingles (8 bytes each) of a bucket that are compared in one block.
BLOCK = 1 << 20
#: Contents or rows (16 bytes each) that are sent to every task; more are joined by shuffle.
SENT = 200_000


@lru_cache(1)
def permutations() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED)
    return tuple(rng.integers(0, 1 << 64, BANDS * ROWS, dtype=np.uint64) | np.uint64(1) for _ in range(2))


def words(text: str) -> bytes:
    """The text as far as it counts: lower-cased words with a space between."""
    return b" ".join(text.encode().lower().split())


def shingles(line: bytes) -> np.ndarray:
    """Sorted different hashes of the shingles of `words`."""
    tokens = line.split()
    if not tokens:
        return np.empty(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    if len(tokens) <= SHINGLE:
        return np.array([digest(line, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    begins = [0, *(ends[:-SHINGLE] + 1).tolist()]
    return np.unique(np.array([digest(line[a:b], SEED) for a, b in zip(begins, ends[SHINGLE - 1:].tolist())], np.uint64))


def least_hashes(found: np.ndarray) -> np.ndarray:
    """The least hash of the (not empty) set under each permutation."""
    by, plus = permutations()
    out = np.full(len(by), np.iinfo(np.uint64).max)
    with np.errstate(over="ignore"):
        for s in range(0, len(found), 1024):
            np.minimum(out, (np.multiply.outer(by, found[s:s + 1024]) + plus[:, None]).min(axis=1), out=out)
    return out


def fingerprint(found: np.ndarray) -> int:
    """SimHash of a (not empty) set, signed: a bit is one if over half the hashes have it."""
    count = sum(np.unpackbits(found[s:s + (1 << 16)].astype("<u8").view(np.uint8), bitorder="little").reshape(-1, 64).sum(axis=0, dtype=np.int64)
                for s in range(0, len(found), 1 << 16))
    return int(np.packbits(2 * count > len(found), bitorder="little").view("<i8")[0])


def _sketch(values: list) -> list[tuple]:
    out = []
    for text in values:
        line = words(text or "")
        found = shingles(line)
        keys, fp = [], None
        if len(found):
            fp = fingerprint(found)
            least = least_hashes(found)
            keys = [xxhash.xxh64_intdigest(least[i * ROWS:(i + 1) * ROWS].tobytes(), i) for i in range(BANDS)]
        out.append((xxhash.xxh3_128_digest(line), len(found), np.array(keys, np.uint64).tobytes(), fp))
    return out


def _contents(values: list) -> list[tuple]:
    return [(xxhash.xxh3_128_digest(words(t or "")),) for t in values]


def _sets(values: list) -> list[tuple]:
    out = []
    for text in values:
        found = shingles(words(text or ""))
        out.append((found.tobytes(), (least_hashes(found) & np.uint64(255)).astype(np.uint8).tobytes()))
    return out


def similar(sets: list[np.ndarray], marks: np.ndarray) -> list[tuple[int, int]]:
    """Edges that connect what the links between the sets connect: each set is compared with those not reached yet.

    `marks`: minimal hashes, a row for each set.
    """
    part, whole = SIMILAR
    sizes = np.array([len(s) for s in sets], np.int64)
    edges, rest = [], np.arange(len(sets))
    while len(rest) > 1:
        reached, rest = [int(rest[0])], rest[1:]
        while reached and len(rest):
            at = reached.pop()
            likely = (whole * np.minimum(sizes[rest], sizes[at]) >= part * np.maximum(sizes[rest], sizes[at]))
            likely &= np.count_nonzero(marks[rest] == marks[at], axis=1) >= LEAST_EQUAL
            near = rest[likely]
            if not len(near):
                continue
            flat, own = np.concatenate([sets[i] for i in near.tolist()]), sets[at]
            hit = own[np.minimum(np.searchsorted(own, flat), len(own) - 1)] == flat
            common = np.add.reduceat(hit.astype(np.int64), np.cumsum(sizes[near]) - sizes[near])
            found = near[(part + whole) * common >= part * (sizes[at] + sizes[near])]
            edges += [(at, int(i)) for i in found]
            reached += found.tolist()
            rest = rest[~np.isin(rest, found)]
    return edges


def _linked(table: pa.Table) -> pa.Table:
    table = table.sort_by("content")
    names = table.column("content").to_pylist()
    sets = [np.frombuffer(s, np.uint64) for s in table.column("shingles").to_pylist()]
    marks = np.frombuffer(b"".join(table.column("marks").to_pylist()), np.uint8).reshape(len(names), -1)
    edges = similar(sets, marks)
    return pa.table({c: pa.array([names[e[i]] for e in edges], pa.binary()) for i, c in enumerate(("id_a", "id_b"))})


def probed(contents: DataFrame) -> DataFrame:
    """(key, content, size) of contents whose fingerprints equal or are linked to another's."""
    values = cut_lineage(contents.where("size > 0").groupBy("fp").agg(F.count(F.lit(1)).alias("n")))
    found = cut_lineage(near_copies.links(values, "fp", DISTANCE))
    nodes = found.select(F.col("id_a").alias("fp")).union(found.select(F.col("id_b").alias("fp")))
    label = connected_components(found, nodes, id_col="fp")
    label = cut_lineage(label.unionByName(values.where("n > 1").select("fp", F.col("fp").alias("component")).join(label, "fp", "left_anti")))
    if row_total(label) <= SENT:
        label = F.broadcast(label)
    key = F.concat(F.lit("simhash "), F.col("component").cast("string")).cast("binary")
    return contents.where("size > 0").join(label, "fp").select(key.alias("key"), "content", "size")


def links(contents: DataFrame, docs: DataFrame, text: str = "text", block: int = BLOCK) -> DataFrame:
    """(id_a, id_b): links between different contents, as many as connect what all links connect.

    `contents`: (content, size, keys, fp), each once; `docs` hold their texts.
    """
    each = F.explode(F.expr(f"transform(sequence(0, {BANDS - 1}), i -> substring(keys, i * 8 + 1, 8))")).alias("key")
    keys = contents.where("size > 0").select("content", "size", each).unionByName(probed(contents))
    shared = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.ceil(F.sum("size") / block).cast("int").alias("blocks")).where("n > 1")
    met = cut_lineage(keys.join(shared.drop("n"), "key").select("key", "content", "blocks"))
    wanted = met.select("content").distinct()
    if row_total(wanted) <= SENT:
        wanted = F.broadcast(wanted)
    texts = with_results(docs.select(F.col(text).alias("text")), "text", {"content": "binary"}, _contents)
    once = texts.join(wanted, "content", "left_semi").dropDuplicates(["content"])
    sets = with_results(once, "text", {"shingles": "binary", "marks": "binary"}, _sets).drop("text")
    # A bucket of one block is compared as it is; of more, each two blocks meet.
    own = F.pmod(F.xxhash64("content"), F.col("blocks")).cast("int")
    other = F.explode(F.when(F.col("blocks") == 1, F.array(F.lit(0))).otherwise(
        F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda b: b != F.col("own")))).alias("other")
    dealt = met.withColumn("own", own).select("key", "content", "own", other).select(
        "key", "content", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"))
    return dealt.join(sets, "content").groupBy("key", "low", "high").applyInArrow(_linked, "id_a binary, id_b binary")


def components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", block: int = BLOCK, carried: dict[str, Column] | None = None) -> DataFrame:
    """(doc_id, content, component, and what is carried) of every row; `component` is the least content that links lead to."""
    names = carried or {}
    given = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), *(c.alias(n) for n, c in names.items()))
    rows = cut_lineage(with_results(given, "text", {"content": "binary", "size": "bigint", "keys": "binary", "fp": "bigint"}, _sketch).drop("text"))
    contents = rows.groupBy("content").agg(*(F.first(c).alias(c) for c in ("size", "keys", "fp")))
    found = cut_lineage(links(contents, docs, text, block).distinct())
    nodes = found.select(F.col("id_a").alias("content")).union(found.select(F.col("id_b").alias("content")))
    label = connected_components(found, nodes, id_col="content")
    if row_total(label) <= SENT:
        label = F.broadcast(label)
    return rows.select("doc_id", *names, "content").join(label, "content", "left").withColumn("component", F.coalesce("component", "content"))


def deduplicated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", block: int = BLOCK, sent: int = SENT) -> DataFrame:
    """One row of `docs` for each component: the smallest id's; of rows with equal ids, or without one, the least hash's.

    Rows without an id come last. Rows with equal hashes are equal; one of them stays. The rows that go, and those of which
    one stays, are counted: few are sent to the tasks that read the texts, which then do not travel.
    """
    mark, state = unused(docs, "mark"), unused(docs, "state")
    hashed = F.md5(F.to_json(F.struct(*(F.col(f"`{c}`") for c in docs.columns)), {"ignoreNullFields": "false"}).cast("binary"))
    rows = cut_lineage(components(docs, doc_id, text, block, {"mark": hashed}))
    first = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), "mark")
    kept = rows.groupBy("component").agg(F.min(first).alias("first")).select(F.col("first.mark").alias("mark"), F.lit(True).alias("kept"))
    # Of each different row: it goes, or it is there more than once. Nothing is said of rows that stay as they are.
    told = rows.groupBy("mark").agg(F.count(F.lit(1)).alias("n")).join(kept, "mark", "left").where("kept IS NULL OR n > 1").select(
        F.col("mark").alias(mark), F.when(F.col("kept"), "once").otherwise("gone").alias(state))
    told = cut_lineage(told)
    if row_total(told) <= sent:
        told = F.broadcast(told)
    marked = docs.withColumn(mark, hashed).join(told, mark, "left")
    once = marked.where(F.col(state) == "once")
    single = once.withColumn(state, F.row_number().over(Window.partitionBy(mark).orderBy(mark))).where(F.col(state) == 1)
    return marked.where(F.col(state).isNull()).select(*docs.columns).unionByName(single.select(*docs.columns))
