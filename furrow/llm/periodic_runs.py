"""Periodic runs of words by longest common extensions on suffix trees.

A run is a stretch of words with smallest period q, `TIMES` periods long and `LEAST` words at least, that no neighbouring
word extends. Every run with two periods or more holds a Lyndon word of length q, which is the longest Lyndon word from
its place in one of the two orders of the words. So each place gives two candidates; they are extended to the right and
to the left by the longest common extension of two places, which is the depth of a lowest common ancestor in the suffix
tree of the words or of their reversal. Ukkonen's construction makes the trees, an Euler tour over the leaves with a
sparse table of least depths answers each extension in constant time, for all candidates at once.

Words of a run are found again one period on. So trees are made only of the stretches that windows cover which the text
holds twice (by hash: a false match costs time, never a result); a text without any has no run, and no run crosses
the end of a stretch.

Words are maximal runs of other characters than the six white ones. Null and empty texts have no words and no runs.
Rows may repeat, and other columns stay; a column named `runs` or `collapsed` is replaced. An empty table gives an empty one.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from furrow.llm.common import with_results, words

LEAST = 24
TIMES = 3
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"
#: Odd multipliers of the window hashes.
MIX, STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1342543DE82EF95)


class SuffixTree:
    """Ukkonen's tree of `text` (whole numbers from 1), ended by a 0 that sorts first."""

    def __init__(self, text: list[int], symbols: int):
        s = [*text, 0]
        self.size, self.wide = len(s), symbols + 1
        n, wide = self.size, self.wide
        start, end, link = [0], [0], [0]
        suffix = [-1]  # of leaves: where their suffix begins
        kids: dict[int, int] = {}  # (node, first symbol) -> node
        node = edge = length = pending = leaves = 0
        for i, c in enumerate(s):
            pending += 1
            split = 0
            while pending:
                if not length:
                    edge = i
                at = node * wide + s[edge]
                child = kids.get(at)
                if child is None:
                    kids[at] = len(start)
                    start.append(i), end.append(n), link.append(0), suffix.append(leaves)
                    leaves += 1
                    if split:
                        link[split] = node
                        split = 0
                else:
                    begin = start[child]
                    span = (end[child] if suffix[child] < 0 else i + 1) - begin
                    if length >= span:
                        node, edge, length = child, edge + span, length - span
                        continue
                    if s[begin + length] == c:
                        if split and node:
                            link[split] = node
                        length += 1
                        break
                    new = len(start)
                    kids[at] = new
                    start.append(begin), end.append(begin + length), link.append(0), suffix.append(-1)
                    start[child] = begin + length
                    kids[new * wide + s[begin + length]] = child
                    kids[new * wide + c] = new + 1
                    start.append(i), end.append(n), link.append(0), suffix.append(leaves)
                    leaves += 1
                    if split:
                        link[split] = new
                    split = new
                pending -= 1
                if node:
                    node = link[node]
                elif length:
                    length -= 1
                    edge = i - pending + 1
        keys = np.fromiter(kids.keys(), np.int64, len(kids))
        below = np.fromiter(kids.values(), np.int64, len(kids))
        order = np.argsort(keys)
        self.kids, self.symbol = below[order], keys[order] % wide
        self.first = np.searchsorted(keys[order], np.arange(len(start) + 1) * wide)
        self.span = np.array(end) - np.array(start)
        self.suffix = suffix

    def tour(self, backwards: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """The suffixes in the order of the leaves, and the least depth on the tour from each leaf to the next.

        Backwards, the order of the words is turned; the end still comes first.
        """
        kids, first = self.kids, self.first
        if backwards:
            node = np.searchsorted(first, np.arange(len(kids)), "right")
            kids = kids[np.lexsort((-self.symbol, self.symbol > 0, node))]
        kids, first, span, suffix = kids.tolist(), first.tolist(), self.span.tolist(), self.suffix
        order, least = [], []
        stack, low = [(0, 0, 0)], 0
        while stack:
            node, depth, low_here = stack.pop()
            if low_here >= 0:
                low = low_here
            if suffix[node] >= 0:
                order.append(suffix[node])
                least.append(low)
                continue
            a, b = first[node], first[node + 1]
            depth += span[node]
            # All but the first child come after a leaf of this node.
            stack += [(kids[x], depth, depth) for x in range(b - 1, a, -1)]
            stack.append((kids[a], depth, -1))
        return np.array(order), np.array(least[1:], np.int32)


class Extensions:
    """Longest common extensions of places: range minimum over the tour by a sparse table."""

    def __init__(self, order: np.ndarray, least: np.ndarray):
        self.rank = np.empty(len(order), np.int64)
        self.rank[order] = np.arange(len(order))
        self.table = [least]
        while len(least) > 1 << len(self.table) - 1 and len(self.table[-1]) > (half := 1 << len(self.table) - 1):
            self.table.append(np.minimum(self.table[-1][:-half], self.table[-1][half:]))

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For different places, one by one."""
        low, high = np.minimum(self.rank[a], self.rank[b]), np.maximum(self.rank[a], self.rank[b])
        level = np.frexp((high - low).astype(np.float64))[1] - 1
        out = np.empty(len(a), np.int64)
        for k in np.unique(level).tolist():
            at = np.flatnonzero(level == k)
            row = self.table[k]
            out[at] = np.minimum(row[low[at]], row[high[at] - (1 << k)])
        return out


def next_smaller(rank: list[int]) -> np.ndarray:
    """The next place with a smaller rank; the last place has the smallest."""
    out, open_ = [0] * len(rank), []
    for i, r in enumerate(rank):
        while open_ and rank[open_[-1]] > r:
            out[open_.pop()] = i
        open_.append(i)
    return np.array(out[:-1], np.int64)


def runs_within(code: np.ndarray, least: int, times: int) -> np.ndarray:
    """(start, length, period) of the runs of one stretch."""
    symbols, text = np.unique(code, return_inverse=True)
    n, text = len(text), text + 1
    tree = SuffixTree(text.tolist(), len(symbols))
    order, low = tree.tour()
    ahead = Extensions(order, low)
    turned = np.empty(n + 1, np.int64)
    turned[tree.tour(backwards=True)[0]] = np.arange(n + 1)
    del tree
    place = np.arange(n)
    pairs = [np.stack([place, next_smaller(rank.tolist()) - place]) for rank in (ahead.rank, turned)]
    i, period = np.unique(np.concatenate(pairs, axis=1), axis=1)
    i, period = (x[period * times <= n] for x in (i, period))
    stop = i + period + ahead.of(i, i + period)
    del ahead
    behind = Extensions(*SuffixTree(text[::-1].tolist(), len(symbols)).tour())
    start = i - behind.of(n - i, n - i - period)
    whole = stop - start >= np.maximum(least, times * period)
    return np.unique(np.stack([start, stop - start, period], axis=1)[whole], axis=0)


def window(least: int, times: int) -> int:
    """A power of two of words that any run holds twice, a period apart."""
    shortest = min(max(least - q, (times - 1) * q) for q in range(1, least + 1))
    return 1 << max(0, shortest.bit_length() - 1)


def stretches(code: np.ndarray, width: int) -> list[tuple[int, int]]:
    """Ranges of words that windows of `width` (a power of two) cover which are found twice or more."""
    if len(code) <= width:
        return []
    with np.errstate(over="ignore"):
        hash_, step, held = (code.astype(np.uint64) + np.uint64(1)) * MIX, STEP, 1
        hash_ ^= hash_ >> np.uint64(29)
        while held < width:
            hash_ = hash_[:-held] * step + hash_[held:]
            step, held = step * step, 2 * held
    order = np.argsort(hash_)
    same = hash_[order[1:]] == hash_[order[:-1]]
    if not same.any():
        return []
    twice = np.zeros(len(hash_), bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    edge = np.zeros(len(code) + 1, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + width, -1)
    covered = np.concatenate([[False], np.cumsum(edge)[:-1] > 0, [False]])
    turns = np.flatnonzero(covered[1:] != covered[:-1]).reshape(-1, 2)
    return [(int(a), int(b)) for a, b in turns]


def runs(tokens: list[bytes], least: int = LEAST, times: int = TIMES) -> np.ndarray:
    """(start, length, period) of all runs, by start, then period."""
    found = [np.empty((0, 3), np.int64)]
    if len(tokens) >= least:
        seen: dict[bytes, int] = {}
        code = np.array([seen.setdefault(t, len(seen)) for t in tokens], np.int64)
        for a, b in stretches(code, window(least, times)):
            if b - a >= least:
                found.append(runs_within(code[a:b], least, times) + np.array([a, 0, 0]))
    out = np.concatenate(found)
    return out[np.lexsort((out[:, 2], out[:, 0]))]


def collapsed(tokens: list[bytes], found: np.ndarray) -> str:
    """The words that no run holds behind its first period, joined by one space."""
    if not len(found):
        return b" ".join(tokens).decode()
    edge = np.zeros(len(tokens) + 1, np.int64)
    np.add.at(edge, found[:, 0] + found[:, 2], 1)
    np.add.at(edge, found[:, 0] + found[:, 1], -1)
    return b" ".join(t for t, over in zip(tokens, np.cumsum(edge).tolist()) if not over).decode()


def with_runs(docs: DataFrame, text: str = "text", least: int = LEAST, times: int = TIMES) -> DataFrame:
    """`docs` with `runs` (start, length and period in words, by start, then period) and `collapsed`, the words left."""
    if least < 1 or times < 2:
        raise ValueError("runs have a word and two periods at least")

    def work(values: list) -> list[tuple]:
        out = []
        for value in values:
            tokens = words(value or "")
            found = runs(tokens, least, times)
            out.append(([{"start": s, "length": n, "period": q} for s, n, q in found.tolist()], collapsed(tokens, found)))
        return out

    return with_results(docs, text, {"runs": RUNS, "collapsed": "string"}, work)
