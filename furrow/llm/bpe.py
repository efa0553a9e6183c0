"""Byte-level BPE encoding and decoding with vectorised pre-tokenisation.

Texts are laid out as one array of code points. A table turns it into an array of codepoint classes; each class is a
function from state to state of a small automaton over what has been read. The functions under composition form a
finite monoid, so the state at every position is an associative scan over a multiplication table, done for all blocks
of the array at once. Where a piece begins follows from the states of neighbouring positions: no regular expression
runs. The slices between boundaries go through a cache; those not in it are merged together, all at once, pair by pair
in rank order.

The strings of a JSON file's added tokens are cut out of a text before it is laid out, and stand for their ids; the parts
between them are texts of their own. A rank file has no added tokens.

Null is the empty text, which has no ids. Texts of any length are taken whole. Repeated rows give equal results, an
empty table gives an empty one. Columns of the input other than the text are left alone; one with the name of a result
column is replaced.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import json
import re
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from furrow.llm.common import by_size, texts, with_results

# --- classes and automaton ------------------------------------------------------------------------------------------

#: Codepoint classes. Letters that occur in the contractions have classes of their own.
LETTER, SHORT, R, V, E, L, NUMBER, OTHER, QUOTE, SPACE, WHITE = range(11)
CLASSES = 11
#: States: begin of text; in a run of letters, numbers, others; behind a space or other white space; behind a quote that
#: begins a piece; behind such a quote and r, v or l; behind a contraction of two or three characters.
BEGIN, IN_L, IN_N, IN_O, IN_SPACE, IN_WHITE, AFTER_QUOTE, QUOTE_R, QUOTE_V, QUOTE_L, TWO, THREE = range(12)
STATES = 12
LETTERS = (LETTER, SHORT, R, V, E, L)
#: Code points that count as white space (a fixed value of the pattern).
WHITE_SPACE = (0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
#: Characters of texts that are laid out together.
SPAN = 1_000_000
#: Pieces kept between spans; with more, only those of the last span stay.
CACHED = 300_000
#: Longer pieces are merged one by one with a heap.
LONG = 96
NEVER = np.iinfo(np.int32).max


@lru_cache(1)
def class_table() -> np.ndarray:
    table = np.empty(0x110000, np.uint8)
    for code in range(0x110000):
        kind = unicodedata.category(chr(code))[0]
        table[code] = LETTER if kind == "L" else NUMBER if kind == "N" else OTHER
    table[list(WHITE_SPACE)] = WHITE
    table[ord(" ")], table[ord("'")] = SPACE, QUOTE
    for letter, kind in {"s": SHORT, "t": SHORT, "m": SHORT, "d": SHORT, "r": R, "v": V, "e": E, "l": L}.items():
        table[ord(letter)] = kind
    return table


def step(state: int, kind: int) -> int:
    """The automaton, one character further."""
    if kind in (SPACE, WHITE):
        return IN_SPACE if kind == SPACE else IN_WHITE
    if kind in (NUMBER, OTHER):
        return IN_N if kind == NUMBER else IN_O
    if kind == QUOTE:
        return IN_O if state in (IN_O, IN_SPACE, AFTER_QUOTE) else AFTER_QUOTE
    if state == AFTER_QUOTE:
        return {SHORT: TWO, R: QUOTE_R, V: QUOTE_V, L: QUOTE_L}.get(kind, IN_L)
    if kind == E and state in (QUOTE_R, QUOTE_V) or kind == L and state == QUOTE_L:
        return THREE
    return IN_L


@lru_cache(1)
def monoid() -> tuple[np.ndarray, np.ndarray]:
    """Products of the transition functions (flat table) and the state each of them leads to from BEGIN.

    Elements 0 to 10 are the classes, 11 to 21 the same as first character of a text: constant functions.
    """
    first = [tuple(step(s, k) for s in range(STATES)) for k in range(CLASSES)]
    known = {f: i for i, f in enumerate(dict.fromkeys(first))}
    elements = list(first) + [(f[BEGIN],) * STATES for f in first]
    index = {}
    for i, f in enumerate(elements):
        index.setdefault(f, i)
    todo = list(index)
    while todo:
        f = todo.pop()
        for g in first + elements[CLASSES:2 * CLASSES]:
            h = tuple(g[s] for s in f)
            if h not in index:
                index[h] = len(elements)
                elements.append(h)
                todo.append(h)
    assert known and len(elements) < 256
    n = len(elements)
    product = np.zeros((n, 256), np.uint8)
    for i, f in enumerate(elements):
        for j, g in enumerate(elements):
            product[i, j] = index[tuple(g[s] for s in f)]
    return product.ravel(), np.array([f[BEGIN] for f in elements], np.uint8)


def scan(functions: np.ndarray, product: np.ndarray, block: int = 128) -> np.ndarray:
    """Inclusive products from the left: within all blocks side by side, then over the blocks' totals."""
    n = len(functions)
    if n <= block:
        out, held = np.empty(n, np.uint8), 0
        for i, f in enumerate(functions.tolist()):
            held = int(product[held * 256 + f]) if i else f
            out[i] = held
        return out
    blocks = -(-n // block)
    padded = np.zeros(blocks * block, np.uint8)
    padded[:n] = functions
    rows = np.ascontiguousarray(padded.reshape(blocks, block).T)
    for j in range(1, block):
        rows[j] = product[rows[j - 1].astype(np.intp) * 256 + rows[j]]
    before = scan(rows[-1], product, block)[:-1]
    rows[:, 1:] = product[before.astype(np.intp)[None, :] * 256 + rows[:, 1:]]
    return rows.T.reshape(-1)[:n]


def boundaries(codes: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Positions at which a piece begins. `begins`: where the (not empty) texts begin in `codes`."""
    n = len(codes)
    if n == 0:
        return np.empty(0, np.int64)
    product, image = monoid()
    kinds = class_table()[codes]
    functions = kinds.copy()
    functions[begins] += CLASSES
    state = image[scan(functions, product)]
    previous = np.empty(n, np.uint8)
    previous[1:], previous[begins] = state[:-1], BEGIN
    white = (kinds == SPACE) | (kinds == WHITE)
    opens = OPENS[previous.astype(np.intp) * STATES + state]
    last = np.zeros(n, bool)  # last of the white space before another character of the same text
    last[:-1] = white[:-1] & ~white[1:]
    ends = begins[1:] - 1
    last[ends] = False
    opens |= last
    three = np.flatnonzero(state == THREE)
    opens[three - 1] = False
    opens[begins] = True
    return np.flatnonzero(opens)


def _opens() -> np.ndarray:
    """Whether a piece begins at a character, by the states before and behind it; contractions of three are mended later."""
    table = np.zeros((STATES, STATES), bool)
    joined = {IN_L: (IN_L, IN_SPACE, QUOTE_R, QUOTE_V, QUOTE_L), IN_N: (IN_N, IN_SPACE), IN_O: (IN_O, IN_SPACE, AFTER_QUOTE),
              IN_SPACE: (IN_SPACE, IN_WHITE), IN_WHITE: (IN_SPACE, IN_WHITE), AFTER_QUOTE: (), QUOTE_R: (), QUOTE_V: (), QUOTE_L: ()}
    for state, befores in joined.items():
        table[[b for b in range(STATES) if b not in befores], state] = True
    return table.ravel()


OPENS = _opens()

# --- merging --------------------------------------------------------------------------------------------------------


class Encoder:
    """Ranks of a byte-level vocabulary with the cache of one Python worker."""

    def __init__(self, ranks: dict[bytes, int], added: dict[str, int] | None = None):
        self.added = dict(added or {})
        named = ranks | {token.encode(): i for token, i in self.added.items()}
        self.vocabulary = [b""] * (max(named.values()) + 1)
        for piece, rank in named.items():
            self.vocabulary[rank] = piece
        self.bytes = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        # Every way to cut a piece into two others is a pair that merges to it.
        pairs = {}
        for piece, rank in ranks.items():
            for cut in range(1, len(piece)):
                left, right = ranks.get(piece[:cut]), ranks.get(piece[cut:])
                if left is not None and right is not None:
                    pairs[left << 32 | right] = rank
        self.pairs = pairs
        self.keys = np.array(sorted(pairs), np.int64)
        self.ranks = np.array([pairs[k] for k in self.keys.tolist()], np.int32)
        slots = 1 << 20
        self.slots = np.zeros(slots, bool)  # most pairs merge to nothing: their slot is empty
        self.slots[self._slot(self.keys)] = True
        self.cache: dict[bytes, bytes] = {}
        self.starts = np.zeros(len(self.vocabulary) + 1, np.int64)
        np.cumsum([len(p) for p in self.vocabulary], out=self.starts[1:])
        self.flat = np.frombuffer(b"".join(self.vocabulary), np.uint8)

    @classmethod
    def load(cls, path: str) -> Encoder:
        return _load(path)

    @staticmethod
    def _slot(keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(44)).astype(np.intp)

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left.astype(np.int64) << 32 | right
        out = np.full(len(keys), NEVER, np.int32)
        some = np.flatnonzero(self.slots[self._slot(keys)])
        at = np.searchsorted(self.keys, keys[some])
        at[at == len(self.keys)] = 0
        hit = self.keys[at] == keys[some]
        out[some[hit]] = self.ranks[at[hit]]
        return out

    def merge_long(self, piece: bytes) -> bytes:
        """One piece of any length: a heap of pairs over a linked list."""
        ids = self.bytes[np.frombuffer(piece, np.uint8)].tolist()
        n = len(ids)
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        find = self.pairs.get
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := find(ids[i] << 32 | ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = right[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = rank, -1
            right[i] = k = right[j]
            if k < n:
                left[k] = i
                if (r := find(rank << 32 | ids[k])) is not None:
                    heapq.heappush(heap, (r, i, rank, ids[k]))
            h = left[i]
            if h >= 0 and (r := find(ids[h] << 32 | rank)) is not None:
                heapq.heappush(heap, (r, h, ids[h], rank))
        return np.array([x for x in ids if x >= 0], np.uint32).tobytes()

    def merge_many(self, pieces: list[bytes]) -> list[bytes]:
        """Pieces of at most LONG bytes, side by side as rows of a matrix; each round merges one pair of each row."""
        out = [b""] * len(pieces)
        lengths = np.array([len(p) for p in pieces], np.int64)
        order = np.argsort(lengths, kind="stable")
        for some in np.array_split(order, max(1, len(order) // 4096)):
            width = int(lengths[some].max(initial=1))
            raw = np.frombuffer(b"".join(pieces[i].ljust(width, b"\0") for i in some.tolist()), np.uint8)
            ids, size, who = self.bytes[raw].reshape(-1, width), lengths[some].copy(), some
            column = np.arange(width)
            rank = np.full((len(who), width), NEVER, np.int32)
            r, c = np.nonzero(column[None, :] < size[:, None] - 1)
            rank[r, c] = self.rank_of(ids[r, c], ids[r, c + 1])
            while len(who):
                at = rank.argmin(axis=1)
                rows = np.arange(len(who))
                best = rank[rows, at]
                done = best == NEVER
                if done.any():
                    flat = ids[done].astype(np.uint32)
                    for i, row, n in zip(who[done].tolist(), flat, size[done].tolist()):
                        out[i] = row[:n].tobytes()
                    stay = ~done
                    ids, size, who, rank, at, best = ids[stay], size[stay], who[stay], rank[stay], at[stay], best[stay]
                    if not len(who):
                        break
                    width = int(size.max())
                    ids, rank, column = ids[:, :width], rank[:, :width], column[:width]
                    rows = rows[:len(who)]
                behind = column[None, :-1] > at[:, None]
                ids = np.concatenate([np.where(behind, ids[:, 1:], ids[:, :-1]), ids[:, -1:]], axis=1)
                rank = np.concatenate([np.where(behind, rank[:, 1:], rank[:, :-1]), np.full((len(who), 1), NEVER, np.int32)], axis=1)
                ids[rows, at] = best
                size -= 1
                rank[rows, at] = NEVER
                right = np.flatnonzero(at + 1 < size)
                rank[right, at[right]] = self.rank_of(ids[right, at[right]], ids[right, at[right] + 1])
                left = np.flatnonzero(at > 0)
                rank[left, at[left] - 1] = self.rank_of(ids[left, at[left] - 1], ids[left, at[left]])
        return out

    def _spans(self, docs: list[str]):
        for start, end in by_size(docs, SPAN):
            yield from self._encode(docs[start:end])

    def _encode(self, docs: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        joined = "".join(docs)
        codes = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        sizes = np.array([len(d) for d in docs], np.int64)
        ends = np.cumsum(sizes)
        begins = (ends - sizes)[sizes > 0]
        cuts = boundaries(codes, begins)
        raw = joined.encode()
        place = cuts
        if len(raw) > len(codes):  # byte offsets behind characters of several bytes
            wide = (codes > 0x7F).astype(np.int64) + (codes > 0x7FF) + (codes > 0xFFFF)
            place = cuts + (np.cumsum(wide) - wide)[cuts]
        edges = np.append(place, len(raw)).tolist()
        pieces = [raw[a:b] for a, b in zip(edges, edges[1:])]
        cache = self.cache
        blobs = list(map(cache.get, pieces))
        if None in blobs:
            fresh = list({p for p, b in zip(pieces, blobs) if b is None})
            short = [p for p in fresh if len(p) <= LONG]
            cache.update(zip(short, self.merge_many(short)))
            own = {p: self.merge_long(p) for p in fresh if len(p) > LONG}  # not worth keeping
            blobs = [own.get(p) or cache[p] for p in pieces] if own else list(map(cache.__getitem__, pieces))
            if len(cache) > CACHED:
                self.cache = {p: cache[p] for p in set(pieces) if p in cache}
        firsts = np.searchsorted(cuts, ends - sizes).tolist() + [len(cuts)]
        return [np.frombuffer(b"".join(blobs[a:b]), np.uint32) for a, b in zip(firsts, firsts[1:])]

    def encode(self, docs: list[str]):
        """The ids of each text, in order."""
        if not self.added:
            yield from self._spans(docs)
            return
        # The longest token first where one begins with another.
        tokens = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")")
        split = [tokens.split(d) for d in docs]  # ordinary parts at even places, tokens at odd ones
        made = self._spans([part for parts in split for part in parts[::2]])
        for parts in split:
            yield np.concatenate([np.array([self.added[part]], np.uint32) if at % 2 else next(made) for at, part in enumerate(parts)])

    def offsets(self, ids: np.ndarray) -> np.ndarray:
        """Where each id's bytes begin in the decoded bytes, and their end."""
        out = np.zeros(len(ids) + 1, np.int64)
        np.cumsum(self.starts[ids + np.uint32(1)] - self.starts[ids], out=out[1:])
        return out

    def decode(self, ids: np.ndarray, offsets: np.ndarray | None = None, span: int = 1 << 20) -> bytes:
        """The bytes of the ids, gathered from the vocabulary in one step per span."""
        at, out = self.offsets(ids) if offsets is None else offsets, []
        for s in range(0, len(ids), span):
            some, place = ids[s:s + span], at[s:s + span + 1]
            shift = np.repeat(self.starts[some] - (place[:-1] - place[0]), np.diff(place))
            out.append(self.flat[shift + np.arange(len(shift))].tobytes())
        return b"".join(out)


def byte_letters() -> dict[str, int]:
    """The printable stand-ins of bytes in JSON vocabularies: printable ones as they are, the others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(others)}


@lru_cache(2)
def _load(path: str) -> Encoder:
    """A rank file, or the vocabulary of a JSON file with its added tokens."""
    with open(path, "rb") as file:
        if not path.endswith(".json"):
            return Encoder({base64.b64decode(a): int(b) for a, b in map(bytes.split, file)})
        found, letters = json.load(file), byte_letters()
    added = {t["content"]: t["id"] for t in found["added_tokens"]}
    return Encoder({bytes(letters[c] for c in piece): i for piece, i in found["model"]["vocab"].items() if piece not in added}, added)


# --- columns --------------------------------------------------------------------------------------------------------


def encode(docs: DataFrame, path: str, text: str = "text", out: str = "tokens") -> DataFrame:
    """`docs` with a struct column: `ids` array<int>, `offsets` array<bigint> (byte offset of each id and the end)."""

    @F.arrow_udf("struct<ids:array<int>,offsets:array<bigint>>")
    def run(column: pa.Array) -> pa.Array:
        coder = Encoder.load(path)
        ids = list(coder.encode(texts(column)))
        places = [coder.offsets(x) for x in ids]
        listed = [pa.ListArray.from_arrays(
            pa.array(np.cumsum([0, *map(len, parts)]), pa.int32()), pa.array(np.concatenate([kind([]), *parts]).astype(to)))
            for parts, kind, to in ((ids, np.array, np.int32), (places, np.array, np.int64))]
        return pa.StructArray.from_arrays(listed, ["ids", "offsets"])

    return docs.withColumn(out, run(F.col(text)))


def decode(df: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """`df` with the bytes of an array column of ids. A null array gives null; an id outside the vocabulary raises."""

    @F.arrow_udf("binary")
    def run(column: pa.Array) -> pa.Array:
        coder = Encoder.load(path)
        return pa.array([None if x is None else coder.decode(np.array(x, np.uint32)) for x in column.to_pylist()], pa.binary())

    return df.withColumn(out, run(F.col(ids)))


def digests(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """`docs` with n_tokens, ids_sha256 and decoded_sha256: encoded, decoded from ids and offsets, both hashed in one pass."""
    def work(values: list) -> list[tuple]:
        coder = Encoder.load(path)
        decimal, rows = list(map(str, range(len(coder.vocabulary)))), []
        for ids in coder.encode([t or "" for t in values]):
            listed = " ".join(map(decimal.__getitem__, ids.tolist())).encode()
            decoded = coder.decode(ids, coder.offsets(ids))
            rows.append((len(ids), hashlib.sha256(listed).hexdigest(), hashlib.sha256(decoded).hexdigest()))
        return rows

    return with_results(docs, text, {"n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"}, work)
