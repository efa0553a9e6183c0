"""URL filters by a bit-parallel wildcard automaton.

All glob rules are packed into one multiword Shift-And machine: a bit per pattern position, a mask of accepting bits per
character class, and a mask of the positions that a wildcard lets wait. One step reads one character of every URL of a
batch against all patterns at once.

Host rules are matched with the host and path as given. The globs are matched with a canonical URL, so that other
spellings of an address do not pass them: the host without user part, port and trailing dots, then the path with escapes
of letters, digits and `-._~` decoded once and its `.` and `..` segments resolved. Escapes of other characters and the case
of paths stay, as they tell addresses apart. The first slash ends the host in both. In globs, `**` is any run of characters, `*` any run without a slash, `?` one character
other than a slash.

Null URLs, and those without `://`, have an empty host and path, which only globs that match the empty string fit.
Repeated rows are judged alike; an empty table gives an empty one. Columns of the input are carried; one with the name
of a result column is replaced. The masks grow with the rules and not with the data; the rules are a parameter.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

from furrow.llm.common import with_results

#: Host rules: verdict and host with path. They fit the host and its subdomains if the path starts like theirs.
HOST_RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
#: Globs that decide where no host rule fits: any of them blocks.
BLOCKED = ("adult*/**", "*.adult*/**", "**/login*", "**/signin*", "**/ads/**", "**/*.exe")
#: Escapes of characters that need none.
ESCAPE = re.compile("%(2[DdEe]|3[0-9]|4[1-9A-Fa-f]|5[0-9AaFf]|6[1-9A-Fa-f]|7[0-9AaEe])")
#: Characters of URLs that are laid out together.
SPAN = 2_000_000


@dataclass(frozen=True)
class Glob:
    pattern: str
    rule: int


def globs_of(host_rules: tuple[tuple[str, str], ...]) -> list[Glob]:
    """Two globs of each host rule: the host itself, and its subdomains. Rule texts are literal up to their end."""
    return [Glob(p, i) for i, (_, rule) in enumerate(host_rules) for p in (f"{rule}**", f"*.{rule}**")]


class Machine:
    """Masks of a set of globs."""

    def __init__(self, patterns: list[str]):
        literals = sorted({c for p in patterns for c in re.sub(r"[*?]", "", p)} | {"/"})
        self.codes = np.array([ord(c) for c in literals], np.uint32)
        classes = len(literals) + 1  # the last: every other character
        slash = literals.index("/")
        accept: list[set[int]] = []  # of each bit: the classes that lead to it from the bit before
        wait: list[set[int]] = []  # the classes that leave it on
        self.first, self.last = [], []
        every, inside = set(range(classes)), set(range(classes)) - {slash}
        for pattern in patterns:
            self.first.append(len(accept))
            accept.append(set())
            wait.append(set())
            for token in re.findall(r"\*\*|\*|\?|[^*?]", pattern):
                if token in ("**", "*"):
                    wait[-1] |= every if token == "**" else inside
                else:
                    accept.append(inside if token == "?" else {literals.index(token)})
                    wait.append(set())
            self.last.append(len(accept) - 1)
        self.words = max(1, -(-len(accept) // 64))
        self.accept, self.wait = self._masks(accept, classes), self._masks(wait, classes)
        self.begin = self._bits(self.first)

    def _bits(self, places: list[int]) -> np.ndarray:
        out = np.zeros(self.words, np.uint64)
        for p in places:
            out[p // 64] |= np.uint64(1 << p % 64)
        return out

    def _masks(self, of_bits: list[set[int]], classes: int) -> np.ndarray:
        out = np.zeros((classes, self.words), np.uint64)
        for bit, of in enumerate(of_bits):
            for c in of:
                out[c, bit // 64] |= np.uint64(1 << bit % 64)
        return out

    def classes(self, codes: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.codes, codes), len(self.codes) - 1)
        return np.where(self.codes[at] == codes, at, len(self.codes))

    def match(self, urls: list[str]) -> np.ndarray:
        """Boolean matrix: URL by pattern."""
        sizes = np.array([len(u) for u in urls], np.int64)
        order = np.argsort(-sizes, kind="stable")
        kinds = self.classes(np.frombuffer("".join(urls).encode("utf-32-le"), np.uint32))
        starts, sizes = (np.cumsum(sizes) - sizes)[order], sizes[order]
        state = np.tile(self.begin, (len(urls), 1))
        one, top = np.uint64(1), np.uint64(63)
        for t in range(int(sizes[0]) if len(sizes) else 0):
            live = int(np.searchsorted(-sizes, -t, side="left"))  # the longer ones come first
            now, kind = state[:live], kinds[starts[:live] + t]
            shifted = now << one
            shifted[:, 1:] |= now[:, :-1] >> top
            state[:live] = shifted & self.accept[kind] | now & self.wait[kind]
        last = np.array(self.last, np.int64)
        hit = (state[:, last // 64] >> (last % 64).astype(np.uint64) & one).astype(bool)
        out = np.empty_like(hit)
        out[order] = hit
        return out


def split_url(url: str | None) -> tuple[str, str]:
    """Host with A-Z lower-cased, and path; both empty without `://`."""
    mark = (url or "").find("://")
    if mark < 0:
        return "", ""
    host, path = re.match(r"([^/?#]*)([^?#]*)", url[mark + 3:], re.S).groups()
    return re.sub("[A-Z]+", lambda m: m[0].lower(), host), path


def canonical(host: str, path: str) -> str:
    """One spelling of an address, of its host and path."""
    host = re.sub(r":[0-9]*\Z", "", host[host.rfind("@") + 1:]).rstrip(".")
    if "%" in path:
        path = ESCAPE.sub(lambda m: chr(int(m[1], 16)), path)
    if "/." in path:
        kept: list[str] = []
        parts = path.split("/")[1:]
        for part in parts:
            if part == "..":
                del kept[-1:]
            elif part != ".":
                kept.append(part)
        path = "/" + "/".join(kept + [""] * (parts[-1] in (".", "..")))
    return host + path


def judge_batch(urls: list[str | None], host_rules: tuple, blocked: tuple) -> list[tuple[str, str, str | None, str]]:
    """Host, path, rule and verdict of each URL."""
    own = globs_of(host_rules)
    rules, globs = Machine([g.pattern for g in own]), Machine(list(blocked))
    places = [split_url(u) for u in urls]
    # The longest rule comes first; of equals, the earlier one.
    rank = np.array([(-len(host_rules[g.rule][1]), g.rule) for g in own], np.int64).reshape(-1, 2)
    order = np.lexsort((rank[:, 1], rank[:, 0]))
    out, start = [], 0
    while start < len(places):
        end, held = start, 0
        while end < len(places) and (end == start or held + len(places[end][0]) + len(places[end][1]) <= SPAN):
            held += len(places[end][0]) + len(places[end][1])
            end += 1
        ruled = rules.match([h + p for h, p in places[start:end]])[:, order]
        block = globs.match([canonical(h, p) for h, p in places[start:end]]).any(axis=1)
        some = ruled.any(axis=1) if own else np.zeros(len(block), bool)
        best = order[ruled.argmax(axis=1)] if own else np.zeros(len(block), np.int64)
        for (host, path), found, at, bad in zip(places[start:end], some.tolist(), best.tolist(), block.tolist()):
            verdict, rule = host_rules[own[at].rule] if found else ("block" if bad else "allow", None)
            out.append((host, path, rule, verdict))
        start = end
    return out


def judged(pages: DataFrame, url: str = "url", host_rules: tuple = HOST_RULES, blocked: tuple = BLOCKED) -> DataFrame:
    """`pages` with host, path, rule (null if none fits) and verdict (allow or block): the longest fitting host rule's;
    without one, block if a glob of `blocked` fits."""
    return with_results(pages, url, dict.fromkeys(("host", "path", "rule", "verdict"), "string"),
                        lambda urls: judge_batch(urls, host_rules, blocked))
