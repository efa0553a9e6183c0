"""Token counts of a unigram vocabulary, without making the tokens.

An Aho-Corasick automaton enumerates the vocabulary's pieces in a chunk of text; one pass over the matches carries, for
each end, the best score and the number of pieces that reach it. Ties go as in the tokenizer: a longer last piece wins,
as a later candidate must be strictly better. A character that is a piece of no match costs the least score less ten and
counts as its UTF-8 bytes (byte fallback). Scores are exact doubles, so a chunk's result does not depend on what stands
before it.

No piece goes on over a space that follows another character, so text is cut there, and a chunk is solved once per
worker. Text is used as it is but for a space in front and spaces as U+2581. Null and empty texts have no
tokens. Texts are taken whole. Repeated rows give equal counts, an empty table gives an empty one. Columns of the input
are carried; one with the name of the result is replaced.
"""

from __future__ import annotations

import os
import re
from collections import Counter
from functools import lru_cache

from pyspark.sql import DataFrame

from furrow.llm.common import with_results

MARK = "▁"
UNKNOWN_PENALTY = 10.0
#: Chunks kept with their counts.
CACHED = 500_000


class Counts:
    """Vocabulary of (piece, score) with an automaton and the counts of chunks seen."""

    def __init__(self, vocabulary: list[tuple[str, float]]):
        import ahocorasick

        if any(MARK in p.lstrip(MARK) for p, _ in vocabulary):
            raise ValueError("a piece goes on over a word's begin: chunks cannot be cut there")
        self.automaton = ahocorasick.Automaton()
        for piece, score in vocabulary:
            if not self.automaton.exists(piece):
                self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.singles = {p for p, _ in vocabulary if len(p) == 1}
        self.unknown = min((s for _, s in vocabulary), default=0.0) - UNKNOWN_PENALTY
        self.cache: dict[str, int] = {}

    def chunk(self, text: str) -> int:
        """Pieces of the best path through one chunk."""
        n, found = len(text), self.automaton.iter(text)
        score, count = [0.0] + [float("-inf")] * n, [0] * (n + 1)
        if not self.singles.issuperset(text):
            found = sorted([*((last, -size, worth, 1) for last, (size, worth) in found), *(
                (i, -1, self.unknown, len(c.encode())) for i, c in enumerate(text) if c not in self.singles)], key=lambda m: m[:2])
            for last, size, worth, pieces in found:
                candidate = score[last + 1 + size] + worth
                if candidate > score[last + 1]:
                    score[last + 1], count[last + 1] = candidate, count[last + 1 + size] + pieces
            return count[n]
        for last, (size, worth) in found:  # by their end, the longest first
            start = last + 1 - size
            candidate = score[start] + worth
            if candidate > score[last + 1]:
                score[last + 1], count[last + 1] = candidate, count[start] + 1
        return count[n]

    def __call__(self, text: str) -> int:
        if not text:
            return 0
        cache, total = self.cache, 0
        for word, times in Counter(chunks(text)).items():
            found = cache.get(word)
            if found is None:
                found = self.chunk(word)
                if len(word) < 64 and len(cache) < CACHED:  # frequent chunks come early
                    cache[word] = found
            total += found * times
        return total


def chunks(text: str) -> list[str]:
    """A space in front and spaces as marks; cut before marks that follow another character."""
    parts = text.split(" ")
    if "" not in parts and MARK not in text:
        return [MARK + p for p in parts]
    return re.findall(f"{MARK}*[^{MARK}]+|{MARK}+$", MARK + text.replace(" ", MARK))


@lru_cache(2)
def load(path: str) -> Counts:
    """Ordinary pieces of a SentencePiece file with their scores, read as a unigram vocabulary."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=os.fspath(path))
    return Counts([(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())
                   if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))])


def counted(docs: DataFrame, path: str, text: str = "text", out: str = "n_tokens") -> DataFrame:
    """`docs` with the number of tokens of each text (long)."""

    def work(values: list) -> list[tuple]:
        count = load(path)
        return [(count(t or ""),) for t in values]

    return with_results(docs, text, {out: "bigint"}, work)
