"""Token counts of a unigram vocabulary: Viterbi over matches, keeping counts only.

An Aho-Corasick automaton finds all pieces that end at a character; dynamic programming keeps the
best score and its number of pieces for each character. The tie rule is the tokenizer's: paths are
extended by start, and a later one must score more to replace an earlier one, so of equal paths the
one with the longest last piece stays. A character that is no piece costs the least score less 10,
and counts as its UTF-8 bytes. Scores are added in double precision.

Pieces hold spaces only at their start, so a text falls apart before each run of spaces; a part is solved once and remembered in a
bounded cache. That changes no sum where scores are multiples of
2^-20, which is checked; other vocabularies are solved text by text.

Defined results. Null and empty texts have no tokens. Texts are counted whole. Rows are on their
own, so repeated rows and nulls elsewhere need no rule.
"""

from __future__ import annotations

import hashlib
import re
from typing import NamedTuple

import ahocorasick
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The sign that stands for a space, and what an unknown character costs under the least score.
SPACE_SIGN = "▁"
UNKNOWN_PENALTY = 10.0
CACHE = 500_000
PART = re.compile(r" *[^ ]+| +")


class Vocabulary(NamedTuple):
    """Pieces with scores, and whether a text gets a space in front; set by its file."""

    pieces: tuple[tuple[str, float], ...]
    unknown: float
    prefix: bool
    digest: str


def vocabulary(pieces: dict[str, float], prefix: bool = True) -> Vocabulary:
    rows = tuple(sorted(pieces.items()))
    unknown = min(pieces.values(), default=0.0) - UNKNOWN_PENALTY
    return Vocabulary(rows, unknown, prefix,
                      hashlib.sha256(repr((rows, prefix)).encode()).hexdigest())


def read_pieces(path: str) -> Vocabulary:
    """The normal pieces of a sentencepiece model with byte fallback and no normalisation."""
    from sentencepiece import sentencepiece_model_pb2 as proto

    model = proto.ModelProto()
    with open(path, "rb") as file:
        model.ParseFromString(file.read())
    rules = model.normalizer_spec
    if rules.precompiled_charsmap or rules.remove_extra_whitespaces:
        raise ValueError("the vocabulary must not normalise text")
    if not model.trainer_spec.byte_fallback:
        raise ValueError("the vocabulary must fall back to bytes")
    normal = proto.ModelProto.SentencePiece.NORMAL
    return vocabulary({p.piece: p.score for p in model.pieces if p.type == normal},
                      rules.add_dummy_prefix)


class Counter:
    """Counts the pieces of texts of one task."""

    def __init__(self, of: Vocabulary):
        self.automaton, self.unknown, self.prefix = ahocorasick.Automaton(), of.unknown, of.prefix
        for piece, score in of.pieces:
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.some = bool(of.pieces)
        self.singles = {p for p, _ in of.pieces if len(p) == 1}
        self.by_part = all(SPACE_SIGN not in p.lstrip(SPACE_SIGN) for p, _ in of.pieces) and all(
            (s * 2 ** 20).is_integer() for _, s in of.pieces)
        self.known: dict[str, int] = {}

    def solve(self, text: str) -> int:
        """Pieces on the best path through a text."""
        best, count = [0.0] + [float("-inf")] * len(text), [0] * (len(text) + 1)
        if not self.singles.issuperset(text):
            return self.solve_unknown(text, best, count)
        for last, (length, score) in self.automaton.iter(text):
            end = last + 1  # matches come by their end, the longest first
            start = end - length
            score += best[start]
            if score > best[end]:
                best[end] = score
                count[end] = count[start] + 1
        return count[-1]

    def solve_unknown(self, text: str, best: list[float], count: list[int]) -> int:
        """The same with characters that are no pieces: each steps on alone."""
        matches = self.automaton.iter(text) if self.some else iter(())
        last, (length, score) = next(matches, (len(text), (0, 0.0)))
        for end, char in enumerate(text, 1):
            while last == end - 1:
                start = end - length
                score += best[start]
                if score > best[end]:
                    best[end], count[end] = score, count[start] + 1
                last, (length, score) = next(matches, (len(text), (0, 0.0)))
            if char not in self.singles and best[end - 1] + self.unknown > best[end]:
                best[end] = best[end - 1] + self.unknown
                count[end] = count[end - 1] + len(char.encode("utf-8", "surrogatepass"))
        return count[-1]

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        text = (" " if self.prefix else "") + text.replace(SPACE_SIGN, " ")
        if not self.by_part:
            return self.solve(text.replace(" ", SPACE_SIGN))
        if len(self.known) > CACHE:
            self.known.clear()
        known, parts = self.known, PART.findall(text)
        for part in set(parts):
            if part not in known:
                known[part] = self.solve(part.replace(" ", SPACE_SIGN))
        return sum(map(known.__getitem__, parts))


#: The counter of a worker process, by the digest of its vocabulary.
_counters: dict[str, Counter] = {}


def counter(of: Broadcast) -> Counter:
    key = of.value.digest
    if key not in _counters:
        _counters.clear()
        _counters[key] = Counter(of.value)
    return _counters[key]


def with_token_counts(
    docs: DataFrame, of: Broadcast, text: str = "text", to: str = "n_tokens",
) -> DataFrame:
    """The documents with the number of tokens of their texts."""
    def counts(texts: pa.Array) -> pa.Array:
        own = counter(of)
        return pa.array([own.count(t) for t in texts.to_pylist()], pa.int64())
    return docs.withColumn(to, F.arrow_udf(counts, "bigint")(F.col(text)))
