"""Language of a text: multinomial naive Bayes over hashed character n-grams.

Each letter gives three n-grams: itself, itself with the next character, and itself between its
neighbours; all that is no letter counts as one space, and letters are lower-cased. N-grams are
hashed to ``BINS`` bins. Training counts bins per language inside each task and sums the counts over
tasks; the matrix of log probabilities has languages x bins cells, checked against ``CELLS`` before
it is broadcast. Scoring gathers and sums matrix rows in numpy, block by block.

Defined results. A text that is null or has no letter is ``und`` with score 0, as is every text when
nothing could be learned. Languages that are null, and rows without a text, teach nothing. Equal
scores go to the first language by code point. Long texts are read whole, in blocks that share one
character on each side, so the n-grams are those of the whole text.
"""

from __future__ import annotations

import math
import sys
import unicodedata
from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zonescope.plans.workspace import written

BINS = 1 << 15
#: Cells of the model at most: 64 million 32-bit numbers.
CELLS = 1 << 26
#: Added to every count.
SMOOTHING = 0.5
BLOCK = 1 << 20
UNKNOWN = "und"
#: Odd multipliers of the hash.
MIX = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D), np.uint32(0x27D4EB2F))
SHIFT = np.uint32(32 - int(math.log2(BINS)))


class Model(NamedTuple):
    langs: tuple[str, ...]
    weights: np.ndarray  # bins x languages, log probabilities
    priors: np.ndarray


@cache
def letter_table() -> np.ndarray:
    """Which code points are letters."""
    return np.array([unicodedata.category(chr(i))[0] == "L" for i in range(sys.maxunicode + 1)])


def pieces(texts: list[str | None]) -> Iterator[tuple[int, str, bool, bool]]:
    """(text number, piece, has a character before, has one after): long texts in blocks."""
    for i, text in enumerate(texts):
        text = (text or "").lower()
        for start in range(0, len(text), BLOCK):
            end = start + BLOCK
            before, after = start > 0, end < len(text)
            yield i, text[start - before:end + after], before, after


def blocks(texts: list[str | None]) -> Iterator[list[tuple[int, str, bool, bool]]]:
    part, size = [], 0
    for piece in pieces(texts):
        part.append(piece)
        size += len(piece[1])
        if size >= BLOCK:
            yield part
            part, size = [], 0
    if part:
        yield part


def ngrams(part: list[tuple[int, str, bool, bool]]) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Bins (3 x letters), where each piece's letters start, and the text number of each piece."""
    joined = " " + " ".join(p[1] for p in part) + " "
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    letters = letter_table()[codes]
    codes = np.where(letters, codes, np.uint32(32))
    at, starts = 1, []
    for _, text, before, after in part:
        starts.append(at)
        if before:
            letters[at] = False
        at += len(text) + 1
        if after:
            letters[at - 2] = False
    places = np.flatnonzero(letters)
    here, following, previous = codes[places], codes[places + 1], codes[places - 1]
    one = here * MIX[0]
    two = (one ^ (one >> np.uint32(15))) + following * MIX[1] + np.uint32(1)
    three = ((two ^ (two >> np.uint32(13))) * MIX[3]) + previous * MIX[2] + np.uint32(2)
    bins = np.stack([(h * MIX[1] ^ (h >> np.uint32(16))) * MIX[2] >> SHIFT
                     for h in (one, two, three)])
    return bins.astype(np.int64), np.searchsorted(places, starts), [p[0] for p in part]


def count_bins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, bin, n) of a task; bin -1 counts its texts."""
    found: dict[str, np.ndarray] = {}
    for batch in batches:
        langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for lang in set(langs):
            own = [t for t, of in zip(texts, langs, strict=True) if of == lang]
            counts = found.setdefault(lang, np.zeros(BINS + 1, np.int64))
            counts[BINS] += len(own)
            for part in blocks(own):
                bins, _, _ = ngrams(part)
                counts[:BINS] += np.bincount(bins.ravel(), minlength=BINS)
    for lang, counts in found.items():
        bins = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array([lang] * len(bins), pa.string()),
             pa.array(np.where(bins == BINS, -1, bins), pa.int32()), pa.array(counts[bins])],
            names=["lang", "bin", "n"])


def bin_counts(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, bin, n) over all documents with a language and a text, written."""
    rows = docs.select(F.col(lang).alias("lang"), F.col(text).alias("text")).filter(
        F.col("lang").isNotNull() & F.col("text").isNotNull())
    counted = rows.mapInArrow(count_bins, "lang string, bin int, n bigint")
    return written(counted.groupBy("lang", "bin").agg(F.sum("n").alias("n")), "lang-bins")


def fit(counts: DataFrame, cells: int = CELLS) -> Model:
    """The model; its counts, at most ``cells``, come to the driver."""
    priors = sorted(counts.filter("bin = -1").select("lang", "n").limit(cells // BINS + 1).collect())
    if len(priors) * BINS > cells:
        raise ValueError(f"more than {cells // BINS} languages: raise cells")
    langs = tuple(r["lang"] for r in priors)
    table = np.zeros((BINS, len(langs)))
    rows = counts.filter("bin >= 0").toPandas()
    table[rows["bin"], [langs.index(x) for x in rows["lang"]]] = rows["n"]
    share = (table + SMOOTHING) / (table + SMOOTHING).sum(axis=0)
    texts = np.array([r["n"] for r in priors], float)
    return Model(langs, np.log(share).astype(np.float32), np.log(texts / max(texts.sum(), 1)))


def scores(texts: list[str | None], model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Log score of each text and language, and the letters of each text."""
    total, letters = np.zeros((len(texts), len(model.langs))), np.zeros(len(texts), np.int64)
    for part in blocks(texts):
        bins, starts, owners = ngrams(part)
        ends = np.append(starts[1:], bins.shape[1])
        filled = ends > starts
        if not filled.any():
            continue
        gathered = model.weights[bins[0]] + model.weights[bins[1]] + model.weights[bins[2]]
        sums = np.add.reduceat(gathered, starts[filled], axis=0, dtype=np.float64)
        owner = np.array(owners)[filled]
        np.add.at(total, owner, sums)
        np.add.at(letters, owner, (ends - starts)[filled])
    return total + model.priors, letters


def predict(texts: list[str | None], model: Model) -> list[dict]:
    if not model.langs:
        return [{"lang": UNKNOWN, "score": 0.0}] * len(texts)
    total, letters = scores(texts, model)
    best = total.argmax(axis=1)
    top = total[np.arange(len(texts)), best]
    share = 1.0 / np.exp(total - top[:, None]).sum(axis=1)
    return [{"lang": model.langs[b], "score": s} if n else {"lang": UNKNOWN, "score": 0.0}
            for b, s, n in zip(best.tolist(), share.tolist(), letters.tolist(), strict=True)]


def with_language(docs: DataFrame, model: Broadcast, text: str = "text") -> DataFrame:
    """The documents with ``lang_pred`` and ``score``, the posterior of that language."""
    def predicted(texts: pa.Array) -> pa.Array:
        return pa.array(predict(texts.to_pylist(), model.value),
                        pa.struct([("lang", pa.string()), ("score", pa.float64())]))
    found = F.arrow_udf(predicted, "struct<lang: string, score: double>")(F.col(text))
    return docs.withColumn("lang_pred", found).withColumns(
        {"score": F.col("lang_pred.score"), "lang_pred": F.col("lang_pred.lang")})


def held_out(doc_id: Column, folds: int = 3, fold: int = 1) -> Column:
    """Whether crc32 of the id as text falls into the fold; an id that is null does not."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(folds)) == fold, F.lit(False))
