"""Quality rules with thresholds that adapt to each language and source.

A document is measured over its whole text. The measures of the documents that pass the base rules
are summarised per language, source and measure in a mergeable quantile sketch: counts in
logarithmic buckets, each value within 1 % of its bucket's middle. Such sketches merge by adding
counts, so they are built with map-side sums, need no row order and are equal in every run. The
fences stand at the median plus a multiple of the distance from a low quantile to the median: low
quality lies above, so up to half of a group may be bad without moving its fence. Groups under
``min_docs`` use the merged sketch of their language, and languages under it that of all documents.

Defined results. A null or wordless text has measures of 0 and fails the base rules. Null languages
and sources are groups of their own. Equal documents get equal verdicts. An empty table gives no
rows. Very long texts are measured whole. Result columns replace input columns of the same names.
"""

from __future__ import annotations

import math
from collections import Counter
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from zonescope.llm.text import CONTINUATION, SPACE, exact, own
from zonescope.plans.workspace import written

SYMBOLS = b"#*$%&|<>"
MEASURES = "n_words n_lines word_chars n_symbols n_dup_lines n_repeat_words".split()

#: Relative error of the sketch, and the base of its buckets.
ERROR = 0.01
BASE = (1 + ERROR) / (1 - ERROR)
LEAST = 1e-6
#: The bucket of values under LEAST.
ZERO = -10_000


class Fence(NamedTuple):
    """above / below > median + spread * (median - low quantile) + slack fails."""

    measure: str
    above: str
    below: str
    spread: float
    slack: float


FENCES = (
    Fence("symbols", "n_symbols", "n_words", 4.0, 0.1),
    Fence("dup_lines", "n_dup_lines", "n_lines", 4.0, 0.4),
    Fence("repeats", "n_repeat_words", "n_words", 4.0, 0.3),
    Fence("word_length", "word_chars", "n_words", 5.0, 0.8),
)
LOW, MIDDLE = 0.05, 0.5
MIN_DOCS = 200
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50


def ratio(f: Fence) -> Column:
    return F.when(F.col(f.below) > 0, F.col(f.above) / F.col(f.below)).otherwise(0.0)


def repeat_words(words: list[bytes]) -> int:
    """Words inside 3-word windows that are found twice or more."""
    windows = list(zip(words, words[1:], words[2:], strict=False))
    if len(set(windows)) == len(windows):
        return 0
    found, covered = Counter(windows), bytearray(len(words))
    for i, window in enumerate(windows):
        if found[window] > 1:
            covered[i] = covered[i + 1] = covered[i + 2] = 1
    return sum(covered)


def measure(text: bytes | None) -> tuple[int, ...]:
    """The measures of one text, in the order of MEASURES."""
    text = text or b""
    words = text.split()  # bytes split at the six ASCII white-space characters
    lines = [line for line in text.split(b"\n") if line.strip()]
    return (
        len(words), len(lines), len(text.translate(None, SPACE + CONTINUATION)),
        len(text) - len(text.translate(None, SYMBOLS)), len(lines) - len(set(lines)),
        repeat_words(words),
    )


def measure_texts(texts: pa.Array) -> pa.Array:
    rows = [measure(t) for t in texts.cast(pa.large_binary()).to_pylist()]
    columns = zip(*rows, strict=True) if rows else [[]] * len(MEASURES)
    return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], names=MEASURES)


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents with one struct column of measures; texts alone go to Python."""
    kind = "struct<" + ", ".join(f"{m}: bigint" for m in MEASURES) + ">"
    return docs.withColumn(own("m"), F.arrow_udf(measure_texts, kind)(F.col(text)))


def with_values(
    rows: DataFrame, lang: str = "lang", source: str = "source", keep: list[str] | None = None,
) -> DataFrame:
    """Columns of the measures, base_failed, and the working columns of the fences."""
    names = rows.columns if keep is None else keep
    result = {*MEASURES, "base_failed", "kept"}
    names = [n for n in names if n.lower() not in result and n != own("m")]
    flat = rows.select(*[F.col(f"`{n}`") for n in names],
                       F.col(lang).alias(own("lang")), F.col(source).alias(own("source")),
                       F.col(f"{own('m')}.*"))
    failed = (F.col("n_words") < MIN_WORDS) | (
        100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return flat.withColumns(
        {"base_failed": failed} | {own(f.measure): ratio(f) for f in FENCES})


def bucket(value: Column) -> Column:
    """The sketch's bucket of a value of 0 or more."""
    return F.when(value < LEAST, F.lit(ZERO)).otherwise(
        F.ceil(F.log(value) / F.lit(math.log(BASE)))).cast("int")


def bucket_value(of: Column) -> Column:
    return F.when(of == ZERO, F.lit(0.0)).otherwise(
        F.pow(F.lit(BASE), of) * F.lit(2.0 / (BASE + 1)))


def sketches(values: DataFrame) -> DataFrame:
    """(lang, source, measure, bucket) -> n over the documents that pass the base rules."""
    each = F.explode(F.array(*[
        F.struct(F.lit(f.measure).alias("measure"), bucket(F.col(own(f.measure))).alias("bucket"))
        for f in FENCES])).alias("e")
    return values.filter(~F.col("base_failed")).select(own("lang"), own("source"), each).groupBy(
        own("lang"), own("source"), F.col("e.measure").alias("measure"),
        F.col("e.bucket").alias("bucket")).agg(F.count("*").alias("n"))


def quantiles(sketch: DataFrame, by: list[str]) -> DataFrame:
    """(by, measure) -> docs, low, middle from sketches merged over all else."""
    merged = sketch.groupBy(*by, "measure", "bucket").agg(F.sum("n").alias("n"))
    group = Window.partitionBy(*by, "measure")
    ranked = merged.withColumns({
        "upto": F.sum("n").over(group.orderBy("bucket")), "docs": F.sum("n").over(group)})
    at = lambda q: bucket_value(F.min(
        F.when(F.col("upto") >= F.col("docs") * F.lit(q), F.col("bucket"))))
    return ranked.groupBy(*by, "measure").agg(
        F.max("docs").alias("docs"), at(LOW).alias("low"), at(MIDDLE).alias("middle"))


def thresholds(sketch: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """One row per language and source: the highest value that passes, by measure."""
    lang, source = own("lang"), own("source")
    fine = quantiles(sketch, [lang, source])
    coarse = quantiles(sketch, [lang]).select(
        F.col(lang).alias("l"), F.col("measure").alias("lm"), F.col("docs").alias("ldocs"),
        F.col("low").alias("llow"), F.col("middle").alias("lmiddle"))
    whole = quantiles(sketch, []).select(
        F.col("measure").alias("am"), F.col("low").alias("alow"), F.col("middle").alias("amiddle"))
    joined = fine.join(coarse, exact(F.col(lang), F.col("l")) & (F.col("measure") == F.col("lm")))
    joined = joined.join(whole, F.col("measure") == F.col("am"))
    pick = lambda name: F.when(F.col("docs") >= min_docs, F.col(name)).when(
        F.col("ldocs") >= min_docs, F.col(f"l{name}")).otherwise(F.col(f"a{name}"))
    low, middle = pick("low"), pick("middle")
    fence = lambda f: F.max(F.when(
        F.col("measure") == f.measure, middle + f.spread * (middle - low) + f.slack))
    return joined.groupBy(
        F.col(lang).alias(own("l")), F.col(source).alias(own("s"))
    ).agg(*[fence(f).alias(own(f"{f.measure}_max")) for f in FENCES])


def judged(values: DataFrame, fences: DataFrame) -> DataFrame:
    """``with_values`` rows and ``kept``: not failed by the base rules, no measure over its fence."""
    joined = values.join(
        fences, exact(F.col(own("lang")), F.col(own("l")))
        & exact(F.col(own("source")), F.col(own("s"))), "left")
    passed = ~F.col("base_failed")
    for f in FENCES:
        # A group without a row has no document that passed the base rules.
        passed = passed & (F.col(own(f.measure)) <= F.col(own(f"{f.measure}_max")))
    names = [n for n in values.columns if not n.startswith(own(""))]
    return joined.select(*[F.col(f"`{n}`") for n in names],
                         F.coalesce(passed, F.lit(False)).alias("kept"))


def accepted(docs: DataFrame, lang: str = "lang", source: str = "source") -> DataFrame:
    """The documents that pass, in their own columns.

    Texts are measured once and written with their measures, so that neither the thresholds nor the
    verdicts need Python again, and no text is shuffled. Documents with null texts fail.
    """
    rows = written(measured(docs), "quality-rows")
    values = with_values(rows, lang, source, keep=[])
    fences = written(thresholds(written(sketches(values), "quality-sketch")), "quality-fences")
    row = own("row")
    packed = rows.withColumn(row, F.struct(*[F.col(f"`{n}`") for n in docs.columns]))
    values = with_values(packed, lang, source, keep=[row]).withColumnRenamed(row, "document")
    return judged(values, fences).filter("kept").select("document.*")
