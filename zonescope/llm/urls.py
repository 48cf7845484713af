"""Judge urls by rules on host and path, as a sort-merge range join.

The key of a url is its host with the labels reversed, each closed by a character below all others,
and then its path: ``com`` ``example`` ``www`` ``/a``. A host with all its subdomains is then one
interval of keys, and the intervals of two hosts are nested or apart. Urls and rules are dealt to
key ranges, each rule to all ranges that its interval meets, and sorted; one sweep over a range keeps
a stack of the hosts that hold the present key. The path of a rule is compared for the hosts on the
stack, deepest first.

The bounds of the ranges are quantiles of a bounded sample of keys (about ``SAMPLE``); they only
balance the work. A host with a third of all urls is spread over ranges by its paths; equal urls are
counted as one row before the sort and joined back by the url.

Defined results. A url that is null or has no ``://`` has an empty host and path; no rule fits it. A
rule on the longer host wins, then the one with the longer path, then ``block``. Equal rules count
once; rules without a host or path, or with another verdict, fit nothing. Without rules every url
gets the default. An empty table gives no rows. Extra columns stay;
host, path, rule and verdict replace input columns of those names.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zonescope.llm.text import exact, own
from zonescope.plans.workspace import written

#: Closes a label in a key; it sorts before every character that a label may hold.
CLOSE, ABOVE = "\x01", "\x02"
#: Keys sampled, about, to set the bounds of the ranges, and characters of a bound.
SAMPLE = 20_000
BOUND_CHARS = 64
RANGES = 1024

Rule = tuple[str, str, str]  # verdict, host, path


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; else empty."""
    host = F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"),
                      F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host, up to ?, # or the end."""
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def host_key(host: Column) -> Column:
    """The labels reversed and closed. A host that holds CLOSE itself shares a key with others; the
    sweep compares the host."""
    labels = F.reverse(F.split(F.translate(host, CLOSE, ABOVE), r"\."))
    return F.when(host == "", F.lit("")).otherwise(
        F.concat(F.concat_ws(CLOSE, labels), F.lit(CLOSE)))


def rule_table(spark, rules: Iterable[Rule]) -> DataFrame:
    return spark.createDataFrame(list(rules), "verdict string, host string, path string")


def range_bounds(keys: DataFrame, ranges: int, sample: int) -> list[str]:
    """Keys that cut the rows into about equal ranges, from a random sample of bounded size."""
    every = max(1, keys.count() // sample)
    rows = keys.filter(F.pmod(F.xxhash64("key"), F.lit(every)) == 0).select(
        F.substring("key", 1, BOUND_CHARS).alias("key")).limit(2 * sample).collect()
    found = sorted(r["key"] for r in rows)
    step = max(1, len(found) // ranges)
    return sorted(set(found[step::step]))


def range_finder(bounds: list[str]):
    """The number of bounds at or below a key; strings sort by code point here and in Spark."""
    @F.arrow_udf("int")
    def find(keys: pa.Array) -> pa.Array:
        return pa.array([bisect_right(bounds, k) for k in keys.to_pylist()], pa.int32())
    return find


def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by (part, key, rules first). The stack holds the hosts that hold the key."""
    at, stack = None, []
    for batch in batches:
        out = []
        for part, key, host, path, verdict in zip(
                *[batch.column(n).to_pylist() for n in ("part", "key", "host", "path", "verdict")],
                strict=True):
            if part != at:
                at, stack = part, []
            while stack and not key.startswith(stack[-1][0]):
                stack.pop()
            if verdict is not None:  # a rule: the key is its host's
                if not stack or stack[-1][0] != key:
                    stack.append((key, []))
                stack[-1][1].append((host, path, verdict))
                continue
            rule = decided = None
            for _, rules in reversed(stack):
                fits = [(len(p), v == "block", h + p, v) for h, p, v in rules
                        if path.startswith(p) and (host == h or host.endswith("." + h))]
                if fits:
                    *_, rule, decided = max(fits)
                    break
            out.append((host, path, rule, decided))
        columns = list(zip(*out, strict=True)) or [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns],
                                         names=["host", "path", "rule", "verdict"])


def judged_urls(
    pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow",
    ranges: int = RANGES, sample: int = SAMPLE,
) -> DataFrame:
    """The pages with host, path, rule and verdict."""
    parts = pages.select(host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    urls = written(parts.distinct().withColumn(
        "key", F.concat(host_key(F.col("host")), "path")), "urls")
    range_of = range_finder(range_bounds(urls.select("key"), ranges, sample))
    rules = rules.filter((F.col("host") != "") & F.col("path").isNotNull()
                         & F.col("verdict").isin("allow", "block")).distinct()
    rules = rules.withColumn("key", host_key(F.col("host"))).withColumn(
        "above", F.concat(F.expr("substring(key, 1, length(key) - 1)"), F.lit(ABOVE)))
    spread = rules.withColumns({"low": range_of("key"), "high": range_of("above")}).withColumn(
        "part", F.explode(F.sequence("low", "high")))
    columns = ["part", "key", "host", "path", "verdict"]
    rows = urls.withColumns({
        "part": range_of("key"), "verdict": F.lit(None).cast("string"),
    }).select(*columns).unionByName(spread.select(*columns))
    swept = rows.repartition(F.col("part")).sortWithinPartitions(
        "part", "key", F.col("verdict").isNull(), "path", "verdict",
    ).mapInArrow(sweep, "host string, path string, rule string, verdict string")
    decided = swept.filter(F.col("rule").isNotNull()).select(
        F.col("host").alias(own("h")), F.col("path").alias(own("p")),
        F.col("rule").alias(own("rule")), F.col("verdict").alias(own("verdict")))
    names = [n for n in pages.columns if n.lower() not in ("host", "path", "rule", "verdict")]
    found = pages.withColumns({own("host"): host_of(F.col(url)), own("path"): path_of(F.col(url))})
    return found.join(
        decided, exact(F.col(own("host")), F.col(own("h")))
        & exact(F.col(own("path")), F.col(own("p"))), "left").select(
            *[F.col(f"`{n}`") for n in names], F.col(own("host")).alias("host"),
            F.col(own("path")).alias("path"), F.col(own("rule")).alias("rule"),
            F.coalesce(own("verdict"), F.lit(default)).alias("verdict"))
