"""Mix sources to target weights.

Every document has a hash-random key. Words are summed per source and key range, a prefix sum over
the ranges finds the range where a source's budget ends, and only that range is sorted: no task
holds more than one range of one source, however large the source. What is left is one row per
source (its whole epochs and the key at the cut), so documents are marked in one pass without a
shuffle of their text.

Defined results. A null text has size 0 and is never taken. Null sources are a source of their
own, the last in order. Documents with the same key (repeated rows) are cut together: each gets its
share of what is left, rounded down. An empty table gives no rows. Columns of the input stay as
they are; the four result columns replace input columns of the same names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from zonescope.llm.text import exact, n_words, own
from zonescope.plans.workspace import written

#: Hex digits of the key that name a range: 16^3 ranges per source.
RANGE_DIGITS = 3

SIZE, KEY, SOURCE, RANGE = own("size"), own("key"), own("source"), own("range")


def random_key(doc_id: Column, text: Column, seed: str) -> Column:
    """A hash-random key, the same in every run and for every order of the rows."""
    part = lambda c: F.coalesce(c, F.lit(""))
    return F.md5(F.concat(
        F.lit(f"{seed}:"), part(doc_id.cast("string")), F.lit(":"), part(F.md5(text))))


def sized(
    docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id",
    seed: str = "mix",
) -> DataFrame:
    """The documents with working columns for source, size and random key."""
    return docs.withColumns({
        SOURCE: F.col(source), SIZE: n_words(F.col(text)),
        KEY: random_key(F.col(doc_id), F.col(text), seed),
    })


def source_targets(
    sizes: DataFrame, weights: Sequence[float], share: float, limit: float,
) -> DataFrame:
    """One row per source with its size and target; the sources' rows are all that meets here.

    Sources by code point, null last, take the weights in turn. The targets sum to ``share`` times
    all sizes; none is above ``limit`` times its source, and what is over is shared again by weight
    among the others. The sources that stop at their limit are those with the least limit per
    weight, so prefix sums in that order give the level of all others at once.
    """
    if not weights or min(weights) <= 0 or not 0 < share <= limit:
        raise ValueError("weights must be positive, and share at most limit")
    by_name = Window.orderBy(F.col(SOURCE).asc_nulls_last())
    turn = F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1
    named = sizes.select(
        SOURCE, F.col("source_size"),
        F.element_at(F.array(*[F.lit(float(w)) for w in weights]), turn.cast("int")).alias("w"),
        (F.col("source_size") * F.lit(float(limit))).alias("cap"))
    by_cap = Window.orderBy(F.col("cap") / F.col("w"), F.col(SOURCE).asc_nulls_last())
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    after = by_cap.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    stepped = named.select(
        "*", F.row_number().over(by_cap).alias("step"),
        ((F.sum("source_size").over(everything) * F.lit(float(share))
          - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
         / F.sum("w").over(after)).alias("level"))
    fits = F.when(F.col("level") * F.col("w") <= F.col("cap"), F.col("step"))
    leveled = stepped.withColumn(
        "level", F.min_by("level", fits).over(everything))
    return leveled.select(
        SOURCE, "source_size",
        F.least(F.col("cap"), F.coalesce(F.col("level") * F.col("w"), F.col("cap"))).alias("target"))


def mix_plan(
    keyed: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, limit: float = 2.0,
    range_digits: int = RANGE_DIGITS,
) -> DataFrame:
    """One row per source: target, whole epochs, and where the last epoch is cut.

    ``keyed`` needs the working columns of ``sized`` only and is read twice; give it written.
    """
    ranged = keyed.select(SOURCE, SIZE, KEY, F.substring(KEY, 1, range_digits).alias(RANGE))
    sums = written(ranged.groupBy(SOURCE, RANGE).agg(F.sum(SIZE).alias("words")), "mix-ranges")
    targets = source_targets(
        sums.groupBy(SOURCE).agg(F.sum("words").alias("source_size")), weights, share, limit)
    budget = F.floor("target").cast("long")
    targets = written(targets.select(
        "*", F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size")))
        .otherwise(0).cast("long").alias("epochs")).select(
            "*", (budget - F.col("epochs") * F.col("source_size")).alias("rest")), "mix-targets")

    in_source = Window.partitionBy(sums[SOURCE]).orderBy(RANGE).rowsBetween(
        Window.unboundedPreceding, -1)
    located = sums.withColumn("before", F.coalesce(F.sum("words").over(in_source), F.lit(0)))
    rest = targets.select(F.col(SOURCE).alias("s"), "rest")
    cut_ranges = located.join(rest, exact(F.col(SOURCE), F.col("s"))).filter(
        (F.col("before") <= F.col("rest")) & (F.col("rest") < F.col("before") + F.col("words")))
    cut_ranges = written(cut_ranges.select(
        "s", F.col(RANGE).alias("r"), (F.col("rest") - F.col("before")).alias("room")), "mix-cuts")

    # Only the rows of the one range per source in which its budget ends are sorted.
    last = ranged.join(
        cut_ranges, exact(F.col(SOURCE), F.col("s")) & (F.col(RANGE) == F.col("r")))
    blocks = last.groupBy("s", "room", KEY).agg(F.sum(SIZE).alias("block"))
    in_range = Window.partitionBy("s").orderBy(KEY).rowsBetween(Window.unboundedPreceding, -1)
    cuts = blocks.withColumn(
        "left", F.col("room") - F.coalesce(F.sum("block").over(in_range), F.lit(0))).filter(
        (F.col("left") >= 0) & (F.col("left") < F.col("block")))
    cuts = cuts.select("s", F.col(KEY).alias("cut_key"), "left", "block")
    return written(targets.join(cuts, exact(F.col(SOURCE), F.col("s")), "left").select(
        F.col(SOURCE).alias(own("s")), F.col("source_size").alias(own("source_size")),
        F.col("target").alias(own("target")), F.col("epochs").alias(own("epochs")),
        F.col("cut_key").alias(own("cut_key")), F.col("left").alias(own("left")),
        F.col("block").alias(own("block"))), "mix-plan")


def mix(keyed: DataFrame, plan: DataFrame) -> DataFrame:
    """The documents of ``sized`` with size, source_size, target and taken.

    ``plan`` has one row per source; Spark broadcasts it when the written table is under the
    session's threshold and else shuffles.
    """
    c = lambda name: F.col(own(name))
    part = (F.when(F.col(KEY) < c("cut_key"), F.col(SIZE))
            .when(F.col(KEY) == c("cut_key"),
                  F.expr(f"{SIZE} * {own('left')} div {own('block')}"))
            .otherwise(0))
    marked = keyed.join(plan, exact(F.col(SOURCE), c("s")))
    results = {
        "size": F.col(SIZE), "source_size": c("source_size"), "target": c("target"),
        "taken": F.col(SIZE) * c("epochs") + part,
    }
    names = [n for n in keyed.columns if n not in (SIZE, KEY, SOURCE) and n.lower() not in results]
    return marked.select(*[F.col(f"`{n}`") for n in names],
                         *[v.cast("double" if k == "target" else "long").alias(k)
                           for k, v in results.items()])


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix as documents: each as often as the mix takes it, in the columns of ``docs``.

    Documents stay whole. The one at a source's cut counts when at least half of it is taken, so a
    source is off its budget by half a document at most. Rows with the key at the cut (repeats of one
    id and text) are numbered, partition by partition, and the first of them are taken.
    """
    plan = mix_plan(written(sized(docs).select(SOURCE, SIZE, KEY), "mix-sizes"), **options)
    c = lambda name: F.col(own(name))
    kept, copies = own("row"), own("copies")
    packed = docs.withColumn(kept, F.struct(*[F.col(f"`{n}`") for n in docs.columns]))
    joined = sized(packed).join(plan, exact(F.col(SOURCE), c("s"))).filter(F.col(SIZE) > 0)
    at_cut = F.col(KEY).eqNullSafe(c("cut_key"))
    before_cut = F.coalesce(F.col(KEY) < c("cut_key"), F.lit(False)).cast("int")
    whole = joined.filter(~at_cut).select(kept, (c("epochs") + before_cut).alias(copies))

    cut = written(joined.filter(at_cut).select(
        kept, SOURCE, c("epochs"), F.round(c("left") / F.col(SIZE)).alias(own("more")),
        F.monotonically_increasing_id().alias(own("place"))), "mix-cut").withColumn(
        own("part"), F.shiftright(own("place"), 33))
    parts = cut.groupBy(SOURCE, own("part")).agg(F.count("*").alias(own("n")))
    earlier = Window.partitionBy(SOURCE).orderBy(own("part")).rowsBetween(
        Window.unboundedPreceding, -1)
    parts = written(parts.select(
        F.col(SOURCE).alias(own("ps")), c("part").alias(own("pp")),
        F.coalesce(F.sum(own("n")).over(earlier), F.lit(0)).alias(own("before"))), "mix-cut-parts")
    in_part = Window.partitionBy(SOURCE, own("part")).orderBy(own("place"))
    numbered = cut.withColumn(own("i"), F.row_number().over(in_part)).join(
        parts, exact(F.col(SOURCE), c("ps")) & (c("part") == c("pp")))
    taken = (c("before") + c("i") <= c("more")).cast("int")
    rows = whole.unionByName(numbered.select(kept, (c("epochs") + taken).alias(copies)))
    repeated = rows.filter(c("copies") >= 1).select(
        kept, F.explode(F.sequence(F.lit(1), c("copies").cast("int"))).alias(own("copy")))
    return repeated.select(f"{kept}.*")
