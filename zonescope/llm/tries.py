"""Prefix tries over conversations that share their heads.

Every conversation is rebuilt from the head of a base conversation and its own later turns, and each
distinct sequence of first turns is a node. No rebuilt text is made. A turn has a hash element, and
a sequence of turns the pair (length n, sum of element i times r^i modulo a prime, in four lanes):
a monoid, as (n, g) * (m, f) = (n + m, g + r^n f). A conversation's prefix products come from one
scan of its own turns; the product of head and suffix is worked out from three of them. Sequences
with equal products form a node. The turns that end a node's members are compared by their texts,
through the references (row keys) that the members keep, wherever a node has several of them; if two
differ, all is done again with other elements.

Size. Turns are dealt by (conversation, turn) ranges, so a long conversation is scanned in many
blocks whose products are combined; members per node are counted with map-side sums; the
ids that end in a node are packed 4096 to a row before their digest, which one task reads as a
stream. Sums over subtrees need no pass per level: each node's amount goes to its smallest member,
and a node adds the suffix sums of its members.

Defined results. Rows with a null conv_id take no part; every other id is a conversation. Null turns
come first; turns of equal number go by the MD5 of role and text, and repeated rows are repeated turns.
Null roles and texts are empty. Texts of any length are hashed whole. An empty table gives no rows, as
there is no conversation that starts at the root. Other columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from zonescope.operators.joins import spread_join
from zonescope.plans.workspace import written

PRIME = (1 << 31) - 1
#: One base per lane (any numbers under the prime would do).
BASES = (1_103_515_245, 1_664_525_013, 742_938_285, 1_583_458_089)
LANES = range(len(BASES))
#: A head has fewer turns than this.
HEADS = 6
#: Conversations share the head of the first of so many ids.
GROUP = 100
#: Ids that end in a node and are packed in one row, and depths of a conversation in one window.
PACK, STRETCH = 4096, 1 << 16
KEY = ["depth", "k1", "k2"]


def texts_of(rows: DataFrame) -> DataFrame:
    """(conv, turn, tie, ref, role, text); ``ref`` names a turn inside its conversation."""
    said = rows.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv"), F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    whole = F.concat(F.col("role").cast("binary"), F.lit(b"\x00"), F.col("text").cast("binary"))
    return said.withColumn("tie", F.unhex(F.md5(whole))).withColumn(
        "ref", F.xxhash64("turn", "tie"))


def turns_of(rows: DataFrame, seed: int) -> DataFrame:
    """(conv, turn, tie, ref, chars, a, b): order, name and hash elements of each turn."""
    return texts_of(rows).select(
        "conv", "turn", "tie", "ref", F.length("text").cast("long").alias("chars"),
        F.xxhash64(F.lit(seed), "role", "text").alias("a"),
        F.xxhash64(F.lit(~seed), "text", "role").alias("b"))


def power(base: int, exponents: np.ndarray) -> np.ndarray:
    """base ** exponents modulo the prime, by squaring."""
    out, square, left = np.ones(len(exponents), np.int64), base, exponents.copy()
    while left.any():
        out = np.where(left & 1, out * square % PRIME, out)
        square, left = square * square % PRIME, left >> 1
    return out


SCAN = "conv long, place long, ref long, chars long, block int, " + ", ".join(
    f"g{i} long, w{i} long" for i in LANES)
COLUMNS = ["conv", "place", "ref", "chars", "block", *(f"{x}{i}" for i in LANES for x in "gw")]


def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Places and prefix products inside a block; ``w`` is what a turn adds to its product."""
    last, place, sums = None, 0, np.zeros(len(BASES), np.int64)
    for batch in batches:
        if not batch.num_rows:
            continue
        conv, ref, chars, a, b, block = (
            batch.column(n).to_numpy() for n in ("conv", "ref", "chars", "a", "b", "block"))
        new = np.concatenate([[conv[0] != last], conv[1:] != conv[:-1]])
        first = np.maximum.accumulate(np.where(new, np.arange(len(conv)), -1))
        carried = first < 0
        places = np.arange(len(conv)) - first + np.where(carried, place, 1)
        out = [conv, places, ref, chars, block]
        elements = [a, a >> 31, b, b >> 31]
        for i, base in enumerate(BASES):
            added = ((elements[i] & PRIME) % (PRIME - 1) + 1) * power(base, places) % PRIME
            upto = np.cumsum(added)
            before = np.where(carried, -sums[i], (upto - added)[np.maximum(first, 0)])
            whole = (upto - before) % PRIME
            out += [whole, added]
            sums[i] = whole[-1]
        last, place = conv[-1], int(places[-1])
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in out], names=COLUMNS)


def lanes(of) -> list[Column]:
    return [of(i).alias(f"g{i}") for i in LANES]


def powers(exponent: str, i: int) -> Column:
    """The base of a lane to an exponent under 2^30, by five bits at a time."""
    out = F.lit(1).cast("long")
    for shift in range(0, 30, 5):
        step = pow(BASES[i], 1 << shift, PRIME)
        table = ", ".join(f"{pow(step, n, PRIME)}L" for n in range(32))
        out = out * F.expr(
            f"get(array({table}), cast(shiftright({exponent}, {shift}) & 31 as int))") % PRIME
    return out


def prefixes(turns: DataFrame) -> DataFrame:
    """(conv, block, place, ref, chars, g*, w*): each turn with its place and prefix product."""
    order = [F.col("conv"), F.col("turn").asc_nulls_first(), F.col("tie")]
    parts = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    local = written(
        turns.repartitionByRange(parts, *order).sortWithinPartitions(*order)
        .withColumn("block", F.spark_partition_id()).drop("turn", "tie")
        .mapInArrow(scan, SCAN), "trie-blocks")
    ends = local.groupBy("conv", "block").agg(
        F.max("place").alias("n"), *(F.max_by(f"g{i}", "place").alias(f"g{i}") for i in LANES))
    ends = written(ends, "trie-ends")
    several = ends.groupBy("conv").agg(F.count("*").alias("blocks")).filter("blocks > 1").select("conv")
    before = Window.partitionBy("conv").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    split = ends.join(several, "conv").withColumn("offset", F.coalesce(
        F.sum("n").over(before), F.lit(0)))
    split = split.withColumns({f"move{i}": powers("offset", i) for i in LANES})
    carry = written(split.select("conv", "block", "offset", *(f"move{i}" for i in LANES), *(
        (F.coalesce(F.sum(F.col(f"g{i}") * F.col(f"move{i}") % PRIME).over(before), F.lit(0)) % PRIME)
        .alias(f"before{i}") for i in LANES)).filter("offset > 0"), "trie-carry")
    # One row per block at most, as only its first conversation can have begun before.
    joined = local.join(carry, ["conv", "block"], "left")
    moved = lambda name, i: F.when(F.col("offset").isNull(), F.col(name)).otherwise(
        F.col(name) * F.col(f"move{i}") % PRIME)
    return written(joined.select(
        "conv", "block", (F.col("place") + F.coalesce("offset", F.lit(0))).alias("place"), "ref",
        "chars", *lanes(lambda i: (moved(f"g{i}", i) + F.coalesce(f"before{i}", F.lit(0))) % PRIME),
        *(moved(f"w{i}", i).alias(f"w{i}") for i in LANES)), "trie-prefixes")


def rebuilt(table: DataFrame) -> DataFrame:
    """(conv, depth, k1, k2, p1, p2, chars, of, ref, ends): every prefix of every rebuilt conversation.

    ``p1`` and ``p2`` are the products of the prefix one turn shorter, ``ends`` marks the last turn;
    ``of`` and ``ref`` refer to the row of the prefix's last turn.
    """
    heads = F.array_sort(F.collect_list(F.when(F.col("place") < HEADS, F.struct(
        "place", "ref", "chars", *(f"g{i}" for i in LANES), *(f"w{i}" for i in LANES)))))
    convs = written(table.groupBy("conv").agg(
        F.max("place").alias("n"), heads.alias("own")), "trie-convs")
    digits = F.col("conv").cast("string").cast("binary")
    shared = convs.withColumns({
        "h": (F.crc32(digits) % HEADS).cast("int"), "base": F.col("conv") - F.col("conv") % GROUP})
    base = convs.select(F.col("conv").alias("base"), F.col("own").alias("head"))
    joined = shared.join(base, "base", "left").withColumn(
        "head", F.coalesce(F.slice("head", F.lit(1), F.col("h")), F.slice("own", 1, 0)))
    b = F.size("head").cast("long")
    at_end = lambda items, i, of: F.coalesce(
        F.get(items, of - 1)[f"g{i}"], F.lit(0))
    info = written(joined.select(
        "conv", "n", "h", "base", "head", b.alias("b"),
        (b + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length"),
        *(at_end(F.col("head"), i, F.size("head")).alias(f"head{i}") for i in LANES),
        *(at_end(F.col("own"), i, F.least(F.size("own"), F.col("h"))).alias(f"cut{i}")
          for i in LANES)), "trie-info")

    def keys(product, added) -> list[Column]:
        two = lambda v, i: F.shiftleft(v(i), 31).bitwiseOR(v(i + 1))
        parent = lambda i: F.pmod(product(i) - added(i), F.lit(PRIME))
        return [two(product, 0).alias("k1"), two(product, 2).alias("k2"),
                two(parent, 0).alias("p1"), two(parent, 2).alias("p2")]

    zero = lambda i: F.lit(0).cast("long")
    ends = (F.col("depth") == F.col("length")).alias("ends")
    null = F.lit(None).cast("long")
    root = info.withColumn("depth", F.lit(0).cast("long")).select(
        "conv", "depth", *keys(zero, zero), F.lit(0).cast("long").alias("chars"),
        null.alias("of"), null.alias("ref"), ends)
    of_head = info.select("conv", "length", "base", F.explode("head").alias("t")).withColumn(
        "depth", F.col("t.place")).select(
        "conv", "depth", *keys(lambda i: F.col(f"t.g{i}"), lambda i: F.col(f"t.w{i}")),
        "t.chars", F.col("base").alias("of"), "t.ref", ends)
    # Joined by block, so that a long conversation is many keys.
    blocks = table.groupBy("conv", "block").agg(F.max("place").alias("most"))
    tails = blocks.join(info.drop("head", "n", "base"), "conv").filter("most > h").drop("most")
    own = table.join(tails, ["conv", "block"]).filter("place > h").withColumns({
        "depth": F.col("place") - F.col("h") + F.col("b"), "back": (F.col("h") - F.col("b")).cast("int")})
    shift = [F.lit([pow(BASES[i], -n, PRIME) for n in range(HEADS)]) for i in LANES]
    shifted = lambda v, i: v * F.get(shift[i], F.col("back")) % PRIME
    tail = own.select("conv", "depth", *keys(
        lambda i: (F.col(f"head{i}") + shifted(
            F.pmod(F.col(f"g{i}") - F.col(f"cut{i}"), F.lit(PRIME)), i)) % PRIME,
        lambda i: shifted(F.col(f"w{i}"), i)), "chars", F.col("conv").alias("of"), "ref", ends)
    return written(root.unionByName(of_head).unionByName(tail), "trie-paths")


def clashes(rows: DataFrame, paths: DataFrame, nodes: DataFrame) -> DataFrame:
    """The nodes whose members end in different turns, by the texts that their references name."""
    doubtful = nodes.filter("low_ref != high_ref or low_of != high_of")
    refs = spread_join(
        paths.select(*KEY, "of", "ref"), doubtful.select(*KEY), KEY, row_id=["of"],
        counts=doubtful.select(*KEY, F.col("n_convs").alias("n"))).distinct()
    said = texts_of(rows).select(F.col("conv").alias("of"), "ref", "role", "text")
    return refs.join(said, ["of", "ref"]).groupBy(*KEY).agg(
        F.min("role").alias("r0"), F.max("role").alias("r1"),
        F.min("text").alias("t0"), F.max("text").alias("t1"),
    ).filter("r0 != r1 or t0 != t1")


def streamed_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The SHA-256 of each node's packed ids, which come in order."""
    key, state, out = None, None, []

    def flushed():
        columns = list(zip(*out, strict=True)) if out else [[]] * 4
        return pa.RecordBatch.from_arrays(
            [*(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3], pa.string())],
            names=[*KEY, "ends_sha256"])

    for batch in batches:
        for *at, ids in zip(*(batch.column(n).to_pylist() for n in (*KEY, "ids")), strict=True):
            if at == key:
                state.update(b"," + ids.encode())
            else:
                if key is not None:
                    out.append((*key, state.hexdigest()))
                key, state = at, hashlib.sha256(ids.encode())
        yield flushed()
        out = []
    if key is not None:
        out.append((*key, state.hexdigest()))
    yield flushed()


def end_digests(paths: DataFrame) -> DataFrame:
    """(key, ends_sha256) of the nodes in which a conversation ends."""
    packs = paths.filter("ends").groupBy(
        *KEY, F.floor(F.col("conv") / PACK).alias("pack")).agg(F.array_join(F.transform(
            F.array_sort(F.collect_list("conv")), lambda c: c.cast("string")), ",").alias("ids"))
    return packs.repartition(*KEY).sortWithinPartitions(*KEY, "pack").select(
        *KEY, "ids").mapInArrow(streamed_digests, "depth long, k1 long, k2 long, ends_sha256 string")


def subtree_sums(paths: DataFrame, nodes: DataFrame) -> DataFrame:
    """(key, n_leaves, saved_tokens) over the subtree of each node.

    A node's amounts stand at (its smallest member, its depth). What a member adds to a node is the
    sum of its amounts from the node's depth on.
    """
    zero = F.lit(0).cast("long")
    amounts = nodes.select(
        F.col("conv_id").alias("conv"), "depth", *(F.lit(None).cast("long").alias(k) for k in KEY[1:]),
        ((F.col("n_convs") - 1) * F.col("chars")).alias("saved"),
        (F.col("n_ends") == F.col("n_convs")).cast("long").alias("leaf"))
    stretch = F.floor(F.col("depth") / STRETCH)
    both = paths.select("conv", *KEY, zero.alias("saved"), zero.alias("leaf")).unionByName(
        amounts).withColumn("stretch", stretch)
    downward = Window.partitionBy("conv", "stretch").orderBy(F.desc("depth")).rangeBetween(
        Window.unboundedPreceding, Window.currentRow)
    summed = both.select(
        "conv", "stretch", *KEY, F.sum("saved").over(downward).alias("saved"),
        F.sum("leaf").over(downward).alias("leaf")).filter("k1 is not null")
    # Only conversations of several stretches have amounts beyond the stretch of a row.
    long = written(paths.filter(F.col("depth") >= STRETCH).select("conv").distinct(), "trie-long")
    deeper = Window.partitionBy("conv").orderBy(F.desc("stretch")).rowsBetween(
        Window.unboundedPreceding, -1)
    upper = both.join(long, "conv", "left_semi").groupBy("conv", "stretch").agg(
        F.sum("saved").alias("s"), F.sum("leaf").alias("l")).select(
        "conv", "stretch", F.sum("s").over(deeper).alias("more_saved"),
        F.sum("l").over(deeper).alias("more_leaves"))
    whole = summed.join(written(upper, "trie-stretches"), ["conv", "stretch"], "left")
    return whole.groupBy(*KEY).agg(
        F.sum(F.col("leaf") + F.coalesce("more_leaves", zero)).alias("n_leaves"),
        F.sum(F.col("saved") + F.coalesce("more_saved", zero)).alias("saved_tokens"))


def prefix_trie(rows: DataFrame) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens and ends_sha256. ``rows`` has conv_id, turn, role and text."""
    rows = rows.select("conv_id", "turn", "role", "text")
    for seed in count():
        paths = rebuilt(prefixes(turns_of(rows, seed)))
        nodes = written(paths.groupBy(*KEY).agg(
            F.min("conv").alias("conv_id"), F.count("*").alias("n_convs"),
            F.sum(F.col("ends").cast("long")).alias("n_ends"), F.max("chars").alias("chars"),
            F.min("p1").alias("p1"), F.max("p1").alias("q1"), F.min("p2").alias("p2"),
            F.max("p2").alias("q2"), F.min("ref").alias("low_ref"), F.max("ref").alias("high_ref"),
            F.min("of").alias("low_of"), F.max("of").alias("high_of")), "trie-nodes")
        if nodes.filter("p1 != q1 or p2 != q2").isEmpty() and clashes(
                rows, paths, nodes).isEmpty():
            break
    null = lambda kind, name: F.lit(None).cast(kind).alias(name)
    longs = ["conv_id", "n_convs", "n_leaves", "saved_tokens", "n_children", "p1", "p2"]

    def part(frame: DataFrame, **given: Column) -> DataFrame:
        named = lambda n, kind: given[n].alias(n) if n in given else (
            F.col(n) if n in frame.columns else null(kind, n))
        return frame.select(*(named(n, "long") for n in [*KEY, *longs]),
                            named("ends_sha256", "string"))

    children = part(nodes.filter("depth > 0").select(
        F.col("depth") - 1, "p1", "p2").toDF(*KEY), n_children=F.lit(1).cast("long"))
    merged = written(part(nodes).unionByName(part(subtree_sums(paths, nodes))).unionByName(
        children).unionByName(part(end_digests(paths))).groupBy(*KEY).agg(
        *(F.max(n).alias(n) for n in longs if n != "n_children"),
        F.sum("n_children").alias("n_children"), F.max("ends_sha256").alias("ends_sha256")),
        "trie-merged")
    above = merged.filter("n_children > 0")
    parents = above.select(*KEY, F.col("conv_id").alias("parent_conv_id"))
    below = merged.withColumnsRenamed({"depth": "d", "k1": "own1", "k2": "own2"}).withColumns(
        {"depth": F.col("d") - 1, "k1": F.col("p1"), "k2": F.col("p2")})
    found = spread_join(below, parents, KEY, "left", ["own1"], counts=above.select(
        *KEY, F.col("n_children").alias("n")))
    return found.select(
        "conv_id", F.col("d").alias("depth"), "parent_conv_id", "n_convs",
        F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"), "n_leaves",
        "saved_tokens", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"))
