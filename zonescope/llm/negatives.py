"""Hard-negative mining: for each anchor and positive, the best rows of other labels in a score window.

Scores are exact integer inner products. An anchor's positives are its best rows of its own label. A
positive's window ends at the positive's score; the windows of an anchor overlap, so their upper
limits cut the scores into disjoint slots, (next lower limit, limit]. The best k rows are kept per slot
(in the task, as rows stream by, and again where tasks meet). The best k under a limit are then the
first k of its slot and all lower ones, in order: one merge answers every window, and its lower end
only cuts the tail.

Size. Anchors are a stated query set and meet all rows in blocks: a task holds ``ANCHORS`` anchors and
streams the rows of one part past them. Blocks and parts are dealt by hash, after equal rows are made
one, so no label or vector makes a block larger. Partial results are merged part group by part group.

Defined results. Rows without an id, or with a null label, a null vector, or a null or non-finite
component take no part. Rows equal in all columns used count once; rows that share an id are no
partners of each other. Only vectors of equal length meet. Scores of equal height go by the smaller id.
Scores beyond +-2^50 count as +-2^50. A positive with a negative score has an empty window. Anchors
without positives, and empty tables, give no rows. Other columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zonescope.plans.workspace import written

#: Anchors of a block, rows of a part, and rows that are scored at a time.
ANCHORS, PART, CHUNK = 1024, 16_384, 2048
#: Parts whose partial results are merged at once.
MERGE = 256
MOST = 1 << 50
FOUND = "anchor_id long, anchor_key long, part int, slot int, score long, id long"


def quantised(vectors: DataFrame, scale: int) -> DataFrame:
    """(id, label, vector) -> (id, label, q, dims, key): the rows that take part, each once."""
    sound = F.forall("vector", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(np.inf)))
    # From 2^52 on every double is whole; floor() itself gives a 64-bit integer.
    whole = lambda v: F.when(
        F.abs(v) < F.lit(2.0 ** 52), F.floor(v).cast("double")).otherwise(v)
    rows = vectors.filter("id is not null and label is not null").filter(
        F.coalesce(sound, F.lit(False)))
    rows = rows.select("id", "label", F.transform(
        "vector", lambda v: whole(v * F.lit(float(scale)))).alias("q")).distinct()
    return rows.select("id", "label", "q", F.size("q").alias("dims"),
                       F.xxhash64("label", "q").alias("key"))


def scores(anchors: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Exact inner products, in floating point where no sum can pass 2^53, else in whole numbers."""
    high = lambda m: float(np.abs(m).max(initial=0.0))
    if high(anchors) * high(rows) * max(1, anchors.shape[1]) < 2.0 ** 53:
        found = anchors @ rows.T
    else:
        whole = lambda m: np.array([[int(v) for v in r] for r in m], object).reshape(m.shape)
        found = whole(anchors) @ whole(rows).T
    return np.clip(found, -MOST, MOST).astype(np.int64)


class Best:
    """The best k (score, id) per anchor and slot."""

    def __init__(self, anchors: int, slots: int, k: int):
        self.k, self.shape = k, (anchors, slots)
        self.least = np.full(self.shape, -(1 << 62))  # what a full slot asks of another entry
        self.held = [np.empty(0, np.int64) for _ in range(4)]

    def offer(self, *entries: np.ndarray) -> None:
        """Entries as arrays: anchor, slot, score, id."""
        anchor, slot, score, ids = (np.concatenate(p) for p in zip(self.held, entries, strict=True))
        order = np.lexsort((ids, -score, slot, anchor))
        group = (anchor * self.shape[1] + slot)[order]
        first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if len(
            group) else np.empty(0, np.int64)
        rank = np.arange(len(group)) - np.repeat(first, np.diff([*first, len(group)]))
        order, rank = order[rank < self.k], rank[rank < self.k]
        self.held = [c[order] for c in (anchor, slot, score, ids)]
        full = order[rank == self.k - 1]
        self.least[anchor[full], slot[full]] = score[full]


class Block:
    """Anchors that the rows of a part stream past."""

    def __init__(self, k: int, slots: int, same: bool, low: int):
        self.k, self.slots, self.same, self.low, self.parts = k, slots, same, low, []
        self.best: Best | None = None

    def add(self, ids, labels, keys, vectors, limits) -> None:
        self.parts.append((ids, labels, keys, vectors, limits))

    def meet(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray) -> None:
        if not self.parts:
            return
        if self.best is None:
            self.ids, self.labels, self.keys, self.vectors, self.limits = (
                np.concatenate(c) for c in zip(*self.parts, strict=True))
            self.best = Best(len(self.ids), self.slots, self.k)
        for at in range(0, len(ids), CHUNK):
            cut = slice(at, at + CHUNK)
            score = scores(self.vectors, vectors[cut])
            alike = self.labels[:, None] == labels[None, cut]
            if self.same:
                slot = np.zeros(score.shape, np.int8)
                good = alike & (self.ids[:, None] != ids[None, cut])
            else:
                # Limits go down, so the last one that is not under the score is the slot's.
                slot = np.full(score.shape, -1, np.int8)
                for j in range(self.slots):
                    slot += score <= self.limits[:, j, None]
                low = np.where(self.limits >= 0, self.limits, MOST).min(axis=1)
                good = ~alike & (slot >= 0) & (100 * score >= self.low * low[:, None])
            good &= score >= np.take_along_axis(self.best.least, np.maximum(slot, 0).astype(
                np.int64), axis=1)
            i, j = np.nonzero(good)
            self.best.offer(i, slot[i, j].astype(np.int64), score[i, j], ids[cut][j])

    def rows(self, part: int) -> pa.RecordBatch | None:
        if self.best is None:
            return None
        anchor, slot, score, ids = self.best.held
        return pa.RecordBatch.from_arrays(
            [pa.array(self.ids[anchor]), pa.array(self.keys[anchor]),
             pa.array(np.full(len(anchor), part, np.int32)), pa.array(slot.astype(np.int32)),
             pa.array(score), pa.array(ids)],
            names=["anchor_id", "anchor_key", "part", "slot", "score", "id"])


def found(
    vectors: DataFrame, anchors: DataFrame, blocks: int, parts: int, k: int, slots: int,
    same: bool, low: int = 0,
) -> DataFrame:
    """(anchor_id, anchor_key, slot, top): the best k rows per anchor and slot, by falling score.

    ``anchors`` are rows with ``limits``, falling numbers, -1 where there are no more. ``low`` is the
    percentage of the least limit under which no score counts.
    """
    hashed = lambda n: F.pmod(F.xxhash64("id", "key"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    held = anchors.select("dims", hashed(blocks).alias("block"), "id", "label", "key", "q", "limits",
                          every(parts).alias("part"), F.lit(0).alias("kind"))
    moving = vectors.select("dims", every(blocks).alias("block"), "id", "label", "key", "q",
                            F.lit(None).cast("array<long>").alias("limits"),
                            hashed(parts).alias("part"), F.lit(1).alias("kind"))
    place = ["dims", "block", "part"]

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, block = None, None
        for batch in batches:
            columns = [batch.column(n).to_numpy() for n in (*place, "kind", "id", "label", "key")]
            whole = np.stack(columns[:4])
            cuts = [0, *(np.flatnonzero((whole[:, 1:] != whole[:, :-1]).any(axis=0)) + 1).tolist(),
                    batch.num_rows]
            for i, j in zip(cuts[:-1], cuts[1:], strict=True):
                if i == j:
                    continue
                now = tuple(whole[:3, i].tolist())
                if now != at:
                    if block is not None and (rows := block.rows(at[2])) is not None:
                        yield rows
                    at, block = now, Block(k, slots, same, low)
                some = batch.slice(i, j - i)
                q = some.column("q").flatten().to_numpy().reshape(j - i, now[0])
                ids, labels, keys = (c[i:j] for c in columns[4:])
                if whole[3, i]:
                    block.meet(ids, labels, q)
                else:
                    limits = some.column("limits").flatten().to_numpy().reshape(j - i, -1)
                    block.add(ids, labels, keys, q, limits)
        if block is not None and (rows := block.rows(at[2])) is not None:
            yield rows

    both = held.unionByName(moving).repartition(*place).sortWithinPartitions(*place, "kind")
    partial = both.mapInArrow(stream, FOUND)
    entry = F.struct((-F.col("score")).alias("fall"), "id")
    top = lambda entries: F.slice(F.array_sort(entries), 1, k)
    by = ["anchor_id", "anchor_key", "slot"]
    merged = partial.groupBy(*by, F.floor(F.col("part") / MERGE).alias("group")).agg(
        top(F.collect_list(entry)).alias("top"))
    return merged.groupBy(*by).agg(top(F.flatten(F.collect_list("top"))).alias("top"))


def hard_negatives(
    vectors: DataFrame, is_anchor: Column, vec_id: str = "vec_id", label: Column | str = "label",
    vector: str = "embedding", scale: int = 256, positives: int = 5, k: int = 5, low: int = 80,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``is_anchor`` is a condition on the column ``id``. Components become floor(scale * x). For each
    anchor and each of its first ``positives`` rows of the same label: its first ``k`` rows of other
    labels with low * positive_score <= 100 * negative_score <= 100 * positive_score.
    """
    label = F.col(label) if isinstance(label, str) else label
    table = written(quantised(vectors.select(
        F.col(vec_id).cast("long").alias("id"), label.cast("long").alias("label"),
        F.col(vector).cast("array<double>").alias("vector")), scale), "mine-rows")
    anchors = written(table.filter(is_anchor), "mine-anchors")
    blocks = max(1, -(-anchors.count() // ANCHORS))
    parts = max(1, -(-table.count() // PART))

    none = anchors.withColumn("limits", F.array(F.lit(-1).cast("long")))
    near = written(found(table, none, blocks, parts, positives, 1, True), "mine-positives")
    limits = F.array_sort(F.array_distinct(F.filter(
        F.transform("top", lambda e: e["fall"]), lambda f: f <= 0)))
    padded = F.slice(F.concat(F.transform(limits, lambda f: -f), F.array_repeat(
        F.lit(-1).cast("long"), positives)), 1, positives)
    near = near.select("anchor_id", "anchor_key", "top", padded.alias("limits"))
    limited = anchors.join(
        near.select(F.col("anchor_id").alias("id"), F.col("anchor_key").alias("key"), "limits"),
        ["id", "key"])
    slots = found(table, limited, blocks, parts, k, positives, False, low)
    # Slots in order hold falling scores, so the entries of all are in order once slots are.
    by_anchor = slots.groupBy("anchor_id", "anchor_key").agg(F.flatten(F.transform(
        F.array_sort(F.collect_list(F.struct("slot", "top"))), lambda s: F.transform(
            s["top"], lambda e: F.struct(s["slot"].alias("slot"), (-e["fall"]).alias("score"),
                                         e["id"].alias("id"))))).alias("entries"))
    wanted = near.select("anchor_id", "anchor_key", "limits", F.explode("top").alias("p")).select(
        "anchor_id", "anchor_key", F.col("p.id").alias("positive_id"),
        (-F.col("p.fall")).alias("positive_score"), "limits").withColumn(
        "own", F.array_position("limits", F.col("positive_score")) - 1).filter("own >= 0")
    under = F.slice(F.filter("entries", lambda e: e["slot"] >= F.col("own")), 1, k)
    window = F.filter(under, lambda e: 100 * e["score"] >= low * F.col("positive_score"))
    return wanted.join(by_anchor, ["anchor_id", "anchor_key"]).select(
        "anchor_id", "positive_id", "positive_score", F.posexplode(window).alias("at", "e")).select(
        "anchor_id", "positive_id", (F.col("at") + 1).cast("int").alias("rank"),
        F.col("e.id").alias("negative_id"), "positive_score",
        F.col("e.score").alias("negative_score"))
