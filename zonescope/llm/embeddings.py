"""Near-duplicate vectors: spherical k-means cells, blocked cosine products inside them.

Equal vectors are one representative from the start. Centroids are fitted on a bounded sample
(``SAMPLE_PER_CELL`` x cells); their number grows with the square root of the rows. A vector lives in
the cell of its nearest centroid. If two linked vectors live in different cells, the plane halfway
between the centroids passes between them, so one of them is within half the link angle of it: a
vector visits every cell whose plane is that near, and no link is lost. A cell compares its residents
with each other and with its visitors, in blocks of bounded size, one row per pair of blocks. A block
pair gives back a number of links per vector and one edge per vector to the smallest of its local
component, never the pairs.

Defined results. Vectors are linked only if their labels are equal and not null and their lengths
are equal. Null, empty and zero vectors and those with null, NaN or infinite components link with
nothing, as do rows without an id, which have no component and are kept. Repeated rows are vectors of
their own, linked with each other. Vectors of another length than most are compared in blocks without
cells. An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zonescope.llm.components import components
from zonescope.plans.workspace import written

#: Sampled vectors per cell, cells at most (so the centroids stay under 64 MB at 256 dimensions),
#: rounds of k-means, vectors in a block.
SAMPLE_PER_CELL, MAX_CELLS, ROUNDS, BLOCK = 32, 1 << 15, 8, 512
#: Room for rounding in the plane test.
ROUNDING = 1e-9
#: Centroids closer than this are visited by all: their gap says little about the plane between them.
CLOSE = 1e-3
#: The cell of vectors whose length is not that of the centroids.
ELSEWHERE = -1


def unit(values: list[float | None] | None) -> bytes | None:
    """The vector scaled to length 1 in double precision, None if it links with nothing."""
    if not values or None in values:
        return None
    v = np.array(values, np.float64)
    most = np.abs(v).max()
    if not 0 < most < math.inf:  # also NaN
        return None
    v = v / most
    return (v / np.sqrt(v @ v)).tobytes()


def units(column: pa.Array) -> pa.Array:
    return pa.array([unit(v) for v in column.to_pylist()], pa.binary())


def rows_of(column: pa.Array | list[bytes]) -> np.ndarray:
    raw = column.to_pylist() if isinstance(column, pa.Array) else column
    return np.frombuffer(b"".join(raw), np.float64).reshape(len(raw), -1)


def fit(sample: np.ndarray, cells: int, rounds: int = ROUNDS) -> np.ndarray:
    """Spherical k-means: unit centroids of unit vectors; the same for the same sample."""
    order = np.random.default_rng(7).permutation(len(sample))
    centroids = sample[order[:cells]].copy()
    for _ in range(rounds):
        nearest = np.concatenate([(part @ centroids.T).argmax(axis=1) for part in
                                  np.array_split(sample, max(1, len(sample) * cells >> 22))])
        sums = np.zeros_like(centroids)
        np.add.at(sums, nearest, sample)
        length = np.sqrt((sums * sums).sum(axis=1))
        full = length > 1e-6
        centroids[full] = sums[full] / length[full, None]
    # A tight group may have drawn many centroids; most of them fall together here, and any choice of
    # centroids is exact.
    centroids = np.unique(centroids, axis=0)
    return centroids[np.sort(np.unique(np.round(centroids, 4), axis=0, return_index=True)[1])]


def places(vectors: np.ndarray, centroids: np.ndarray, reach: float) -> Iterator[list[int]]:
    """The cells of each vector, its home first, then those that it visits."""
    gaps = np.sqrt(np.maximum(2 - 2 * (centroids @ centroids.T), 0))
    # Squared gaps are off by rounding alone, too much for the small ones.
    close = gaps < CLOSE
    gaps[close] = 1
    for start in range(0, len(vectors), 1024):
        near = vectors[start:start + 1024] @ centroids.T
        home = near.argmax(axis=1)
        distance = (near[np.arange(len(near)), home][:, None] - near) / gaps[home]
        visits = (distance <= reach + ROUNDING) | close[home]
        visits[np.arange(len(near)), home] = False
        for h, row in zip(home.tolist(), visits, strict=True):
            yield [h, *np.flatnonzero(row).tolist()]


def smallest_linked(links: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """The smallest id of each vector's component inside a block pair."""
    least, before = ids.copy(), None
    while before is None or (least != before).any():
        before = least.copy()
        i, j = links
        np.minimum.at(least, i, before[j])
        np.minimum.at(least, j, before[i])
    return least


def link_blocks(x: dict, y: dict | None, cosine: float) -> tuple[np.ndarray, ...]:
    """(id, links, smallest id) of the vectors of a block, or of a pair of blocks, that have links."""
    one, two = x, x if y is None else y
    i, j = np.nonzero(one["unit"] @ two["unit"].T >= cosine)
    if y is None:
        i, j = i[i < j], j[i < j]
    elif y["home"] is not None:
        # y visits x's cell; if the resident also visits y's home, the lower of both cells counts.
        both = np.isin(two["home"][j] + i * (1 << 20), one["visits"])
        counts = ~both | (one["cell"] < two["home"][j])
        i, j = i[counts], j[counts]
    ids = one["id"] if y is None else np.concatenate([one["id"], two["id"]])
    copies = one["copies"] if y is None else np.concatenate([one["copies"], two["copies"]])
    if y is not None:
        j = j + len(one["id"])
    found = np.bincount(i, copies[j], len(ids)) + np.bincount(j, copies[i], len(ids))
    least = smallest_linked((i, j), ids)
    linked = found > 0
    return ids[linked], found[linked].astype(np.int64), least[linked]


def block(rows: pa.ListScalar, cell: int, resident: bool) -> dict:
    values = rows.values
    cells = values.field("cells").to_pylist()
    return {
        "id": values.field("id").to_numpy(), "copies": values.field("copies").to_numpy(),
        "unit": rows_of(values.field("unit")), "cell": cell,
        "home": None if resident else np.array([c[0] for c in cells], np.int64),
        "visits": np.array([v + i * (1 << 20) for i, c in enumerate(cells) for v in c[1:]],
                           np.int64) if resident else None}


def block_rows(reps: DataFrame) -> DataFrame:
    """(label, dim, cell, resident, block, rows): vectors of a cell in blocks of bounded size."""
    placed = reps.select("label", "dim", "id", "copies", "unit", "cells",
                         F.posexplode("cells").alias("at", "cell")).withColumn(
        "resident", F.col("at") == 0)
    keys = ["label", "dim", "cell", "resident"]
    sizes = written(placed.groupBy(*keys).agg(F.count("*").alias("n")), "vec-sizes")
    sized = placed.join(sizes, keys).withColumn("block", F.pmod(
        F.xxhash64("id"), F.ceil(F.col("n") / BLOCK)).cast("int"))
    return written(sized.groupBy(*keys, "block").agg(F.collect_list(
        F.struct("id", "copies", "unit", "cells")).alias("rows")), "vec-blocks")


def links(blocks: DataFrame, cosine: float) -> DataFrame:
    """(id, n, least) for each block pair and vector with links in it."""
    left, right = blocks.filter("resident").alias("l"), blocks.alias("r")
    same = [F.col(f"l.{k}") == F.col(f"r.{k}") for k in ("label", "dim", "cell")]
    apart = ~F.col("r.resident") | (F.col("l.block") < F.col("r.block"))
    pairs = left.join(right, same[0] & same[1] & same[2] & apart).select(
        "l.cell", F.col("l.rows").alias("x"), "r.resident", F.col("r.rows").alias("y"))
    alone = blocks.filter("resident").select(
        "cell", F.col("rows").alias("x"), F.lit(True).alias("resident"),
        F.lit(None).cast(blocks.schema["rows"].dataType).alias("y"))

    def compare(batches):
        kind = pa.schema([(n, pa.int64()) for n in ("id", "n", "least")])
        for batch in batches:
            out = [tuple(np.empty(0, np.int64) for _ in range(3))]
            for cell, x, resident, y in zip(*batch.columns, strict=True):
                cell, resident = cell.as_py(), resident.as_py()
                out.append(link_blocks(
                    block(x, cell, True), block(y, cell, resident) if y.is_valid else None, cosine))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], schema=kind)
    return alone.unionByName(pairs).mapInArrow(compare, "id bigint, n bigint, least bigint")


def near_vectors(
    vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label",
    cosine: float = 0.98,
) -> DataFrame:
    """(id, n_links, component_id, kept) for each vector."""
    if not 0 < cosine < 1:
        raise ValueError("cosine must be between 0 and 1")
    table = vectors.select(
        F.col(vec_id).cast("long").alias("id"), F.col(label).alias("label"),
        F.arrow_udf(units, "binary")(F.col(embedding).cast("array<double>")).alias("unit"))
    table = table.withColumn("unit", F.when(
        F.col("label").isNotNull() & F.col("id").isNotNull(), F.col("unit")))
    table = written(table.withColumns({
        "key": F.md5("unit"), "dim": F.length("unit")}), "vec-units")
    usable = table.filter(F.col("unit").isNotNull())
    groups = written(usable.groupBy("label", "key").agg(
        F.min("id").alias("rep"), F.count("*").alias("copies")), "vec-groups")
    reps = usable.join(groups, ["label", "key"]).filter("id = rep").select(
        "id", "label", "dim", "copies", "unit").dropDuplicates(["id", "label", "unit"])
    reps = written(reps, "vec-reps")

    n = reps.count()
    cells = max(1, min(MAX_CELLS, math.isqrt(n)))
    most = reps.groupBy("dim").count().orderBy(F.desc("count"), "dim").first()
    dim = most["dim"] if most else 0
    every = max(1, n // (SAMPLE_PER_CELL * cells))
    sample = [bytes(r["unit"]) for r in reps.filter(F.col("dim") == dim).filter(
        F.pmod(F.xxhash64("unit"), F.lit(every)) == 0).select("unit").limit(
        2 * SAMPLE_PER_CELL * cells).collect()]
    shared = reps.sparkSession.sparkContext.broadcast(
        fit(rows_of(sorted(sample)), cells) if sample else np.empty((0, 0)))
    # Half the link angle, as the distance of a unit vector from a plane through the centre.
    reach = math.sin(math.acos(cosine) / 2)

    def cells_of(column: pa.Array) -> pa.Array:
        raw = column.to_pylist()
        out, fit_in = [[ELSEWHERE]] * len(raw), [i for i, v in enumerate(raw) if len(v) == dim]
        if fit_in and len(shared.value):
            found = places(rows_of([raw[i] for i in fit_in]), shared.value, reach)
            for i, own in zip(fit_in, found, strict=True):
                out[i] = own
        return pa.array(out, pa.list_(pa.int32()))
    reps = written(reps.withColumn("cells", F.arrow_udf(cells_of, "array<int>")("unit")),
                   "vec-placed")
    found = written(links(block_rows(reps), cosine), "vec-links")
    counts = found.groupBy("id").agg(F.sum("n").alias("n"))
    labels = components(found.select(F.col("id").alias("a"), F.col("least").alias("b")))
    per_rep = groups.join(counts, F.col("rep") == F.col("id"), "left").drop("id").join(
        labels, F.col("rep") == F.col("node"), "left").select(
        F.col("label").alias("l"), F.col("key").alias("k"),
        (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        F.coalesce("component", "rep").alias("component"))
    per_rep = written(per_rep, "vec-labelled")
    joined = table.select("id", "label", "key").join(
        per_rep, (F.col("label") == F.col("l")) & (F.col("key") == F.col("k")), "left")
    return joined.select(
        "id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component", "id").alias("component_id"),
        F.coalesce(F.col("id") == F.coalesce("component", "id"), F.lit(True)).alias("kept"))
