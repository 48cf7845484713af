"""Near-duplicates by MinHash bands and sequential Bayesian verification.

A document's set is the distinct 2-word shingles (``width``) of its whole text, as 64-bit hashes.
Documents with equal sets are one representative from the start. Bands of MinHash values put
representatives into buckets. Verification is in two passes:

1. Every representative is compared with the smallest one of each of its buckets. Signatures are
   compared batch by batch; a pair is dropped as soon as the posterior probability that its
   similarity reaches the threshold is under ``MISS``. The two best pairs of a representative are
   verified on the full sets, and what they link becomes a component.
2. Members of a bucket that are still in different components are compared, in blocks of bounded
   size; blocks within one component are skipped. No pair leaves a meeting of two blocks: what leaves
   it is a forest that joins the components of surviving pairs to groups. The members of a group
   then meet in blocks with their full sets, where survivors are verified, and again only a forest
   of links leaves, at most one per component of the meeting.

Nothing is capped: a pair that shares a band and is not dropped by the posterior bound ends in one
component or is verified. With 40 bands of 5 values a pair of similarity 0.8 shares no band with
probability 1.2e-7.

Defined results. Null and wordless texts have an empty set and link with nothing. Texts with fewer
words than a shingle have one shingle, all their words. Repeated rows get equal results; where an id
has several texts, each row follows its own. A null id links with nothing, has no component and is
kept. An empty table gives no rows. Texts of any length are read whole.
"""

from __future__ import annotations

import hashlib
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zonescope.llm.components import components
from zonescope.llm.text import own
from zonescope.plans.workspace import written

BANDS, ROWS = 40, 5
#: MinHash values that are compared, one byte of each, and those in a batch.
COMPARED, BATCH = 128, 16
#: Probability under which a pair is dropped.
MISS = 1e-6
#: Members of a block.
BLOCK = 256
#: Bytes of sets in a block, and blocks of a cell that one task pairs with all others.
BLOCK_BYTES = 4 << 20
TOGETHER = 8
#: A label with this many members in a cell gets blocks of its own.
POOLED = 64
#: Members of a group whose pairs all meet; those of a larger one meet in their buckets.
GROUP = 4096
CACHE = 200_000
CHUNK = 2048
#: Rows of an Arrow batch that are Python objects at a time.
SLICE = 256

LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_random = np.random.default_rng(20_250_101)
FACTORS = _random.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
OFFSETS = _random.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)
MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


class WordHashes(dict):
    """The 64-bit hash of a word, remembered; bounded."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > CACHE:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value


_hashes = WordHashes()


def shingles(text: bytes | None, width: int) -> np.ndarray:
    """The sorted distinct shingle hashes of a text."""
    words = (text or b"").translate(LOWER).split()
    if not words:
        return np.empty(0, np.uint64)
    hashes = np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))
    many = max(1, len(words) - width + 1)
    out = np.full(many, len(words) if len(words) < width else width, np.uint64)
    for i in range(min(width, len(words))):
        out = (out ^ hashes[i:i + many]) * MIX[0]
        out ^= out >> np.uint64(29)
    return np.unique((out * MIX[1]) ^ (out >> np.uint64(32)))


def minima(hashes: np.ndarray) -> np.ndarray:
    least = np.full(len(FACTORS), np.uint64(0xFFFFFFFFFFFFFFFF))
    for i in range(0, len(hashes), CHUNK):
        values = np.multiply.outer(hashes[i:i + CHUNK], FACTORS)
        values += OFFSETS
        np.minimum(least, values.min(axis=0), out=least)
    return least


def band_hashes(least: np.ndarray) -> np.ndarray:
    rows = least.reshape(BANDS, ROWS)
    out = np.arange(BANDS, dtype=np.uint64)
    for i in range(ROWS):
        out = (out ^ rows[:, i]) * MIX[0]
        out ^= out >> np.uint64(31)
    return out.view(np.int64)


def sliced(column: pa.Array):
    """The values as bytes, a slice at a time."""
    for at in range(0, len(column), SLICE):
        yield from column.slice(at, SLICE).cast(pa.large_binary()).to_pylist()


SKETCH = "struct<n: bigint, key: binary, bands: array<bigint>, sig: binary>"


def sketches(
    docs: DataFrame, doc_id: str, text: str, width: int, by_text: bool = False,
) -> DataFrame:
    """(id, n, key, bands, sig): set size and digest, buckets, bytes to compare.

    ``by_text`` adds a hash of the text, as ids may have several texts.
    """
    def sketch(texts: pa.Array) -> pa.Array:
        out = []
        for t in sliced(texts):
            found = shingles(t, width)
            if not len(found):
                out.append({"n": 0, "key": None, "bands": None, "sig": None})
                continue
            least = minima(found)
            out.append({
                "n": len(found), "key": digest(found.tobytes()),
                "bands": band_hashes(least),
                "sig": (least[:COMPARED] >> np.uint64(50)).astype(np.uint8).tobytes()})
        return pa.array(out, pa.struct([("n", pa.int64()), ("key", pa.binary()),
                                        ("bands", pa.list_(pa.int64())), ("sig", pa.binary())]))
    more = [F.xxhash64(F.col(text)).alias("text_hash")] if by_text else []
    found = docs.select(F.col(doc_id).cast("long").alias("id"), *more,
                        F.arrow_udf(sketch, SKETCH)(F.col(text)).alias("s"))
    return found.select("id", "s.*", *(["text_hash"] if by_text else []))


def needed(threshold: float, miss: float = MISS) -> list[tuple[int, int]]:
    """(values compared, matches needed) after each batch.

    With a uniform prior on the share p of equal bytes, the posterior that p is at least the share
    t of a pair at the threshold, after m of n, is P(Binomial(n + 1, t) <= m).
    """
    share = threshold + (1 - threshold) / 256
    out = []
    for n in range(BATCH, COMPARED + 1, BATCH):
        total = 0.0
        for m in range(n + 1):
            total += comb(n + 1, m) * share ** m * (1 - share) ** (n + 1 - m)
            if total >= miss:
                out.append((n, m))
                break
    return out


def surviving(a: np.ndarray, b: np.ndarray, rule: list[tuple[int, int]]) -> np.ndarray:
    """Matches of each pair of signature rows, -1 where a batch drops the pair."""
    matches, alive = np.zeros(len(a), np.int64), np.arange(len(a))
    for n, least in rule:
        matches[alive] += (a[alive, n - BATCH:n] == b[alive, n - BATCH:n]).sum(axis=1)
        lost = matches[alive] < least
        matches[alive[lost]] = -1
        alive = alive[~lost]
        if not len(alive):
            break
    return matches


def signature_rows(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, COMPARED)


def compared(pairs: DataFrame, sigs: DataFrame, rule: list[tuple[int, int]]) -> DataFrame:
    """(a, b, matches) of the pairs that survive; ``sigs`` is (id, sig)."""
    def match(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array(surviving(signature_rows(a), signature_rows(b), rule))
    one, two = (sigs.select(F.col("id").alias(i), F.col("sig").alias(f"sig_{i}")) for i in "ab")
    joined = pairs.join(one, "a").join(two, "b")
    return joined.select("a", "b", F.arrow_udf(match, "bigint")("sig_a", "sig_b").alias(
        "matches")).filter("matches >= 0")


def verified(
    pairs: DataFrame, docs: DataFrame, doc_id: str, text: str, width: int, percent: int,
) -> DataFrame:
    """The pairs (a, b) whose full sets have 100 * intersection >= percent * union."""
    pairs = written(pairs.select("a", "b"), "near-pairs")
    ids = written(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "near-ids")

    def linked(a: pa.Array, b: pa.Array) -> pa.Array:
        out = []
        for x, y in zip(sliced(a), sliced(b), strict=True):
            out.append(alike(np.frombuffer(x, np.uint64), [np.frombuffer(y, np.uint64)], percent)[0])
        return pa.array(out)
    full = full_sets(docs, doc_id, text, width, ids)
    one, two = (full.select(F.col("id").alias(i), F.col("set").alias(f"set_{i}")) for i in "ab")
    joined = pairs.join(one, "a").join(two, "b")
    return joined.filter(F.arrow_udf(linked, "boolean")("set_a", "set_b")).select("a", "b")


def best(pairs: DataFrame, by: list[str]) -> DataFrame:
    """The pair with most matches for each key."""
    return pairs.groupBy(*by).agg(F.max(F.struct("matches", "a", "b")).alias("p")).select("p.*")


def in_blocks(members: DataFrame) -> DataFrame:
    """(cell, spread, pool, block, rows): the members of each cell, dealt into blocks by id.

    ``members`` is (cell, id, label, n, sig, set). Blocks are bounded by members and by bytes of their
    sets. A label with many members in a cell has a pool of blocks, as they need not meet.
    """
    sizes = members.groupBy("cell", "label").agg(
        F.count("*").alias("many"), F.sum(F.coalesce(F.octet_length("set"), F.lit(0))).alias("bytes"))
    pools = written(sizes.withColumn("pool", F.when(
        F.col("many") >= POOLED, F.col("label")).otherwise(-1)), "near-pools")
    per_pool = written(pools.groupBy("cell", "pool").agg(F.greatest(
        F.ceil(F.sum("many") / BLOCK), F.ceil(F.sum("bytes") / BLOCK_BYTES)).alias("blocks")),
        "near-sizes")
    per_cell = written(per_pool.groupBy("cell").agg(
        F.ceil(F.sum("blocks") / TOGETHER).cast("bigint").alias("spread")), "near-spreads")
    placed = members.join(pools.select("cell", "label", "pool"), ["cell", "label"]).join(
        per_pool, ["cell", "pool"]).join(per_cell, "cell")
    block = F.pmod(F.xxhash64("id", F.lit("block")), F.col("blocks")).cast("int")
    return written(placed.withColumn("block", block).groupBy("cell", "spread", "pool", "block").agg(
        F.collect_list(F.struct("id", "label", "n", "sig", "set")).alias("rows")), "near-blocks")


def meetings(blocks: DataFrame, first_only: bool) -> DataFrame:
    """(x, y): the rows of two blocks of a cell that meet; y is null where a block meets itself.

    ``first_only`` leaves pairs of blocks of which none is the first of its pool for later. The
    pairs of a large cell are dealt over as many tasks as it has ``spread``.
    """
    within = blocks.filter((F.col("pool") == -1) & (F.size("rows") > 1)).select(
        F.col("rows").alias("x"), F.lit(None).cast(blocks.schema["rows"].dataType).alias("y"))
    left = blocks.withColumn("salt", F.pmod(F.xxhash64("pool", "block"), F.col("spread"))).alias("l")
    right = blocks.withColumn("salt", F.explode(F.sequence(
        F.lit(0).cast("bigint"), F.col("spread") - 1))).alias("r")
    meet = (F.col("l.cell") == F.col("r.cell")) & (F.col("l.salt") == F.col("r.salt")) & (
        F.struct("l.pool", "l.block") < F.struct("r.pool", "r.block")) & (
        (F.col("l.pool") != F.col("r.pool")) | (F.col("l.pool") == -1))
    if first_only:
        meet = meet & ((F.col("l.block") == 0) | (F.col("r.block") == 0))
    return within.unionByName(left.join(right, meet).select(
        F.col("l.rows").alias("x"), F.col("r.rows").alias("y")))


def forest(
    members: DataFrame, payload: DataFrame, rule: list[tuple[int, int]], percent: int,
    first_only: bool = False,
) -> DataFrame:
    """(a, b): labels to be joined, fewer per meeting of blocks than it has labels.

    ``members`` is (cell, id, key, label), ``payload`` (id, key, n, sig, set): it joins the members
    of cells that hold several labels, not the others. Two labels are joined by a pair of members of
    a cell that the posterior does not drop and, where members have sets, whose sets have
    100 * intersection >= percent * union.
    """
    cells = written(members.groupBy("cell").agg(
        F.min("label").alias("low"), F.max("label").alias("high")).filter("low < high").select("cell"),
        "near-open")
    several = written(members.join(cells, "cell", "left_semi").join(payload, ["id", "key"]).drop(
        "key"), "near-members")

    def join_labels(batches):
        kind = pa.schema([("a", pa.int64()), ("b", pa.int64())])
        for batch in batches:
            out = []
            for x, y in zip(batch.column(0), batch.column(1), strict=True):
                out += joined_labels(x, y if y.is_valid else None, rule, percent)
            yield pa.RecordBatch.from_arrays(
                [pa.array([p[i] for p in out], pa.int64()) for i in (0, 1)], schema=kind)
    met = meetings(in_blocks(several), first_only)
    return written(met.mapInArrow(join_labels, "a bigint, b bigint").distinct(), "near-forest")


def joined_labels(
    x: pa.ListScalar, y: pa.ListScalar | None, rule: list[tuple[int, int]], percent: int,
) -> list[tuple[int, int]]:
    """The label pairs that the members of x and y, or of x alone, join: a forest."""
    sides = [side.values for side in (x, y) if side is not None]

    def column(name: str) -> np.ndarray:
        return np.concatenate([side.field(name).to_numpy() for side in sides])
    label, n = column("label").copy(), column("n")
    sig = np.concatenate([signature_rows(side.field("sig")) for side in sides])
    full = None
    if not sides[0].field("set").null_count:
        full = [np.frombuffer(v, np.uint64) for side in sides for v in side.field("set").to_pylist()]
    out = []
    for i in range(len(sides[0])):
        start = i + 1 if y is None else len(sides[0])
        near = np.flatnonzero((label[start:] != label[i]) & (
            100 * np.minimum(n[start:], n[i]) >= percent * np.maximum(n[start:], n[i]))) + start
        if len(near):
            near = near[surviving(sig[np.full(len(near), i)], sig[near], rule) >= 0]
        if len(near) and full is not None:
            near = near[alike(full[i], [full[j] for j in near], percent)]
        for other in np.unique(label[near]):
            out.append((int(label[i]), int(other)))
            label[label == other] = label[i]
    return out


def alike(one: np.ndarray, others: list[np.ndarray], percent: int) -> np.ndarray:
    """Which of ``others`` have 100 * intersection >= percent * union with ``one``; sorted sets."""
    sizes = np.array([len(other) for other in others])
    values = np.concatenate(others)
    at = np.minimum(np.searchsorted(one, values), len(one) - 1)
    both = np.add.reduceat((one[at] == values).astype(np.int64), np.cumsum(sizes) - sizes)
    return 100 * both >= percent * (len(one) + sizes - both)


def full_sets(docs: DataFrame, doc_id: str, text: str, width: int, ids: DataFrame) -> DataFrame:
    """(id, key, set): the shingles of the documents in ``ids`` and the digest of each set."""
    def sets(texts: pa.Array) -> pa.Array:
        found = (shingles(t, width).tobytes() for t in sliced(texts))
        return pa.array([{"key": digest(s), "set": s} for s in found],
                        pa.struct([("key", pa.binary()), ("set", pa.binary())]))
    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("t")).join(
        ids, "id", "left_semi")
    return written(rows.select("id", F.arrow_udf(sets, "struct<key: binary, set: binary>")("t").alias(
        "s")).select("id", "s.*").dropDuplicates(["id", "key"]), "near-sets")


def digest(found: bytes) -> bytes:
    return hashlib.blake2b(found, digest_size=16).digest()


def relabelled(members: DataFrame, edges: DataFrame) -> DataFrame:
    """Members with the label that ``edges`` between labels give them."""
    joined = written(components(edges).toDF("node", "joined"), "near-groups")
    return members.join(joined, F.col("label") == F.col("node"), "left").withColumn(
        "label", F.coalesce("joined", "label")).drop("node", "joined")


def later_links(
    members: DataFrame, sigs: DataFrame, docs: DataFrame, doc_id: str, text: str, width: int,
    percent: int, rule: list[tuple[int, int]],
) -> DataFrame:
    """(a, b): components that a link between two of ``members`` joins.

    ``members`` is (band, id, key, component), ``sigs`` (id, key, n, sig). Pairs that survive the
    posterior make groups of components, first by the first blocks, then by all blocks of buckets
    that still hold several groups. Then sets travel once per block of a group, and links are
    verified where they meet.
    """
    bare = sigs.withColumn("set", F.lit(None).cast("binary"))
    bucket = F.col("band").alias("cell")
    members = members.withColumn("label", F.col("component"))
    near = forest(members.select(bucket, "id", "key", "label"), bare, rule, percent, first_only=True)
    grouped = written(relabelled(members, near), "near-grouped")
    more = forest(grouped.select(bucket, "id", "key", "label"), bare, rule, percent)
    grouped = written(relabelled(grouped, more), "near-grouped")

    sizes = grouped.groupBy("label").agg(
        F.min("component").alias("low"), F.max("component").alias("high"),
        F.approx_count_distinct("id").alias("size")).filter("low < high")
    groups = written(sizes.select(F.col("label").alias("group"), "size"), "near-group-sizes")
    # A group beyond this size may be a chain: its members meet in their buckets only.
    within = F.when(F.col("size") > GROUP, F.col("band")).otherwise(0)
    placed = written(grouped.join(groups, F.col("label") == F.col("group")).select(
        F.struct("group", within.alias("band")).alias("cell"), "id", "key",
        F.col("component").alias("label")).dropDuplicates(["cell", "id", "key"]), "near-placed")
    if placed.isEmpty():
        return near.limit(0)
    ids = written(placed.select("id").distinct(), "near-ids")
    sets = full_sets(docs, doc_id, text, width, ids)
    return forest(placed, sigs.join(sets, ["id", "key"]), rule, percent)


def near_duplicates(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80,
    by_text: bool = False,
) -> DataFrame:
    """(id, n_shingles, component_id, kept) for each document; with ``by_text`` a text_hash too."""
    rule = needed(percent / 100)
    table = written(sketches(docs, doc_id, text, width, by_text), "near-sketches")
    known = table.filter(F.col("key").isNotNull() & F.col("id").isNotNull())
    reps = written(known.groupBy("key").agg(F.min("id").alias("rep")), "near-reps")
    chosen = written(known.join(reps.select(F.col("key").alias("k"), "rep"), (
        F.col("key") == F.col("k")) & (F.col("id") == F.col("rep"))).select(
        "id", "key", "n", "bands", "sig").dropDuplicates(["id", "key"]), "near-chosen")
    sigs = chosen.select("id", "sig").distinct()
    banded = chosen.select("id", F.explode("bands").alias("band"))
    buckets = written(banded.groupBy("band").agg(
        F.min("id").alias("leader"), F.max("id").alias("last")).filter("leader < last").select(
        "band", "leader"), "near-buckets")

    stars = banded.join(buckets, "band").filter("id != leader").select(
        F.col("leader").alias("a"), F.col("id").alias("b")).distinct()
    stars = written(compared(stars, sigs, rule), "near-stars")
    first = best(stars, ["b"])
    second = best(stars.join(first.select("a", "b"), ["a", "b"], "left_anti"), ["b"])
    first = written(first.unionByName(second), "near-first")
    edges = written(verified(first, docs, doc_id, text, width, percent), "near-edges")
    found = written(components(edges), "near-components")

    labelled = written(chosen.select("id", "key", F.explode("bands").alias("band")).join(
        buckets.select("band"), "band", "left_semi").join(
        found, F.col("id") == F.col("node"), "left").select(
        "band", "id", "key", F.coalesce("component", "id").alias("component")), "near-labelled")
    links = later_links(labelled, chosen.select("id", "key", "n", "sig"), docs, doc_id, text, width,
                        percent, rule)
    found = written(components(edges.unionByName(links)), "near-components")

    per_set = reps.join(found, F.col("rep") == F.col("node"), "left").select(
        F.col("key").alias("k"), F.coalesce("component", "rep").alias("component_id"))
    per_set = written(per_set, "near-sets-labelled")
    joined = table.join(per_set, F.col("key") == F.col("k"), "left").select(
        "id", F.col("n").alias("n_shingles"), F.when(
            F.col("id").isNotNull(), F.coalesce("component_id", "id")).alias("component_id"),
        *(["text_hash"] if by_text else []))
    return joined.withColumn("kept", F.coalesce(
        F.col("id") == F.col("component_id"), F.lit(True)))


def one_per_group(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options,
) -> DataFrame:
    """The documents without those whose group has a smaller id; documents without an id stay.

    Verdicts go back to id and text, so a document does not go with its namesake. Columns of the input
    stay as they are.
    """
    found = near_duplicates(docs, doc_id, text, by_text=True, **options).filter("not kept").select(
        F.col("id").alias(own("id")), F.col("text_hash").alias(own("hash"))).distinct()
    gone = written(found, "near-gone")
    return docs.join(gone, (F.col(doc_id).cast("long") == F.col(own("id"))) & (
        F.xxhash64(F.col(text)) == F.col(own("hash"))), "left_anti")
