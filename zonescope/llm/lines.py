"""Drop lines that an earlier document or place has, equal or a few edits away; DataFrame operations only.

Lines of ``min_chars`` characters or more are compared; shorter ones always stay. Equal lines are one
node from the start. Two lines are linked when they are at most k characters apart (replaced, more or
less), where k is one for each ``CHARS_PER_EDIT`` characters of the shorter line, at least 1 and at
most ``max_edits``. Lines of a range of neighbouring lengths have the same k + 1 segments, cut by the least
length of the range: the first ones lie at places from the start of a line, the last ones at places
from its end, and what a line is longer stays between them. k edits leave a segment as it is that has as
many edits before it as segments, and no more after it than segments. So a line is listed under its
own segments, and probes segment i as far from its place as the lesser of i and k - i (segment join with
multi-match-aware substrings), in its own range and in the one below, if a line there can be near.
Probes are first looked up in a bitmap over the segments that exist, so nearly all of them end where
they are made. A bitmap has bounded size and room for ``ROUND_SEGMENTS``; more are worked off in rounds
of neighbouring ranges of lengths. So the share of probes that pass by chance does not grow with the table.

Candidate pairs are verified with Spark's banded Levenshtein distance, where the words and the pairs of
neighbouring characters of two lines differ no more than by the edits: one edit takes and gives three words
at most and four pairs, both together. In a segment where more than
``CROWD`` lines meet, all are compared with its first line; after that only lines that are still in
different components are, in blocks of the crowd, by their sketches; a pair that these allow is verified
once, however many segments it meets in. Linked lines are one
class. Of a class, the first line of the document with the smallest id stays.

Defined results. Documents without an id keep all lines and count for nothing. Rows with equal ids
and texts are one document and are treated alike; other texts of an id are documents of their own. Null texts stay null, and have no lines. Empty lines and line
ends inside a text stay in place around dropped lines. Very long lines take part whole. An empty
table gives no rows. Other columns stay as they are.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zonescope.llm.components import components
from zonescope.llm.text import WORD, own
from zonescope.plans.workspace import written

MIN_CHARS = 24
#: Characters of a line for each edit that it may have, so that segments have 12 or more.
CHARS_PER_EDIT = 24
#: Edits of the query; a call without the parameter, as in the pipeline, links lines one edit apart.
MAX_EDITS = 4
#: Lines that may meet in one segment before pairs of them wait for the components.
CROWD = 16
#: Lines of a crowd that a task compares with the others.
BLOCK = 512
#: Bitmaps have a word of 64 bits for each four keys, 2^22 words (32 MB) at most, in rows of 2^4 words;
#: so a round has 2^24 segments, unless the lines of one range of lengths have more.
KEYS_A_WORD, WORD_BITS, ROW_BITS = 4, 22, 4
ROUND_SEGMENTS = KEYS_A_WORD << WORD_BITS
#: Numbers of 64 bits for the words of a line, and for its pairs of characters.
SKETCH = 4
LONGEST = (1 << 31) - 1


def occurrences(docs: DataFrame, doc_id: str, text: str, min_chars: int) -> DataFrame:
    """(id, of, at, line, node, check) of the lines that are compared; ``of`` is a hash of the text."""
    # The hash is taken before the lines are cut: else it would be taken of the whole text for each line.
    texts = docs.select(F.col(doc_id).cast("long").alias("id"), F.xxhash64(F.col(text)).alias("of"),
                        F.col(text).alias("text")).filter(F.col("id").isNotNull())
    rows = texts.select("id", "of", F.posexplode(F.split("text", "\n")).alias("at", "line"))
    return rows.filter(F.length("line") >= min_chars).withColumns({
        "node": F.xxhash64("line"), "check": F.xxhash64("line", F.lit(1))})


def allowed(chars: Column, max_edits: int) -> Column:
    """Edits between a line of ``chars`` characters and one that is not shorter."""
    return F.greatest(F.lit(1), F.least(
        F.lit(max_edits), F.floor(chars / CHARS_PER_EDIT))).cast("int")


def length_range(chars: str, max_edits: int) -> str:
    """The least length of the range that a line of ``chars`` characters belongs to.

    Ranges are wider than lines of a link differ in length, so such lines are of one range or of two
    that meet; the number of ranges grows with the logarithm of the longest line.
    """
    narrow, wide = (12, 16) if max_edits <= 12 else (48, 64)
    return (f"case when {chars} < 192 then {chars} - {chars} % {narrow} when {chars} < 4096 "
            f"then {chars} - {chars} % {wide} else {chars} - {chars} % greatest({wide}, "
            f"shiftleft(1, length(bin({chars})) - 8)) end")


def range_edits(low: str, max_edits: int) -> str:
    """Edits between a line of a range that starts at ``low`` and one that is not shorter, at most."""
    narrow, wide = (12, 16) if max_edits <= 12 else (48, 64)
    last = (f"(case when {low} < 192 then {narrow} when {low} < 4096 then {wide} "
            f"else greatest({wide}, shiftleft(1, length(bin({low})) - 8)) end) + {low} - 1")
    return f"cast(greatest(1, least({max_edits}, ({last}) div {CHARS_PER_EDIT})) as int)"


def segment_key(start: str, stop: str, i: str, shift: str) -> str:
    """The hash of segment ``i`` of the range ``low`` with ``k`` edits, ``shift`` from its place.

    Of one byte a character, lines are cut as bytes (``raw``), which need no count of characters and
    have the same hash.
    """
    at = f"if({i} <= k - {i}, 0, chars - size) + {start} + {shift} + 1"
    return (f"if(plain, xxhash64(low, {i}, substring(raw, {at}, {stop} - {start})), "
            f"xxhash64(low, {i}, substring(line, {at}, {stop} - {start})))")


def with_range(every: DataFrame, max_edits: int, min_chars: int) -> DataFrame:
    """The lines with their ``chars``, ``low`` (of their range), its ``size`` to cut and ``k`` edits."""
    table = every.selectExpr("*", "cast(line as binary) as raw", "length(line) as chars").selectExpr(
        "*", "octet_length(line) = chars as plain", f"{length_range('chars', max_edits)} as low")
    return table.selectExpr("*", f"greatest(low, {min_chars}) as size",
                            f"{range_edits('low', max_edits)} as k")


def own_segments(every: DataFrame, max_edits: int, min_chars: int) -> DataFrame:
    """The lines with ``chars``, ``low`` and ``own``, the keys of their own segments."""
    key = segment_key("cast(i * size div (k + 1) as int)", "cast((i + 1) * size div (k + 1) as int)",
                      "i", "0")
    table = with_range(every, max_edits, min_chars)
    return table.selectExpr(*every.columns, "chars", "low",
                            f"transform(sequence(0, k), i -> {key}) as own")


def shifts(max_edits: int) -> Column:
    """At 2 * k: the (i, shift) at which to probe for lines of the same range, which have their own
    segments in place; at 2 * k + 1: for lines of the range below."""
    lists = [[(i, s) for i in range(k + 1) for s in range(-min(i, k - i), min(i, k - i) + 1)
              if s or below] for k in range(max_edits + 1) for below in (0, 1)]
    return F.array(*[F.array(*[F.struct(F.lit(i).alias("i"), F.lit(s).alias("shift")) for i, s in x]).cast(
        "array<struct<i:int,shift:int>>") for x in lists])


def segments(
    every: DataFrame, max_edits: int, min_chars: int, probes: bool,
    low: int = 0, high: int = LONGEST,
) -> DataFrame:
    """(node, chars, segment) of the lines' own segments, or of the other places that they probe; of
    ranges that start at ``low`` to ``high`` characters."""
    if not probes:
        return own_segments(every, max_edits, min_chars).filter(F.col("low").between(low, high)).select(
            "node", "chars", F.explode("own").alias("segment"))
    table = with_range(every.select("node", "line"), max_edits, min_chars).withColumnsRenamed(
        {"low": "own_low", "k": "own_k"}).drop("size")
    table = table.withColumn("below", F.expr(length_range("(own_low - 1)", max_edits)))
    table = table.withColumn("low", F.explode(F.expr(
        f"if(own_low > {min_chars} and chars - own_low < {range_edits('below', max_edits)}, "
        "array(own_low, below), array(own_low))"))).filter(F.col("low").between(low, high))
    table = table.selectExpr("*", f"greatest(low, {min_chars}) as size",
                             f"{range_edits('low', max_edits)} as k")
    table = table.withColumn("place", F.explode(F.get(
        shifts(max_edits), F.expr("2 * k + if(low < own_low, 1, 0)")))).selectExpr(
        "*", "place.i as i", "place.shift as shift").selectExpr(
        "*", "cast(i * size div (k + 1) as int) as start",
        "cast((i + 1) * size div (k + 1) as int) as stop")
    return table.selectExpr("node", "chars", segment_key("start", "stop", "i", "shift") + " as segment")


def word_bits(keys: int) -> int:
    """The words of a bitmap for so many keys, as a power of two."""
    return min(WORD_BITS, max(ROW_BITS, (-(-keys // KEYS_A_WORD) - 1).bit_length()))


def word(key: Column, bits: int) -> Column:
    return key.bitwiseAND(F.lit((1 << bits) - 1))


def mask(name: str) -> Column:
    """Four bits of a word for a key."""
    return F.expr(" | ".join(f"shiftleft(1L, cast(shiftright({name}, {40 + 6 * i}) & 63 as int))"
                             for i in range(4)))


def row_words(name: str) -> Column:
    """The words of a row, of those (word, ``name``) that are its own; the others are zero."""
    return F.array(*[F.expr(f"bit_or(if((word & {(1 << ROW_BITS) - 1}) = {i}, {name}, 0L))")
                     for i in range(1 << ROW_BITS)])


def in_rows(words: DataFrame) -> DataFrame:
    """The words of a bitmap, dealt by ``row``, so that a row is put together where its words meet."""
    return words.withColumn("row", F.shiftright("word", ROW_BITS)).repartition("row")


def dense(words: DataFrame, name: str) -> DataFrame:
    """(row, bits): the rows of a bitmap, given those (word, bits) that are not zero."""
    return written(in_rows(words).groupBy("row").agg(row_words("bits").alias("bits")), name)


def bitmap(keys: DataFrame, bits: int, name: str) -> DataFrame:
    """A bitmap over the keys of a table of one column."""
    key = keys.columns[0]
    return dense(keys.select(word(F.col(key), bits).alias("word"), mask(key).alias("bits")), name)


def maybe_in(table: DataFrame, key: str, rows: DataFrame, bits: int) -> DataFrame:
    """The rows whose key may be in a bitmap: all that are, and few others."""
    place = word(F.col(key), bits)
    found = F.get(rows["bits"], place.bitwiseAND(F.lit((1 << ROW_BITS) - 1)).cast("int"))
    return table.join(F.broadcast(rows), (F.shiftright(place, ROW_BITS) == rows["row"]) & (
        mask(key).bitwiseAND(found) == mask(key))).select(*table.columns)


def length_rounds(nodes: DataFrame, max_edits: int) -> list[tuple[int, int, int]]:
    """(low, high, segments): runs of length ranges, each with ``ROUND_SEGMENTS`` segments at most or
    of one range."""
    counts = nodes.groupBy("low").agg(F.count("*").alias("lines")).selectExpr(
        "low", f"lines * ({range_edits('low', max_edits)} + 1) as n").collect()
    out: list[tuple[int, int, int]] = []
    for chars, n in sorted(map(tuple, counts)):
        if out and out[-1][2] + n <= ROUND_SEGMENTS:
            out[-1] = out[-1][0], chars, out[-1][2] + n
        else:
            out.append((chars, chars, n))
    # Rounds meet, and the last has no end.
    return [(low, after[0] - 1 if after else LONGEST, n) for (low, _, n), after in zip(
        out, [*out[1:], None][:len(out)], strict=True)]


def meeting_entries(
    every: DataFrame, places: DataFrame, nodes: DataFrame, max_edits: int, min_chars: int,
) -> DataFrame:
    """(segment, node, chars, found) where two lines meet; ``found`` for a line's own segments."""
    rounds = length_rounds(nodes, max_edits)
    if len(rounds) < 2:
        return round_entries(every, places, max_edits, min_chars, *(rounds or [(0, LONGEST, 0)])[0])
    lows = F.array(*[F.lit(low) for low, _, _ in rounds])
    held = every.select("node", "line", F.size(F.filter(
        lows, lambda low: low <= F.length("line"))).alias("round"))
    held = written(held, "line-rounds", parts="round")
    found = []
    for i, (low, high, n) in enumerate(rounds, 1):
        last = sum(low <= high + max_edits for low, _, _ in rounds)
        found.append(round_entries(held.filter(F.col("round").between(i, last)), places, max_edits,
                                   min_chars, low, high, n))
    return reduce(DataFrame.unionByName, found)


def round_entries(
    every: DataFrame, places: DataFrame, max_edits: int, min_chars: int, low: int, high: int, n: int,
) -> DataFrame:
    """The entries of lines of ranges from ``low`` to ``high``, which have ``n`` segments."""
    bits = word_bits(n)
    listed = places.filter(F.col("low").between(low, high)).select(
        "node", "chars", F.explode("own").alias("segment"))
    several = F.min("node") < F.max("node")
    words = written(in_rows(listed.withColumn("word", word(F.col("segment"), bits))).groupBy(
        "row", "word", "segment").agg(several.alias("several")).select(
        "row", "word", mask("segment").alias("bits"),
        F.expr("if(several, bits, 0L)").alias("shared")).groupBy("row").agg(
        row_words("bits").alias("bits"), row_words("shared").alias("shared")), "line-words")
    probes = segments(every, max_edits, min_chars, True, low, high)
    hits = written(maybe_in(probes, "segment", words.select("row", "bits"), bits), "line-probes")
    of_hits = hits.select(word(F.col("segment"), bits).alias("word"), mask("segment").alias("bits"))
    shared = words.select("row", F.posexplode("shared").alias("i", "bits")).filter("bits != 0").select(
        (F.shiftleft("row", ROW_BITS) + F.col("i")).alias("word"), "bits")
    wanted = dense(shared.unionByName(of_hits), "line-wanted-bits")
    entries = maybe_in(listed, "segment", wanted, bits).withColumn("found", F.lit(True)).unionByName(
        hits.withColumn("found", F.lit(False)))
    entries = written(entries.groupBy("segment", "node").agg(
        F.max("chars").alias("chars"), F.max("found").alias("found")), "line-entries")
    met = written(entries.groupBy("segment").agg(
        F.max("found").alias("any"), F.count("*").alias("n")).filter("any and n > 1").select(
        "segment"), "line-segments")
    return written(entries.join(met, "segment", "left_semi"), "line-first")


def word_sketch(line: Column) -> Column:
    """A bit for each word of a line, in ``SKETCH`` numbers of 64."""
    hashes = F.transform(F.split(line, " "), lambda w: F.xxhash64(w))

    def bits_of(hashes: Column, i: int) -> Column:
        one = lambda h: F.call_function("shiftleft", F.lit(1).cast("long"), h.bitwiseAND(
            F.lit(63)).cast("int"))
        return F.aggregate(hashes, F.lit(0).cast("long"), lambda bits, h: F.when(
            F.shiftright(h, 6).bitwiseAND(F.lit(SKETCH - 1)) == i, bits.bitwiseOR(one(h))).otherwise(bits))
    return bound(hashes, lambda own: F.struct(*[bits_of(own, i).alias(f"s{i}") for i in range(SKETCH)]))


def alike(a: str, b: str, most: Column) -> Column:
    """Whether sketches differ by what so many edits can change: three words each, of both lines."""
    return F.expr(" + ".join(f"bit_count({a}.s{i} ^ {b}.s{i})" for i in range(SKETCH))) <= 3 * most


def pair_sketches(lines: DataFrame) -> DataFrame:
    """(node, p0, ...): the pairs of neighbouring characters of each line that it has an odd number of
    times, a bit for each, in ``SKETCH`` numbers of 64.

    Unlike sets of words, the sketches of long lines do not fill up: bits differ only by pairs that
    one line has more often than the other.
    """
    pairs = lines.selectExpr("node", "encode(line, 'UTF-32') as wide").selectExpr(
        "node", "wide", "explode(sequence(0, greatest(octet_length(wide) div 4 - 2, 0))) as at").selectExpr(
        "node", "xxhash64(substring(wide, cast(4 * at + 1 as int), 8)) as h").selectExpr(
        "node", f"cast(shiftright(h, 6) & {SKETCH - 1} as int) as i",
        "shiftleft(1L, cast(h & 63 as int)) as bit")
    return pairs.groupBy("node").agg(*[F.expr(
        f"bit_xor(if(i = {i}, bit, 0L))").alias(f"p{i}") for i in range(SKETCH)])


def maybe_near() -> Column:
    """Whether the words and character pairs of line_a and line_b allow that they are near."""
    most = F.least("sketch_a.k", "sketch_b.k")
    pairs = F.expr(" + ".join(f"bit_count(sketch_a.p{i} ^ sketch_b.p{i})" for i in range(SKETCH)))
    return (pairs <= 4 * most) & alike("sketch_a.words", "sketch_b.words", most)


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """What ``use`` makes of a value that is worked out once."""
    return F.get(F.transform(F.array(value), use), 0)


def equal_chars(a: Column, b: Column, most: Column, start: Callable[[Column, Column, Column], Column]) -> Column:
    """Characters, ``most`` at most, that two strings share from an end; ``start`` tells where in a
    string so many more begin after those found. Powers of two are tried from the largest on."""
    steps = F.transform(F.sequence(F.length(F.bin(most)) - 1, F.lit(0)), lambda i: F.call_function(
        "shiftleft", F.lit(1), i))
    same = lambda n, step: (
        F.substring(a, start(a, n, step), step) == F.substring(b, start(b, n, step), step))
    return F.aggregate(steps, F.lit(0), lambda n, step: F.when(
        (n + step <= most) & same(n, step), n + step).otherwise(n))


def distance(a: Column, b: Column, most: int) -> Column:
    """Edits between two strings, -1 for more than ``most``; of what is left between their equal ends,
    as the time of Spark's function grows with the product of the lengths."""
    least = F.least(F.length(a), F.length(b))
    head = equal_chars(a, b, least, lambda x, n, step: n + 1)

    def tail(p: Column) -> Column:
        return equal_chars(a, b, least - p, lambda x, n, step: F.length(x) - n - step + 1)
    return bound(head, lambda p: bound(tail(p), lambda q: F.levenshtein(
        F.substring(a, p + 1, F.length(a) - p - q), F.substring(b, p + 1, F.length(b) - p - q), most)))


def near(a: Column, b: Column, max_edits: int) -> Column:
    """Whether two lines are as many edits apart as the shorter one may have, or fewer."""
    return bound(distance(a, b, max_edits), lambda apart: (apart >= 0) & (
        apart <= allowed(F.least(F.length(a), F.length(b)), max_edits)))


def one_edit(a: Column, b: Column) -> Column:
    """Whether two strings are at most one edit apart."""
    return near(a, b, 1)


def linked_lines(
    every: DataFrame, places: DataFrame, nodes: DataFrame, max_edits: int, min_chars: int,
) -> DataFrame:
    """(node, component) of the lines that are linked with another."""
    first = meeting_entries(every, places, nodes, max_edits, min_chars)
    wanted = written(first.select("node").distinct(), "line-wanted")
    bits = word_bits(wanted.count())
    texts = maybe_in(every.select("node", "line"), "node", bitmap(wanted, bits, "line-node-bits"), bits)
    # Not a semi-join: Spark would do it before that with the bitmap, and shuffle the text of all lines.
    lines = written(texts.join(wanted, "node").groupBy("node").agg(F.first("line").alias("line")),
                    "line-texts")
    lines = written(lines.join(pair_sketches(lines), "node").select("node", "line", F.struct(
        allowed(F.length("line"), max_edits).alias("k"), word_sketch(F.col("line")).alias("words"),
        *[f"p{i}" for i in range(SKETCH)]).alias("sketch")), "line-sketches")
    sizes = written(first.groupBy("segment").agg(
        F.min(F.when(F.col("found"), F.col("node"))).alias("first"), F.count("*").alias("n")),
        "line-sizes")

    few = first.join(sizes.filter(f"n <= {CROWD}").select("segment"), "segment")
    one = few.filter("found").select("segment", F.col("node").alias("a"), F.col("chars").alias("chars_a"))
    two = few.select("segment", F.col("node").alias("b"), "found", F.col("chars").alias("chars_b"))
    met = one.join(two, "segment").filter("a < b or (a != b and not found)")
    crowd = written(first.join(sizes.filter(f"n > {CROWD}"), "segment"), "line-crowds")
    star = crowd.filter("node != first").select(F.col("first").alias("a"), F.col("node").alias("b"))
    met = met.filter(f"abs(chars_a - chars_b) <= {max_edits}").select("a", "b")
    pairs = written(met.unionByName(star).select(
        F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "line-pairs")
    sketch = lambda n: lines.select(F.col("node").alias(n), F.col("sketch").alias(f"sketch_{n}"))
    likely = written(pairs.join(sketch("a"), "a").join(sketch("b"), "b").filter(maybe_near()).select(
        "a", "b"), "line-likely")
    edges = written(near_pairs(likely, lines, max_edits), "line-edges")
    found = components(edges)
    if crowd.isEmpty():
        return found
    likely = written(crowd_pairs(crowd, found, lines, max_edits).distinct(), "line-crowd-likely")
    rest = written(near_pairs(likely, lines, max_edits), "line-crowd-edges")
    return components(edges.unionByName(rest))


def near_pairs(likely: DataFrame, lines: DataFrame, max_edits: int) -> DataFrame:
    """The pairs (a, b) of near lines; texts are joined only to pairs whose sketches allow a link."""
    text = lambda n: lines.select(F.col("node").alias(n), F.col("line").alias(f"line_{n}"))
    return likely.join(text("a"), "a").join(text("b"), "b").filter(near(
        F.col("line_a"), F.col("line_b"), max_edits)).select("a", "b")


def crowd_pairs(
    crowd: DataFrame, found: DataFrame, lines: DataFrame, max_edits: int,
) -> DataFrame:
    """(a, b) of lines of a crowd that are in different components and may be near by their sketches;
    lines that meet in several segments come as often."""
    labelled = written(crowd.select("segment", "node", "chars", "found").join(
        found.select(F.col("node").alias("of"), "component"), F.col("node") == F.col("of"),
        "left").select("segment", "node", "chars", "found", F.coalesce("component", "node").alias("label")),
        "line-crowd-labels")
    blocks = written(labelled.groupBy("segment").agg(
        F.min("label").alias("low"), F.max("label").alias("high"),
        F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")).filter("low < high").select(
        "segment", "blocks"), "line-crowd-blocks")
    members = written(labelled.join(blocks, "segment").join(lines.select("node", "sketch"), "node"),
                      "line-crowd-members")
    one = members.filter("found").select(
        "segment", F.pmod(F.xxhash64("node"), "blocks").cast("int").alias("block"),
        F.col("node").alias("a"), F.col("label").alias("label_a"), F.col("chars").alias("chars_a"),
        F.col("sketch").alias("sketch_a"))
    two = members.select(
        "segment", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"),
        F.col("node").alias("b"), F.col("label").alias("label_b"), F.col("chars").alias("chars_b"),
        F.col("sketch").alias("sketch_b"), F.col("found").alias("found_b"))
    return one.join(two, (one["segment"] == two["segment"]) & (one["block"] == two["block"]) & (
        F.col("label_a") != F.col("label_b")) & ((F.col("a") < F.col("b")) | ~F.col("found_b")) & (
        F.abs(F.col("chars_a") - F.col("chars_b")) <= max_edits) & maybe_near()).select(
        F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def dropped_lines(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS,
    max_edits: int = 1,
) -> DataFrame:
    """(id, of, at, near) of the lines to drop; ``near`` where no equal line comes earlier."""
    if min_chars < 16:
        raise ValueError("lines must be long enough for the splits before the first pairs")
    if not 1 <= max_edits < 32:
        raise ValueError("max_edits must be from 1 to 31")
    every = occurrences(docs, doc_id, text, min_chars)
    # All that later steps need of a line but its text, so that texts are cut into lines three times only.
    places = written(own_segments(every, max_edits, min_chars).drop("line"), "line-places")
    nodes = written(places.groupBy("node", "check").agg(
        F.min("id").alias("winner"), F.count("*").alias("n"), F.min("low").alias("low")), "line-nodes")
    linked = linked_lines(every.select("node", "line"), places, nodes, max_edits, min_chars)
    classes = written(line_classes(nodes, linked), "line-classes")

    hits = written(places.select("id", "of", "at", "node", "check").join(classes, ["node", "check"]),
                   "line-hits")
    first = F.min(F.struct("at", "of")).alias("first")
    kept = hits.filter("id = class_winner").groupBy("class", "id").agg(first).select(
        "class", "id", "first.*", F.lit(True).alias("kept"))
    first_equal = hits.filter("id = winner").groupBy("node", "check", "id").agg(first).select(
        "node", "check", "id", "first.*", F.lit(True).alias("near"))
    return hits.select("id", "of", "at", "node", "check", "class").join(
        kept, ["class", "id", "of", "at"], "left").filter("kept is null").join(
        first_equal, ["node", "check", "id", "of", "at"], "left").select(
        "id", "of", "at", F.coalesce("near", F.lit(False)).alias("near"))


def line_classes(nodes: DataFrame, linked: DataFrame) -> DataFrame:
    """(node, check, winner, class, class_winner) of lines that have an equal or linked one.

    ``winner`` is the smallest document with the line, ``class_winner`` that with one of its class.
    """
    label = linked.select(F.col("node").alias("of"), "component")
    classed = nodes.join(label, F.col("node") == F.col("of"), "left").filter(
        "n > 1 or component is not null").select(
        "node", "check", "winner", F.coalesce("component", F.xxhash64("node", "check")).alias(
            "class"))
    classed = written(classed, "line-classed")
    winners = classed.groupBy("class").agg(F.min("winner").alias("class_winner"))
    return classed.join(written(winners, "line-winners"), "class")


def without_dropped(
    docs: DataFrame, dropped: DataFrame, doc_id: str = "doc_id", text: str = "text",
) -> DataFrame:
    """The documents without the dropped lines; those left without a word go.

    Lines are dropped by id and text, so a document loses no line that only its namesake repeats.
    """
    per_doc = written(dropped.groupBy("id", "of").agg(F.collect_set("at").alias(own("drop"))).select(
        F.col("id").alias(own("id")), F.col("of").alias(own("of")), own("drop")), "line-drops")
    lines, drop = F.split(F.col(text), "\n"), F.col(own("drop"))
    places = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), drop)
    left = F.concat_ws("\n", F.transform(places, lambda i: F.get(lines, i)))
    cleaned = F.when(drop.isNull(), F.col(text)).otherwise(left)
    joined = docs.join(per_doc, (F.col(doc_id).cast("long") == F.col(own("id"))) & (
        F.xxhash64(F.col(text)) == F.col(own("of"))), "left")
    names = [F.col(f"`{n}`") if n != text else cleaned.alias(text) for n in docs.columns]
    return joined.filter(drop.isNull() | cleaned.rlike(WORD)).select(*names)
