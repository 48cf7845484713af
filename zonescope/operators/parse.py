"""Dump lines -> resolver records.

The meaning of a line depends on the lines before it: whether a cache section is open, the last
attribute comment, whether a bracketed TYPE65 value is still open, and the owner in force. All
four are worked out in three levels:

1. inside each block (a run of lines of one split), with windows, for both possible states at its start;
2. inside each range of blocks, over one summary row per block segment, for all states at its start;
3. over one row per range, which gives each range, and so each block, the state it starts with.

The lines are shuffled and sorted once, by block; a task holds the blocks that hash to it. A block is a
run of lines of one split, as a split may hold more lines than a task can sort. It is cut in two
segments at its first section marker: what lies before it counts only if the section was open when the
block began.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from zonescope import constants as C
from zonescope.functions import svcb
from zonescope.functions.text import whole_number
from zonescope.plans.workspace import tasks_for, written
from zonescope.sources.dump import SPLIT, Dump

WS, TOKEN = r"[\t\n\f\r ]", r"[^\t\n\f\r ]"
STRIPE = 1 << 20  # lines of a source that one task may gather
BLOCK_LINES = 1 << 15  # numbers of lines that a block spans
BLOCK = [*SPLIT, "piece"]


@dataclass(frozen=True)
class Dialect:
    """``compat`` keeps every oddity of the dump rules; otherwise common shapes are read in full."""

    compat: bool = True

    @property
    def types(self) -> tuple[str, ...]:
        extra = () if self.compat else ("IN A", "IN AAAA", "IN CNAME", "TYPE64")
        return C.POSITIVE_TYPES + extra

    @property
    def negative_types(self) -> tuple[str, ...]:
        return C.NEGATIVE_TYPES + (() if self.compat else ("TYPE64",))

    @property
    def routes(self) -> dict[str, str]:
        extra = {"IN A": "A", "IN AAAA": "AAAA", "IN CNAME": "CNAME", "IN PTR": "PTR",
                 "TYPE64": "TYPE64"}
        return C.ROUTES if self.compat else {**C.ROUTES, **extra}

    @property
    def record_line(self) -> str:
        """owner? ttl \\-? type rest, as five groups."""
        types = "|".join(t.replace(" ", WS + "+") for t in self.types)
        return rf"(?d)^({TOKEN}+)?{WS}*([0-9]+){WS}+(\\-)?({types}){WS}+(.+)\z"


# The shape of what follows the type.
START_REST = rf"^\\#{WS}+[0-9]+{WS}*\({WS}*"
SHORT_REST = rf"(?d)^{TOKEN}+(?:{WS}+{TOKEN}+(?:{WS}*\(.*)?)?\z"
NEGATIVE_REST = rf"^;-\${TOKEN}+\z"
UNBRACKETED = rf"^\\#{WS}+[0-9]+{WS}+"


def classify(lines: DataFrame, dialect: Dialect) -> DataFrame:
    """What each line says on its own: no state, one pass of one pattern over record lines."""
    line = F.col("line")
    closing = F.lit(False)
    for words in C.CACHE_CLOSES:
        closing = closing | line.contains(words)
    space = r"[\s\x0B\u0085\p{Z}]*"
    comment = rf"^;{space}({'|'.join(C.ATTRIBUTES)}){space}\z"
    marked = lines.select(
        *BLOCK, "mid", "line",
        F.when(line.contains(C.CACHE_OPENS), True).when(closing, False).alias("marker"),
        line.startswith(";").alias("comment"),
        (line.startswith(";") | line.startswith("$")).alias("skipped"),
    ).select(
        "*",
        F.when(F.col("comment"), F.nullif(F.regexp_extract("line", comment, 1), F.lit("")))
        .alias("attr_mark"),
        (F.col("marker").isNull() & ~F.col("skipped")).alias("plain"),
    )
    text = line if dialect.compat else F.regexp_replace("line", rf"{WS}+\z", "")
    # A line holds no line feed, so a line feed can part the groups.
    groups = F.split(F.regexp_replace(text, dialect.record_line, "$1\n$2\n$3\n$4\n$5"), "\n")
    split = marked.withColumn("g", F.when(F.col("plain"), groups)).select(
        *BLOCK, "mid", "line", "marker", "attr_mark", "plain",
        *(F.get("g", F.lit(i)).alias(name) for i, name in
          enumerate(("owner_text", "ttl_text", "minus", "type_text", "rest"))),
    )
    matched = F.col("rest").isNotNull()
    negative = F.col("minus") == "\\-"
    positive = matched & ~negative
    start = positive & (F.col("type_text") == "TYPE65") & F.col("rest").rlike(START_REST)
    has_close = line.contains(")")
    if dialect.compat:
        short = F.col("rest").rlike(SHORT_REST)
        one_line = F.lit(False)
    else:
        short = F.lit(True)
        one_line = F.col("rest").contains(")")
    indented = line.rlike(rf"^{WS}") & ~F.col("type_text").rlike(rf"^(?:IN{WS}+)?NS\z")
    form = (
        F.when(start & ~one_line, "start")
        .when(positive & (short | start), "record")
        .when(positive & indented, "indented")
        .when(matched & negative & F.col("type_text").isin(*dialect.negative_types)
              & F.col("rest").rlike(NEGATIVE_REST), "negative")
    )
    owner = F.col("owner_text")
    any_owner = owner if dialect.compat else F.nullif(owner, F.lit(""))
    return split.withColumn("form", form).select(
        *BLOCK, "mid", "line", "marker", "attr_mark", "plain", "ttl_text", "type_text", "rest",
        "form", has_close.alias("has_close"),
        F.when(F.col("form") == "start", any_owner)
        .when(F.col("form").isin("record", "negative") & owner.endswith("."), owner)
        .alias("sets_owner"),
    )


def _flip(state: Column, times: Column) -> Column:
    return (state + times) % 2


def _local_state(lines: DataFrame, dialect: Dialect) -> DataFrame:
    """State inside each block segment, for a start outside (0) and inside (1) an open value.

    All windows share one partitioning and order, so the lines are shuffled and sorted once. What
    is carried forward is marked with its segment, as the first segment may turn out not to count.
    """
    block = Window.partitionBy(*BLOCK).orderBy("mid")
    so_far = block.rowsBetween(Window.unboundedPreceding, 0)
    earlier = block.rowsBetween(Window.unboundedPreceding, -1)
    df = classify(lines, dialect).select(
        "*", F.last("marker", True).over(so_far).alias("gate"), F.row_number().over(block).alias("rn"),
    ).withColumn("seg", F.col("gate").isNotNull().cast("int"))
    # In the first segment the section is taken to be open; the summaries put that right.
    is_open = F.col("marker").isNull() & F.coalesce("gate", F.lit(True))
    df = df.withColumn("open", is_open).withColumn("live", F.col("open") & F.col("plain"))
    live, starts = F.col("live"), F.coalesce(F.col("form") == "start", F.lit(False))
    # A line maps the "value is open" flag to a fixed flag, flips it, or leaves it.
    df = df.select(
        "*",
        F.when(live & starts & F.col("has_close"), 1).otherwise(0).alias("flip"),
        F.when(live & starts & ~F.col("has_close"), 1)
        .when(live & ~starts & F.col("has_close"), 0).alias("fixed"),
    )
    head_flips = F.sum(F.when(F.col("seg") == 0, F.col("flip")).otherwise(0)).over(so_far)
    tail_flips = F.sum(F.when(F.col("seg") == 1, F.col("flip")).otherwise(0)).over(so_far)
    attr = F.when(F.col("open") & F.col("attr_mark").isNotNull(), F.struct("seg", "attr_mark"))
    df = df.select(
        "*",
        F.when(F.col("seg") == 0, head_flips).otherwise(tail_flips).alias("flips"),
        F.last(attr, True).over(so_far).alias("attr"),
        F.lead("seg").over(block).alias("next_seg"),
    )
    # The fixed flag less the flips up to it, from which later lines count on; plus 2 in segment 1.
    anchor = F.when(F.col("fixed").isNotNull(), _flip(F.col("fixed"), F.col("flips")) + 2 * F.col("seg"))
    df = df.withColumn("anchor", F.last(anchor, True).over(earlier)).withColumn(
        "flips_before", F.col("flips") - F.col("flip"))
    df = df.withColumn("known_before", F.when(
        F.floor(F.col("anchor") / 2) == F.col("seg"),
        _flip(F.col("anchor") % 2, F.col("flips_before"))))
    df = df.select(
        "*",
        F.coalesce("fixed", _flip(F.col("known_before"), F.col("flip"))).alias("known"),
        *(F.coalesce("known_before", _flip(F.lit(m), F.col("flips_before"))).alias(f"before{m}")
          for m in (0, 1)),
    )
    marks = []
    for m in (0, 1):
        outside = live & (F.col(f"before{m}") == 0)
        owner = F.when(outside & F.col("sets_owner").isNotNull(), F.struct("seg", "sets_owner"))
        first = F.when(outside & starts, 2 * F.col("rn") + F.col("seg"))
        marks += [F.last(owner, True).over(so_far).alias(f"owner{m}"),
                  F.last(first, True).over(so_far).alias(f"start{m}")]
    df = df.select("*", *marks)
    mine = F.col("seg")
    may_be_inside = (F.col("before0") == 1) | (F.col("before1") == 1)
    return df.select(
        *BLOCK, "seg", "rn", "next_seg", "marker", "plain", "form", "ttl_text", "type_text",
        "rest", "has_close", "sets_owner", "gate", "known", "flips", "before0", "before1",
        F.when(live & may_be_inside, svcb.clean_hex(F.col("line"))).alias("body"),
        F.when(F.col("attr.seg") == mine, F.col("attr.attr_mark")).alias("attr"),
        *(F.when(F.col(f"owner{m}.seg") == mine, F.col(f"owner{m}.sets_owner")).alias(f"owner{m}")
          for m in (0, 1)),
        *(F.when(F.col(f"start{m}") % 2 == mine, F.floor(F.col(f"start{m}") / 2)).alias(f"start{m}")
          for m in (0, 1)),
    )


#: What may hold before a unit: the section gate and the "value is open" flag.
BEGINNINGS = [(gate, inside) for gate in (0, 1) for inside in (0, 1)]


def _units(local: DataFrame) -> DataFrame:
    """One row per block segment: what it does to the state, as a function of the gate before it.

    ``fixed<g>`` or ``flip<g>`` say what becomes of the "value is open" flag; ``attr<g>``,
    ``owner<g><m>`` and ``start<g><m>`` are what it carries on for gate g and flag m before it. A first
    segment leaves all as it is when the gate is shut.
    """
    ends = local.filter("next_seg IS NULL OR next_seg <> seg")
    first = F.col("seg") == 0
    shut = lambda value, none=None: F.when(first, F.lit(none)).otherwise(value)
    flip = F.col("flips") % 2
    return ends.select(
        *BLOCK, "seg", "gate",
        F.when(F.col("next_seg").isNull(), F.col("rn")).otherwise(0).alias("n"),
        shut(F.col("known")).alias("fixed0"), F.col("known").alias("fixed1"),
        shut(flip, 0).alias("flip0"), flip.alias("flip1"),
        shut(F.col("attr")).alias("attr0"), F.col("attr").alias("attr1"),
        *(shut(F.col(f"{name}{m}")).alias(f"{name}0{m}") for name in ("owner", "start")
          for m in (0, 1)),
        *(F.col(f"{name}{m}").alias(f"{name}1{m}") for name in ("owner", "start") for m in (0, 1)),
    )


def _carried(
    units: DataFrame, by: list[str], order: list[str], beginnings: list[tuple[int, int]]
) -> DataFrame:
    """Adds ``offset`` and, for each beginning (g, m) of a group, ``from<g><m>``: the state before
    each unit and, as ``to``, after it. Numbers of lines count from the group's begin."""
    group = Window.partitionBy(*by).orderBy(*order)
    so_far = group.rowsBetween(Window.unboundedPreceding, 0)
    earlier = group.rowsBetween(Window.unboundedPreceding, -1)
    gates = sorted({g for g, _ in beginnings})
    df = units.withColumns({
        "offset": F.coalesce(F.sum("n").over(earlier), F.lit(0)),
        **{f"gate_in{g}": F.coalesce(F.last("gate", True).over(earlier), F.lit(bool(g)))
           for g in gates},
    })

    def by_gate(name: str, g: int) -> Column:
        return F.when(F.col(f"gate_in{g}"), F.col(f"{name}1")).otherwise(F.col(f"{name}0"))

    df = df.withColumns({f"turns{g}": F.sum(by_gate("flip", g)).over(so_far) for g in gates})
    df = df.withColumns({f"anchor{g}": F.last(F.when(by_gate("fixed", g).isNotNull(), _flip(
        by_gate("fixed", g), F.col(f"turns{g}"))), True).over(so_far) for g in gates})
    df = df.withColumns({f"open{g}{m}": _flip(F.coalesce(f"anchor{g}", F.lit(m)), F.col(f"turns{g}"))
                         for g, m in beginnings})
    df = df.withColumns({f"open_in{g}{m}": F.lag(f"open{g}{m}", 1, m).over(group)
                         for g, m in beginnings})

    def picked(name: str, g: int, m: int) -> Column:
        def at(gate: int) -> Column:
            return F.when(F.col(f"open_in{g}{m}") == 1, F.col(f"{name}{gate}1")).otherwise(
                F.col(f"{name}{gate}0"))
        return F.when(F.col(f"gate_in{g}"), at(1)).otherwise(at(0))

    def state(g: int, m: int, rows: Window, gate: Column, inside: Column) -> list[Column]:
        return [
            gate.alias("gate"), inside.alias("open"),
            F.last(by_gate("attr", g), True).over(rows).alias("attr"),
            F.last(picked("owner", g, m), True).over(rows).alias("owner"),
            F.last(picked("start", g, m) + F.col("offset"), True).over(rows).alias("start")]

    names = [*units.columns, "offset"]
    return df.select(*names, *(F.struct(
        *state(g, m, earlier, F.col(f"gate_in{g}"), F.col(f"open_in{g}{m}")),
        F.struct(*state(g, m, so_far, F.last("gate", True).over(so_far), F.col(f"open{g}{m}")))
        .alias("to")).alias(f"from{g}{m}") for g, m in beginnings))


def _composed(carried: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """The units of each group as one unit, in the columns of ``_units``."""
    last = F.struct(*order)
    rows = carried.groupBy(*by).agg(
        F.sum("n").alias("n"),
        *(F.max_by(f"from{g}{m}.to", last).alias(f"to{g}{m}") for g, m in BEGINNINGS))
    # The flag after the group is the same for both flags before it, or keeps or turns them.
    fixed = lambda g: F.when(
        F.col(f"to{g}0.open") == F.col(f"to{g}1.open"), F.col(f"to{g}0.open"))
    return rows.select(
        *by, "n", F.col("to00.gate").alias("gate"),
        *(fixed(g).alias(f"fixed{g}") for g in (0, 1)),
        *(F.when(fixed(g).isNull(), F.col(f"to{g}0.open")).otherwise(0).alias(f"flip{g}")
          for g in (0, 1)),
        *(F.col(f"to{g}0.attr").alias(f"attr{g}") for g in (0, 1)),
        *(F.col(f"to{g}{m}.{name}").alias(f"{name}{g}{m}") for name in ("owner", "start")
          for g, m in BEGINNINGS))


def _incoming_state(local: DataFrame, files: DataFrame, ranges: int | None = None) -> DataFrame:
    """One row per block: the state its two segments start with, and its first line number.

    Segments are functions of the state before them. They are sorted in ranges, composed inside each
    range for every state that may hold before it, and the compositions of the ranges are scanned:
    no task holds more than the segments of one range, or one row per range.
    """
    spark = local.sparkSession
    ranges = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    place, by = ["file", "block_start", "piece", "seg"], ["source", "range"]
    units = written(
        _units(local).join(files, "file_key").repartitionByRange(ranges, "source", *place)
        .withColumn("range", F.spark_partition_id()), "units")
    inside = written(_carried(units, by, place, BEGINNINGS), "segments")
    scanned = _carried(_composed(inside, by, place), ["source"], ["range"], [(0, 0)])
    whole = Window.partitionBy("source").orderBy("range").rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing)
    at_end = F.last("from00.to").over(whole)
    scanned = written(scanned.select(
        *by, F.col("offset").alias("before"), F.col("from00").alias("begin"),
        F.when(at_end["open"] == 1, at_end["start"]).alias("unclosed")), "ranges")

    df = inside.join(scanned, by)
    pick = F.when(F.lit(False), F.col("from00"))
    for g, m in BEGINNINGS:
        pick = pick.when((F.col("begin.gate") == bool(g)) & (F.col("begin.open") == m),
                         F.col(f"from{g}{m}"))
    entry = F.struct(
        "source", F.col("at.gate").alias("gate_in"), (F.col("before") + F.col("offset")).alias("offset"),
        F.col("at.open").alias("open_in"), F.coalesce("at.attr", "begin.attr").alias("attr_in"),
        F.coalesce("at.owner", "begin.owner").alias("owner_in"),
        F.coalesce(F.col("before") + F.col("at.start"), F.col("begin.start")).alias("start_in"),
        "unclosed")
    return df.withColumn("at", pick).groupBy(*BLOCK).agg(
        F.first(F.when(F.col("seg") == 0, entry), True).alias("head"),
        F.first(F.when(F.col("seg") == 1, entry), True).alias("tail"),
    )


def line_states(
    dump: Dump, compat: bool = True, ranges: int | None = None, block_lines: int = BLOCK_LINES
) -> DataFrame:
    """Every line with the state in force: section gate, attribute, open value and owner.

    ``seq`` is the number of the line in its source, empty lines not counted; ``value_seq`` that
    of the line that started the bracketed value. ``ranges`` of blocks are scanned at once (by default
    as many as the session has shuffle partitions). The lines are counted first: there are so many tasks
    that each sorts a bounded number of blocks, which hold ``block_lines`` lines at most.

    The lines with their local state are written first, so the patterns and windows run once. So is
    the block table; Spark broadcasts it when its measured size is under the session's threshold.
    """
    spark = dump.lines.sparkSession
    lines = dump.lines.withColumn("piece", F.floor(F.col("mid") / block_lines)).repartition(
        tasks_for(spark, dump.lines.count()), *BLOCK)
    local = written(_local_state(lines, Dialect(compat)), "lines")
    blocks = written(_incoming_state(local, dump.files, ranges), "blocks")
    df = local.join(blocks, BLOCK).withColumn(
        "at", F.when(F.col("seg") == 0, F.col("head")).otherwise(F.col("tail"))
    )
    inside = F.col("at.open_in") == 1

    def pick(name: str) -> Column:
        return F.when(inside, F.col(f"{name}1")).otherwise(F.col(f"{name}0"))

    return df.select(
        F.col("at.source").alias("source"),
        (F.col("at.offset") + F.col("rn")).alias("seq"),
        "body", "marker", "plain", "form", "ttl_text", "type_text", "rest", "has_close",
        (F.col("marker").isNull() & F.coalesce(F.col("gate"), F.col("at.gate_in")))
        .alias("in_cache"),
        pick("before").alias("in_value"),
        F.coalesce("attr", "at.attr_in", F.lit(C.NO_ATTRIBUTE)).alias("attribute"),
        F.coalesce(pick("owner"), F.col("at.owner_in")).alias("owner"),
        "sets_owner",
        F.coalesce(F.col("at.offset") + pick("start"), F.col("at.start_in")).alias("value_seq"),
        F.col("at.unclosed").alias("unclosed"),
    )


def resolved_lines(states: DataFrame, compat: bool = True) -> DataFrame:
    """The lines that make a record, a piece of a record or a domain, with their state.

    kind: record, indented, negative, or start/body/close of a bracketed value. A value that is
    never closed is left out, but its owner stays registered.
    """
    dialect = Dialect(compat)
    inside = F.col("in_value") == 1
    kind = F.when(inside, F.when(F.col("has_close"), "close").otherwise("body")).otherwise(
        F.col("form"))
    routes = F.create_map(*(F.lit(x) for pair in dialect.routes.items() for x in pair))
    negative = F.col("kind") == "negative"
    return states.filter("in_cache AND plain").withColumn("kind", kind).select(
        "source", "seq", "kind", F.col("owner").alias("domain"),
        F.when(~inside, F.col("sets_owner")).alias("registers"),
        F.when(negative, F.col("type_text")).otherwise(
            F.try_element_at(routes, F.col("type_text"))).alias("rtype"),
        F.when(~inside, whole_number(F.col("ttl_text"))).alias("ttl"),
        "attribute",
        F.when(negative, F.lower(F.expr("substr(rest, 4)"))).otherwise("").alias("rcode"),
        F.when(F.col("kind") == "start", svcb.clean_hex(F.regexp_replace("rest", START_REST, "")))
        .when(inside, F.col("body"))
        .when(negative, "").otherwise(F.col("rest")).alias("rest"),
        F.when(F.col("kind").isin("start", "body", "close"), F.col("value_seq"))
        .alias("value_seq"),
        "unclosed",
    ).filter(
        "kind IS NOT NULL AND (registers IS NOT NULL OR value_seq IS NULL"
        " OR unclosed IS NULL OR value_seq <> unclosed)"
    ).withColumn(
        "kind", F.when(F.col("value_seq") == F.col("unclosed"), "owner").otherwise(F.col("kind"))
    ).drop("unclosed")


def domains(resolved: DataFrame) -> DataFrame:
    """The owners a dump names, with or without a kept record."""
    return resolved.filter("registers IS NOT NULL").select(
        "source", F.col("registers").alias("domain")).distinct()


def stitched_values(resolved: DataFrame) -> DataFrame:
    """Bracketed values, one row each: pieces joined per stripe of lines, then per value."""
    pieces = resolved.filter(F.col("kind").isin("start", "body", "close")).withColumn(
        "stripe", F.floor(F.col("seq") / STRIPE))

    def joined(item: str) -> Column:
        return F.array_join(
            F.transform(F.array_sort(F.collect_list(item)), lambda x: x["rest"]), "")

    ending = F.when(F.col("kind") == "close", F.struct("seq", "domain", "attribute"))
    stripes = pieces.groupBy("source", "value_seq", "stripe").agg(
        F.max("ttl").alias("ttl"), F.max(ending).alias("ending"),
        joined(F.struct("seq", "rest")).alias("rest"),
    )
    return stripes.groupBy("source", "value_seq").agg(
        F.max("ttl").alias("ttl"), F.max("ending").alias("ending"),
        joined(F.struct("stripe", "rest")).alias("rest"),
    ).select(
        "source", "ending.seq", "ending.domain", F.lit("TYPE65").alias("rtype"), "ttl",
        "ending.attribute", F.lit("").alias("rcode"), "rest",
    )


def records(resolved: DataFrame, compat: bool = True) -> DataFrame:
    """One row per resource record or negative entry, in the order of ``seq``.

    ``rdata`` is the value as reported (decoded text for TYPE65, the server for MX); ``wire`` holds
    the hex data of a TYPE65 record. A TYPE65 value under two bytes has no ``rdata``.
    """
    single = resolved.filter(
        F.col("kind").isin("record", "indented", "negative") & F.col("rtype").isNotNull()
    ).select("source", "seq", "domain", "rtype", "ttl", "attribute", "rcode", "rest")
    rest, positive = F.col("rest"), F.col("rcode") == ""
    mx = F.col("rtype") == "MX"
    words = F.split(rest, " ", 2)
    hexed = rest if compat else F.regexp_replace(rest, UNBRACKETED + "|" + START_REST, "")
    wire = F.when(
        positive & (F.col("rtype") == "TYPE65"), svcb.even_hex(svcb.clean_hex(hexed)))
    df = single.unionByName(stitched_values(resolved)).filter(
        F.col("domain").isNotNull() & (F.col("domain") != "")
        & ~(mx & positive & (F.instr(rest, " ") == 0))
    ).withColumn("wire", wire)
    decoded = decode(df)
    return decoded.select(
        "source", "seq", "domain", "rtype", "ttl", "attribute", "rcode",
        F.when(F.col("wire").isNotNull(), svcb.readable(
            F.col("svc_priority"), F.col("svc_target.name"), F.col("svc_params")))
        .when(mx & positive, F.get(words, F.lit(1))).otherwise(rest).alias("rdata"),
        F.when(mx, F.when(positive, whole_number(F.get(words, F.lit(0)))).otherwise(0))
        .alias("priority"),
        "wire",
    )


def decode(df: DataFrame) -> DataFrame:
    """Adds svc_priority, svc_target and svc_params from ``wire``."""
    data = F.col("svc_data")
    return (
        df.withColumn("svc_data", F.unhex("wire"))
        .withColumn("svc_priority", svcb.priority(data))
        .withColumn("svc_target", svcb.target(data))
        .withColumn("svc_params", svcb.params(data, F.col("svc_target.next")))
    )


def negatives(records: DataFrame) -> DataFrame:
    """The domains with a negative entry, per kind."""
    return records.filter(F.col("rcode").isin("nxdomain", "nxrrset")).select(
        "source", "domain", "rcode").distinct()


def svcb_params(records: DataFrame) -> DataFrame:
    """One row per SVCB param in wire order, with its shown form, strict form and broken rule."""
    data = decode(records.filter("wire IS NOT NULL").select("source", "domain", "seq", "wire"))
    key, value = F.col("param.key"), F.col("param.value")
    return data.select(
        "source", "domain", "seq", F.col("svc_priority").alias("priority"),
        F.col("svc_target.name").alias("target"), F.posexplode("svc_params").alias("pos", "param"),
    ).select(
        "source", "domain", "seq", "priority", "target", "pos", key.alias("key"),
        F.hex(value).alias("value_hex"), svcb.param_text(key, value).alias("text"),
        svcb.strict_text(key, value).alias("strict"), svcb.violation(key, value).alias("violation"),
    )
