"""Delegation traces over captured responses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zonescope import constants as C
from zonescope.functions.arrays import either_contains
from zonescope.functions.text import fully_qualified, let
from zonescope.operators.health import NO_ITEMS, answers, no_items
from zonescope.operators.joins import ROWS_PER_TASK, spread_join
from zonescope.plans.workspace import tasks_for, written

#: Servers whose replies about one name a row may hold; names with more are walked by joins.
MAP_REPLIES = 4096
STEP = f"kind string, addresses {NO_ITEMS}, child_ns {NO_ITEMS}, auth_ns {NO_ITEMS}, target string"
TRACE = f"domain string, addresses {NO_ITEMS}, child_ns {NO_ITEMS}, parent_ns {NO_ITEMS}"


def _steps(
    responses: DataFrame, qtype: str, stop_on_rcode: bool, address: str | None
) -> DataFrame:
    """(server, qname, step): what a reply means for a walk; a reply without a step ends it.

    kind: end, alias (go on with ``target``) or next (ask the first of ``auth_ns``).
    """
    replies = answers(responses, qtype)
    addresses = F.col(address) if address else no_items()
    failed = F.col("rcode") != 0
    ended = F.when(failed, "end") if stop_on_rcode else F.when(F.lit(False), "end")
    kind = (
        ended.when(F.size("rr_cname") > 0, "alias")
        .when(F.size(addresses) > 0, "end")
        .when(~failed & (F.size("auth_ns") > 0), "next")
    )
    return replies.withColumn("kind", kind).filter("kind IS NOT NULL").select(
        "server", "qname", F.struct(
            "kind",
            F.when(failed & F.lit(stop_on_rcode), no_items()).otherwise(addresses)
            .alias("addresses"),
            F.when(F.col("auth_type") == "SOA", no_items()).otherwise(F.col("auth_ns"))
            .alias("child_ns"),
            "auth_ns", fully_qualified(F.get("rr_cname", F.lit(0))).alias("target"),
        ).alias("step"))


def _walk_rows(steps: DataFrame, root_ns: list[str], hops: int | None) -> DataFrame:
    """(qname, parent_ns, step): the walk of each name down from the root, inside its row.

    A name's replies are one map from server to step, at most ``map_replies`` of a walked name; names are
    dealt over tasks by the number of replies. All hops follow the map in one ``aggregate``. A walk
    without a hop limit asks each server of the map once at most: more hops would go round for ever.
    """
    tasks = tasks_for(steps.sparkSession, steps.count())
    names = steps.repartition(tasks, "qname").groupBy("qname").agg(
        F.map_from_entries(F.collect_list(F.struct("server", "step"))).alias("said"))
    state = f"struct<server: string, parent_ns: {NO_ITEMS}, step: struct<{STEP}>, live: boolean>"
    begin = F.struct(
        F.lit(root_ns[0]).alias("server"), F.lit(root_ns).cast(NO_ITEMS).alias("parent_ns"),
        F.lit(None).cast(f"struct<{STEP}>").alias("step"), F.lit(True).alias("live")).cast(state)

    def hop(at: Column, _: Column) -> Column:
        def asked(step: Column) -> Column:
            onward = F.coalesce(step["kind"] == "next", F.lit(False))
            return F.struct(
                F.when(onward, F.get(step["auth_ns"], F.lit(0))).alias("server"),
                F.when(onward, step["auth_ns"]).otherwise(at["parent_ns"]).alias("parent_ns"),
                step.alias("step"), onward.alias("live")).cast(state)
        return F.when(at["live"], let(
            F.try_element_at("said", F.coalesce(at["server"], F.lit(""))), asked)).otherwise(at)

    limit = F.size("said") if hops is None else F.lit(hops)
    walk = F.aggregate(F.sequence(F.lit(1), limit), begin, hop)
    return names.withColumn("walk", walk).select("qname", "walk.parent_ns", "walk.step").filter(
        "step.kind <> 'next'")


def _walk_joins(steps: DataFrame, root_ns: list[str], hops: int | None) -> DataFrame:
    """The same for names with so many replies that no row holds them: one join per hop."""
    frontier = steps.select("qname").distinct().select(
        "qname", F.lit(root_ns[0]).alias("server"), F.lit(root_ns).cast(NO_ITEMS).alias("parent_ns"),
        F.lit([root_ns[0]]).cast(NO_ITEMS).alias("asked"))
    found = steps.select("qname", F.lit(None).cast(NO_ITEMS).alias("parent_ns"), "step").limit(0)
    hop = 0
    while hops is None or hop < hops:
        hop += 1
        step = written(frontier.join(steps, ["server", "qname"]).select(
            "qname", "parent_ns", "step", "asked"), "hop")
        found = found.unionByName(step.filter("step.kind <> 'next'").drop("asked"))
        server = F.get("step.auth_ns", F.lit(0))
        frontier = step.filter("step.kind = 'next'")
        if hops is None:
            frontier = frontier.filter(~F.array_contains("asked", server))
        frontier = frontier.select(
            "qname", server.alias("server"), F.col("step.auth_ns").alias("parent_ns"),
            (F.array_append("asked", server) if hops is None else F.col("asked")).alias("asked"))
        if frontier.isEmpty():
            break
    return found


def walks(
    steps: DataFrame, root_ns: list[str], hops: int | None, map_replies: int = MAP_REPLIES
) -> DataFrame:
    """(qname, parent_ns, step) of the names whose walk reaches an end or an alias.

    Only names that the first root server was asked for can be walked; their replies are read once.
    """
    sizes = steps.groupBy("qname").agg(
        F.count("*").alias("n"), F.max(F.col("server") == root_ns[0]).alias("rooted"))
    many = written(sizes.filter((F.col("n") > map_replies) & F.col("rooted")).select("qname"), "many")
    if many.isEmpty():
        return _walk_rows(steps, root_ns, hops)
    few = steps.join(many, "qname", "left_anti")
    return _walk_rows(few, root_ns, hops).unionByName(
        _walk_joins(steps.join(many, "qname", "left_semi"), root_ns, hops))


def delegation_trace(
    names: DataFrame, responses: DataFrame, resolver: str, qtype: str = "A",
    hops: int | None = C.TRACE_HOPS, depth: int = C.TRACE_DEPTH, stop_on_rcode: bool = True,
    rows_per_task: int = ROWS_PER_TASK, map_replies: int = MAP_REPLIES,
) -> DataFrame:
    """(domain, addresses, child_ns, parent_ns) for each domain whose trace gives a result.

    The walk of a name does not depend on who asks for it, so all captured names are walked once, in
    one aggregate. A CNAME starts again at the root with its target, ``depth`` times at most: one
    join with the walks for each level of aliases in use.
    """
    spark = names.sparkSession
    root = responses.filter(
        (F.col("server") == resolver) & (fully_qualified(F.col("qname")) == "."))
    root = answers(root, qtype).first()  # one row
    if root is None or root["rcode"] != 0 or not root["auth_ns"]:
        return spark.createDataFrame([], TRACE)
    address = {"A": "rr_a", "AAAA": "rr_aaaa"}.get(qtype)
    steps = written(_steps(responses, qtype, stop_on_rcode, address), "steps")
    walked = written(walks(steps, root["auth_ns"], hops, map_replies), "walks")
    results = spark.createDataFrame([], TRACE)
    walkers = names.select("domain", fully_qualified(F.col("domain")).alias("qname")).distinct()
    for level in range(depth + 1):
        # At first a name stands for itself; later many names may wait for one target.
        joined = walkers.join(walked, "qname") if level == 0 else spread_join(
            walkers, walked, ["qname"], row_id=["domain"], rows_per_task=rows_per_task)
        reached = written(joined, "trace")
        results = results.unionByName(reached.filter("step.kind = 'end'").select(
            "domain", "step.addresses", "step.child_ns", "parent_ns"))
        walkers = reached.filter("step.kind = 'alias'").select(
            "domain", F.col("step.target").alias("qname"))
        if walkers.isEmpty():
            break
    return results


def trace_answers(
    names: DataFrame, responses: DataFrame, resolver: str, qtype: str = "A",
    depth: int = C.TRACE_DEPTH,
) -> DataFrame:
    """(domain, addresses): the answers-only trace. It has no hop limit, and a response code other
    than 0 only ends a trace whose reply holds neither a CNAME nor an address."""
    return delegation_trace(
        names, responses, resolver, qtype, hops=None, depth=depth, stop_on_rcode=False
    ).select("domain", "addresses")


def parent_child_mismatch(
    negatives: DataFrame, traces: DataFrame, compat: bool = True
) -> DataFrame:
    """NXDOMAIN domains whose child name servers do not hold all of the parent's."""
    names = negatives.filter("rcode = 'nxdomain'").select("source", "domain")
    agree = either_contains(F.col("child_ns"), F.col("parent_ns"), compat)
    return names.join(traces, "domain").filter((F.size("child_ns") > 0) & ~agree).select(
        "source", "domain", "child_ns", "parent_ns")
