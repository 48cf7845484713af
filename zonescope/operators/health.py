"""Health checks over captured responses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zonescope import constants as C
from zonescope.functions.arrays import bag_equal
from zonescope.functions.text import fully_qualified
from zonescope.operators.joins import ROWS_PER_TASK, spread_join
from zonescope.operators.lists import least_by
from zonescope.operators.reports import of_type
from zonescope.plans.workspace import TASK_ROWS, written

LISTS = ["rr_a", "rr_aaaa", "rr_cname", "rr_ns", "rr_mx", "rr_txt", "rr_ds"]
NO_ITEMS = "array<string>"


def no_items() -> Column:
    return F.array().cast(NO_ITEMS)


def status(answered: Column, rcode: Column, n_answers: Column) -> Column:
    """The status of one probe as text."""
    names = F.create_map(*(F.lit(x) for pair in C.RCODES.items() for x in pair))
    return (
        F.when(~F.coalesce(answered, F.lit(False)), F.lit(C.NO_REPLY))
        .when((rcode == 0) & (n_answers == 0), F.lit("NODATA"))
        .otherwise(F.coalesce(F.try_element_at(names, rcode), F.lit("")))
    )


def probe_status(responses: DataFrame) -> DataFrame:
    return responses.withColumn(
        "status", status(F.col("answered"), F.col("rcode"), F.col("n_answers")))


def latency(responses: DataFrame) -> DataFrame:
    """Adds ``latency_ms``: 0 for a probe without a reply."""
    ms = F.unix_millis("recv_at") - F.unix_millis("sent_at")
    return responses.withColumn("latency_ms", F.when(F.col("answered"), ms).otherwise(0))


def bucket_answers(raw: DataFrame) -> DataFrame:
    """Raw captures (record text) -> the columns of the response table.

    An answer counts by its type; the authority names are the fifth word of each authority
    record, and ``auth_type`` is the type of the last one.
    """
    def words(text: Column) -> Column:
        return F.split(F.trim(text), r"\s+")

    def of(rtype: str) -> Column:
        mine = F.filter("answer", lambda r: F.get(words(r), F.lit(3)) == rtype)
        return F.transform(mine, lambda r: F.get(F.split(r, "\t"), F.lit(4)))

    a_records = F.filter("answer", lambda r: F.get(words(r), F.lit(3)) == "A")
    authority = F.coalesce("authority", no_items())
    return raw.select(
        "server", "qname", "qtype", "attempt", "answered", "rcode",
        F.coalesce(F.size(F.coalesce("answer", no_items())), F.lit(0)).alias("n_answers"),
        *(F.coalesce(of(name[3:].upper()), no_items()).alias(name) for name in LISTS),
        F.get(words(F.try_element_at(a_records, F.lit(-1))), F.lit(1)).cast("bigint").alias("ttl_a"),
        F.transform(authority, lambda r: F.get(words(r), F.lit(4))).alias("auth_ns"),
        F.get(words(F.try_element_at(authority, F.lit(-1))), F.lit(3)).alias("auth_type"),
        "sent_at", "recv_at",
    )


def combine_types(responses: DataFrame, qtypes: list[str]) -> DataFrame:
    """One row per (server, qname): the answers over several query types, asked in that order.

    Lists add up and the last response code wins. The first type without a reply ends the row:
    what came before is kept. Each type is one aggregate, so a hot name needs no list of rows.
    """
    body = F.struct("answered", "rcode", *LISTS, "ttl_a", "auth_ns", "auth_type")
    first = responses.filter(F.col("attempt") == 1).groupBy("server", "qname").agg(*(
        F.min_by(body, F.when(F.col("qtype") == t, F.struct("sent_at"))).alias(f"t{i}")
        for i, t in enumerate(qtypes)))
    kept, going = [], F.lit(True)
    for i in range(len(qtypes)):
        going = going & F.coalesce(F.col(f"t{i}.answered"), F.lit(False))
        kept.append(F.when(going, F.col(f"t{i}")).alias(f"t{i}"))
    first = first.select("server", "qname", *kept)
    order = range(len(qtypes))

    def all_of(name: str) -> Column:
        return F.concat(*(F.coalesce(F.col(f"t{i}.{name}"), no_items()) for i in order))

    def last_of(name: str) -> Column:
        return F.coalesce(*(F.col(f"t{i}.{name}") for i in reversed(order)))

    return first.select(
        "server", "qname", F.coalesce(last_of("rcode"), F.lit(0)).alias("rcode"),
        *(all_of(name).alias(name) for name in LISTS),
        F.coalesce(last_of("ttl_a"), F.lit(0)).alias("ttl_a"),
        all_of("auth_ns").alias("auth_ns"), F.coalesce(last_of("auth_type"), F.lit("")).alias("auth_type"),
    )


def answers(
    responses: DataFrame, qtype: str = "A", attempts: int = 1, task_rows: int = TASK_ROWS
) -> DataFrame:
    """One row per (server, qname): the first reply within ``attempts`` tries; none, no row."""
    tries = responses.filter(
        (F.col("qtype") == qtype) & F.col("answered") & (F.col("attempt") <= attempts)
    ).select(
        "server", fully_qualified(F.col("qname")).alias("qname"),
        F.struct("rcode", "n_answers", "rr_a", "rr_aaaa", "rr_cname", "auth_ns", "auth_type").alias("reply"),
        F.struct("attempt", "sent_at").alias("at"))
    return least_by(tries, ["server", "qname"], "reply", "at", task_rows).select(
        "server", "qname", "reply.*")


def probed(names: DataFrame, responses: DataFrame, resolver: str) -> DataFrame:
    """Adds the resolver's ``status`` to each domain; no captured reply is a status of its own."""
    replies = answers(responses.filter(F.col("server") == resolver)).select(
        "qname", status(F.lit(True), F.col("rcode"), F.col("n_answers")).alias("status"))
    return names.withColumn("qname", fully_qualified(F.col("domain"))).join(
        replies, "qname", "left"
    ).withColumn("status", F.coalesce("status", F.lit(C.NO_REPLY))).drop("qname")


def failing_negatives(
    negatives: DataFrame, responses: DataFrame, resolver: str
) -> DataFrame:
    """NXRRSET domains that the resolver no longer answers: (source, domain, status)."""
    names = negatives.filter("rcode = 'nxrrset'").select("source", "domain")
    return probed(names, responses, resolver).filter(~F.col("status").isin("NOERROR", "NODATA"))


def _alias_steps(
    aliases: DataFrame, limit: int, rows_per_task: int
) -> list[tuple[int, DataFrame]]:
    """(n, (server, target, far)) for n = 1, 2, 4, ...: where ``n`` aliases in a row lead.

    Each table is the one before joined with itself, over alias rows alone, until no chain is that long.
    """
    steps, n = [], 1
    table = written(aliases.select("server", "qname", "target").toDF("server", "target", "far"), "alias-1")
    while n <= limit and not table.isEmpty():
        steps.append((n, table))
        n *= 2
        onward = table.select("server", "target", "far").toDF("server", "far", "further")
        if n <= limit:
            table = written(spread_join(
                table, onward, ["server", "far"], row_id=["target"], rows_per_task=rows_per_task,
            ).select("server", "target", F.col("further").alias("far")), f"alias-{n}")
    return steps


def chase_cnames(
    answers: DataFrame, limit: int = C.CNAME_LIMIT, rows_per_task: int = ROWS_PER_TASK,
    asked_for: DataFrame | None = None,
) -> DataFrame:
    """(server, qname, rr_a, rr_cname, hops): each answer after following its first CNAME at the
    same server, ``limit`` times at most. A name without a reply ends the chain with empty lists.

    Steps of 1, 2, 4, ... aliases are worked out once; a name takes the largest that fit, so rings
    and long chains stop at the limit. All replies are joined once, for the ends of the chains.
    ``asked_for`` (server, qname) limits the chains to those that start there.
    """
    replies = answers.select("server", "qname", "rr_a", "rr_cname")
    starts = replies.withColumn("hops", F.lit(0))
    if asked_for is not None:
        starts = starts.join(asked_for, ["server", "qname"], "left_semi")
    alias = F.size("rr_cname") > 0
    steps = _alias_steps(replies.filter(alias).select(
        "server", "qname", fully_qualified(F.get("rr_cname", F.lit(0))).alias("target")),
        limit, rows_per_task)
    if not steps:
        return starts
    at = starts.filter(alias).select("server", "qname", "hops", F.col("qname").alias("target"))
    for n, table in reversed(steps):
        far = F.when(F.col("hops") + n <= limit, F.col("far"))
        at = written(spread_join(
            at, table, ["server", "target"], "left", ["qname"], rows_per_task
        ).select("server", "qname", (F.col("hops") + F.when(far.isNotNull(), n).otherwise(0)).alias(
            "hops"), F.coalesce(far, "target").alias("target")), "chase")
    ends = replies.select(
        "server", F.col("qname").alias("target"), F.col("rr_a").alias("a"), F.col("rr_cname").alias("c"))
    found = spread_join(at, ends, ["server", "target"], "left", ["qname"], rows_per_task).select(
        "server", "qname", F.coalesce("a", no_items()).alias("rr_a"),
        F.coalesce("c", no_items()).alias("rr_cname"), "hops")
    return starts.filter(~alias).unionByName(found)


def ns_disagreement(
    records: DataFrame, responses: DataFrame, resolver: str, rows_per_task: int = ROWS_PER_TASK
) -> DataFrame:
    """(domain, name server) pairs whose addresses differ from the resolver's.

    The resolver is asked twice at most, a name server once. No reply counts as no addresses.
    """
    pairs = of_type(records, "NS").select(
        "source", "domain", "seq", F.col("rdata").alias("ns"),
        fully_qualified(F.col("domain")).alias("qname"))
    expected = answers(responses.filter(F.col("server") == resolver), attempts=2).select(
        "qname", F.col("rr_a").alias("expected_a"), F.col("rr_cname").alias("expected_cname"))
    asked_for = pairs.select(F.col("ns").alias("server"), "qname").distinct()
    actual = chase_cnames(
        written(answers(responses), "answers"), rows_per_task=rows_per_task, asked_for=asked_for,
    ).select(
        F.col("server").alias("ns"), "qname", F.col("rr_a").alias("actual_a"),
        F.col("rr_cname").alias("actual_cname"))
    both = spread_join(
        spread_join(pairs, actual, ["ns", "qname"], "left", ["seq"], rows_per_task),
        expected, ["qname"], "left", ["source", "seq"], rows_per_task,
        counts=pairs.groupBy("qname").agg(F.count("*").alias("n")))
    lists = ["expected_a", "expected_cname", "actual_a", "actual_cname"]
    both = both.select("source", "domain", "seq", "ns",
                       *(F.coalesce(c, no_items()).alias(c) for c in lists))
    return both.filter(~bag_equal(F.col("expected_a"), F.col("actual_a"))).withColumn(
        "actual_a", F.array_sort("actual_a"))


def check_counts(checks: dict[str, tuple[DataFrame, DataFrame]]) -> DataFrame:
    """(check, hits, total): names flagged and names looked at, per check."""
    rows = None
    for name, (hits, total) in checks.items():
        for flag, frame in ((1, hits), (0, total)):
            one = frame.select("source", "domain").distinct().select(
                F.lit(name).alias("check"), F.lit(flag).alias("hit"))
            rows = one if rows is None else rows.unionByName(one)
    return rows.groupBy("check").agg(
        F.sum("hit").alias("hits"), F.count_if(F.col("hit") == 0).alias("total"))
