"""Name-server addresses and who owns them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from zonescope import constants as C
from zonescope.functions import ip
from zonescope.operators.joins import ROWS_PER_TASK, spread_join
from zonescope.operators.reports import of_type
from zonescope.plans.workspace import written


def ns_addresses(
    records: DataFrame, compat: bool = True, rows_per_task: int = ROWS_PER_TASK
) -> DataFrame:
    """(source, domain, seq, ns, rtype, ip): every address of every NS record of every domain.

    A negative address entry gives the empty text (dropped when ``compat`` is off). Name servers
    of many domains are hot keys, so the join spreads them.
    """
    ns = of_type(records, "NS").select("source", "domain", "seq", F.col("rdata").alias("ns"))
    found = of_type(records, "A", "AAAA").select(
        "source", F.col("domain").alias("ns"), "rtype", F.col("rdata").alias("ip"))
    if not compat:
        found = found.filter("ip <> ''")
    return spread_join(
        ns, found, ["source", "ns"], row_id=["domain", "seq"], rows_per_task=rows_per_task)


def ns_ips(records: DataFrame, compat: bool = True) -> DataFrame:
    """(source, ip): the distinct addresses of all name servers.

    Name servers are made distinct before the join: no name is hot.
    """
    names = of_type(records, "NS").select("source", F.col("rdata").alias("domain")).distinct()
    found = of_type(records, "A", "AAAA").join(names, ["source", "domain"], "left_semi")
    ips = found.select("source", F.col("rdata").alias("ip")).distinct()
    return ips if compat else ips.filter("ip <> ''")


def ip_counts(addresses: DataFrame) -> DataFrame:
    """(source, ip, n_domains): how many (domain, name server) pairs resolve to each address."""
    return addresses.groupBy("source", "ip").agg(F.count("*").alias("n_domains"))


def ip_domains(addresses: DataFrame) -> DataFrame:
    """(source, ip, n_domains, domain): the domains behind each address, one row each.

    A domain is repeated when several of its name servers share the address.
    """
    counts = written(ip_counts(addresses), "ip-counts")
    return spread_join(
        addresses, counts, ["source", "ip"], row_id=["domain", "seq", "ns"],
        counts=counts.withColumnRenamed("n_domains", "n"),
    ).select("source", "ip", "n_domains", "domain")


def range_networks(ranges: DataFrame, compat: bool = True) -> DataFrame:
    """(line_no, range, client) -> (client, family, hi, lo, plen, line_no).

    CIDR entries keep their prefix; an IPv4 range ``a-b`` becomes its aligned blocks. Anything
    else is skipped; so are IPv6 ranges, unless ``compat`` is off.
    """
    slash = F.split("range", "/")
    base = ip.address(slash[0])
    plen_text = F.regexp_replace(F.get(slash, F.lit(1)), "^0+(?=[0-9])", "")
    v6_text = F.instr(slash[0], ":") > 0
    cidr = ranges.select(
        "client", "line_no", base.alias("at"),
        F.when(plen_text.rlike(r"^[0-9]{1,3}\z"), plen_text.try_cast("int")).alias("bits"),
        v6_text.alias("v6"),
    ).filter(
        (F.size(slash) == 2) & F.col("at").isNotNull()
        & (F.col("bits") <= F.when(F.col("v6"), 128).otherwise(32))
    )
    # An IPv4-mapped network is an IPv4 one; under 96 bits it is a plain IPv6 network.
    mapped = F.col("v6") & (F.col("at.family") == 4)
    wide = mapped & (F.col("bits") < 96)
    family = F.when(wide, 6).otherwise(F.col("at.family"))
    lo = F.when(wide, F.col("at.lo").bitwiseOR(F.lit(0xFFFF00000000))).otherwise(F.col("at.lo"))
    bits = F.when(mapped & ~wide, F.col("bits") - 96).otherwise(F.col("bits"))
    networks = cidr.select(
        "client", "line_no", family.alias("family"), F.col("at.hi").alias("hi"), lo.alias("lo"),
        bits.alias("plen"),
    ).withColumn(
        "net", ip.masked(F.col("family"), F.col("hi"), F.col("lo"), F.col("plen"))
    ).select("client", "family", "net.hi", "net.lo", "plen", "line_no")

    ends = F.transform(F.split("range", "-"), lambda t: ip.ipv4_number(F.trim(F.regexp_replace(
        t, r"^\s+|\s+\z", ""))))
    spans = ranges.filter((F.size(F.split("range", "-")) == 2) & ~F.col("range").contains("/")).select(
        "client", "line_no", ends[0].alias("first"), ends[1].alias("last")
    ).filter("first <= last")
    # At block size 2^b only the block at each end of the span can be one that its parent does
    # not cover, so every size up to that of the span gives two candidates at most.
    largest = F.floor(F.log2(F.col("last") - F.col("first") + 1)).cast("int")
    sized = spans.select(
        "*", F.explode(F.sequence(F.lit(0), largest)).alias("b")
    ).withColumn("size", F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("b")))
    size = F.col("size")
    low = F.ceil(F.col("first") / size).cast("bigint") * size
    high = (F.floor((F.col("last") + 1) / size).cast("bigint") - 1) * size
    blocks = sized.select(
        "*", F.explode(F.array_distinct(F.array(low, high))).alias("start")
    )
    parent = F.col("start") - F.pmod(F.col("start"), size * 2)
    fits = (F.col("start") >= F.col("first")) & (F.col("start") + size - 1 <= F.col("last"))
    parent_fits = (parent >= F.col("first")) & (parent + size * 2 - 1 <= F.col("last"))
    dashed = blocks.filter(fits & ((F.col("b") == 32) | ~parent_fits)).select(
        "client", F.lit(4).alias("family"), F.lit(0).cast("bigint").alias("hi"),
        F.col("start").alias("lo"), (F.lit(32) - F.col("b")).alias("plen"), "line_no")
    networks = networks.unionByName(dashed)
    return networks if compat else networks.unionByName(ipv6_spans(ranges))


def ipv6_spans(ranges: DataFrame) -> DataFrame:
    """The networks of IPv6 ranges ``a-b``: their aligned blocks, 254 at most."""
    ends = F.transform(F.split("range", "-"), lambda t: ip.ipv6_bits(
        F.regexp_replace(t, r"^\s+|\s+\z", "")))
    spans = ranges.filter((F.size(F.split("range", "-")) == 2) & F.col("range").contains(":")).select(
        "client", "line_no", ends.alias("ends"))
    blocks = spans.select("client", "line_no", F.explode(ip.span_blocks(
        F.col("ends")[0], F.col("ends")[1])).alias("block"))
    return blocks.select("client", "line_no", ip.bits_network(
        F.col("block.bits"), F.col("block.plen")).alias("net")).select(
        "client", "net.family", "net.hi", "net.lo", "net.plen", "line_no")


#: Order of events at one address: networks open, addresses look, networks close.
OPENS, LOOKS, CLOSES = 0, 1, 2
PLACE = ["family", "hi", "lo", "kind", "plen"]


def _events(parsed: DataFrame, networks: DataFrame) -> DataFrame:
    """(family, hi, lo, kind, plen, client, ip, n, step): where networks begin and end, and addresses.

    ``n`` is how many entries open or close there, ``step`` the same for distinct networks. The halves of an
    address get their sign bit turned, as they are unsigned.
    """
    unique = networks.groupBy("family", "plen", "hi", "lo").agg(
        F.min_by("client", "line_no").alias("client"), F.count("*").alias("n"))
    end = ip.last_address(F.col("family"), F.col("hi"), F.col("lo"), F.col("plen"))
    none = F.lit(None).cast("string")

    def events(frame: DataFrame, hi, lo, kind: int, plen, client, name, n, step: int) -> DataFrame:
        turned = lambda half: F.col(half).bitwiseXOR(F.lit(-(1 << 63)))
        return frame.select(
            F.col("family").cast("int").alias("family"), turned(hi).alias("hi"), turned(lo).alias("lo"),
            F.lit(kind).alias("kind"), plen.cast("int").alias("plen"), client.alias("client"),
            name.alias("ip"), n.cast("bigint").alias("n"), F.lit(step).cast("bigint").alias("step"))

    plen = F.col("plen")
    opened = events(unique, "hi", "lo", OPENS, plen, F.col("client"), none, F.col("n"), 1)
    closed = events(unique.withColumn("end", end), "end.hi", "end.lo", CLOSES, plen, none, none,
                    -F.col("n"), -1)
    looks = events(parsed, "hi", "lo", LOOKS, F.lit(0), none, F.col("ip"), F.lit(0), 0)
    return opened.unionByName(closed).unionByName(looks)


def attribute_ips(
    ips: DataFrame, networks: DataFrame, ranges: int | None = None
) -> DataFrame:
    """(ip, client, plen, n_matches) for each distinct ``ip``.

    Longest prefix wins, then the earliest line; ``n_matches`` counts the matching entries and
    shows overlaps. Networks are nested or apart, so they cut the addresses into intervals that
    each belong to the innermost open network: one sweep in address order, with one row per
    address. How many networks are open is a running sum, and the innermost one is the last that
    opened at that level. The sweep runs inside ranges of equal size (``ranges`` of them, by default the
    session's shuffle partitions); sums and open networks pass from range to range as a row per
    range and level.
    """
    ranges = ranges or int(ips.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    distinct = written(
        ips.select("ip").distinct().withColumn("at", ip.address(F.col("ip"))), "distinct-ips")
    parsed = distinct.filter("at IS NOT NULL").select("ip", "at.family", "at.hi", "at.lo")
    events = written(_events(parsed, networks).repartitionByRange(ranges, *PLACE[:3]).withColumn(
        "range", F.spark_partition_id()), "sweep")

    so_far = Window.partitionBy("range").orderBy(*PLACE).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    passed = written(events.groupBy("range").agg(F.sum("n").alias("n"), F.sum("step").alias("step"))
                     .select("range", *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_before")
                                        for c in ("n", "step"))), "sweep-ranges")
    levels = events.select(
        "range", *PLACE, "client", "ip", F.sum("n").over(so_far).alias("n"),
        F.sum("step").over(so_far).alias("step"),
    ).filter(F.col("kind") != CLOSES).join(passed, "range").select(
        "range", *PLACE, "client", "ip", (F.col("step") + F.col("step_before")).alias("level"),
        (F.col("n") + F.col("n_before")).alias("n_matches"))
    levels = written(levels, "sweep-levels")

    opens = F.col("kind") == OPENS
    network = F.struct("client", "plen")
    at_level = Window.partitionBy("range", "level").orderBy(*PLACE).rowsBetween(
        Window.unboundedPreceding, 0)
    ranges_before = Window.partitionBy("level").orderBy("range").rowsBetween(
        Window.unboundedPreceding, -1)
    left_open = levels.groupBy("range", "level").agg(
        F.max_by(network, F.when(opens, F.struct(*PLACE))).alias("last")
    ).select("range", "level", F.last("last", True).over(ranges_before).alias("open_before"))
    found = levels.withColumn("open", F.last(F.when(opens, network), True).over(at_level)).filter(
        F.col("kind") == LOOKS).join(left_open, ["range", "level"])
    best = F.when(F.col("level") > 0, F.coalesce("open", "open_before"))
    unknown = F.lit(C.UNKNOWN_CLIENT)
    return found.select(
        "ip", F.coalesce(best["client"], unknown).alias("client"), best["plen"].alias("plen"),
        "n_matches",
    ).unionByName(distinct.filter("at IS NULL").select(
        "ip", unknown.alias("client"), F.lit(None).cast("int").alias("plen"),
        F.lit(0).cast("bigint").alias("n_matches")))


def ns_ownership(addresses: DataFrame, networks: DataFrame) -> DataFrame:
    """(source, client, ip, n_domains, domains): owner and domains of each name-server address.

    Addresses are counted first; lists are built only for the ones that show theirs.
    """
    counts = written(ip_counts(addresses), "ip-counts")
    shown = counts.filter(F.col("n_domains") <= C.LIST_LIMIT).select("source", "ip")
    lists = spread_join(
        addresses, shown, ["source", "ip"], "left_semi", ["domain", "seq", "ns"],
        counts=counts.withColumnRenamed("n_domains", "n"),
    ).groupBy("source", "ip").agg(
        F.array_join(F.array_sort(F.collect_list("domain")), "|").alias("domains"))
    return counts.join(lists, ["source", "ip"], "left").join(
        attribute_ips(counts, networks), "ip"
    ).select("source", "client", "ip", "n_domains",
             F.coalesce("domains", F.lit(C.LIST_TOO_LONG)).alias("domains"))
