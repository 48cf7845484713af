"""A dump, an ownership list and captured responses, derived from the star-schema tables.

The tables hold no DNS data, so names, addresses and lines are worked out from their keys:
suppliers give name servers, customers zones, orders hosts, nations and parts address ranges.
The results are as large as the tables, and are written once per session and folder.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from zonescope.operators.health import no_items
from zonescope.plans.cache import Cache, load_cache
from zonescope.plans.workspace import new_folder, written
from zonescope.sources.dump import Dump, scan_dump
from zonescope.sources.ranges import scan_ranges

RESOLVER = "192.0.2.53"
ROOT_NS = "a.root.example."
CHAIN_NS = "chain.example."


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def n_suppliers(spark: SparkSession, sf_dir: str) -> int:
    return table(spark, sf_dir, "supplier").count()


def _line(*parts) -> Column:
    return F.concat(*(p if isinstance(p, Column) else F.lit(p) for p in parts))


def _text(*lines: Column) -> Column:
    """Lines as one cell; a NULL line is left out."""
    return F.concat_ws("\n", *lines)


def _str(value: Column) -> Column:
    return value.cast("string")


def _hex(value: Column, digits: int) -> Column:
    return F.lpad(F.hex(value), digits, "0")


def _v6(prefix: str, number: Column) -> Column:
    """``prefix::`` followed by a number in its last two groups (the first one only if needed)."""
    low, high = F.lower(F.hex(number % 65536)), F.lower(F.hex(F.floor(number / 65536)))
    return _line(prefix, "::", F.when(number >= 65536, _line(high, ":")).otherwise(""), low)


def server_lines(supplier: DataFrame) -> DataFrame:
    s = F.col("s_suppkey")
    owner = _line("ns", _str(s), ".dns.example.")
    ip = _line("10.", _str(F.floor(s / 50000)), ".", _str(s % 250), ".",
               _str(53 + F.floor(s / 250) % 200))
    return supplier.select(s.alias("key"), _text(
        F.when(s % 10 == 9, _line(owner, "\t300\t\\-A\t;-$NXRRSET"))
        .otherwise(_line(owner, "\t300\tA\t", ip)),
        F.when(s % 3 == 0, _line("\t\t\t300\tAAAA\t", _v6("2001:db8", s))),
    ).alias("text"))


def ns_pair(n: int) -> tuple[Column, Column]:
    """The name servers of zone ``c_custkey``; the second one is NULL for some."""
    c = F.col("c_custkey")
    return (
        _line("ns", _str(c % n), ".dns.example."),
        F.when(c % 5 != 0, _line("ns", _str((7 * c + 1) % n), ".dns.example.")),
    )


def zone_lines(customer: DataFrame, n: int) -> DataFrame:
    c = F.col("c_custkey")
    ttl = _str(300 + c % 60)
    owner = _line("z", _str(c), ".example.")
    first, second = ns_pair(n)

    def indented(rest) -> Column:
        return _line("\t\t\t", ttl, "\t", rest)

    return customer.select(c.alias("key"), _text(
        _line(owner, "\t", ttl, "\tIN NS\t", first),
        F.when(second.isNotNull(), indented(_line("NS\t", second))),
        F.when(c % 4 == 1, indented(_line("MX\t10 mx", _str(c), ".example.")))
        .when(c % 4 == 2, indented("\\-MX\t;-$NXRRSET")),
        F.when(c % 6 == 0, indented('TXT\t"v=spf1 -all"'))
        .when(c % 6 == 1, indented(_line('TXT\t"v=spf1 include:z', _str(c), ' ~all"')))
        .when(c % 6 == 2, indented(_line('TXT\t"site-verification=', _str(c), '"')))
        .when(c % 6 == 3, _line(owner, "\t", ttl, '\tTXT\t"v=spf1 a mx -all"')),
    ).alias("text"))


def https_hex() -> Column:
    """TYPE65 wire data of host ``o_orderkey``, six shapes; the fifth breaks two rules."""
    o = F.col("o_orderkey")
    shape = F.floor(o / 8) % 6
    label = _line("svc", _str(o))
    hint = _line("000400040A", _hex(F.floor(o / 65536) % 256, 2), _hex(o % 65536, 4))
    return (
        F.when(shape == 0, _line("000100", "00010003026832", hint))
        .when(shape == 1, _line("0001", _hex(F.length(label), 2), F.hex(F.encode(label, "UTF-8")),
                                "07", F.hex(F.encode(F.lit("example"), "UTF-8")), "00",
                                "0003000201BB"))
        .when(shape == 2, _line("000100", "0006001020010DB80000000000000000", _hex(o, 8)))
        .when(shape == 3, _line("000100", "00050004", _hex(o, 8)))
        .when(shape == 4, _line("000100", "00010003056832", "000400030A0000"))
        .otherwise(_line("001000", "00010006026833026832", "000700022F71"))
    )


def host_lines(orders: DataFrame) -> DataFrame:
    o, z = F.col("o_orderkey"), F.col("o_custkey")
    kind = o % 8
    ttl = _str(60 + o % 240)
    owner = _line("h", _str(o), ".z", _str(z), ".example.")
    wire = F.col("wire")
    return orders.withColumn("wire", https_hex()).select(o.alias("key"), _text(
        F.when(kind <= 1, _line(owner, "\t", ttl, "\tA\t198.51.100.", _str(o % 250)))
        .when(kind == 2, _line(owner, "\t", ttl, "\tCNAME\tz", _str(z), ".example."))
        .when(kind == 3, _line(owner, "\t", ttl, "\t\\-AAAA\t;-$NXRRSET"))
        .when(kind == 4, _line(owner, "\t", ttl, "\t\\-ANY\t;-$NXDOMAIN"))
        .when(kind == 5, _line(owner, "\t", ttl, "\tPTR\tp", _str(o), ".example."))
        .when(kind == 6, _text(
            _line(owner, "\t", ttl, "\tTYPE65\t\\# ", _str(F.floor(F.length(wire) / 2)), " ( ",
                  F.substring(wire, 1, 8)),
            _line("\t\t\t\t\t", F.substring(wire, 9, 8)),
            _line("\t\t\t\t\t", F.substring(wire, F.lit(17), F.length(wire)), " )")))
        .otherwise(_text(_line(owner, "\t", ttl, "\t\\-TYPE65\t;-$NXRRSET"),
                         _line("\t\t\t", ttl, "\t\\-TYPE64\t;-$NXRRSET"))),
        F.when(kind == 1, _line("\t\t\t", ttl, "\tAAAA\t", _v6("2001:db8:1", o))),
    ).alias("text"))


def outside_lines(part: DataFrame) -> DataFrame:
    """Record-like lines for the parts of the dump outside the cache section."""
    p = F.col("p_partkey")
    return part.select(p.alias("key"), _line(
        "p", _str(p), ".outside.example.\t1\tA\t192.0.2.", _str(p % 250)).alias("text"))


def write_dump(spark: SparkSession, sf_dir: str) -> str:
    """The dump as the text files of one folder, in order; returns the folder."""
    outside = outside_lines(table(spark, sf_dir, "part"))

    def fixed(text: str) -> DataFrame:
        return spark.range(0, 1, 1, 1).select(F.col("id").alias("key"), F.lit(text).alias("text"))

    sections = [
        fixed("; Start view _default"),
        outside,
        fixed(";\n; Cache dump of view '_default' (cache _default)\n;\n$DATE 20250101000000"),
        fixed("; glue"),
        server_lines(table(spark, sf_dir, "supplier")),
        fixed("; additional\n; authanswer"),
        zone_lines(table(spark, sf_dir, "customer"), n_suppliers(spark, sf_dir)),
        fixed("; answer"),
        host_lines(table(spark, sf_dir, "orders")),
        fixed(";\n; Address database dump\n;"),
        outside,
        fixed("; Dump complete"),
    ]
    rows = reduce(DataFrame.unionByName, (
        s.select(F.lit(i).alias("section"), "key", "text") for i, s in enumerate(sections)))
    folder = new_folder(spark, "dump")
    rows.orderBy("section", "key").select("text").write.text(folder)
    return folder


def write_ranges(spark: SparkSession, sf_dir: str) -> str:
    """The ownership list as text; returns the folder."""
    n, p, s = F.col("n_nationkey"), F.col("p_partkey"), F.col("s_suppkey")
    third = 10 * n
    nation = table(spark, sf_dir, "nation").select(F.explode(F.array(
        _line("10.0.", _str(third), ".0-10.0.", _str(third + 4), ".255 ", F.col("n_name")),
        _line("10.0.", _str(third + 5), ".0/24 ", F.col("n_name")),
        _line("10.0.", _str(third + 6), ".1 ", F.col("n_name")),
        _line("10.0.", _str(third + 6), ".0 - 10.0.", _str(third + 6), ".255 ", F.col("n_name")),
        _line("10.0.", _str(third + 6), ".x-10.0.", _str(third + 6), ".255 ", F.col("n_name")),
        F.when(n == 0, F.lit("10.0.128.0/17 BACKBONE")),
        F.when(n == 0, F.lit("2001:db8::/32 V6POOL")),
    )).alias("value"))
    low = p % 200
    block = _line("172.", _str(16 + p % 16), ".", _str(F.floor(p / 16) % 256), ".")
    part = table(spark, sf_dir, "part").select(_line(
        block, _str(low), "-", block, _str(low + (p * 7) % 56), " PART", _str(p)).alias("value"))
    single = table(spark, sf_dir, "supplier").filter(s % 6 == 0).select(_line(
        _v6("2001:db8", s), "/128 leased to SUPPLIER", _str(s)).alias("value"))
    folder = new_folder(spark, "ranges")
    nation.filter("value IS NOT NULL").unionByName(part).unionByName(single).write.text(folder)
    return folder


def _responses(df: DataFrame, **given: Column) -> DataFrame:
    """Fill up the columns of the response table."""
    reply = {
        "qtype": F.lit("A"), "attempt": F.lit(1), "answered": F.lit(True), "rcode": F.lit(0),
        "rr_a": no_items(), "rr_cname": no_items(), "auth_ns": no_items(),
        "auth_type": F.lit(None).cast("string"), "ms": F.lit(0), **given,
    }
    lists = {name: no_items() for name in ("rr_aaaa", "rr_ns", "rr_mx", "rr_txt", "rr_ds")}
    cells = {**reply, **lists}
    sent = F.to_timestamp(F.lit("2025-01-01 00:00:00"))
    return df.select(*(c.alias(name) for name, c in cells.items())).select(
        "server", "qname", "qtype", F.col("attempt").cast("int").alias("attempt"), "answered",
        F.col("rcode").cast("int").alias("rcode"),
        (F.size("rr_a") + F.size("rr_cname")).alias("n_answers"),
        "rr_a", "rr_aaaa", "rr_cname", "rr_ns", "rr_mx", "rr_txt", "rr_ds",
        F.when(F.size("rr_a") > 0, F.lit(300)).cast("bigint").alias("ttl_a"),
        "auth_ns", "auth_type", sent.alias("sent_at"),
        (sent + F.make_dt_interval(secs=F.col("ms") / 1000)).alias("recv_at"))


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the resolver and the name servers said, as if captured."""
    n = n_suppliers(spark, sf_dir)
    o, z, c = F.col("o_orderkey"), F.col("o_custkey"), F.col("c_custkey")
    resolver, no_list = F.lit(RESOLVER), no_items()
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    host = _line("h", _str(o), ".z", _str(z), ".example.")
    state = F.col("o_orderstatus")
    negative = _responses(
        orders.filter("o_orderkey % 8 IN (3, 7) AND o_orderkey % 40 <> 3"),
        server=resolver, qname=host, rcode=F.when(state == "P", 2).otherwise(0),
        rr_a=F.when(state == "F", F.array(_line("198.51.100.", _str(o % 250)))).otherwise(no_list),
        ms=o % 500)

    customer = table(spark, sf_dir, "customer").select("c_custkey")
    zone = _line("z", _str(c), ".example.")
    a1 = F.array(_line("10.9.", _str(c % 250), ".1"))
    a2 = F.array(_line("10.9.", _str(c % 250), ".2"))
    alias = F.array(_line("www.z", _str(c), ".example."))
    lost = (c % 19 == 0) | (c % 23 == 0)
    tries = [
        _responses(customer, server=resolver, qname=zone, answered=~lost,
                   rr_a=F.when(lost, no_list).otherwise(a1), ms=c % 300),
        _responses(customer.filter(lost), server=resolver, qname=zone, attempt=F.lit(2),
                   answered=c % 23 != 0, rr_a=F.when(c % 23 == 0, no_list).otherwise(a1), ms=c % 300),
    ]
    first, second = ns_pair(n)
    differs = F.when(c % 11 == 0, a2).otherwise(a1)
    heard = customer.filter("c_custkey % 5 <> 0 AND c_custkey % 13 <> 0")
    aliased = c % 17 == 0
    servers = [
        _responses(customer, server=first, qname=zone, rr_a=a1, ms=c * 3 % 200),
        _responses(heard, server=second, qname=zone,
                   rr_a=F.when(aliased, no_list).otherwise(differs),
                   rr_cname=F.when(aliased, alias).otherwise(no_list), ms=c * 3 % 200),
        _responses(heard.filter(aliased), server=second, qname=alias[0], rr_a=differs),
    ]

    gone = orders.filter("o_orderkey % 8 = 4").withColumn("c_custkey", z)
    both = F.when(second.isNotNull(), F.array(first, second)).otherwise(F.array(first))
    soa, aliases = o % 24 == 12, o % 48 == 20
    target = _line("t", _str(o % 100), ".target.example.")
    target_ns = F.array(F.lit("ns0.dns.example."))
    targets = gone.filter(aliases).select((o % 100).alias("o_orderkey")).distinct()
    traces = [
        _responses(spark.range(1), server=resolver, qname=F.lit("."),
                   auth_ns=F.array(F.lit(ROOT_NS)), auth_type=F.lit("NS")),
        _responses(gone, server=F.lit(ROOT_NS), qname=host, auth_ns=both, auth_type=F.lit("NS")),
        _responses(
            gone.filter("o_orderkey % 48 <> 44"), server=first, qname=host,
            rcode=F.when(soa, 3).otherwise(0),
            rr_a=F.when(soa | aliases, no_list).otherwise(F.array(_line("203.0.113.", _str(o % 250)))),
            rr_cname=F.when(aliases, F.array(target)).otherwise(no_list),
            auth_ns=F.when(soa, F.array(F.lit("soa.example."))).when(o % 16 == 4, F.array(first))
            .otherwise(both),
            auth_type=F.when(soa, "SOA").otherwise("NS")),
        _responses(targets, server=F.lit(ROOT_NS), qname=target, auth_ns=target_ns,
                   auth_type=F.lit("NS")),
        _responses(targets, server=target_ns[0], qname=target,
                   rr_a=F.array(_line("203.0.113.", _str(o))), auth_ns=target_ns,
                   auth_type=F.lit("NS")),
    ]
    return reduce(DataFrame.unionByName, [negative, *tries, *servers, *traces])


def deep_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(domain): two names per part, the starts of ``deep_responses``."""
    p = F.col("p_partkey")
    part = table(spark, sf_dir, "part")
    return part.select(F.explode(F.array(
        _line("d", _str(p), ".deep.example."), _line("a", _str(p), "-0.deep.example."))).alias("domain"))


def deep_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long ways, as if captured: delegations of 1 to 12 hops, 0 to 12 aliases from the root, and at one
    server 0 to 6 aliases and rings."""
    p, i = F.col("p_partkey"), F.col("i")
    part = table(spark, sf_dir, "part").select("p_partkey")
    address = F.array(_line("203.0.113.", _str(p % 250)))

    def each(first: int, last: Column) -> DataFrame:
        return part.withColumn("last", last).withColumn("i", F.explode(F.sequence(
            F.lit(first).cast("bigint"), F.col("last"))))

    def server(n: Column) -> Column:
        return _line("ns", _str(n), ".deep.example.")

    def chain(letter: str, n: Column) -> Column:
        return _line(letter, _str(p), "-", _str(n), ".deep.example.")

    def aliases(rows: DataFrame, at: str, letter: str) -> DataFrame:
        more = i < F.col("last")
        return _responses(
            rows, server=F.lit(at), qname=chain(letter, i), rr_a=F.when(more, no_items()).otherwise(address),
            rr_cname=F.when(more, F.array(chain(letter, i + 1))).otherwise(no_items()))

    ring = F.array(_line("r", _str(p), ".deep.example."))
    return reduce(DataFrame.unionByName, [
        _responses(spark.range(1), server=F.lit(RESOLVER), qname=F.lit("."),
                   auth_ns=F.array(F.lit(ROOT_NS)), auth_type=F.lit("NS")),
        _responses(each(1, p % 12 + 1), server=F.when(i == 1, ROOT_NS).otherwise(server(i - 1)),
                   qname=_line("d", _str(p), ".deep.example."),
                   rr_a=F.when(i == F.col("last"), address).otherwise(no_items()),
                   auth_ns=F.array(server(i)), auth_type=F.lit("NS")),
        aliases(each(0, p % 13), ROOT_NS, "a"),
        aliases(each(0, p % 7), CHAIN_NS, "c"),
        _responses(part.filter(p % 5 == 0), server=F.lit(CHAIN_NS), qname=ring[0], rr_cname=ring),
    ])


def raw_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A capture with record text: each zone asked for A, AAAA and MX."""
    n = n_suppliers(spark, sf_dir)
    c = F.col("c_custkey")
    zone = _line("z", _str(c), ".example.")
    first, _ = ns_pair(n)
    sent = F.to_timestamp(F.lit("2025-01-01 00:00:00"))

    def asked(rows: DataFrame, qtype: str, answered, rcode, answer: Column, authority: Column):
        return rows.select(
            F.lit(RESOLVER).alias("server"), zone.alias("qname"), F.lit(qtype).alias("qtype"),
            F.lit(1).alias("attempt"), answered.alias("answered"), rcode.alias("rcode"),
            answer.alias("answer"), authority.alias("authority"), sent.alias("sent_at"),
            sent.alias("recv_at"))

    customer = table(spark, sf_dir, "customer").select("c_custkey")
    ttl = _str(300 + c % 60)
    none = no_items()
    a = _line(zone, "\t", ttl, "\tIN\tA\t10.9.", _str(c % 250), ".1")
    more = _line(zone, "\t", _str(301 + c % 60), "\tIN\tA\t10.9.", _str(c % 250), ".2")
    return reduce(DataFrame.unionByName, [
        asked(customer, "A", F.lit(True), F.lit(0),
              F.when(c % 3 == 0, F.array(a, more)).otherwise(F.array(a)),
              F.array(_line(zone, "\t3600\tIN\tNS\t", first))),
        asked(customer, "AAAA", c % 4 != 0, F.when(c % 5 == 0, 2).otherwise(0),
              F.when((c % 4 == 0) | (c % 5 == 0), none).otherwise(F.array(
                  _line(zone, "\t", ttl, "\tIN\tAAAA\t", _v6("2001:db8", c)))),
              F.when(c % 5 == 0, F.array(_line(
                  zone, "\t60\tIN\tSOA\tsoa.example. host.example. 1 2 3 4 5"))).otherwise(none)),
        asked(customer.filter("c_custkey % 7 <> 0"), "MX", F.lit(True), F.lit(0),
              F.array(_line(zone, "\t", ttl, "\tIN\tMX\t10 mx", _str(c), ".example.")), none),
    ])


_made: dict[tuple[str, str, str], object] = {}


def _once(spark: SparkSession, sf_dir: str, name: str, make):
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _made:
        _made[key] = make()
    return _made[key]


def dump_folder(spark: SparkSession, sf_dir: str) -> str:
    return _once(spark, sf_dir, "dump", lambda: write_dump(spark, sf_dir))


def dump(spark: SparkSession, sf_dir: str) -> Dump:
    return scan_dump(spark, dump_folder(spark, sf_dir), source="directory")


def cache(spark: SparkSession, sf_dir: str, compat: bool = True) -> Cache:
    return _once(spark, sf_dir, f"cache-{compat}", lambda: load_cache(
        spark, dump_folder(spark, sf_dir), "directory", compat))


def ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_ranges(spark, _once(spark, sf_dir, "ranges", lambda: write_ranges(spark, sf_dir)))


def captured(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _once(spark, sf_dir, "responses", lambda: written(responses(spark, sf_dir), "responses"))


def captured_deep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _once(spark, sf_dir, "deep", lambda: written(deep_responses(spark, sf_dir), "deep"))


def captured_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _once(spark, sf_dir, "raw", lambda: written(raw_responses(spark, sf_dir), "raw"))
