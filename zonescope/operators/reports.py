"""Lookups and inventory reports over the record table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zonescope import constants as C
from zonescope.operators.lists import joined, stripe_of
from zonescope.operators.parse import STRIPE
from zonescope.sources.responses import probe_names

DOMAIN = ["source", "domain"]


def of_type(records: DataFrame, *rtypes: str) -> DataFrame:
    return records.filter(F.col("rtype").isin(*rtypes))


def ns_names(records: DataFrame, **bounds: int) -> DataFrame:
    """(source, domain, value): the name servers of each domain in file order."""
    return joined(of_type(records, "NS"), DOMAIN, F.col("rdata"), **bounds)


def ptr_report(records: DataFrame, **bounds: int) -> DataFrame:
    return joined(of_type(records, "PTR"), DOMAIN, F.col("rdata"), **bounds)


def txt_report(records: DataFrame, **bounds: int) -> DataFrame:
    return joined(of_type(records, "TXT"), DOMAIN, F.col("rdata"), **bounds)


def spf_report(records: DataFrame, **bounds: int) -> DataFrame:
    """TXT contents that hold an SPF policy."""
    spf = of_type(records, "TXT").filter(F.col("rdata").contains("v=spf"))
    return joined(spf, DOMAIN, F.col("rdata"), **bounds)


def mx_report(records: DataFrame, **bounds: int) -> DataFrame:
    """Every MX of a domain as ``priority server``, unless its first MX is a negative NXRRSET."""
    text = F.concat_ws(" ", F.col("priority").cast("string"), F.col("rdata"))
    listed = joined(of_type(records, "MX"), DOMAIN, text, head=F.min(F.struct("seq", "rcode")),
                    **bounds)
    return listed.filter("head.rcode <> 'nxrrset'").drop("head")


def first_of_type(records: DataFrame, rtype: str) -> DataFrame:
    """(source, domain, value, rcode) of the first record of a type."""
    return of_type(records, rtype).groupBy(*DOMAIN).agg(
        F.min_by(F.struct(F.col("rdata").alias("value"), "rcode"), "seq").alias("first")
    ).select(*DOMAIN, "first.value", "first.rcode")


def https_report(records: DataFrame) -> DataFrame:
    """The first TYPE65 value of each domain, unless it is a negative NXRRSET."""
    return first_of_type(records, "TYPE65").filter("rcode <> 'nxrrset'").drop("rcode")


def type64_report(records: DataFrame) -> DataFrame:
    return first_of_type(records, "TYPE64").drop("rcode")


def single_ns(records: DataFrame) -> DataFrame:
    """Domains with exactly one NS record: (source, domain, ns, short).

    ``short`` marks the ones that are listed: fewer than five dot-separated pieces.
    """
    item = F.concat(F.lit("{"), F.concat_ws(
        " ", "rdata", F.col("ttl").cast("string"), F.lit(""), "attribute"), F.lit("}"))
    return of_type(records, "NS").groupBy(*DOMAIN).agg(
        F.count("*").alias("n"), F.min(item).alias("ns")
    ).filter("n = 1").select(
        *DOMAIN, "ns", (F.size(F.split("domain", "[.]")) < 5).alias("short"))


def _item(*pairs: tuple[str, str]) -> Column:
    cells = [F.concat(F.lit(f"{name}="), F.col(column).cast("string")) for name, column in pairs]
    return F.concat(F.lit("{"), F.concat_ws(", ", *cells), F.lit("}"))


# Report name, type and value label, in the order of the detail line.
DETAIL = (
    ("NSs", "NS", None), ("As", "A", "IP"), ("AAAAs", "AAAA", "IP"), ("ANY", "ANY", "IP"),
    ("TYPE65", "TYPE65", "IP"), ("TYPE64", "TYPE64", "IP"), ("CNAME", "CNAME", "IP"),
    ("MX", "MX", "MailServer"), ("PTR", "PTR", "Target"), ("TXT", "TXT", "Content"),
)


def _item_text() -> Column:
    ns = F.concat(F.lit("{"), F.concat_ws(
        " ", "rdata", F.col("ttl").cast("string"), F.lit(""), "attribute"), F.lit("}"))
    text = F.when(F.col("rtype") == "NS", ns).when(
        F.col("rcode") != "", _item(("TTL", "ttl"), ("Rcode", "rcode"), ("Attribute", "attribute")))
    for _, rtype, label in DETAIL[1:]:
        value = [("Priority", "priority")] if rtype == "MX" else []
        text = text.when(
            F.col("rtype") == rtype,
            _item(("TTL", "ttl"), *value, (label, "rdata"), ("Attribute", "attribute")))
    return text


def record_detail(records: DataFrame, domains: DataFrame, stripe: int = STRIPE) -> DataFrame:
    """(source, domain, detail): one line per domain with its records of every type.

    Of a type, the items before its first negative entry are shown, or that entry when it comes
    first. Items are joined per stripe of lines, up to the stripe's own first negative entry, and
    then the stripes up to the one where the list stops.
    """
    keys = [*DOMAIN, "rtype"]
    negative = F.when(F.col("rcode") != "", F.col("seq"))
    pieces = records.drop("wire").withColumn("text", _item_text()).groupBy(
        *keys, stripe_of(F.col("seq"), stripe).alias("stripe")).agg(
        F.min("seq").alias("first"), F.min(negative).alias("stop"),
        F.min_by("text", negative).alias("stop_text"),
        F.array_sort(F.collect_list(F.struct("seq", "text"))).alias("items"))
    shown = F.filter("items", lambda x: F.col("stop").isNull() | (x["seq"] < F.col("stop")))
    pieces = pieces.withColumn("piece", F.when(F.size(shown) > 0, F.array_join(
        F.transform(shown, lambda x: x["text"]), " "))).drop("items")
    lists = pieces.groupBy(*keys).agg(
        F.min("first").alias("first"), F.min("stop").alias("stop"),
        F.min_by("stop_text", "stop").alias("stop_text"),
        F.array_sort(F.collect_list(F.struct("stripe", "piece"))).alias("pieces"))
    before = F.filter("pieces", lambda x: x["piece"].isNotNull() & (
        F.col("stop").isNull() | (x["stripe"] <= stripe_of(F.col("stop"), stripe))))
    text = F.when(F.col("first") == F.col("stop"), F.col("stop_text")).otherwise(
        F.array_join(F.transform(before, lambda x: x["piece"]), " "))
    texts = lists.select(*DOMAIN, "rtype", F.concat(F.lit("["), text, F.lit("]")).alias("text"))
    every = texts.unionByName(domains.select(*DOMAIN), allowMissingColumns=True).groupBy(*DOMAIN).agg(
        *(F.coalesce(F.max(F.when(F.col("rtype") == t, F.col("text"))), F.lit("[]")).alias(t)
          for _, t, _ in DETAIL)
    )
    cells: list[Column] = []
    for i, (name, rtype, _) in enumerate(DETAIL):
        sep = "" if i == 0 else "," if name == "TYPE64" else ", "
        cells += [F.lit(f"{sep}{name}: "), F.col(rtype)]
    return every.select(*DOMAIN, F.concat(*cells).alias("detail"))


def nested_records(records: DataFrame, domains: DataFrame) -> DataFrame:
    """One row per domain with a list of structs for each record type, in line order.

    A list is one cell, so Spark's limit on a row (2 GB) bounds the records of a domain here; the
    record table itself has no such limit.
    """
    item = F.struct("seq", "ttl", "attribute", "rcode", "rdata", "priority")
    lists = records.groupBy(*DOMAIN).agg(*(
        F.array_sort(F.collect_list(F.when(F.col("rtype") == t, item))).alias(name)
        for name, t, _ in DETAIL))
    names = [name for name, _, _ in DETAIL]
    joined_lists = domains.select(*DOMAIN).distinct().join(lists, DOMAIN, "left")
    return joined_lists.select(
        *DOMAIN, *(F.coalesce(name, F.array().cast(lists.schema[name].dataType)).alias(name)
                   for name in names))


def lookup(
    probes: DataFrame, records: DataFrame, domains: DataFrame, **bounds: int
) -> DataFrame:
    """(domain, found, text) for every probed name, found or not.

    Only the records of probed names are read on.
    """
    names = probe_names(probes)
    detail = record_detail(
        records.join(names, "domain", "left_semi"), domains.join(names, "domain", "left_semi"),
        **bounds)
    found = F.col("detail").isNotNull()
    return names.join(detail, "domain", "left").select(
        "source", "domain", found.alias("found"),
        F.when(found, F.concat(F.lit("Domain ("), F.col("domain"), F.lit("): "), F.col("detail")))
        .otherwise(F.concat(F.lit(C.NOT_FOUND), F.col("domain"))).alias("text"),
    )


def point_lookup(name: str, records: DataFrame, domains: DataFrame) -> DataFrame:
    """``lookup`` of one name; the filter reaches the scan of the record table."""
    wanted = F.col("domain") == name
    probe = records.sparkSession.createDataFrame([(name,)], "domain string")
    return lookup(probe, records.filter(wanted), domains.filter(wanted))


def cache_summary(domains: DataFrame, negatives: DataFrame) -> DataFrame:
    """Per source: how many domains there are, and how many with each kind of negative entry."""
    counts = negatives.withColumn("n_domains", F.lit(0)).unionByName(
        domains.select("source", "domain", F.lit("").alias("rcode"), F.lit(1).alias("n_domains")))
    return counts.groupBy("source").agg(
        F.sum("n_domains").alias("domains"),
        F.count_if(F.col("rcode") == "nxdomain").alias("nxdomain"),
        F.count_if(F.col("rcode") == "nxrrset").alias("nxrrset"),
    )


def report_sizes(reports: dict[str, DataFrame], key: str = "domain") -> DataFrame:
    """(report, n): the number of distinct keys in each report."""
    sized = None
    for name, report in reports.items():
        one = report.select(F.lit(name).alias("report"), F.col(key).alias("key"))
        sized = one if sized is None else sized.unionByName(one)
    names = F.array(*(F.lit(name) for name in reports))
    spark = sized.sparkSession
    every = spark.range(1).select(F.explode(names).alias("report"))
    return every.join(
        sized.groupBy("report", "key").count().groupBy("report").agg(F.count("*").alias("n")),
        "report", "left").select("report", F.coalesce("n", F.lit(0)).alias("n"))
