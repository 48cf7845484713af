"""Every query of the library over the derived dump, list and responses."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from zonescope import constants as C
from zonescope.functions import ip
from zonescope.functions.arrays import bag_equal, bounded_contains, either_contains
from zonescope.operators import addresses as addr
from zonescope.operators import health, parse, reports, trace
from zonescope.plans import derived as D
from zonescope.plans.workspace import new_folder, written
from zonescope.sinks import lines
from zonescope.sources.responses import scan_responses

Query = Callable[[SparkSession, str], DataFrame]
LISTED = ["domain", "value"]


def _text(items: str) -> Column:
    return F.array_join(items, ",").alias(items)


def _states(spark: SparkSession, sf: str) -> DataFrame:
    return parse.line_states(D.dump(spark, sf))


def _resolved(spark: SparkSession, sf: str) -> DataFrame:
    return parse.resolved_lines(_states(spark, sf))


def _addresses(spark: SparkSession, sf: str) -> DataFrame:
    return written(addr.ns_addresses(D.cache(spark, sf).records), "addresses")


def _networks(spark: SparkSession, sf: str) -> DataFrame:
    return written(addr.range_networks(D.ranges(spark, sf)), "networks")


# --- parsing -------------------------------------------------------------------------------------

def dump_records(spark: SparkSession, sf: str) -> DataFrame:
    return D.cache(spark, sf).records.select(
        "domain", "rtype", "ttl", "attribute", "rcode", "rdata", "priority")


def dump_parse(spark: SparkSession, sf: str) -> DataFrame:
    """The whole way from text to records, nothing read from an earlier run."""
    resolved = written(_resolved(spark, sf), "resolved")
    return parse.records(resolved).groupBy("rtype", "rcode").agg(F.count("*").alias("n_records"))


def section_gate(spark: SparkSession, sf: str) -> DataFrame:
    return _states(spark, sf).groupBy("in_cache").agg(F.count("*").alias("n_lines"))


def attribute_carry(spark: SparkSession, sf: str) -> DataFrame:
    return _states(spark, sf).filter("in_cache AND plain").groupBy("attribute").agg(
        F.count("*").alias("n_lines"))


def owner_inherit(spark: SparkSession, sf: str) -> DataFrame:
    return _states(spark, sf).filter("in_cache AND plain").groupBy("owner").agg(
        F.count("*").alias("n_lines"))


def stitched_values(spark: SparkSession, sf: str) -> DataFrame:
    return parse.stitched_values(_resolved(spark, sf)).select(
        "domain", "ttl", "attribute", F.upper("rest").alias("hex"))


def negative_records(spark: SparkSession, sf: str) -> DataFrame:
    return D.cache(spark, sf).records.filter("rcode <> ''").select(
        "domain", "rtype", "ttl", "attribute", "rcode")


def domain_registry(spark: SparkSession, sf: str) -> DataFrame:
    return D.cache(spark, sf).domains.select("domain")


def cache_summary(spark: SparkSession, sf: str) -> DataFrame:
    cache = D.cache(spark, sf)
    return reports.cache_summary(cache.domains, cache.negatives).drop("source")


def negative_domains(spark: SparkSession, sf: str) -> DataFrame:
    return D.cache(spark, sf).negatives.select("domain", "rcode")


# --- lookups and reports -------------------------------------------------------------------------

def domain_lookup(spark: SparkSession, sf: str) -> DataFrame:
    cache = D.cache(spark, sf)
    return reports.point_lookup("z1.example.", cache.records, cache.domains).select(
        "domain", "found", "text")


def page_hosts(spark: SparkSession, sf: str) -> DataFrame:
    host = F.regexp_extract("url", "^[a-z]+://([^/:?#]+)", 1)
    return D.table(spark, sf, "pages").select(host.alias("domain"))


def bulk_lookup(spark: SparkSession, sf: str) -> DataFrame:
    cache = D.cache(spark, sf)
    zones = D.table(spark, sf, "customer").select(
        F.concat(F.lit("z"), F.col("c_custkey").cast("string"), F.lit(".example.")).alias("domain"))
    probes = page_hosts(spark, sf).unionByName(zones)
    return reports.lookup(probes, cache.records, cache.domains).select(
        "domain", "found", "text")


def domain_ns(spark: SparkSession, sf: str) -> DataFrame:
    return reports.ns_names(D.cache(spark, sf).records).select(*LISTED)


def record_detail(spark: SparkSession, sf: str) -> DataFrame:
    cache = D.cache(spark, sf)
    return reports.record_detail(cache.records, cache.domains).drop("source")


def nested_records(spark: SparkSession, sf: str) -> DataFrame:
    """The nested rows, each list flattened to text."""
    cache = D.cache(spark, sf)
    nested = reports.nested_records(cache.records, cache.domains)
    text = lambda name: F.array_join(F.transform(name, lambda x: F.concat_ws(
        " ", x["ttl"].cast("string"), x["attribute"], x["rcode"], x["rdata"],
        x["priority"].cast("string"))), ",").alias(name)
    return nested.select("domain", *(text(name) for name, _, _ in reports.DETAIL))


def https_report(spark: SparkSession, sf: str) -> DataFrame:
    return reports.https_report(D.cache(spark, sf).records).select("domain", "value")


def type64_report(spark: SparkSession, sf: str) -> DataFrame:
    return reports.type64_report(D.cache(spark, sf, compat=False).records).select("domain", "value")


def svcb_params(spark: SparkSession, sf: str) -> DataFrame:
    return parse.svcb_params(D.cache(spark, sf).records).select(
        "domain", "priority", "target", "pos", "key", "value_hex", "text")


def svcb_violations(spark: SparkSession, sf: str) -> DataFrame:
    return parse.svcb_params(D.cache(spark, sf).records).select(
        "domain", "pos", "key", "strict", "violation")


def ptr_report(spark: SparkSession, sf: str) -> DataFrame:
    return reports.ptr_report(D.cache(spark, sf).records).select(*LISTED)


def txt_report(spark: SparkSession, sf: str) -> DataFrame:
    return reports.txt_report(D.cache(spark, sf).records).select(*LISTED)


def spf_report(spark: SparkSession, sf: str) -> DataFrame:
    return reports.spf_report(D.cache(spark, sf).records).select(*LISTED)


def spf_report_relaxed(spark: SparkSession, sf: str) -> DataFrame:
    return reports.spf_report(D.cache(spark, sf, compat=False).records).select(*LISTED)


def mx_report(spark: SparkSession, sf: str) -> DataFrame:
    return reports.mx_report(D.cache(spark, sf).records).select(*LISTED)


def single_ns(spark: SparkSession, sf: str) -> DataFrame:
    return reports.single_ns(D.cache(spark, sf).records).filter("short").select("domain", "ns")


def single_ns_count(spark: SparkSession, sf: str) -> DataFrame:
    return reports.single_ns(D.cache(spark, sf).records).agg(F.count("*").alias("n_domains"))


def report_sizes(spark: SparkSession, sf: str) -> DataFrame:
    records = D.cache(spark, sf).records
    by_domain = reports.report_sizes({
        "spf": reports.spf_report(records), "txt": reports.txt_report(records),
        "mx": reports.mx_report(records), "ptr": reports.ptr_report(records),
        "https": reports.https_report(records), "type64": reports.type64_report(records),
    })
    by_ip = reports.report_sizes({"ns_ip": addr.ns_ips(records)}, key="ip")
    return by_domain.unionByName(by_ip)


# --- name-server addresses -----------------------------------------------------------------------

def ns_address_join(spark: SparkSession, sf: str) -> DataFrame:
    return addr.ns_addresses(D.cache(spark, sf).records).select("domain", "ns", "rtype", "ip")


def ns_ip_list(spark: SparkSession, sf: str) -> DataFrame:
    return addr.ns_ips(D.cache(spark, sf).records).select("ip")


def ns_ip_domains(spark: SparkSession, sf: str) -> DataFrame:
    return addr.ip_domains(_addresses(spark, sf)).drop("source")


def ip_ranges(spark: SparkSession, sf: str) -> DataFrame:
    network = ip.network_text(F.col("family"), F.col("hi"), F.col("lo"), F.col("plen"))
    return _networks(spark, sf).select("client", "family", network.alias("network"), "plen")


def ip_attribution(spark: SparkSession, sf: str) -> DataFrame:
    return addr.attribute_ips(addr.ns_ips(D.cache(spark, sf).records), _networks(spark, sf))


def ns_ip_ownership(spark: SparkSession, sf: str) -> DataFrame:
    return addr.ns_ownership(_addresses(spark, sf), _networks(spark, sf)).drop("source")


# --- health checks -------------------------------------------------------------------------------

def probe_status(spark: SparkSession, sf: str) -> DataFrame:
    return health.probe_status(D.captured(spark, sf)).select("server", "qname", "attempt", "status")


def probe_latency(spark: SparkSession, sf: str) -> DataFrame:
    return health.latency(D.captured(spark, sf)).select(
        "server", "qname", "attempt", "latency_ms")


def response_normalise(spark: SparkSession, sf: str) -> DataFrame:
    bucketed = health.bucket_answers(D.captured_raw(spark, sf))
    return health.combine_types(bucketed, ["A", "AAAA", "MX"]).select(
        "server", "qname", "rcode", _text("rr_a"), _text("rr_aaaa"), _text("rr_mx"),
        "ttl_a", _text("auth_ns"), "auth_type")


def failing_negatives(spark: SparkSession, sf: str) -> DataFrame:
    return health.failing_negatives(
        D.cache(spark, sf).negatives, D.captured(spark, sf), D.RESOLVER).select("status", "domain")


def _words(spark: SparkSession, sf: str) -> DataFrame:
    return D.table(spark, sf, "documents").select(
        "doc_id", F.split("text", " ").alias("words"),
        F.split(F.replace("text", F.lit("."), F.lit("")), " ").alias("bare"))


def bag_equality(spark: SparkSession, sf: str) -> DataFrame:
    return _words(spark, sf).select(
        "doc_id", bag_equal(F.col("words"), F.col("bare")).alias("equal"))


def bounded_containment(spark: SparkSession, sf: str) -> DataFrame:
    return _words(spark, sf).select(
        "doc_id", bounded_contains(F.col("words"), F.col("bare")).alias("contained"))


def either_containment(spark: SparkSession, sf: str) -> DataFrame:
    """Containment in one direction, and in either."""
    both = [either_contains(F.col("bare"), F.col("words"), compat) for compat in (True, False)]
    return _words(spark, sf).select("doc_id", both[0].alias("one_way"), both[1].alias("either"))


def captured_files(spark: SparkSession, sf: str) -> DataFrame:
    """A capture written as JSON and read back as a capture, by server."""
    folder = new_folder(spark, "capture")
    D.captured(spark, sf).write.json(folder)
    return scan_responses(spark, folder, "json").groupBy("server").agg(
        F.count("*").alias("n_probes"), F.count_if("answered").alias("n_answered"),
        F.sum(F.size("rr_a") + F.size("rr_cname")).alias("n_answers"))


def cname_chase(spark: SparkSession, sf: str) -> DataFrame:
    replies = written(health.answers(D.captured(spark, sf)), "answers")
    return health.chase_cnames(replies).select(
        "server", "qname", "hops", _text("rr_a"), _text("rr_cname"))


def _disagreement(spark: SparkSession, sf: str) -> DataFrame:
    return health.ns_disagreement(D.cache(spark, sf).records, D.captured(spark, sf), D.RESOLVER)


def ns_disagreement(spark: SparkSession, sf: str) -> DataFrame:
    return _disagreement(spark, sf).select(
        "domain", "ns", _text("expected_a"), _text("actual_a"), _text("actual_cname"))


def _traces(spark: SparkSession, sf: str) -> DataFrame:
    gone = D.cache(spark, sf).negatives.filter("rcode = 'nxdomain'")
    return trace.delegation_trace(gone, D.captured(spark, sf), D.RESOLVER)


def delegation_trace(spark: SparkSession, sf: str) -> DataFrame:
    return _traces(spark, sf).select(
        "domain", _text("addresses"), _text("child_ns"), _text("parent_ns"))


def trace_answers(spark: SparkSession, sf: str) -> DataFrame:
    gone = D.cache(spark, sf).negatives.filter("rcode = 'nxdomain'")
    return trace.trace_answers(gone, D.captured(spark, sf), D.RESOLVER).select(
        "domain", _text("addresses"))


def deep_traces(spark: SparkSession, sf: str) -> DataFrame:
    """Traces of 1 to 12 hops and 0 to 12 aliases, of which 10 are followed."""
    found = trace.delegation_trace(D.deep_names(spark, sf), D.captured_deep(spark, sf), D.RESOLVER)
    return found.select("domain", _text("addresses"), _text("child_ns"), _text("parent_ns"))


def deep_answers(spark: SparkSession, sf: str) -> DataFrame:
    return trace.trace_answers(D.deep_names(spark, sf), D.captured_deep(spark, sf), D.RESOLVER).select(
        "domain", _text("addresses"))


def deep_chase(spark: SparkSession, sf: str) -> DataFrame:
    """Chains of 0 to 6 aliases and rings, of which 5 are followed."""
    replies = written(health.answers(D.captured_deep(spark, sf)), "answers")
    starts = replies.filter((F.col("server") == D.CHAIN_NS) & F.col("qname").rlike("^(c[0-9]+-0|r)"))
    return health.chase_cnames(replies, asked_for=starts.select("server", "qname")).select(
        "qname", "hops", _text("rr_a"), _text("rr_cname"))


def _mismatch(spark: SparkSession, sf: str) -> DataFrame:
    return trace.parent_child_mismatch(D.cache(spark, sf).negatives, _traces(spark, sf))


def parent_child_mismatch(spark: SparkSession, sf: str) -> DataFrame:
    return _mismatch(spark, sf).select("domain", _text("child_ns"), _text("parent_ns"))


def check_counts(spark: SparkSession, sf: str) -> DataFrame:
    cache, captured = D.cache(spark, sf), D.captured(spark, sf)
    return health.check_counts({
        "failing_negatives": (
            health.failing_negatives(cache.negatives, captured, D.RESOLVER),
            cache.negatives.filter("rcode = 'nxrrset'")),
        "parent_child_mismatch": (
            _mismatch(spark, sf), cache.negatives.filter("rcode = 'nxdomain'")),
        "ns_disagreement": (_disagreement(spark, sf), reports.of_type(cache.records, "NS")),
    })


# --- written reports -----------------------------------------------------------------------------

def _read_back(spark: SparkSession, report: str, report_lines: DataFrame) -> DataFrame:
    folder = lines.write_lines(report_lines, new_folder(spark, report), "20250101000000")
    return spark.read.text(folder).select(F.col("value").alias("line"))


def _read_in_order(spark: SparkSession, folder: str) -> DataFrame:
    """(source, place, line): the lines of each source as a reader of its files meets them."""
    text = spark.read.text(folder).select(
        "source", F.col("value").alias("line"), F.col("_metadata.file_name").alias("file"),
        F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("id"))
    order = Window.partitionBy("source").orderBy("file", "start", "id")
    return text.select("source", F.row_number().over(order).alias("place"), "line")


def _listed(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    records = D.cache(spark, sf).records
    return {
        "spf": lines.report_lines(reports.spf_report(records)),
        "txt": lines.report_lines(reports.txt_report(records)),
        "mx": lines.report_lines(reports.mx_report(records)),
        "ptr": lines.report_lines(reports.ptr_report(records)),
        "https": lines.report_lines(reports.https_report(records)),
        "type64": lines.report_lines(
            reports.type64_report(D.cache(spark, sf, compat=False).records)),
        "ns_ip": lines.ip_lines(addr.ns_ips(records)),
    }


def report_files(spark: SparkSession, sf: str) -> DataFrame:
    every = None
    for name, report in _listed(spark, sf).items():
        one = _read_back(spark, name, report).select(F.lit(name).alias("report"), "line")
        every = one if every is None else every.unionByName(one)
    return every


def written_sizes(spark: SparkSession, sf: str) -> DataFrame:
    """The lines of each report, counted while its files are written."""
    sizes = []
    for name, report in _listed(spark, sf).items():
        counted = Observation(name)
        lines.write_lines(report, new_folder(spark, name), "20250101000000", counted=counted)
        sizes.append((name, counted.get.get("n_lines", 0)))
    return spark.createDataFrame(sizes, "report string, n bigint")


def ownership_file(spark: SparkSession, sf: str) -> DataFrame:
    owners = addr.ns_ownership(_addresses(spark, sf), _networks(spark, sf))
    return _read_back(spark, "ownership", lines.ownership_lines(owners))


def failing_file(spark: SparkSession, sf: str) -> DataFrame:
    failing = health.failing_negatives(
        D.cache(spark, sf).negatives, D.captured(spark, sf), D.RESOLVER)
    return _read_back(spark, "failing", lines.failing_lines(failing))


def parent_child_file(spark: SparkSession, sf: str) -> DataFrame:
    return _read_back(spark, "parent_child", lines.parent_child_lines(_mismatch(spark, sf)))


def ns_disagreement_file(spark: SparkSession, sf: str) -> DataFrame:
    """Lines with the domain of the head line above them, and their place under it."""
    blocks = lines.disagreement_lines(written(_disagreement(spark, sf), "odd"), D.RESOLVER)
    folder = lines.write_lines(blocks, new_folder(spark, "ns_disagreement"), "20250101000000")
    read = _read_in_order(spark, folder)
    is_head = F.instr("line", C.NS_DIFFERS) > 0
    so_far = Window.partitionBy("source").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    return read.select(
        F.last(F.when(is_head, F.substring_index("line", C.NS_DIFFERS, 1)), True).over(so_far).alias(
            "domain"),
        (F.col("place") - F.last(F.when(is_head, F.col("place")), True).over(so_far)).alias("place"),
        "line")


_ALL = (
    dump_records, dump_parse, section_gate, attribute_carry, owner_inherit, stitched_values,
    negative_records, domain_registry, cache_summary, negative_domains, domain_lookup, bulk_lookup,
    domain_ns, record_detail, nested_records, https_report, type64_report, svcb_params, svcb_violations, ptr_report,
    txt_report, spf_report, spf_report_relaxed, mx_report, single_ns, single_ns_count, report_sizes,
    ns_address_join, ns_ip_list, ns_ip_domains, ip_ranges, ip_attribution, ns_ip_ownership,
    probe_status, probe_latency, response_normalise, failing_negatives, bag_equality,
    bounded_containment, either_containment, captured_files, cname_chase, ns_disagreement,
    delegation_trace, trace_answers, deep_traces, deep_answers, deep_chase,
    parent_child_mismatch, check_counts, report_files, written_sizes, ownership_file, failing_file,
    parent_child_file, ns_disagreement_file,
)
NAMES = {"bag_equality": "bag_equal", "bounded_containment": "bounded_contains"}
QUERIES: dict[str, Query] = {NAMES.get(f.__name__, f.__name__): f for f in _ALL}
