"""Resolve not-modified revisits to the full response that they refer to.

A revisit refers to the latest earlier full response of its canonical url. Captures become one event
per url and second; events are sorted by (url, time) into ranges, so a url with a third of all
captures spans many ranges. Inside a range a window carries the last response on; what a range ends
with is carried to later ranges of the same url through one row per url and range. Then validators
are compared, and the headers that a 304 may update are merged over those of the response.

Defined results, in ``resolution``: ``full`` for full responses (type ``response``, status 200),
``resolved``, ``mismatch`` (the validators differ), ``unchecked`` (no validator that both have),
``orphan`` (no earlier full response, or no url or time) for revisits (type ``revisit`` or status
304), and ``other``. Earlier is strictly earlier; of several responses of one second the one with the
largest id counts. Equal rows get equal results. Header names are compared without case; of a
repeated one the last counts; null headers are none. An empty table gives no rows. Other columns
stay; the four result columns replace input columns of their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from zonescope.llm.text import own
from zonescope.plans.workspace import written

#: Headers that stay with the stored body, and those of a connection (fixed values).
KEPT_HEADERS = (
    "content-encoding", "content-length", "content-range", "content-type",
    "connection", "keep-alive", "proxy-authenticate", "proxy-authentication-info",
    "proxy-authorization", "proxy-connection", "te", "trailer", "transfer-encoding", "upgrade",
)
RESULTS = ("canonical_url", "resolution", "refers_to", "merged_headers")
URL = r"^\s*([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(\?[^#]*)?"


def canonical_url(url: Column) -> Column:
    """Scheme and host lower-cased, no default port, fragment or empty query, / for an empty path."""
    part = lambda i: F.regexp_extract(url, URL, i)
    scheme, host, path, query = F.lower(part(1)), F.lower(part(2)), part(3), part(4)
    host = F.when(scheme == "http", F.regexp_replace(host, ":80$", "")).when(
        scheme == "https", F.regexp_replace(host, ":443$", "")).otherwise(host)
    host = F.regexp_replace(host, ":$", "")
    return F.when(scheme != "", F.concat(
        scheme, F.lit("://"), host, F.when(path == "", F.lit("/")).otherwise(F.trim(path)),
        F.when(query == "?", F.lit("")).otherwise(F.rtrim(query)))).otherwise(F.trim(url))


def plain_headers(headers: Column) -> Column:
    """Lower-case names, the last value of each."""
    entries = F.transform(F.coalesce(F.map_entries(headers), F.array()), lambda e: F.struct(
        F.lower(F.trim(e["key"])).alias("key"), e["value"].alias("value")))
    names = F.array_distinct(F.transform(entries, lambda e: e["key"]))
    return F.map_from_arrays(names, F.transform(names, lambda n: F.element_at(
        F.filter(entries, lambda e: e["key"] == n), -1)["value"]))


def merged(stored: Column, fresh: Column) -> Column:
    """The stored headers with what a 304 may update."""
    allowed = F.map_filter(fresh, lambda k, _: ~k.isin(*KEPT_HEADERS))
    return F.map_concat(F.map_filter(stored, lambda k, _: ~F.map_contains_key(allowed, k)), allowed)


def validators_agree(stored: Column, fresh: Column) -> Column:
    """Weak comparison of entity tags, else equal modification times; null if neither is in both."""
    tag = lambda h: F.regexp_replace(F.trim(h["etag"]), "^W/", "")
    return F.coalesce(tag(stored) == tag(fresh),
                      F.trim(stored["last-modified"]) == F.trim(fresh["last-modified"]))


def latest_responses(events: DataFrame) -> DataFrame:
    """(url, at, ref) of each revisited url and time; ref is null without an earlier response.

    ``events`` is (url, at, revisited, response) with one row per url and time.
    """
    ranged = written(events.repartitionByRange("url", "at").withColumn(
        "part", F.spark_partition_id()), "warc-ranges")
    here = Window.partitionBy("part", "url").orderBy("at").rowsBetween(
        Window.unboundedPreceding, -1)
    ends = ranged.filter("response is not null").groupBy("url", "part").agg(
        F.max_by("response", "at").alias("response"))
    # A url has at most one such row per range.
    before = Window.partitionBy("url").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    spans = ranged.groupBy("url", "part").agg(F.max("revisited").alias("revisited"))
    carried = written(spans.join(ends, ["url", "part"], "left").select(
        "url", "part", "revisited", F.last("response", True).over(before).alias("carried")).filter(
        F.col("revisited") & F.col("carried").isNotNull()).drop("revisited"), "warc-carried")
    found = ranged.withColumn("ref", F.last("response", True).over(here)).filter("revisited")
    return found.select("url", "part", "at", "ref").join(carried, ["url", "part"], "left").select(
        "url", "at", F.coalesce("ref", "carried").alias("ref"))


def resolved_revisits(
    captures: DataFrame, record_id: str = "record_id", url: str = "url", at: str = "captured_at",
    kind: str = "warc_type", status: str = "status", headers: str = "headers",
) -> DataFrame:
    """The captures with canonical_url, resolution, refers_to and merged_headers."""
    full = (F.col(kind) == "response") & (F.col(status) == 200)
    revisit = (F.col(kind) == "revisit") | (F.col(status) == 304)
    state = F.when(full, "full").when(revisit, "revisit").otherwise("other")
    names = [n for n in captures.columns if n.lower() not in RESULTS]
    marked = captures.select(*[F.col(f"`{n}`") for n in names]).withColumns({
        own("url"): canonical_url(F.col(url)), own("at"): F.col(at), own("state"): state,
        own("id"): F.col(record_id), own("headers"): plain_headers(F.col(headers))})
    c = lambda name: F.col(own(name))
    response = F.when(c("state") == "full", F.struct(
        c("id").alias("id"), c("headers").alias("headers")))
    timed = marked.filter(
        c("url").isNotNull() & c("at").isNotNull() & (c("state") != "other"))
    events = written(timed.groupBy(c("url").alias("url"), c("at").alias("at")).agg(
        F.max(c("state") == "revisit").alias("revisited"),
        F.max_by(response, F.when(c("state") == "full", F.struct(
            c("id").isNotNull().alias("known"), c("id").alias("id")))).alias("response")),
        "warc-events")
    found = written(latest_responses(events), "warc-found").select(
        F.col("url").alias(own("u")), F.col("at").alias(own("t")), F.col("ref").alias(own("ref")))
    joined = marked.join(found, (c("url") == c("u")) & (c("at") == c("t")) & (
        c("state") == "revisit"), "left")
    stored = c("ref")["headers"]
    agree = validators_agree(stored, c("headers"))
    resolution = F.when(c("state") != "revisit", c("state")).when(
        c("ref").isNull(), "orphan").when(agree, "resolved").when(
        ~agree, "mismatch").otherwise("unchecked")
    good = resolution == "resolved"
    return joined.select(
        *[F.col(f"`{n}`") for n in names], c("url").alias("canonical_url"),
        resolution.alias("resolution"), F.when(good, c("ref")["id"]).alias("refers_to"),
        F.when(good, merged(stored, c("headers"))).otherwise(c("headers")).alias("merged_headers"))
