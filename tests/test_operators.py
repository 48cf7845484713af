"""Operators on small hand-made tables: hot keys, ranges, chains, traces, sinks."""

import ipaddress
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from zonescope.operators import addresses, health, lists, reports, trace
from zonescope.operators.joins import spread_join
from zonescope.plans.workspace import FEW_ROWS, TASK_ROWS, tasks_for
from zonescope.sinks import lines
from zonescope.sources.ranges import scan_ranges, split_ranges
from zonescope.sources.responses import RAW_RESPONSES, RESPONSES, scan_responses

RECORDS = ("source string, seq bigint, domain string, rtype string, ttl bigint, attribute string, "
           "rcode string, rdata string, priority bigint, wire string")


def records(spark, *rows):
    """(domain, type, rdata[, rcode[, priority]]) in line order."""
    return spark.createDataFrame([
        ("s", i, r[0], r[1], 60, "answer", r[3] if len(r) > 3 else "", r[2],
         r[4] if len(r) > 4 else None, None) for i, r in enumerate(rows)], RECORDS)


def test_spread_join_equals_a_plain_join(spark):
    rng = random.Random(1)
    left = spark.createDataFrame(
        [(rng.choice(["hot"] * 5 + ["a", "b", None, "x"]), i) for i in range(200)], "k string, i int")
    right = spark.createDataFrame(
        [("hot", 1), ("hot", 2), ("a", 3), ("c", 4), (None, 5)], "k string, v int")
    for how in ("inner", "left"):
        plain = Counter(map(tuple, left.join(right, ["k"], how).select("k", "i", "v").collect()))
        spread = spread_join(left, right, ["k"], how, ["i"], rows_per_task=10)
        assert Counter(map(tuple, spread.select("k", "i", "v").collect())) == plain


def test_long_lists_are_one_row_at_any_size(spark):
    rows = [("hot." if i % 3 else f"d{i % 7}.", "TXT", f"t{i}") for i in range(300)]
    df = records(spark, *rows).repartition(5)
    whole = {r.domain: r.value for r in reports.txt_report(df).collect()}
    assert whole["hot."].split(",") == [t for d, _, t in rows if d == "hot."]
    for stripe in (2, 32):
        got = reports.txt_report(df, stripe=stripe).collect()
        assert len(got) == len(whole) and {r.domain: r.value for r in got} == whole


def test_mx_report(spark):
    rows = [("a.", "MX", "m1.", "", 10), ("a.", "MX", "", "nxrrset", 0), ("b.", "MX", "", "nxrrset", 0),
            ("b.", "MX", "m2.", "", 5), ("c.", "MX", "", "nxdomain", 0)]
    for bounds in ({}, {"stripe": 1}):
        got = {r.domain: r.value for r in reports.mx_report(records(spark, *rows), **bounds).collect()}
        assert got == {"a.": "10 m1.,0 ", "c.": "0 "}


def test_first_value_reports(spark):
    df = records(spark, ("a.", "TYPE65", "", "nxrrset"), ("a.", "TYPE65", "x"), ("b.", "TYPE65", "y"),
                 ("b.", "TYPE65", "z"), ("c.", "TYPE65", "", "nxdomain"), ("d.", "TYPE64", "", "nxrrset"))
    assert {tuple(r)[1:] for r in reports.https_report(df).collect()} == {("b.", "y"), ("c.", "")}
    assert [tuple(r)[1:] for r in reports.type64_report(df).collect()] == [("d.", "")]


def test_record_detail(spark):
    rows = [("a.", "A", "1.1.1.1"), ("a.", "A", "", "nxrrset"), ("a.", "A", "2.2.2.2"),
            ("a.", "AAAA", "", "nxrrset"), ("a.", "AAAA", "::1"), ("a.", "NS", "n1."),
            ("a.", "NS", "n2."), ("a.", "MX", "m.", "", 5), ("a.", "PTR", "p."), ("a.", "TXT", '"t"')]
    df = records(spark, *rows)
    owners = spark.createDataFrame([("s", "a."), ("s", "empty.")], "source string, domain string")
    want = ("NSs: [{n1. 60  answer} {n2. 60  answer}], As: [{TTL=60, IP=1.1.1.1, Attribute=answer}], "
            "AAAAs: [{TTL=60, Rcode=nxrrset, Attribute=answer}], ANY: [], TYPE65: [],TYPE64: [], "
            "CNAME: [], MX: [{TTL=60, Priority=5, MailServer=m., Attribute=answer}], "
            "PTR: [{TTL=60, Target=p., Attribute=answer}], TXT: [{TTL=60, Content=\"t\", Attribute=answer}]")
    got = {r.domain: r.detail for r in reports.record_detail(df, owners).collect()}
    assert got["a."] == want
    assert got["empty."] == ("NSs: [], As: [], AAAAs: [], ANY: [], TYPE65: [],TYPE64: [], CNAME: [], "
                             "MX: [], PTR: [], TXT: []")
    hot = records(spark, *[("a.", "A", f"1.1.1.{i}") for i in range(40)], ("a.", "A", "", "nxrrset"),
                  *[("a.", "A", f"2.2.2.{i}") for i in range(40)])
    for stripe in (2, 16, 1000):
        text, = [r.detail for r in reports.record_detail(hot, owners, stripe=stripe).collect()
                 if r.domain == "a."]
        assert text.count("IP=1.1.1.") == 40 and "2.2.2." not in text and "nxrrset" not in text
        shown = {r.domain: r.detail for r in reports.record_detail(df, owners, stripe=stripe).collect()}
        assert shown == got
    nested = {r.domain: r for r in reports.nested_records(df, owners).collect()}
    assert [x.rdata for x in nested["a."].NSs] == ["n1.", "n2."] and nested["empty."].As == []
    assert [x.rcode for x in nested["a."].As] == ["", "nxrrset", ""]
    probes = spark.createDataFrame([("a.",), ("no.",), ("a.",)], "domain string")
    found = {r.domain: (r.found, r.text) for r in reports.lookup(probes, df, owners).collect()}
    assert found == {"a.": (True, f"Domain (a.): {want}"), "no.": (False, "未找到域名: no.")}
    assert reports.point_lookup("A.", df, owners).first().found is False


def test_single_ns(spark):
    df = records(spark, ("a.b.c.", "NS", "n1."), ("a.b.c.d.", "NS", "n1."), ("x.", "NS", "n1."),
                 ("x.", "NS", "n2."))
    assert {(r.domain, r.ns, r.short) for r in reports.single_ns(df).collect()} == {
        ("a.b.c.", "{n1. 60  answer}", True), ("a.b.c.d.", "{n1. 60  answer}", False)}


def test_ns_addresses(spark):
    df = records(
        spark, ("a.", "NS", "n1."), ("a.", "NS", "n2."), ("b.", "NS", "n1."), ("c.", "NS", "none."),
        ("n1.", "A", "1.1.1.1"), ("n1.", "AAAA", "::1"), ("n2.", "A", "1.1.1.1"),
        ("n2.", "AAAA", "", "nxrrset"), ("n1.", "CNAME", "x."))
    want = Counter({("a.", "n1.", "1.1.1.1"): 1, ("a.", "n1.", "::1"): 1, ("a.", "n2.", "1.1.1.1"): 1,
                    ("a.", "n2.", ""): 1, ("b.", "n1.", "1.1.1.1"): 1, ("b.", "n1.", "::1"): 1})
    for rows_per_task in (1, 1000):
        found = addresses.ns_addresses(df, rows_per_task=rows_per_task)
        assert Counter((r.domain, r.ns, r.ip) for r in found.collect()) == want
    assert {r.ip for r in addresses.ns_ips(df).collect()} == {"1.1.1.1", "::1", ""}
    assert {r.ip for r in addresses.ns_ips(df, compat=False).collect()} == {"1.1.1.1", "::1"}
    assert addresses.ns_addresses(df, compat=False).count() == 5
    assert Counter((r.ip, r.n_domains, r.domain) for r in addresses.ip_domains(found).collect()) == {
        ("1.1.1.1", 3, "a."): 2, ("1.1.1.1", 3, "b."): 1, ("::1", 2, "a."): 1, ("::1", 2, "b."): 1,
        ("", 1, "a."): 1}


RANGE_LINES = [
    "10.0.0.0/8 big ISP", "10.1.2.3/16 host bits CORP", "10.1.0.5-10.1.0.9 SPAN", "10.1.0.5 skipped",
    "10.9.0.1 - 10.9.0.9 skipped", "x-10.0.0.1 skipped", "10.0.0.9-10.0.0.1 skipped",
    "10.0.0.1-x skipped", "10.0.0.0/33 skipped", "2001:db8::/32 V6", "2001:db8::1-2001:db8::9 skipped",
    "::ffff:192.0.2.0/120 MAPPED", "::ffff:192.0.2.0/90 skipped-for-v4", "0.0.0.0/0 ANY ",
    "255.255.255.0-255.255.255.255 TOP", "1.1.1.1/32\tTABBED", "9.9.9.9/32", "10.1.0.0/16 LATER", "",
    "10.0.0.1/8/9 skipped", "2001:db8::/129 skipped",
]


def test_ranges_and_attribution(spark):
    raw = spark.createDataFrame(list(enumerate(RANGE_LINES)), "line_no bigint, line string")
    networks = addresses.range_networks(split_ranges(raw)).cache()
    ips = ["10.1.0.5", "10.1.0.10", "10.2.0.1", "8.8.8.8", "2001:db8::5", "::ffff:10.1.0.9", "",
           "2001:db9::1", "192.0.2.7", "255.255.255.255", "1.1.1.1", "9.9.9.9", "bad", "::1"]
    df = spark.createDataFrame([(i,) for i in ips], "ip string")
    for ranges in (1, 7):
        got = {r.ip: (r.client, r.plen, r.n_matches)
               for r in addresses.attribute_ips(df, networks, ranges).collect()}
        assert got == {
            "10.1.0.5": ("SPAN", 32, 5), "10.1.0.10": ("CORP", 16, 4), "10.2.0.1": ("ISP", 8, 2),
            "8.8.8.8": ("", 0, 1), "2001:db8::5": ("V6", 32, 1), "::ffff:10.1.0.9": ("SPAN", 31, 5),
            "": ("未知", None, 0), "2001:db9::1": ("未知", None, 0),
            "192.0.2.7": ("MAPPED", 24, 2), "255.255.255.255": ("TOP", 24, 2), "1.1.1.1": ("", 0, 1),
            "9.9.9.9": ("9.9.9.9/32", 32, 2), "bad": ("未知", None, 0), "::1": ("未知", None, 0)}


def test_sweep_equals_a_search_of_all_networks(spark):
    rng = random.Random(8)
    lines, ips = ["::/0 all", "8000::/1 upper", "::/96 low"], set()
    for i in range(150):
        bits = rng.choice([0, 3, 8, 9, 16, 17, 24, 30, 31, 32])
        base = ipaddress.ip_network((rng.choice([10 << 24, 11 << 24, 0, 255 << 24]) + rng.randrange(1 << 18),
                                     bits), strict=False)
        lines.append(f"{base} c{i}")
        bits = rng.choice([1, 32, 63, 64, 65, 96, 127, 128])
        start = rng.choice([0x20010DB8 << 96, 0, (1 << 128) - (1 << 20)]) + rng.randrange(1 << 66) % (
            1 << rng.choice([20, 66]))
        base = ipaddress.ip_network((min(start, (1 << 128) - 1), bits), strict=False)
        lines.append(f"{base} d{i}")
    for line in lines:
        net = ipaddress.ip_network(line.split()[0])
        for at in (int(net[0]), int(net[-1]), int(net[0]) - 1, int(net[-1]) + 1, int(net[0]) + 1):
            if 0 <= at < 1 << net.max_prefixlen:
                ips.add(str((ipaddress.IPv4Address if net.version == 4 else ipaddress.IPv6Address)(at)))
    ips = sorted(ips, key=lambda _: rng.random())[:500]
    raw = spark.createDataFrame(list(enumerate(lines)), "line_no bigint, line string")
    networks = addresses.range_networks(split_ranges(raw))
    got = {r.ip: (r.client, r.plen, r.n_matches) for r in addresses.attribute_ips(
        spark.createDataFrame([(i,) for i in ips], "ip string"), networks, 9).collect()}
    nets = [(ipaddress.ip_network(x.split()[0]), x.split()[1]) for x in lines]
    for text in ips:
        at = ipaddress.ip_address(text)
        at = getattr(at, "ipv4_mapped", None) or at
        hits = [(-n.prefixlen, i, c) for i, (n, c) in enumerate(nets) if at.version == n.version and at in n]
        want = (min(hits)[2], -min(hits)[0], len(hits)) if hits else ("未知", None, 0)
        assert got[text] == want, text


def test_spans_become_the_smallest_set_of_blocks(spark):
    rng = random.Random(5)
    spans = [(0, 2**32 - 1), (0, 0), (2**32 - 1, 2**32 - 1), (1, 2**32 - 2)]
    for _ in range(300):
        lo = rng.getrandbits(32)
        spans.append((lo, min(lo + rng.getrandbits(rng.randint(1, 32)), 2**32 - 1)))
    rows = [(i, f"{ipaddress.IPv4Address(a)}-{ipaddress.IPv4Address(b)}", f"c{i}")
            for i, (a, b) in enumerate(spans)]
    got = {}
    for r in addresses.range_networks(
            spark.createDataFrame(rows, "line_no bigint, range string, client string")).collect():
        got.setdefault(r.client, set()).add((r.lo, r.plen))
    for i, (a, b) in enumerate(spans):
        want = ipaddress.summarize_address_range(ipaddress.IPv4Address(a), ipaddress.IPv4Address(b))
        assert got[f"c{i}"] == {(int(n.network_address), n.prefixlen) for n in want}


def test_ipv6_ranges_become_aligned_blocks(spark):
    rng = random.Random(6)
    top, mapped = 2**128 - 1, 0xFFFF << 32
    spans = [(0, top), (0, 0), (top, top), (1, top - 1), (5, 5), (2**127 - 1, 2**127), (6, 13),
             (mapped + 5, mapped + 70), (mapped - 3, mapped + 2**32 + 4)]
    for _ in range(200):
        lo = rng.getrandbits(128)
        spans.append((lo, min(lo + rng.getrandbits(rng.randint(1, 128)), top)))
    full = lambda n: ipaddress.IPv6Address(n).exploded
    rows = [(i, f"{full(a)}-{full(b)}", f"c{i}") for i, (a, b) in enumerate(spans)]
    odd = [(900, "::2-::1", "x"), (901, "::1-10.0.0.1", "x"), (902, "::1-::g", "x"), (903, "::1-::2-::3", "x"),
           (904, None, "x"), (905, "-", "x"), (906, "::1-", "x"), (907, "10.0.0.1-10.0.0.2", "v4")]
    df = spark.createDataFrame(rows + odd, "line_no bigint, range string, client string")
    got = {}
    for r in addresses.range_networks(df, compat=False).collect():
        number = (r.hi % 2**64 << 64 | r.lo % 2**64) + (mapped if r.family == 4 else 0)
        got.setdefault(r.client, []).append((number, r.plen + (96 if r.family == 4 else 0)))
    for i, (a, b) in enumerate(spans):
        want = ipaddress.summarize_address_range(ipaddress.IPv6Address(a), ipaddress.IPv6Address(b))
        assert sorted(got.pop(f"c{i}")) == sorted((int(n.network_address), n.prefixlen) for n in want), i
    assert list(got) == ["v4"]
    assert {r.client for r in addresses.range_networks(df).collect()} == {"v4"}


def test_ownership_hides_long_lists(spark):
    rows = [(f"d{i:02}.", "NS", "n.") for i in range(51)] + [("x.", "NS", "m.")]
    df = records(spark, *rows, ("n.", "A", "1.1.1.1"), ("m.", "A", "2.2.2.2"))
    raw = spark.createDataFrame([(0, "1.1.1.1/32 ME")], "line_no bigint, line string")
    networks = addresses.range_networks(split_ranges(raw))
    owned = addresses.ns_ownership(addresses.ns_addresses(df), networks)
    assert {r.line for r in lines.ownership_lines(owned).collect()} == {
        "NS IP归属,NS IP,解析域名数,域名清单", "ME,1.1.1.1,51,过长不显示", "未知,2.2.2.2,1,x."}


def replies(spark, *rows):
    """(server, qname, dict of what differs from an empty reply)."""
    names = [c.split()[0] for c in RESPONSES.replace("\n", " ").split(",")]
    out = []
    for server, qname, given in rows:
        row = {"server": server, "qname": qname, "qtype": "A", "attempt": 1, "answered": True,
               "rcode": 0, "ttl_a": 0, "sent_at": None, "recv_at": None, "auth_type": None}
        row.update({k: [] for k in ("rr_a", "rr_aaaa", "rr_cname", "rr_ns", "rr_mx", "rr_txt",
                                    "rr_ds", "auth_ns")})
        row.update(given)
        row["n_answers"] = len(row["rr_a"]) + len(row["rr_cname"])
        out.append(tuple(row[n] for n in names))
    return spark.createDataFrame(out, RESPONSES)


def test_status_and_failing_negatives(spark):
    df = replies(
        spark, ("r", "ok.", {"rr_a": ["1.1.1.1"]}), ("r", "empty.", {}), ("r", "alias.", {"rr_cname": ["x."]}),
        ("r", "fail.", {"rcode": 2}), ("r", "odd.", {"rcode": 12}), ("r", "late.", {"answered": False}),
        ("r", "late.", {"attempt": 2}), ("other", "lost.", {}))
    names = ["ok.", "empty.", "alias.", "fail.", "odd.", "late.", "lost", "fail"]
    negatives = spark.createDataFrame(
        [("s", n, "nxrrset") for n in names] + [("s", "gone.", "nxdomain")],
        "source string, domain string, rcode string")
    got = {r.domain: r.status for r in health.probed(negatives, df, "r").collect()}
    assert got == {"ok.": "NOERROR", "empty.": "NODATA", "alias.": "NOERROR", "fail.": "SERVFAIL",
                   "odd.": "", "late.": "无响应", "lost": "无响应", "fail": "SERVFAIL", "gone.": "无响应"}
    failing = health.failing_negatives(negatives, df, "r")
    assert {r.line for r in lines.failing_lines(failing).collect()} == {
        "SERVFAIL|fail.", "|odd.", "无响应|late.", "无响应|lost", "SERVFAIL|fail"}


def below_the_exchanges(df):
    """What a plan does before its rows are shuffled for the first time."""
    return df._jdf.queryExecution().executedPlan().toString().rsplit("Exchange", 1)[1]


def test_first_replies_are_sorted_after_they_are_dealt(spark):
    """One name asked 300 times and 60 others: tasks of 20 rows give the replies of one task."""
    tries = [("r", "hot.", {"attempt": 1 + i % 3, "rr_a": [f"1.1.1.{i % 3}"]}) for i in range(300)]
    tries += [(f"s{i % 7}", f"n{i}", {"rr_a": [f"2.2.2.{i}"]}) for i in range(60)]
    df = replies(spark, *tries, ("r", "n0", {"answered": False}))
    small = health.answers(df, attempts=3, task_rows=20)
    found = sorted(map(tuple, small.select("server", "qname", "rr_a").collect()))
    assert found == sorted([("r", "hot.", ["1.1.1.0"])] + [
        (f"s{i % 7}", f"n{i}.", [f"2.2.2.{i}"]) for i in range(60)])
    assert sorted(map(tuple, health.answers(df, attempts=3).collect())) == sorted(map(tuple, small.collect()))
    assert health.answers(df.limit(0)).count() == 0
    for plan in (health.answers(df), trace._walk_rows(trace._steps(df, "A", True, "rr_a"), ["r"], 10)):
        assert not re.search("Sort|ObjectHashAggregate", below_the_exchanges(plan))


def test_tasks_follow_the_number_of_rows(spark):
    session = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert [tasks_for(spark, n) for n in (0, 1, FEW_ROWS + 1)] == [1, 1, 2]
    assert tasks_for(spark, TASK_ROWS) == session and tasks_for(spark, 100 * TASK_ROWS + 1) == 101


def test_cname_chase(spark):
    chain = [("n", f"c{i}.", {"rr_cname": [f"c{i + 1}."]}) for i in range(8)]
    df = replies(spark, *chain, ("n", "c8.", {"rr_a": ["8.8.8.8"]}), ("n", "dead.", {"rr_cname": ["no."]}),
                 ("n", "loop.", {"rr_cname": ["loop."]}), ("other", "no.", {"rr_a": ["1.1.1.1"]}))
    for rows_per_task in (1, 1000):
        got = {r.qname: (r.rr_a, r.rr_cname, r.hops) for r in health.chase_cnames(
            health.answers(df), rows_per_task=rows_per_task).collect()}
        assert got["c3."] == (["8.8.8.8"], [], 5)
        assert got["c2."] == ([], ["c8."], 5)
        assert got["c8."] == (["8.8.8.8"], [], 0)
        assert got["dead."] == ([], [], 1)
        assert got["loop."] == ([], ["loop."], 5)
        assert len(got) == 12


def test_ns_disagreement(spark):
    df = records(spark, ("a.", "NS", "n1."), ("a.", "NS", "n2."), ("a.", "NS", "n2."), ("b.", "NS", "n1."),
                 ("c.", "NS", "n1."))
    captured = replies(
        spark, ("r", "a.", {"answered": False}), ("r", "a.", {"attempt": 2, "rr_a": ["1", "2"]}),
        ("n1.", "a.", {"rr_a": ["2", "1"]}), ("n2.", "a.", {"answered": False}),
        ("n2.", "a.", {"attempt": 2, "rr_a": ["1", "2"]}), ("n1.", "b.", {"rr_a": ["9"]}),
        ("r", "b.", {"rr_cname": ["x."], "rr_a": ["3"]}))
    for rows_per_task in (1, 1000):
        odd = health.ns_disagreement(df, captured, "r", rows_per_task)
        assert sorted((r.domain, r.ns, r.expected_a, r.actual_a) for r in odd.collect()) == [
            ("a.", "n2.", ["1", "2"], []), ("a.", "n2.", ["1", "2"], []), ("b.", "n1.", ["3"], ["9"])]
    text = lines.disagreement_lines(odd, "r").orderBy("domain", "place")
    assert [r.line for r in text.collect()] == [
        "a. NS不一致：ns（r）结果-[1 2]-[]", " " * 12 + "ns（n2.）结果-[]-[]",
        " " * 12 + "ns（n2.）结果-[]-[]", "", "b. NS不一致：ns（r）结果-[3]-[x.]",
        " " * 12 + "ns（n1.）结果-[9]-[]", ""]
    counts = health.check_counts({"x": (odd, reports.of_type(df, "NS"))}).first()
    assert (counts.hits, counts.total) == (2, 3)


def test_raw_responses(spark):
    a = "a.\t300\tIN\tA\t1.1.1.1"
    raw = spark.createDataFrame([
        ("r", "a.", "A", 1, True, 0, ["a.\t60\tIN\tCNAME\tb.", a, "a.\t301\tIN\tA\t1.1.1.2"],
         ["a.\t9\tIN\tNS\tn1.", "a.\t9\tIN\tSOA\tn2. h. 1 2 3 4 5"], None, None),
        ("r", "a.", "AAAA", 1, False, 0, [], [], None, None),
        ("r", "a.", "MX", 1, True, 2, ["a.\t1\tIN\tMX\t10 m."], [], None, None),
        ("r", "b.", "MX", 1, True, 0, ["b.\t1\tIN\tTXT\t\"x y\"", "b.\t1\tIN\tHINFO\tz"], None, None, None),
    ], RAW_RESPONSES)
    bucketed = health.bucket_answers(raw)
    one = bucketed.filter("qname = 'a.' AND qtype = 'A'").first()
    assert (one.n_answers, one.rr_a, one.rr_cname, one.ttl_a, one.auth_ns, one.auth_type) == (
        3, ["1.1.1.1", "1.1.1.2"], ["b."], 301, ["n1.", "n2."], "SOA")
    txt = bucketed.filter("qname = 'b.'").first()
    assert (txt.rr_txt, txt.n_answers, txt.auth_ns) == (['"x y"'], 2, [])
    both = {r.qname: r for r in health.combine_types(bucketed, ["A", "AAAA", "MX"]).collect()}
    assert (both["a."].rcode, both["a."].rr_mx, both["a."].rr_a) == (0, [], ["1.1.1.1", "1.1.1.2"])
    late = {r.qname: r for r in health.combine_types(bucketed, ["A", "MX"]).collect()}
    assert (late["a."].rcode, late["a."].rr_mx, late["a."].auth_type) == (2, ["10 m."], "SOA")
    assert (late["b."].rcode, late["b."].rr_mx) == (0, [])


def test_traces(spark):
    def ns(*names, kind="NS", **more):
        return {"auth_ns": list(names), "auth_type": kind, **more}

    long = [(f"h{i}.", "long.", ns(f"h{i + 1}.")) for i in range(1, 12)]
    chain = [("root.", f"c{i}.", {"rr_cname": [f"c{i + 1}."]}) for i in range(12)]
    df = replies(
        spark, ("r", ".", ns("root.", "root2.")),
        ("root.", "ok.", ns("p1.", "p2.")), ("p1.", "ok.", ns("p1.", rr_a=["1.1.1.1"])),
        ("root.", "soa.", ns("p1.")), ("p1.", "soa.", ns("x.", kind="SOA", rcode=3)),
        ("root.", "refused.", ns("p1.", rcode=5, rr_a=["6.6.6.6"])),
        ("root.", "alias.", ns("p9.", rr_cname=["ok"], rr_a=["9.9.9.9"])),
        ("root.", "end.", {}), ("root.", "ring.", ns("q1.")), ("q1.", "ring.", ns("root.")),
        ("root.", "long.", ns("h1.")), *long, ("h12.", "long.", {"rr_a": ["12.12.12.12"]}),
        *chain, ("root.", "c12.", {"rr_a": ["7.7.7.7"]}))
    names = spark.createDataFrame([(n,) for n in (
        "ok.", "soa.", "refused.", "alias.", "end.", "ring.", "long.", "missing.", "c0.", "c2.")],
        "domain string")
    for rows_per_task, map_replies in ((1, 4096), (1000, 3)):
        got = {r.domain: (r.addresses, r.child_ns, r.parent_ns) for r in trace.delegation_trace(
            names, df, "r", rows_per_task=rows_per_task, map_replies=map_replies).collect()}
        assert got == {
            "ok.": (["1.1.1.1"], ["p1."], ["p1.", "p2."]), "soa.": ([], [], ["p1."]),
            "refused.": ([], ["p1."], ["root.", "root2."]),
            "alias.": (["1.1.1.1"], ["p1."], ["p1.", "p2."]),
            "c2.": (["7.7.7.7"], [], ["root.", "root2."])}
    simple = {r.domain: r.addresses for r in trace.trace_answers(names, df, "r").collect()}
    steps = trace._steps(df, "A", True, "rr_a")
    text = trace.walks(steps, ["root.", "root2."], 10)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in text  # all hops of a name inside its row
    assert simple == {"ok.": ["1.1.1.1"], "refused.": ["6.6.6.6"], "alias.": ["1.1.1.1"],
                      "long.": ["12.12.12.12"], "c2.": ["7.7.7.7"]}
    assert trace.delegation_trace(names, df, "nobody").count() == 0
    negatives = names.select(F.lit("s").alias("source"), "domain", F.lit("nxdomain").alias("rcode"))
    traces = spark.createDataFrame(
        [("ok.", [], ["a."], ["a.", "b."]), ("soa.", [], [], ["a."]), ("end.", [], ["a.", "b."], ["b."]),
         ("long.", [], ["a."], ["b."])],
        "domain string, addresses array<string>, child_ns array<string>, parent_ns array<string>")
    bad = trace.parent_child_mismatch(negatives, traces)
    assert {r.line for r in lines.parent_child_lines(bad).collect()} == {
        "ok.|[a.]|[a. b.]", "long.|[a.]|[b.]"}
    assert {r.domain for r in trace.parent_child_mismatch(negatives, traces, compat=False).collect()} == {
        "long."}


def test_written_lines(spark, tmp_path):
    df = records(spark, ("a.", "PTR", "p1."), ("a.", "PTR", "", "nxrrset"), ("b.", "PTR", "p2."))
    folder = lines.write_lines(lines.report_lines(reports.ptr_report(df)), str(tmp_path / "ptr"), "1")
    assert folder.endswith("run=1")
    assert {r.value for r in spark.read.text(folder).collect()} == {"a.|p1.,", "b.|p2."}
    with pytest.raises(Exception, match="already exists|ALREADY_EXISTS"):
        lines.write_lines(lines.ip_lines(addresses.ns_ips(df)), str(tmp_path / "ptr"), "1")


def read_files(folder, source):
    found = sorted((folder / f"source={source}").glob("part-*"))
    return [x for f in found for x in f.read_text().split("\n")[:-1]]


def test_blocks_are_written_whole_and_by_dump(spark, tmp_path):
    rows = [(s, f"d{d}.", k, f"n{k}.", ["1"], [], ["2"], []) for s in ("one", "two")
            for d in range(30) for k in range(3)]
    odd = spark.createDataFrame(rows, "source string, domain string, seq bigint, ns string, "
                                "expected_a array<string>, expected_cname array<string>, "
                                "actual_a array<string>, actual_cname array<string>").repartition(7)
    odd = odd.withColumn("seq", F.col("seq") + 1)
    folder = lines.write_lines(lines.disagreement_lines(odd, "r"), str(tmp_path / "odd"), "1")
    for source in ("one", "two"):
        text = read_files(tmp_path / "odd" / "run=1", source)
        blocks = ["\n".join(text[i:i + 5]) for i in range(0, len(text), 5)]
        want = [f"d{d}." for d in range(30)]
        assert sorted(b.split(" ")[0] for b in blocks) == sorted(want)
        for block in blocks:
            head, *odd_ones, blank = block.split("\n")
            assert "（r）" in head and blank == ""
            assert [x.strip()[3:6] for x in odd_ones] == ["n0.", "n1.", "n2."]


def test_two_dumps_give_two_outputs(spark, tmp_path):
    owned = spark.createDataFrame(
        [("x", "ME", "1.1.1.1", 1, "a."), ("y", "US", "2.2.2.2", 1, "b."), ("y", "US", "3.3.3.3", 1, "c.")],
        "source string, client string, ip string, n_domains bigint, domains string")
    lines.write_lines(lines.ownership_lines(owned), str(tmp_path / "own"), "1")
    folder = tmp_path / "own" / "run=1"
    header = "NS IP归属,NS IP,解析域名数,域名清单"
    assert read_files(folder, "x") == [header, "ME,1.1.1.1,1,a."]
    assert read_files(folder, "y")[0] == header and len(read_files(folder, "y")) == 3


def test_range_lines_keep_file_order(spark, tmp_path):
    (tmp_path / "a.txt").write_text("10.0.0.0/8 FIRST\n10.0.0.0/0008 ZEROS\n")
    (tmp_path / "b.txt").write_text("10.0.0.0/8 SECOND\n" + "192.0.2.0/24 PAD\n" * 500)
    networks = addresses.range_networks(scan_ranges(spark, str(tmp_path)))
    ip = spark.createDataFrame([("10.1.1.1",)], "ip string")
    found = addresses.attribute_ips(ip, networks).first()
    assert (found.client, found.plen, found.n_matches) == ("FIRST", 8, 3)


def test_captures_as_files(spark, tmp_path):
    df = replies(spark, ("r", "a.", {"answered": False}), ("r", "b.", {"rr_a": ["1"]}))
    negatives = spark.createDataFrame(
        [("s", "a.", "nxrrset"), ("s", "b.", "nxrrset")], "source string, domain string, rcode string")
    for fmt in ("parquet", "json"):
        df.write.format(fmt).save(str(tmp_path / fmt))
        captured = scan_responses(spark, str(tmp_path / fmt), fmt)
        failing = health.failing_negatives(negatives, captured, "r").collect()
        assert [(r.domain, r.status) for r in failing] == [("a.", "无响应")]


def test_list_helper_keeps_duplicates(spark):
    df = records(spark, ("a.", "NS", "n."), ("a.", "NS", "n."))
    assert lists.joined(df, ["domain"], F.col("rdata")).first().value == "n.,n."


def test_files_follow_the_size_of_a_source(spark, tmp_path):
    rows = spark.range(6000).select(
        F.when(F.col("id") < 200, F.concat(F.lit("dump"), F.col("id").cast("string"))).otherwise("large")
        .alias("source"), F.lit("the same line").alias("line")).repartition(8)
    folder = lines.write_lines(rows, str(tmp_path / "out"), "1", lines_per_file=1000)
    files = [p for p in (tmp_path / "out" / "run=1").rglob("part-*")]
    large = [p for p in files if p.parent.name == "source=large"]
    assert len(files) - len(large) == 200 and 1 <= len(large) <= 6
    assert spark.read.text(folder).groupBy("source").count().filter("source = 'large'").first()[1] == 5800
    assert (tmp_path / "out" / "run=1" / "_SUCCESS").exists()
