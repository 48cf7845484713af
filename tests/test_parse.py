"""Dump parsing: the golden dump, one dump per oddity, and the same dump cut in tiny splits."""

import random

import pytest

from zonescope.operators import parse
from zonescope.plans import cache
from zonescope.sources.dump import Dump, long_lines, scan_dump

OPEN = "; Cache dump of view '_default' (cache _default)"

GOLDEN = """; Start view _default
zero.example.\t1\tA\t9.9.9.9
; Cache dump of view '_default' (cache _default)
$DATE 20250101000000
\t300\tA\t8.8.8.8
; glue
ns1.dns.example.\t300\tA\t10.0.1.53
\t300\tAAAA\t2001:db8::1
ns2.dns.example.\t300\t\\-A\t;-$NXRRSET
; authanswer
z1.example.\t300\tIN NS\tns1.dns.example.
\t300\tNS\tns2.dns.example.
\t300\tMX\t10 mx1.example.
\t300\tTXT\t"v=spf1 include:a.example ~all"
\t300\tTXT\t"site-verification=1"
; additional
z2.example.\t300\tTXT\t"v=spf1 a mx -all"
\t300\tTXT\t"note two"
z3.example.\t300\tIN A\t1.1.1.1
z4.example.\t300\tIN PTR\tp.example.
\t300\tPTR\tq.example.
z5.example.\t300\tIN SOA\tm.example. h.example. ( 1 2 3 4 5 )
300 A 7.7.7.7
; answer
h1.example.\t60\tTYPE65\t\\# 31 (
\t\t00010000010003
; glue
\t\t02683200040008 0A000001
\t\t0A000002 )
h2.example.\t60\t\\-ANY\t;-$NXDOMAIN
h3.example.\t60\t\\-TYPE65\t;-$NXRRSET
h4.example.\t60\tTYPE65\t\\# 3 ( 000100 )
h5.example.\t60\tA\t5.5.5.5
h6.example.\t60\tA\t6.6.6.6 )
h7.example.\t60\tA\t7.7.7.8
\t\t60\tTYPE65\t\\# 3 (
\t\t000100 )
\t60\tA\t7.7.7.9
h8.example.\t60\tMX\t5\ttab.example.
h9.example.\t60\t\\-MX\t;-$NXRRSET
\t60\tMX\t20 mx9.example.
; Address database dump
h10.example.\t60\tA\t1.2.3.4
"""

# line, domain, type, ttl, attribute, rcode, rdata, priority
GOLDEN_RECORDS = [
    (7, "ns1.dns.example.", "A", 300, "glue", "", "10.0.1.53", None),
    (8, "ns1.dns.example.", "AAAA", 300, "glue", "", "2001:db8::1", None),
    (9, "ns2.dns.example.", "A", 300, "glue", "nxrrset", "", None),
    (11, "z1.example.", "NS", 300, "authanswer", "", "ns1.dns.example.", None),
    (12, "z1.example.", "NS", 300, "authanswer", "", "ns2.dns.example.", None),
    (13, "z1.example.", "MX", 300, "authanswer", "", "mx1.example.", 10),
    (14, "z1.example.", "TXT", 300, "authanswer", "", '"v=spf1 include:a.example ~all"', None),
    (15, "z1.example.", "TXT", 300, "authanswer", "", '"site-verification=1"', None),
    (18, "z1.example.", "TXT", 300, "authanswer", "", '"note two"', None),
    (21, "z4.example.", "PTR", 300, "authanswer", "", "q.example.", None),
    (23, "z5.example.", "A", 0, "authanswer", "", "7.7.7.7", None),
    (29, "h1.example.", "TYPE65", 60, "glue", "",
     'SVCB(priority=1, target=., params=[alpn="h2", ipv4hint="10.0.0.1,10.0.0.2"])', None),
    (30, "h2.example.", "ANY", 60, "glue", "nxdomain", "", None),
    (31, "h3.example.", "TYPE65", 60, "glue", "nxrrset", "", None),
    (34, "h4.example.", "TYPE65", 60, "glue", "", "SVCB(priority=1, target=., params=[])", None),
    (35, "h7.example.", "A", 60, "glue", "", "7.7.7.8", None),
    (40, "h9.example.", "MX", 60, "glue", "nxrrset", "", 0),
    (41, "h9.example.", "MX", 60, "glue", "", "mx9.example.", 20),
]
GOLDEN_DOMAINS = {"ns1.dns.example.", "ns2.dns.example.", "z1.example.", "z4.example.",
                  "z5.example.", "h1.example.", "h2.example.", "h3.example.", "h4.example.",
                  "h7.example.", "", "h8.example.", "h9.example."}


def parsed(spark, tmp_path, text, compat=True, split_bytes=None, source="file"):
    """(records, domains) of a dump given as text, or as {file name: text}."""
    files = text if isinstance(text, dict) else {"dump.txt": text}
    for name, body in files.items():
        (tmp_path / name).write_bytes(body.encode())
    keys = {"spark.sql.files.maxPartitionBytes": split_bytes,
            "spark.sql.files.openCostInBytes": split_bytes and 0}
    old = {k: spark.conf.get(k) for k in keys}
    try:
        for k, v in keys.items():
            if v is not None:
                spark.conf.set(k, str(v))
        dump = scan_dump(spark, str(tmp_path), source)
        resolved = parse.resolved_lines(parse.line_states(dump, compat), compat).cache()
        rows = [tuple(r) for r in parse.records(resolved, compat).select(
            "source", "seq", "domain", "rtype", "ttl", "attribute", "rcode", "rdata", "priority",
        ).collect()]
        owners = {tuple(r) for r in parse.domains(resolved).collect()}
        resolved.unpersist()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    return sorted(rows, key=str), owners


def plain(rows):
    return sorted(((*r[1:],) for r in rows), key=lambda r: r[0])


@pytest.mark.parametrize("split_bytes", [None, 97])
def test_golden_dump(spark, tmp_path, split_bytes):
    rows, owners = parsed(spark, tmp_path, GOLDEN, split_bytes=split_bytes)
    assert plain(rows) == GOLDEN_RECORDS
    assert {d for _, d in owners} == GOLDEN_DOMAINS


# One dump per oddity; all are parsed in one job, each file as a source of its own.
CASES = {
    "views": [
        "; glue", "a.example.\t1\tA\t1.1.1.1", "; Address database dump", "\t2\tA\t2.2.2.2",
        "; Start view other", "; Cache dump of view 'other'", "\t3\tA\t3.3.3.3"],
    "marker": [
        "a.example.\t1\tA\t1.1.1.1", '\t1\tTXT\t"Start view of things"', "\t1\tA\t2.2.2.2"],
    "blanks": [
        "a.example.\t1\tA\t1.1.1.1", "b.example.\t1\tNS\tns.example. ", "\t1\tTXT\tx ",
        "\t1\tNS\tns2.example. "],
    "unclosed": ["a.example.\t1\tTYPE65\t\\# 3 (", "\t000100", "b.example.\t1\tA\t1.1.1.1"],
    "unbracketed": ["a.example.\t1\tA\t1.1.1.1", "\t1\tTYPE65\t\\# 3 000100"],
    "short": ["a.example.\t1\tTYPE65\t\\# 0 (", "\t)"],
    "numbers": [
        f"a.example.\t{'9' * 30}\tMX\t+7 m.example.", "\t1\tMX\tx  m.example.",
        f"\t1\tMX\t-{'9' * 30} n.example."],
    "no_dot": [
        "a.example.\t1\tA\t1.1.1.1", "nodot\t1\tA\t2.2.2.2", "odd\t1\tTYPE65\t\\# 3 (",
        "\t000100 )", "\t1\tA\t3.3.3.3"],
    "common": [
        'a.example.\t1\tTXT\t"v=spf1 a mx -all"', "b.example.\t1\tIN A\t1.1.1.1",
        "c.example.\t1\tIN PTR\tp.example.", "d.example.\t1\tTYPE65\t\\# 3 ( 000100 )",
        "\t1\tTYPE65\t\\# 3 (", "\t000200 )", "\t1\t\\-TYPE64\t;-$NXRRSET"],
    "crlf": [line + "\r" for line in GOLDEN.splitlines()],
}


def _by_case(spark, folder, compat):
    files = {f"{name}.txt": "\n".join((OPEN, *lines) if name != "crlf" else lines) + "\n"
             for name, lines in CASES.items()}
    rows, owners = parsed(spark, folder, files, compat)

    def mine(source, name):
        return source.endswith(f"/{name}.txt")

    return {name: (plain(r for r in rows if mine(r[0], name)),
                   {d for s, d in owners if mine(s, name)}) for name in CASES}


@pytest.fixture(scope="module")
def compat(spark, tmp_path_factory):
    return _by_case(spark, tmp_path_factory.mktemp("compat"), True)


@pytest.fixture(scope="module")
def relaxed(spark, tmp_path_factory):
    return _by_case(spark, tmp_path_factory.mktemp("relaxed"), False)


def values(rows):
    return [(r[1], r[2], r[3], r[6]) for r in rows]


def test_carriage_returns_change_nothing(compat):
    assert compat["crlf"] == (GOLDEN_RECORDS, GOLDEN_DOMAINS)


def test_state_carries_over_views(compat):
    rows, _ = compat["views"]
    assert [(r[1], r[3], r[4], r[6]) for r in rows] == [
        ("a.example.", 1, "glue", "1.1.1.1"), ("a.example.", 3, "glue", "3.3.3.3")]


def test_marker_words_inside_a_value_close_the_section(compat):
    assert [r[6] for r in compat["marker"][0]] == ["1.1.1.1"]


def test_trailing_blanks(compat, relaxed):
    rows, owners = compat["blanks"]
    assert [(r[1], r[6]) for r in rows] == [("a.example.", "1.1.1.1"), ("a.example.", "x ")]
    assert owners == {"a.example."}
    assert [(r[1], r[6]) for r in relaxed["blanks"][0]] == [
        ("a.example.", "1.1.1.1"), ("b.example.", "ns.example."), ("b.example.", "x"),
        ("b.example.", "ns2.example.")]


def test_unclosed_value_is_dropped_but_its_owner_stays(compat):
    assert compat["unclosed"] == ([], {"a.example."})


def test_unbracketed_value_takes_the_length_digits_in(compat, relaxed):
    # 3 000100 -> 30001000 -> priority 0x3000
    assert compat["unbracketed"][0][1][6] == "SVCB(priority=12288, target=., params=[])"
    assert relaxed["unbracketed"][0][1][6] == "SVCB(priority=1, target=., params=[])"


def test_short_value_is_kept_without_text(compat):
    assert [(r[2], r[6]) for r in compat["short"][0]] == [("TYPE65", None)]


def test_numbers(compat):
    assert [(r[3], r[7], r[6]) for r in compat["numbers"][0]] == [
        (2**63 - 1, 7, "m.example."), (1, 0, " m.example."), (1, -(2**63), "n.example.")]


def test_owner_without_a_final_dot(compat):
    rows, owners = compat["no_dot"]
    assert [(r[1], r[6]) for r in rows] == [
        ("a.example.", "1.1.1.1"), ("a.example.", "2.2.2.2"),
        ("odd", "SVCB(priority=1, target=., params=[])"), ("odd", "3.3.3.3")]
    assert owners == {"a.example.", "odd"}


def test_relaxed_reads_common_shapes(relaxed):
    rows, owners = relaxed["common"]
    assert values(rows) == [
        ("a.example.", "TXT", 1, '"v=spf1 a mx -all"'), ("b.example.", "A", 1, "1.1.1.1"),
        ("c.example.", "PTR", 1, "p.example."),
        ("d.example.", "TYPE65", 1, "SVCB(priority=1, target=., params=[])"),
        ("d.example.", "TYPE65", 1, "SVCB(priority=2, target=., params=[])"),
        ("d.example.", "TYPE64", 1, "")]
    assert owners == {"a.example.", "b.example.", "c.example.", "d.example."}


SHAPES = [
    "; glue", ";answer ", "; authanswer", "; additional", ";; glue", "$TTL 5",
    "; Start view x", OPEN, OPEN, "; Address database dump",
    "o{i}.example.\t{i}\tA\t10.0.0.{i}", "o{i}.example. {i} IN NS ns{i}.example.",
    "\t{i}\tAAAA\t::{i}", "\t{i}\tNS\tns{i}.", "\t{i}\tTXT\ta b c {i}", "\t{i}\tMX\t{i} mx.",
    "\t{i}\tMX\t{i}\tmx.", "p{i}.example.\t1\tTXT\ta b c", "nodot{i}\t5\tA\t1.1.1.1",
    "5{i} A 7.7.7.7", "s{i}.example.\t9\tIN SOA\tm. h. ( 1 2 )", "q{i}.example.\t9\tIN PTR\tp.",
    "h{i}.example.\t60\tTYPE65\t\\# 4 (", "h{i}.example.\t60\tTYPE65\t\\# 3 ( 000{i} )",
    "\t60\tTYPE65\t\\# 3 ( 0001", "\t\t0001000001{i}", "\t\t0003026832 )", "  )", "\t7\tCNAME\tc) d",
    "n{i}.example.\t60\t\\-A\t;-$NXRRSET", "\t60\t\\-ANY\t;-$NXDOMAIN", "\t60\t\\-NS\t;-$NXRRSET",
    "   ", "\t60\tTYPE65\t\\# 3 000100",
]


def random_dump(rng, n):
    lines = [OPEN]
    for i in range(n):
        lines.append(rng.choice(SHAPES).replace("{i}", str(i % 100)))
    return "\n".join(lines) + "\n"


@pytest.mark.parametrize("compat", [True, False])
def test_small_splits_give_the_same_result(spark, tmp_path, compat):
    rng = random.Random(7)
    dumps = {f"d{k:02}.txt": random_dump(rng, 150) for k in range(12)}
    whole = parsed(spark, tmp_path, dumps, compat)
    assert len(whole[0]) > 150
    for split_bytes in (61, 400):
        assert parsed(spark, tmp_path, dumps, compat, split_bytes) == whole


def test_pieces_of_one_dump_share_state(spark, tmp_path):
    lines = GOLDEN.splitlines(keepends=True)
    names = ["a-long-name.txt", "b.txt", "part-0009", "part-0010", "part-0100", "z"]  # by name
    cuts = [0, 6, 17, 26, 28, 36, len(lines)]
    files = {n: "".join(lines[a:b]) for n, a, b in zip(names, cuts, cuts[1:])}
    rows, owners = parsed(spark, tmp_path, files, source="directory")
    assert plain(rows) == GOLDEN_RECORDS
    assert {d for _, d in owners} == GOLDEN_DOMAINS
    rows, _ = parsed(spark, tmp_path, files, source="file")
    assert len(rows) < len(GOLDEN_RECORDS)


def test_value_over_many_stripes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(parse, "STRIPE", 4)
    value = "0001" + "00" + "00FF0028" + "AB" * 40
    pieces = [f"\t\t{value[i:i + 2]}" for i in range(0, len(value), 2)]
    lines = [OPEN, "a.example.\t1\tTYPE65\t\\# 47 (", *pieces, "\t\t)"]
    rows, _ = parsed(spark, tmp_path, "\n".join(lines))
    assert rows[0][7] == f"SVCB(priority=1, target=., params=[key255=0x{'AB' * 40}])"


def test_long_lines_stop_the_scan(spark, tmp_path):
    limit = 1024 * 1024 - 1
    (tmp_path / "a.txt").write_text(OPEN + "\n" + "x" * limit + "\nend\n")
    assert scan_dump(spark, str(tmp_path)).lines.count() == 3
    (tmp_path / "b.txt").write_text("y" * (limit + 1) + "\n")
    assert long_lines(spark, str(tmp_path)).count() == 1
    assert scan_dump(spark, str(tmp_path), on_long_line="keep").lines.count() == 4
    with pytest.raises(Exception, match="line longer than"):
        scan_dump(spark, str(tmp_path)).lines.collect()


def test_many_blocks_in_small_ranges(spark):
    """5,000 blocks of 61 bytes, scanned in ranges, against one block that is scanned at once."""
    dumps = {"long.txt": random_dump(random.Random(11), 15_500), "short.txt": random_dump(random.Random(12), 40)}
    files = spark.createDataFrame(
        [(i, name, name) for i, name in enumerate(dumps)], "file_key long, file string, source string")

    def resolved(block_bytes, ranges):
        rows, blocks = [], set()
        for key, text in enumerate(dumps.values()):
            at = 0
            for mid, line in enumerate(text.split("\n")):
                rows.append((key, at // block_bytes, mid, line))
                at += len(line) + 1
        blocks = {r[:2] for r in rows}
        lines = spark.createDataFrame(
            [r for r in rows if r[3]], "file_key long, block_start long, mid long, line string")
        states = parse.line_states(Dump(lines, files), ranges=ranges)
        return len(blocks), sorted(map(tuple, parse.resolved_lines(states).collect()), key=str)
    n, whole = resolved(1 << 30, 1)
    many, found = resolved(61, 40)
    assert n == 2 and many >= 5000 and len(whole) > 2000
    assert found == whole


def test_a_split_is_many_blocks(spark, tmp_path, monkeypatch):
    """Blocks of 9 lines of one split, dealt over 5 tasks, against the split as one block."""
    (tmp_path / "one.txt").write_text(random_dump(random.Random(13), 3_000))
    dump = scan_dump(spark, str(tmp_path))

    def resolved(**bounds):
        return sorted(map(tuple, parse.resolved_lines(parse.line_states(dump, **bounds)).collect()), key=str)
    whole = resolved()
    assert dump.lines.select("block_start").distinct().count() == 1 and len(whole) > 400
    seen = []
    monkeypatch.setattr(parse, "tasks_for", lambda _, rows: seen.append(rows) or 5)
    assert resolved(block_lines=9) == whole and seen == [dump.lines.count()]


def test_records_are_sorted_in_tasks_by_their_number(spark, tmp_path, monkeypatch):
    (tmp_path / "one.txt").write_text(random_dump(random.Random(14), 2_000))
    rows = lambda cache: sorted(map(tuple, cache.records.collect()), key=str)
    few = cache.load_cache(spark, str(tmp_path))
    monkeypatch.setattr(cache, "tasks_for", lambda *_: 7)
    many = cache.load_cache(spark, str(tmp_path))
    assert rows(few) == rows(many)
    assert len(few.records.inputFiles()) == 1 < len(many.records.inputFiles()) <= 7


def test_records_before_any_attribute(spark, tmp_path):
    """P10: without an attribute line above it a record's attribute is the default."""
    text = f"{OPEN}\na.example.\t1\tA\t1.1.1.1\n; glue\nb.example.\t1\tA\t2.2.2.2\n"
    rows, _ = parsed(spark, tmp_path, text)
    assert sorted((r[2], r[5]) for r in rows) == [("a.example.", "unknown"), ("b.example.", "glue")]
