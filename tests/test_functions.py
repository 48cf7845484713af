"""Column functions against Python's own modules and hand-made wire data."""

import ipaddress
import random
from collections import Counter

from pyspark.sql import functions as F

from zonescope.functions import arrays, ip, svcb
from zonescope.functions.text import bracketed, fully_qualified, whole_number
from zonescope.operators.parse import decode


def test_text(spark):
    df = spark.createDataFrame([("12", "a"), ("", "a."), ("x1", "")], "n string, d string")
    rows = df.select(whole_number(F.col("n")), fully_qualified(F.col("d"))).collect()
    assert [tuple(r) for r in rows] == [(12, "a."), (0, "a."), (0, ".")]
    row = spark.range(1).select(
        bracketed(F.array(F.lit("a"), F.lit("b"))), bracketed(F.lit(None).cast("array<string>"))).first()
    assert tuple(row) == ("[a b]", "[]")


def test_array_predicates(spark):
    rng = random.Random(1)
    cases = [([rng.choice("abc") for _ in range(rng.randint(0, 4))],
              [rng.choice("abc") for _ in range(rng.randint(0, 4))]) for _ in range(300)]
    df = spark.createDataFrame(cases, "a array<string>, b array<string>")
    a, b = F.col("a"), F.col("b")
    for row in df.select("a", "b", arrays.bag_equal(a, b).alias("eq"),
                         arrays.bounded_contains(a, b).alias("has"),
                         arrays.either_contains(a, b).alias("one_way"),
                         arrays.either_contains(a, b, compat=False).alias("either")).collect():
        def has(x, y):
            return len(y) <= len(x) and set(y) <= set(x)
        assert row.eq == (Counter(row.a) == Counter(row.b))
        assert row.has == row.one_way == has(row.a, row.b)
        assert row.either == (has(row.a, row.b) or has(row.b, row.a))
    none = F.lit(None).cast("array<string>")
    assert spark.range(1).select(arrays.bag_equal(none, F.array().cast("array<string>"))).first()[0]


def _ip_texts():
    rng = random.Random(2)
    texts = ["", "1.2.3", "1.2.3.4.5", "256.1.1.1", "01.2.3.4", "1.2.3.4 ", " 1.2.3.4", "1.2.3.x",
             "::", "::1", "1::", ":::", "1:::2", "1::2::3", "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7:8:9",
             "1:2:3:4:5:6:7::", "::2:3:4:5:6:7:8", "1:2:3:4::5:6:7:8", "1:2:3:4:5:6:7", "12345::",
             "::ffff:1.2.3.4", "::ffff:256.2.3.4", "1:2:3:4:5:6:1.2.3.4", "::1.2.3.4", "1.2.3.4::",
             "::g", ":1", "1:", "::FFFF:0102:0304", "fe80::1%eth0", "::1.2.3.4:5", "1:2:3:4:5:6:7:1.2.3.4"]
    for _ in range(150):
        texts.append(str(ipaddress.IPv4Address(rng.getrandbits(32))))
        v6 = rng.getrandbits(128) & rng.choice([-1, ~(0xFFFF << 48), ~(0xFFFFFFFF << 64), 0xFFFF])
        address = ipaddress.IPv6Address(v6 & (2**128 - 1))
        texts += [str(address), address.exploded.upper()]
    return texts


def test_addresses(spark):
    texts = _ip_texts()
    got = {r.t: r.a for r in spark.createDataFrame([(t,) for t in texts], "t string").select(
        "t", ip.address(F.col("t")).alias("a")).collect()}
    for text in texts:
        try:
            want = ipaddress.ip_address(text)
            if "%" in text:
                want = None
        except ValueError:
            want = None
        if want is None:
            assert got[text] is None, text
            continue
        want = getattr(want, "ipv4_mapped", None) or want
        hi, lo = divmod(int(want), 2**64)
        assert (got[text].family, got[text].hi % 2**64, got[text].lo % 2**64) == (
            want.version, hi, lo), text


def test_ipv6_text(spark):
    rng = random.Random(3)
    numbers = [0, 1, 2**128 - 1, 0xFFFF01020304]
    for _ in range(300):
        groups = [rng.choice([0, 0, rng.getrandbits(16), rng.getrandbits(4)]) for _ in range(8)]
        numbers.append(sum(g << (16 * i) for i, g in enumerate(groups)))
    df = spark.createDataFrame([(f"{n:032X}",) for n in numbers], "h string")
    for row in df.select("h", ip.ipv6_text(F.col("h")).alias("t")).collect():
        want = ipaddress.IPv6Address(int(row.h, 16))
        assert row.t == str(want.ipv4_mapped or want)


def test_masks(spark):
    rng = random.Random(4)
    cases = []
    for _ in range(200):
        v = rng.getrandbits(128)
        cases.append((f"{ipaddress.IPv6Address(v)}", rng.randint(0, 128)))
        cases.append((f"{ipaddress.IPv4Address(v % 2**32)}", rng.randint(0, 32)))
    cases += [("2001:db8::1", p) for p in (0, 1, 63, 64, 65, 127, 128)]
    df = spark.createDataFrame(cases, "t string, p int").withColumn("a", ip.address(F.col("t")))
    net = ip.masked(F.col("a.family"), F.col("a.hi"), F.col("a.lo"), F.col("p"))
    text = ip.network_text(F.col("a.family"), F.col("n.hi"), F.col("n.lo"), F.col("p"))
    for row in df.withColumn("n", net).select("t", "p", text.alias("x")).collect():
        assert row.x == str(ipaddress.ip_network(f"{row.t}/{row.p}", strict=False))


def _decoded(spark, wires):
    df = decode(spark.createDataFrame([(w,) for w in wires], "wire string"))
    params = F.col("svc_params")
    rows = df.select(
        "wire", F.col("svc_priority").alias("priority"), F.col("svc_target.name").alias("name"),
        svcb.readable(F.col("svc_priority"), F.col("svc_target.name"), params).alias("text"),
        F.transform(params, lambda p: svcb.strict_text(p["key"], p["value"])).alias("strict"),
        F.transform(params, lambda p: svcb.violation(p["key"], p["value"])).alias("broken"),
    ).collect()
    return {r.wire: r for r in rows}


def test_targets(spark):
    cases = {
        "0001": (".", ""),                              # nothing after the priority
        "000100": (".", ""),
        "000003777777076578616D706C6503636F6D00": ("www.example.com", ""),
        "0001036162": (".", ""),                        # cut label: params start after its length
        "0001C00C000300020050": (".", "key3=0x0050"),   # pointer
        "000101 61C0": (".", ""),                       # pointer cut short after a label
        "0001 0161": ("a", ""),                         # data ends without a root label
        "0001 40" + "62" * 64 + "00": ("b" * 64, ""),   # long label length is taken as it is
        "00013F 00030001 FF": (".", "key3=0xFF"),       # cut label, then a param
    }
    wires = {w.replace(" ", ""): v for w, v in cases.items()}
    got = _decoded(spark, wires)
    for wire, (name, params) in wires.items():
        priority = int(wire[:4], 16)
        assert got[wire].text == f"SVCB(priority={priority}, target={name}, params=[{params}])", wire


def test_too_short(spark):
    got = _decoded(spark, ["", "00"])
    assert got[""].text is None and got["00"].text is None and got["00"].priority is None


def test_params(spark):
    long = "AB" * 257
    cases = {
        "0001 0003 026832": ('alpn="h2"', 'alpn="h2"', None),
        "0001 0000": (None, 'alpn=""', None),
        "0001 0001 00": ('alpn=""', 'alpn=""', None),
        "0001 0004 09016101": ('alpn="a"', None, "ALPN格式错误: 字符串长度不足"),
        "0004 0004 C0000201": ('ipv4hint="192.0.2.1"',) * 2 + (None,),
        "0004 0000": ('ipv4hint=""',) * 2 + (None,),
        "0004 0003 C00002": (None, None, "IPv4Hint长度必须是4的倍数"),
        "0006 0010 20010DB8000000000000000000000001": ('ipv6hint="2001:db8::1"',) * 2 + (None,),
        "0006 0020 00000000000000000000FFFF01020304" + "0" * 32:
            ('ipv6hint="1.2.3.4,::"',) * 2 + (None,),
        "0006 0001 20": (None, None, "IPv6Hint长度必须是16的倍数"),
        "0005 0002 beef": ("echconfig=0xBEEF", "key=0x0005, value=0xBEEF", None),
        "0005 0000": (None, "key=0x0005, value=0x", None),
        "0000 0002 0001": ("key0=0x0001", "reserved=0x0001", None),
        "FFFF 0000": ("key65535=0x", "key=0xFFFF, value=0x", None),
        f"0007 0101 {long}": (None, f"key=0x0007, value=0x{long}", None),
        f"0007 0100 {long[2:]}": (f"key7=0x{long[2:]}", f"key=0x0007, value=0x{long[2:]}", None),
    }
    wires = {"000100" + w.replace(" ", ""): v for w, v in cases.items()}
    got = _decoded(spark, wires)
    for wire, (text, strict, broken) in wires.items():
        assert got[wire].text == f"SVCB(priority=1, target=., params=[{text or ''}])", wire
        assert (got[wire].strict, got[wire].broken) == ([strict], [broken]), wire
    every = [w for w in wires]
    body = "000100" + "".join(w[6:] for w in every)
    for tail in ("", "0003", "00030005AA"):  # a cut param ends the walk
        row = _decoded(spark, [body + tail])[body + tail]
        shown = ", ".join(wires[w][0] for w in every if wires[w][0] is not None)
        assert row.text == f"SVCB(priority=1, target=., params=[{shown}])"
