"""IP text, prefixes and masks as native column expressions.

An address is a struct (family, hi, lo): two signed 64-bit halves, ``hi`` = 0 for IPv4.
IPv4-mapped IPv6 addresses count as IPv4.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from zonescope.functions.text import let

_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_IPV4 = rf"^{_OCTET}(?:\.{_OCTET}){{3}}\z"


def _bits(text: Column) -> Column:
    """Hex text (up to 16 digits) as a signed bigint."""
    return F.conv(text, 16, -10).cast("bigint")


def ipv4_number(text: Column) -> Column:
    """Dotted IPv4 text as a number, NULL when it is not valid."""
    def number(octets: Column) -> Column:
        total = F.lit(0).cast("bigint")
        for i in range(4):
            total = total * 256 + F.get(octets, F.lit(i)).cast("bigint")
        return total

    return F.when(text.rlike(_IPV4), let(F.split(text, r"\."), number))


def ipv4_text(number: Column) -> Column:
    return F.concat_ws(
        ".", *(F.shiftright(number, s).bitwiseAND(F.lit(255)).cast("string") for s in (24, 16, 8, 0))
    )


def _no_groups() -> Column:
    return F.array().cast("array<string>")


def _hex_tail(text: Column) -> Column:
    """An IPv4 tail (``::ffff:1.2.3.4``) as two hex groups, NULL when it is not valid."""
    def groups(v4: Column) -> Column:
        return F.concat(
            F.regexp_extract(text, r"^(.*:)[^:]*\z", 1), F.lower(F.hex(F.shiftright(v4, 16))),
            F.lit(":"), F.lower(F.hex(v4.bitwiseAND(F.lit(65535)))))

    tail = ipv4_number(F.regexp_extract(text, r"^.*:([^:]*)\z", 1))
    return F.when(F.instr(text, ".") > 0, let(tail, groups)).otherwise(text)


def ipv6_digits(text: Column) -> Column:
    """IPv6 text as its 32 hex digits, NULL when it is not valid."""
    def groups(side: Column) -> Column:
        return F.when(side == "", _no_groups()).otherwise(F.split(side, ":"))

    def filled(sides: Column) -> Column:
        # sides: the groups before and after ``::``, or all of them and NULL.
        left, right = sides["left"], F.coalesce(sides["right"], _no_groups())
        missing = F.lit(8) - F.size(left) - F.size(right)
        short = sides["right"].isNotNull()
        ok = (sides["n"] <= 2) & ((short & (missing >= 1)) | (~short & (missing == 0)))
        return F.when(ok, F.concat(
            left, F.array_repeat(F.lit("0"), F.greatest(missing, F.lit(0))), right))

    def digits(all_groups: Column) -> Column:
        return F.when(
            F.forall(all_groups, lambda g: g.rlike(r"^[0-9a-fA-F]{1,4}\z")),
            F.lower(F.array_join(F.transform(all_groups, lambda g: F.lpad(g, 4, "0")), "")))

    def parted(halves: Column) -> Column:
        return F.struct(
            groups(F.get(halves, F.lit(0))).alias("left"),
            groups(F.get(halves, F.lit(1))).alias("right"), F.size(halves).alias("n"))

    sides = let(F.split(_hex_tail(text), "::"), parted)
    return F.when(F.instr(text, ":") > 0, let(let(sides, filled), digits))


def address(text: Column) -> Column:
    """IP text -> struct(family, hi, lo); NULL when the text is no address."""
    def row(family: int, hi: Column, lo: Column) -> Column:
        return F.struct(F.lit(family).alias("family"), hi.alias("hi"), lo.alias("lo"))

    def from_digits(digits: Column) -> Column:
        hi, lo = _bits(F.substring(digits, 1, 16)), _bits(F.substring(digits, 17, 16))
        mapped = digits.startswith("00000000000000000000ffff")
        return F.when(
            mapped, row(4, F.lit(0).cast("bigint"), _bits(F.substring(digits, 25, 8)))
        ).when(digits.isNotNull(), row(6, hi, lo))

    def from_number(v4: Column) -> Column:
        return F.when(v4.isNotNull(), row(4, F.lit(0).cast("bigint"), v4))

    return F.when(F.instr(text, ":") > 0, let(ipv6_digits(text), from_digits)).otherwise(
        let(ipv4_number(text), from_number))


def _ones(bits: Column, width: int) -> Column:
    """The mask of ``bits`` leading ones in a field of ``width`` bits (0 <= bits <= width)."""
    shift = F.greatest(F.least(F.lit(width) - bits, F.lit(63)), F.lit(0))
    mask = F.call_function("shiftleft", F.lit(-1).cast("bigint"), shift)
    return F.when(bits <= 0, F.lit(0).cast("bigint")).otherwise(mask)


def masked(family: Column, hi: Column, lo: Column, plen: Column) -> Column:
    """struct(hi, lo) of the network that holds the address at prefix length ``plen``."""
    v4 = family == 4
    lo4 = lo.bitwiseAND(_ones(plen, 32))
    hi6 = hi.bitwiseAND(_ones(plen, 64))
    lo6 = lo.bitwiseAND(_ones(plen - 64, 64))
    return F.struct(
        F.when(v4, hi).otherwise(hi6).alias("hi"), F.when(v4, lo4).otherwise(lo6).alias("lo")
    )


def last_address(family: Column, hi: Column, lo: Column, plen: Column) -> Column:
    """struct(hi, lo) of the last address of a network that begins at (hi, lo)."""
    host4 = F.bitwise_not(_ones(plen, 32)).bitwiseAND(F.lit(0xFFFFFFFF))
    v4 = family == 4
    return F.struct(
        F.when(v4, hi).otherwise(hi.bitwiseOR(F.bitwise_not(_ones(plen, 64)))).alias("hi"),
        F.when(v4, lo.bitwiseOR(host4))
        .otherwise(lo.bitwiseOR(F.bitwise_not(_ones(plen - 64, 64)))).alias("lo"),
    )


def _shortest(full: Column) -> Column:
    """Eight groups without leading zeros -> the leftmost longest run of zeros as ``::``."""
    short = F.when(F.lit(False), full)
    for zeros in range(8, 1, -1):
        run = rf"^(.*?)(?:^|:)0(?::0){{{zeros - 1}}}(?:\z|:)(.*)\z"
        short = short.when(full.rlike(run), F.regexp_replace(full, run, "$1::$2"))
    return short.otherwise(full)


def ipv6_text(digits: Column) -> Column:
    """32 hex digits in the shortest IPv6 form; an IPv4-mapped address prints as IPv4."""
    def text(lower: Column) -> Column:
        groups = F.transform(
            F.sequence(F.lit(0), F.lit(7)),
            lambda i: F.regexp_replace(lower.substr(i * 4 + 1, F.lit(4)), "^0{1,3}", ""))
        mapped = lower.startswith("00000000000000000000ffff")
        return F.when(mapped, let(_bits(F.substring(lower, 25, 8)), ipv4_text)).otherwise(
            let(F.array_join(groups, ":"), _shortest))

    return let(F.lower(digits), text)


def network_text(family: Column, hi: Column, lo: Column, plen: Column) -> Column:
    digits = F.concat(F.lpad(F.hex(hi), 16, "0"), F.lpad(F.hex(lo), 16, "0"))
    host = F.when(family == 4, ipv4_text(lo)).otherwise(ipv6_text(digits))
    return F.concat(host, F.lit("/"), plen.cast("string"))


def ipv6_bits(text: Column) -> Column:
    """IPv6 text as its 128 binary digits, NULL when it is not valid; mapped addresses stay as they are."""
    def binary(digits: Column) -> Column:
        halves = [F.lpad(F.bin(_bits(F.substring(digits, at, 16))), 64, "0") for at in (1, 17)]
        return F.when(digits.isNotNull(), F.concat(*halves))

    return let(ipv6_digits(text), binary)


def span_blocks(first: Column, last: Column) -> Column:
    """The aligned blocks of a span, as array<struct(bits, plen)>; both ends are 128 binary digits.

    The ends share ``p`` digits. Above the first end, every 0 after those starts a block where it
    becomes a 1; below the last end, every 1 does where it becomes a 0. The 0s at the very end of the
    first and the 1s at the end of the last are one block with their end.
    """
    def shared(a: Column, b: Column) -> Column:
        differ = F.filter(F.sequence(F.lit(1), F.lit(128)),
                          lambda i: a.substr(i, F.lit(1)) != b.substr(i, F.lit(1)))
        return F.coalesce(F.get(differ, F.lit(0)) - 1, F.lit(128))

    def side(end: Column, p: Column, step: str) -> Column:
        # step "1": from the first end upwards; "0": from the last end downwards.
        free, flipped = ("0", "1") if step == "1" else ("1", "0")
        tail = F.least(F.lit(128) - F.length(F.rtrim(end, F.lit(free))), F.lit(127) - p)

        def blocks(tail: Column) -> Column:
            turns = F.filter(F.sequence(F.lit(0), F.lit(127)), lambda j: (j > p) & (
                j < F.lit(128) - tail) & (end.substr(j + 1, F.lit(1)) == free))
            own = F.struct(F.rpad(end.substr(F.lit(1), F.lit(128) - tail), 128, "0").alias("bits"),
                           (F.lit(128) - tail).alias("plen"))
            return F.concat(F.array(own), F.transform(turns, lambda j: F.struct(F.rpad(F.concat(
                end.substr(F.lit(1), j), F.lit(flipped)), 128, "0").alias("bits"), (j + 1).alias("plen"))))

        return let(tail, blocks)

    def both(p: Column) -> Column:
        rest = F.lit(128) - p
        whole = (F.length(F.rtrim(first, F.lit("0"))) <= p) & (
            F.length(F.rtrim(last, F.lit("1"))) <= p)
        one = F.array(F.struct(F.rpad(first, 128, "0").alias("bits"), p.alias("plen")))
        return F.when((rest == 0) | whole, one).otherwise(
            F.concat(side(first, p, "1"), side(last, p, "0")))

    return F.when(first <= last, let(shared(first, last), both))


def bits_network(bits: Column, plen: Column) -> Column:
    """struct(family, hi, lo, plen) of 128 binary digits; a block of mapped addresses is an IPv4 one."""
    mapped = bits.startswith("0" * 80 + "1" * 16) & (plen >= 96)
    hi, lo = (F.conv(F.substring(bits, at, 64), 2, -10).cast("bigint") for at in (1, 65))
    return F.struct(
        F.when(mapped, 4).otherwise(6).alias("family"),
        F.when(mapped, F.lit(0).cast("bigint")).otherwise(hi).alias("hi"),
        F.when(mapped, lo.bitwiseAND(F.lit(0xFFFFFFFF))).otherwise(lo).alias("lo"),
        F.when(mapped, plen - 96).otherwise(plen).alias("plen"))
