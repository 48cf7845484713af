"""SVCB/HTTPS wire data (hex text) decoded with native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from zonescope import constants as C
from zonescope.functions.ip import ipv6_text
from zonescope.functions.text import let

PARAMS = "array<struct<key:int,value:binary>>"


def clean_hex(text: Column) -> Column:
    """Only the hex digits."""
    return F.regexp_replace(text, "[^0-9a-fA-F]", "")


def even_hex(digits: Column) -> Column:
    """A last half byte is filled up with a zero."""
    return F.when(F.length(digits) % 2 == 1, F.concat(digits, F.lit("0"))).otherwise(digits)


def _uint(data: Column, offset: Column, width: int) -> Column:
    return F.conv(F.hex(data.substr(offset + 1, F.lit(width))), 16, 10).cast("int")


def _text(data: Column, offset: Column, length: Column) -> Column:
    return data.substr(offset + 1, length).cast("string")


def priority(data: Column) -> Column:
    return F.when(F.length(data) >= 2, _uint(data, F.lit(0), 2))


def target(data: Column) -> Column:
    """struct(name, next) of the target name that starts at byte 2.

    Root, a pointer and a cut label all read as ``.``; ``next`` is where the params start.
    """
    size = F.length(data)
    first = _uint(data, F.lit(2), 1)

    def step(state: Column, _: Column) -> Column:
        at = state["at"]
        length = _uint(data, at, 1)
        body = at + 1

        def to(at: Column, labels: Column, mode: str) -> Column:
            return F.struct(at.alias("at"), labels.alias("labels"), F.lit(mode).alias("mode"))

        return (
            F.when((state["mode"] != "label") | (at >= size), state)
            .when(length == 0, to(body, state["labels"], "end"))
            .when(length >= 192, to(F.least(body + 1, size), state["labels"], "root"))
            .when(body + length > size, to(body, state["labels"], "root"))
            .otherwise(
                to(body + length,
                   F.concat(state["labels"], F.array(_text(data, body, length))), "label")
            )
        )

    start = F.struct(
        F.lit(2).alias("at"), F.array().cast("array<string>").alias("labels"),
        F.lit("label").alias("mode"),
    )
    # A label takes two bytes or more, so this many steps always reach the end.
    walked = F.aggregate(F.sequence(F.lit(0), F.floor(size / 2).cast("int")), start, step)
    name = F.when(
        (walked["mode"] == "root") | (F.size(walked["labels"]) == 0), F.lit(".")
    ).otherwise(F.array_join(walked["labels"], "."))
    return (
        F.when(size <= 2, F.struct(F.lit(".").alias("name"), F.lit(2).alias("next")))
        .when(first == 0, F.struct(F.lit(".").alias("name"), F.lit(3).alias("next")))
        .when(size > 2, F.struct(name.alias("name"), walked["at"].alias("next")))
    )


def params(data: Column, begin: Column) -> Column:
    """array<struct(key, value)> of the params from byte ``begin``, up to the first cut one."""
    size = F.length(data)

    def step(state: Column, _: Column) -> Column:
        at = state["at"]
        length = _uint(data, at + 2, 2)
        whole = (at + 4 <= size) & (at + 4 + length <= size)
        item = F.struct(
            _uint(data, at, 2).alias("key"), data.substr(at + 5, length).alias("value")
        )
        return F.when(
            state["open"] & whole,
            F.struct((at + 4 + length).alias("at"), F.lit(True).alias("open"),
                     F.concat(state["items"], F.array(item)).alias("items")),
        ).otherwise(
            F.struct(at.alias("at"), F.lit(False).alias("open"), state["items"].alias("items"))
        )

    start = F.struct(
        begin.alias("at"), F.lit(True).alias("open"), F.array().cast(PARAMS).alias("items")
    )
    # A param takes four bytes or more.
    steps = F.floor((size - begin) / 4).cast("int")
    return F.when(steps < 1, F.array().cast(PARAMS)).otherwise(
        F.aggregate(F.sequence(F.lit(1), steps), start, step, lambda s: s["items"])
    )


def _alpn(value: Column) -> Column:
    """struct(items, cut): the length-prefixed strings; ``cut`` when one overran the value."""
    size = F.length(value)

    def step(state: Column, _: Column) -> Column:
        at = state["at"]
        length = _uint(value, at, 1)
        fits = at + 1 + length <= size
        return F.when(
            at < size,
            F.struct(
                F.when(fits, at + 1 + length).otherwise(at + 1).alias("at"),
                F.when(fits, F.concat(state["items"], F.array(_text(value, at + 1, length))))
                .otherwise(state["items"]).alias("items"),
                (state["cut"] | ~fits).alias("cut"),
            ),
        ).otherwise(state)

    start = F.struct(
        F.lit(0).alias("at"), F.array().cast("array<string>").alias("items"),
        F.lit(False).alias("cut"),
    )
    return F.aggregate(F.sequence(F.lit(0), size), start, step)


def _chunks(value: Column, width: int, text) -> Column:
    """The value cut in pieces of ``width`` bytes, each as text, joined with commas."""
    count = F.floor(F.length(value) / width).cast("int")
    pieces = F.transform(
        F.sequence(F.lit(0), F.greatest(count - 1, F.lit(0))),
        lambda i: text(F.hex(value.substr(i * width + 1, F.lit(width)))),
    )
    return F.when(count == 0, F.lit("")).otherwise(F.array_join(pieces, ","))


def _ipv4(digits: Column) -> Column:
    return F.concat_ws(
        ".", *(F.conv(F.substring(digits, 2 * i + 1, 2), 16, 10) for i in range(4))
    )


def _quoted(name: str, value: Column) -> Column:
    return F.concat(F.lit(f'{name}="'), value, F.lit('"'))


def param_text(key: Column, value: Column) -> Column:
    """A param as shown in reports, NULL when it is left out."""
    size = F.length(value)
    hexed = F.hex(value)

    def alpn(list_: Column) -> Column:
        return F.when(
            F.size(list_["items"]) > 0, _quoted("alpn", F.array_join(list_["items"], ",")))

    return (
        F.when(key == 1, let(_alpn(value), alpn))
        .when(key == 4, F.when(size % 4 == 0, _quoted("ipv4hint", _chunks(value, 4, _ipv4))))
        .when(key == 6, F.when(size % 16 == 0, _quoted("ipv6hint", _chunks(value, 16, ipv6_text))))
        .when(key == 5, F.when(size > 0, F.concat(F.lit("echconfig=0x"), hexed)))
        .when(size <= 256, F.concat(F.lit("key"), key.cast("string"), F.lit("=0x"), hexed))
    )


def strict_text(key: Column, value: Column) -> Column:
    """A param in its strict form, NULL when it breaks a rule (see ``violation``)."""
    size = F.length(value)
    hexed = F.hex(value)

    def alpn(list_: Column) -> Column:
        return F.when(~list_["cut"], _quoted("alpn", F.array_join(list_["items"], ",")))

    return (
        F.when(key == 0, F.concat(F.lit("reserved=0x"), hexed))
        .when(key == 1, let(_alpn(value), alpn))
        .when(key == 4, F.when(size % 4 == 0, _quoted("ipv4hint", _chunks(value, 4, _ipv4))))
        .when(key == 6, F.when(size % 16 == 0, _quoted("ipv6hint", _chunks(value, 16, ipv6_text))))
        .otherwise(F.concat(F.format_string("key=0x%04X, value=0x", key), hexed))
    )


def violation(key: Column, value: Column) -> Column:
    """The rule a param breaks, NULL when it is fine."""
    size = F.length(value)
    return (
        F.when((key == 1) & _alpn(value)["cut"], F.lit(C.BAD_ALPN))
        .when((key == 4) & (size % 4 != 0), F.lit(C.BAD_IPV4HINT))
        .when((key == 6) & (size % 16 != 0), F.lit(C.BAD_IPV6HINT))
    )


def readable(priority: Column, target: Column, params: Column) -> Column:
    """``SVCB(priority=…, target=…, params=[…])``, params in wire order."""
    shown = F.filter(
        F.transform(params, lambda p: param_text(p["key"], p["value"])), lambda t: t.isNotNull()
    )
    return F.concat(
        F.lit("SVCB(priority="), priority.cast("string"), F.lit(", target="), target,
        F.lit(", params=["), F.array_join(shown, ", "), F.lit("])"),
    )
