"""Small text and number expressions shared by the operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_LONG = 9223372036854775807


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` worked out once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def whole_number(text: Column) -> Column:
    """Decimal text as bigint: 0 when it is no number, the nearest bigint when it is too long."""
    too_long = F.when(text.startswith("-"), F.lit(-MAX_LONG - 1)).otherwise(F.lit(MAX_LONG))
    return F.when(
        text.rlike(r"^[+-]?[0-9]+\z"), F.coalesce(text.try_cast("bigint"), too_long)
    ).otherwise(F.lit(0).cast("bigint"))


def fully_qualified(name: Column) -> Column:
    """The DNS name with its final dot."""
    return F.when(name.endswith("."), name).otherwise(F.concat(name, F.lit(".")))


def bracketed(items: Column) -> Column:
    """A list as ``[a b c]``; a missing list prints as ``[]``."""
    return F.concat(F.lit("["), F.coalesce(F.array_join(items, " "), F.lit("")), F.lit("]"))
