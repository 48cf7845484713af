"""Array predicates of the health checks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _strings(items: Column) -> Column:
    return F.coalesce(items, F.array().cast("array<string>"))


def bag_equal(left: Column, right: Column) -> Column:
    """Same elements with the same multiplicity, in any order."""
    return F.array_sort(_strings(left)) == F.array_sort(_strings(right))


def bounded_contains(outer: Column, inner: Column) -> Column:
    """Every element of ``inner`` is in ``outer``, and ``inner`` is not the longer list."""
    outer, inner = _strings(outer), _strings(inner)
    return (F.size(inner) <= F.size(outer)) & (F.size(F.array_except(inner, outer)) == 0)


def either_contains(left: Column, right: Column, compat: bool = True) -> Column:
    """``compat`` looks one way only (right in left); otherwise either list may hold the other."""
    one_way = bounded_contains(left, right)
    return one_way if compat else one_way | bounded_contains(right, left)
