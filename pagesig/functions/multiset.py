"""Multiset column functions. A multiset column is array<struct<value, cnt>> sorted by value."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def expand(ms: Column, value: str = "value", cnt: str = "cnt") -> Column:
    """multiplicity -> repeated list, in multiset order."""
    return F.flatten(F.transform(ms, lambda s: F.array_repeat(s[value], s[cnt].cast("int"))))


def serialize(ms: Column, value: str = "value", cnt: str = "cnt") -> Column:
    """Elements sorted by value, each repeated by its count, concatenated."""
    ordered = F.array_sort(ms)
    return F.array_join(expand(ordered, value, cnt), "")
