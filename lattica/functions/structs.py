"""Records: maps, or structs whose null members are absent."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def n_fields(c: Column, names: list[str] | None = None) -> Column:
    """Entries of a map, or members of a struct with these names that are set."""
    if names is None:
        return F.size(F.map_keys(c))
    return reduce(lambda a, b: a + b, [c[n].isNotNull().cast("int") for n in names], F.lit(0))


def min_fields(c: Column, n: int, names: list[str] | None = None) -> Column:
    return n_fields(c, names) >= n


def max_fields(c: Column, n: int, names: list[str] | None = None) -> Column:
    return n_fields(c, names) <= n
