"""Unifying tables and filling in defaults."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def unified(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Records with one key from both sides as one: fields of either, and conflicts, the names of fields in which they differ (null there).

    Keys are distinct on each side; rows with null keys unify with nothing."""
    both = [c for c in left.columns if c in right.columns and c != key]
    a = left.select(key, *(F.col(c).alias(f"__l_{c}") for c in left.columns if c != key))
    b = right.select(key, *(F.col(c).alias(f"__r_{c}") for c in right.columns if c != key))
    joined = a.join(b, key, "full_outer")
    differ = {c: F.coalesce(F.col(f"__l_{c}") != F.col(f"__r_{c}"), F.lit(False)) for c in both}
    columns = [F.col(key)]
    for c in dict.fromkeys([*left.columns, *right.columns]):
        if c in both:
            columns.append(F.when(~differ[c], F.coalesce(f"__l_{c}", f"__r_{c}")).alias(c))
        elif c != key:
            columns.append(F.col(f"__l_{c}" if c in left.columns else f"__r_{c}").alias(c))
    names = F.array_compact(F.array(*(F.when(d, F.lit(c)) for c, d in differ.items()))) if both else F.array().cast("array<string>")
    return joined.select(*columns, names.alias("conflicts"))


def with_defaults(df: DataFrame, defaults: Mapping[str, Column | tuple[Column, list[str]]]) -> DataFrame:
    """Fields that are absent get their default. A default (column, names) uses those fields, which have theirs by then.

    ValueError if defaults need each other."""
    left = {n: d if isinstance(d, tuple) else (d, []) for n, d in defaults.items()}
    while left:
        ready = {n: d for n, (d, needs) in left.items() if not set(needs) & set(left) - {n}}
        if not ready:
            raise ValueError(f"defaults need each other: {sorted(left)}")
        df = df.withColumns({n: F.coalesce(F.col(n), d) if n in df.columns else d for n, d in ready.items()})
        left = {n: d for n, d in left.items() if n not in ready}
    return df
