"""Arrays. Negative bounds are errors in the caller's code and raise ValueError; bounds beyond the end are clamped."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Elements that repeat() makes at most; longer results are null.
MOST_ELEMENTS = 1_000_000


def _bound(*values: int) -> None:
    if min(values) < 0:
        raise ValueError("a bound is negative")


def min_items(c: Column, n: int) -> Column:
    return F.size(c) >= n


def max_items(c: Column, n: int) -> Column:
    return F.size(c) <= n


def unique_items(c: Column) -> Column:
    return F.size(F.array_distinct(c)) == F.size(c)


def match_n(c: Column, count: Callable[[Column], Column], test: Callable[[Column], Column]) -> Column:
    """Whether the number of elements that pass the test passes count."""
    return count(F.size(F.filter(c, lambda x: F.coalesce(test(x), F.lit(False)))))


def contains(c: Column, value: Column) -> Column:
    return F.coalesce(F.array_contains(c, value), F.when(c.isNotNull(), F.lit(False)))


def numbers(start: Column, end: Column, step: int = 1) -> Column:
    """From start on by step, without end; empty if end is not ahead."""
    if step == 0:
        raise ValueError("step is 0")
    ahead = start < end if step > 0 else start > end
    return F.when(ahead, F.sequence(start, end - (1 if step > 0 else -1), F.lit(step))).otherwise(F.array().cast("array<int>"))


def take(c: Column, n: int) -> Column:
    _bound(n)
    return F.slice(c, 1, n)


def drop(c: Column, n: int) -> Column:
    _bound(n)
    return F.slice(c, F.lit(n + 1), F.greatest(F.size(c) - n, F.lit(0)))


def cut(c: Column, low: int, high: int) -> Column:
    _bound(low, high)
    return F.slice(c, low + 1, max(0, high - low))


def slice_strict(c: Column, low: int, high: int) -> Column:
    """As cut(), but null where a bound is beyond the end."""
    _bound(low, high - low)
    return F.when(F.size(c) >= high, cut(c, low, high))


def item(c: Column, i: int) -> Column:
    """Null beyond the end."""
    _bound(i)
    return F.get(c, F.lit(i))


def sort(c: Column, less: Callable[[Column, Column], Column] | None = None) -> Column:
    """Ascending, or by less(a, b)."""
    return F.array_sort(c) if less is None else F.array_sort(c, lambda a, b: F.when(less(a, b), -1).when(less(b, a), 1).otherwise(0))


def is_sorted(c: Column) -> Column:
    return c == F.array_sort(c)


def reverse(c: Column) -> Column:
    return F.reverse(c)


def compact(c: Column) -> Column:
    return F.array_compact(c)


def chunk(c: Column, n: int) -> Column:
    """Runs of n elements; the last may be shorter."""
    _bound(n - 1)
    starts = F.when(F.size(c) > 0, F.sequence(F.lit(1), F.size(c), F.lit(n))).when(c.isNotNull(), F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.slice(c, i, F.lit(n)))


def distinct(c: Column) -> Column:
    return F.array_distinct(c)


def pair(a: Column, b: Column) -> Column:
    """[[a0, b0], ...] up to the shorter one's end."""
    return F.transform(F.slice(a, F.lit(1), F.least(F.size(a), F.size(b))), lambda x, i: F.array(x, F.get(b, i)))


def unpair(c: Column) -> Column:
    """[[first ...], [second ...]] of the elements that have two."""
    c = F.filter(c, lambda x: F.size(x) >= 2)
    return F.array(F.transform(c, lambda x: x[0]), F.transform(c, lambda x: x[1]))


def flatten_n(c: Column, depth: int) -> Column:
    """depth levels taken out of arrays that have as many."""
    for _ in range(depth):
        c = F.flatten(c)
    return c


def flatten(c: Column, kind: T.DataType) -> Column:
    """All levels; kind is the column's type."""
    while isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.ArrayType):
        c, kind = F.flatten(c), kind.elementType
    return c


def concat(*lists: Column) -> Column:
    return F.concat(*lists)


def repeat(c: Column, n: int) -> Column:
    _bound(n)
    return F.when(F.size(c) * n <= MOST_ELEMENTS, F.flatten(F.array_repeat(c, n)))


def total(c: Column, kind: str = "long") -> Column:
    """0 of none."""
    return F.aggregate(c, F.lit(0).cast(kind), lambda a, x: a + x)


def product(c: Column, kind: str = "long") -> Column:
    """1 of none."""
    return F.aggregate(c, F.lit(1).cast(kind), lambda a, x: a * x)


def average(c: Column) -> Column:
    """0 of none."""
    return F.when(F.size(c) == 0, 0.0).otherwise(total(c, "double") / F.size(c))


def least(c: Column) -> Column:
    return F.array_min(c)


def greatest(c: Column) -> Column:
    return F.array_max(c)
