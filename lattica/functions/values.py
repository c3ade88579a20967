"""Values of any kind: selection in documents, equality by content, arithmetic that never overflows silently."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def at(document: Column, path: str, kind: str) -> Column:
    """The value at a path such as $.a.b[0] of a variant, as that type; null if there is none or it is of another kind."""
    return F.try_variant_get(document, path, kind)


def is_null_value(document: Column) -> Column:
    """Whether a variant is the null value, which is not the same as an absent one."""
    return F.is_variant_null(document)


def add(x: Column, y: Column) -> Column:
    """Null where the sum is beyond 64 bits; so are the next two."""
    return F.try_add(x, y)


def subtract(x: Column, y: Column) -> Column:
    return F.try_subtract(x, y)


def multiply(x: Column, y: Column) -> Column:
    return F.try_multiply(x, y)


def positive(x: Column, kind: T.DataType) -> Column:
    """+x; TypeError unless the column is of numbers."""
    if not isinstance(kind, T.NumericType):
        raise TypeError(f"+ needs a number, not {kind.simpleString()}")
    return x


def negative(x: Column, kind: T.DataType) -> Column:
    """-x; null where that is beyond the column's type. TypeError unless the column is of numbers."""
    return F.try_subtract(F.lit(0).cast(kind), positive(x, kind))


def inverse(x: Column, kind: T.DataType) -> Column:
    """!x; TypeError unless the column is of truth values."""
    if not isinstance(kind, T.BooleanType):
        raise TypeError(f"! needs a truth value, not {kind.simpleString()}")
    return ~x


def equal(a: Column, b: Column, left: T.DataType, right: T.DataType) -> Column:
    """Equality by content: numbers of different types by value, arrays in order, structs by the names of their set fields in any
    order; values of different kinds differ. Two absent values are equal."""
    if isinstance(left, T.StructType) and isinstance(right, T.StructType):
        own, other = {f.name: f.dataType for f in left}, {f.name: f.dataType for f in right}
        tests = [equal(a[n], b[n], own[n], other[n]) for n in own if n in other]
        tests += [a[n].isNull() for n in own if n not in other] + [b[n].isNull() for n in other if n not in own]
        both = reduce(lambda x, y: x & y, tests, F.lit(True))
        return F.when(a.isNull() | b.isNull(), a.isNull() & b.isNull()).otherwise(both)
    if isinstance(left, T.ArrayType) and isinstance(right, T.ArrayType):
        each = F.forall(F.transform(a, lambda x, i: equal(x, F.get(b, i), left.elementType, right.elementType)), lambda t: t)
        return F.when(a.isNull() | b.isNull(), a.isNull() & b.isNull()).otherwise((F.size(a) == F.size(b)) & each)
    if left == right or (isinstance(left, T.NumericType) and isinstance(right, T.NumericType)):
        return a.eqNullSafe(b)
    return a.isNull() & b.isNull()
