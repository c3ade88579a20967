"""Bits of 64-bit integers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def bit_and(a: Column, b: Column) -> Column:
    return a.bitwiseAND(b)


def bit_or(a: Column, b: Column) -> Column:
    return a.bitwiseOR(b)


def bit_xor(a: Column, b: Column) -> Column:
    return a.bitwiseXOR(b)


def left(x: Column, n: int) -> Column:
    return F.shiftleft(x.cast("long"), n)


def right(x: Column, n: int) -> Column:
    """Keeps the sign."""
    return F.shiftright(x.cast("long"), n)


def ones(x: Column) -> Column:
    return F.bit_count(x.cast("long"))


def length(x: Column) -> Column:
    """Bits without leading zeros, 0 for 0."""
    return F.when(x == 0, 0).otherwise(F.length(F.bin(x.cast("long"))))


def leading_zeros(x: Column) -> Column:
    return 64 - length(x)


def trailing_zeros(x: Column) -> Column:
    x = x.cast("long")
    return F.when(x == 0, 64).otherwise(F.length(F.bin(x)) - F.length(F.rtrim(F.bin(x), F.lit("0"))))


def reverse(x: Column) -> Column:
    """All 64 bits in reverse order, as a signed number."""
    return F.conv(F.reverse(F.lpad(F.bin(x.cast("long")), 64, "0")), 2, -10).cast("long")
