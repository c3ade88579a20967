"""Comprehensions as DataFrame operations: for, if and let clauses, nested sources, lookups, conditional and computed fields.

A list is a DataFrame or an array column, a record a row or a map. Guards must be true or false: where one is null, the row is not
dropped silently but kept apart, see guard()."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import ranked


def comprehension(source: DataFrame, yields: Mapping[str, Column], where: Column | None = None, let: Mapping[str, Column] | None = None) -> DataFrame:
    """[for x in source, let a = ..., if where, {yields}]: each let may use the ones before it."""
    for name, value in (let or {}).items():
        source = source.withColumn(name, value)
    if where is not None:
        source = source.where(where)
    return source.select(*(v.alias(k) for k, v in yields.items()))


def guard(source: DataFrame, where: Column) -> tuple[DataFrame, DataFrame]:
    """(rows where the guard is true, rows where it is undecided): a null guard is incomplete, not false."""
    return source.where(where), source.where(where.isNull())


def indexed(source: DataFrame, order: list[Column], name: str = "i") -> DataFrame:
    """for i, x in source: i counts from 0 in that order."""
    return ranked(source, order, name)


def elements(source: DataFrame, array: str, name: str = "x", index: str | None = None) -> DataFrame:
    """for row in source, for index, x in row.array: rows whose array is null or empty give nothing."""
    if index:
        return source.select("*", F.posexplode(array).alias(index, name))
    return source.select("*", F.explode(array).alias(name))


def members(source: DataFrame, columns: list[str], key: str = "k", value: str = "v", keep: list[str] | None = None) -> DataFrame:
    """for row in source, for k, v in row: a row for each of the columns that is set; the columns have one type."""
    ids = keep if keep is not None else [c for c in source.columns if c not in columns]
    return source.unpivot(ids, columns, key, value).where(F.col(value).isNotNull())


def entries(source: DataFrame, column: str, key: str = "k", value: str = "v") -> DataFrame:
    """for row in source, for k, v in row.column, a map."""
    return source.select("*", F.explode(column).alias(key, value))


def nested(left: DataFrame, right: DataFrame, where: Column) -> DataFrame:
    """for a in left, for b in right, if where: a join on the guard, whose strategy Spark chooses from its equalities."""
    return left.join(right, where, "inner")


def every_pair(left: DataFrame, right: DataFrame, most: int = 1_000_000) -> DataFrame:
    """for a in left, for b in right, without a guard. ValueError where the result would have more than `most` rows."""
    if left.count() * right.count() > most:
        raise ValueError(f"more than {most} pairs: add a guard")
    return left.join(right)


def having(left: DataFrame, right: DataFrame, on: Column | list[str]) -> DataFrame:
    """if some b in right fits."""
    return left.join(right, on, "left_semi")


def lacking(left: DataFrame, right: DataFrame, on: Column | list[str]) -> DataFrame:
    """if no b in right fits."""
    return left.join(right, on, "left_anti")


def with_or_without(left: DataFrame, right: DataFrame, on: Column | list[str]) -> DataFrame:
    """Each a with every fitting b, or alone."""
    return left.join(right, on, "left")


def lookup(source: DataFrame, table: DataFrame, key: str, table_key: str, value: str, name: str) -> DataFrame:
    """table[row.key] as name, and name + "_missing" where the table lacks a key that the row has. The table's keys are distinct."""
    table = table.select(F.col(table_key).alias("__key"), F.col(value).alias(name), F.lit(True).alias("__found"))
    joined = source.join(table, source[key] == table["__key"], "left")
    return joined.withColumn(f"{name}_missing", F.col("__found").isNull() & F.col(key).isNotNull()).drop("__key", "__found")


def labelled(source: DataFrame, label: Column, value: Column, key_name: str = "label", value_name: str = "value") -> DataFrame:
    """{for x in source {(label): value}}: rows that share a label must agree; value is null and conflict true where they don't.

    Null labels are left out, for a label must be text."""
    rows = source.select(label.alias(key_name), value.alias("__v")).where(F.col(key_name).isNotNull())
    out = rows.groupBy(key_name).agg(F.min("__v").alias("__a"), F.max("__v").alias("__b"))
    conflict = F.coalesce(F.col("__a") != F.col("__b"), F.lit(False))
    return out.select(key_name, F.when(~conflict, F.col("__a")).alias(value_name), conflict.alias("conflict"))


def conditional(condition: Column, value: Column) -> Column:
    """if condition {field: value}: a field that is absent elsewhere."""
    return F.when(condition, value)


def exists(value: Column) -> Column:
    return value.isNotNull()
