"""Lists as tables: folds, groups, order, cuts and set operations, without a task that holds a whole list."""

from __future__ import annotations

import math
from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import ranked, save

#: Rows of a group that one task takes in order; larger groups are cut into runs of that many.
TOGETHER = 10_000_000

#: Pairs of points and ranges in a cell that one task compares; more are cut into blocks of about that many.
PAIRS = 10_000_000
#: Tasks of a range join at most; beyond that each compares more pairs.
MOST_TASKS = 20_000
BLOCK = ["__cell", "__block_p", "__block_r"]


def total(c: Column) -> Column:
    return F.coalesce(F.sum(c), F.lit(0))


def product(c: Column) -> Column:
    return F.coalesce(F.product(c), F.lit(1.0))


def average(c: Column) -> Column:
    return F.coalesce(F.avg(c), F.lit(0.0))


def distinct_about(c: Column, error: float = 0.02) -> Column:
    """About how many distinct values; the state of each task is a few KB, however many there are."""
    return F.approx_count_distinct(c, error)


def quantile_about(c: Column, share: float, accuracy: int = 10_000) -> Column:
    """A value whose rank is within 1 / accuracy of the share."""
    return F.approx_percentile(c, F.lit(share), F.lit(accuracy))


def grouped(source: DataFrame, by: list[str], folds: Mapping[str, Column]) -> DataFrame:
    """A record of folds for each distinct key."""
    return source.groupBy(*by).agg(*(f.alias(name) for name, f in folds.items()))


def distinct(source: DataFrame, columns: list[str], order: list[Column] | None = None) -> DataFrame:
    """Rows with distinct values of the columns; with an order, the first of each such."""
    if order is None:
        return source.select(*columns).distinct()
    first = F.struct(*(o.alias(f"__{i}") for i, o in enumerate(order)), *(F.col(c) for c in source.columns))
    rest = [c for c in source.columns if c not in columns]
    best = source.groupBy(*columns).agg(F.min(first).alias("__first"))
    return best.select(*columns, *(F.col(f"__first.{c}").alias(c) for c in rest))


def collected(source: DataFrame, by: list[str], value: str, order: str, name: str) -> DataFrame:
    """An array of the values of each group, in order. Groups must fit into a row."""
    pairs = F.array_sort(F.collect_list(F.struct(order, value)))
    return source.groupBy(*by).agg(F.transform(pairs, lambda p: p[value]).alias(name))


def unique(source: DataFrame, columns: list[str]) -> DataFrame:
    """Values of the columns that occur more than once, with n; empty if all are unique."""
    return source.groupBy(*columns).agg(F.count("*").alias("n")).where("n > 1")


def take(source: DataFrame, order: list[Column], n: int) -> DataFrame:
    return source.orderBy(*order).limit(n)


def drop(source: DataFrame, order: list[Column], n: int) -> DataFrame:
    return ranked(source, order, "__i").where(F.col("__i") >= n).drop("__i")


def cut(source: DataFrame, order: list[Column], low: int, high: int) -> DataFrame:
    return ranked(source, order, "__i").where((F.col("__i") >= low) & (F.col("__i") < high)).drop("__i")


def chunks(source: DataFrame, order: list[Column], n: int, name: str = "chunk") -> DataFrame:
    """The number of the run of n rows that each row is in."""
    return ranked(source, order, "__i").withColumn(name, F.floor(F.col("__i") / n)).drop("__i")


def zipped(left: DataFrame, right: DataFrame, left_order: list[Column], right_order: list[Column]) -> DataFrame:
    """Rows with equal places in their orders side by side, up to the shorter one's end."""
    return ranked(left, left_order, "__i").join(ranked(right, right_order, "__i"), "__i").drop("__i")


def is_sorted(source: DataFrame, order: list[Column], value: str, run: int = 10_000) -> DataFrame:
    """One row with is_sorted: whether no value is greater than the next. Runs are looked at in tasks, their ends in a small table."""
    rows = ranked(source, order, "__i").select(F.floor(F.col("__i") / run).alias("r"), "__i", F.col(value).alias("v"))
    after = Window.partitionBy("r").orderBy("__i")
    within = rows.withColumn("ok", F.coalesce(F.col("v") <= F.lead("v").over(after), F.lit(True)))
    runs = within.groupBy("r").agg(F.bool_and("ok").alias("ok"), F.min_by("v", "__i").alias("first"), F.max_by("v", "__i").alias("last"))
    runs = runs.withColumn("ok", F.col("ok") & F.coalesce(F.col("last") <= F.lead("first").over(Window.orderBy("r")), F.lit(True)))
    return runs.agg(F.coalesce(F.bool_and("ok"), F.lit(True)).alias("is_sorted"))


def union_all(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def union_distinct(*parts: DataFrame) -> DataFrame:
    return union_all(*parts).distinct()


def common(left: DataFrame, right: DataFrame) -> DataFrame:
    """Distinct rows of both."""
    return left.intersect(right)


def without(left: DataFrame, right: DataFrame) -> DataFrame:
    """Distinct rows of left that right lacks."""
    return left.subtract(right)


def repeated(source: DataFrame, n: int) -> DataFrame:
    return source.withColumn("__n", F.explode(F.array_repeat(F.lit(0), n))).drop("__n")


def _hot(rows: DataFrame, by: list[str], together: int) -> tuple[DataFrame, DataFrame | None]:
    """(rows of groups of at most `together` rows, those of larger groups or None). Nulls are a group. Only keys are read for that, and
    there are at most as many large groups as runs of `together` rows in the input, so their keys are broadcast."""
    if rows.count() <= together:  # no group can have more; of files this reads counts only
        return rows, None
    keys = [F.col(b).alias(f"__k{i}") for i, b in enumerate(by)]
    large = rows.groupBy(*keys).agg(F.count("*").alias("__n")).where(F.col("__n") > together).drop("__n")
    if not large.limit(1).count():
        return rows, None
    if not by:
        return rows.limit(0), rows
    large = F.broadcast(save(large, "large"))
    same = reduce(lambda a, b: a & b, [F.col(b).eqNullSafe(F.col(f"__k{i}")) for i, b in enumerate(by)])
    return rows.join(large, same, "left_anti"), rows.join(large, same, "left_semi")


def ranks(source: DataFrame, by: list[str], order: list[Column], name: str = "rank", together: int = TOGETHER) -> DataFrame:
    """The place from 1 in the order of the row's group; rows equal in the order get places next to each other, in any order.

    Null keys are a group. A group of more than `together` rows is ranked by ranges of its order, in as many tasks as it needs."""
    rows, large = _hot(source, by, together)
    out = rows.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    if large is None:
        return out
    placed = save(ranked(large, [*map(F.col, by), *order], "__i"), "ranked")
    first = placed.groupBy(*(F.col(b).alias(f"__k{i}") for i, b in enumerate(by))).agg(F.min("__i").alias("__first"))
    same = reduce(lambda a, b: a & b, [F.col(b).eqNullSafe(F.col(f"__k{i}")) for i, b in enumerate(by)], F.lit(True))
    placed = placed.join(F.broadcast(first), same).withColumn(name, (F.col("__i") - F.col("__first") + 1).cast("int"))
    return out.unionByName(placed.select(*out.columns))


def moving(source: DataFrame, by: list[str], order: list[Column], fold: Column, before: int, name: str, together: int = TOGETHER) -> DataFrame:
    """The fold over each row and the `before` rows ahead of it in its group. Null keys are a group.

    A group of more than `together` rows is cut into runs of that many (or of `before`, if that is more), each with a copy of the last
    `before` rows of the run ahead of it."""
    rows, large = _hot(source, by, together)
    over = lambda *keys: Window.partitionBy(*keys, *by).rowsBetween(-before, 0)
    out = rows.withColumn(name, fold.over(over().orderBy(*order)))
    if large is None:
        return out
    run = max(together, before, 1)
    placed = ranked(large, [*map(F.col, by), *order], "__i").withColumn("__own", F.floor(F.col("__i") / run))
    ahead = F.when(F.col("__i") % run >= run - before, F.array("__own", F.col("__own") + 1)).otherwise(F.array("__own"))
    placed = placed.withColumn("__run", F.explode(ahead)).withColumn(name, fold.over(over("__run").orderBy("__i")))
    return out.unionByName(placed.where("__run = __own").select(*out.columns))


def rolled_up(source: DataFrame, by: list[str], folds: Mapping[str, Column]) -> DataFrame:
    """Folds for each key, each shorter run of its parts, and all rows; level counts the parts that are left out."""
    return source.rollup(*by).agg(*(f.alias(n) for n, f in folds.items()), F.grouping_id().alias("level"))


def as_of(left: DataFrame, right: DataFrame, by: list[str], time: str, values: list[str], together: int = TOGETHER) -> DataFrame:
    """left with the values of right's last row, in its group, that is not later; of rows at one time any. Null keys are a group, and null
    times the earliest. One shuffle by group and a window; no pairs.

    A group of more than `together` rows is cut into runs of that many, and what the runs ahead have seen last is handed on to each."""
    a = left.select(*left.columns, *(F.lit(None).cast(right.schema[v].dataType).alias(f"__{v}") for v in values), F.lit(1).alias("__side"))
    b = right.select(*by, time, *(F.col(v).alias(f"__{v}") for v in values), F.lit(0).alias("__side"))
    rows, large = _hot(b.unionByName(a, allowMissingColumns=True), by, together)
    told = F.when(F.col("__side") == 0, F.struct(*(F.col(f"__{v}").alias(v) for v in values)))
    seen = lambda *keys: F.last(told, ignorenulls=True).over(Window.partitionBy(*keys, *by).orderBy(*(["__i"] if keys else [time, "__side"])).rowsBetween(Window.unboundedPreceding, 0))
    answer = lambda rows: rows.where("__side = 1").select(*left.columns, *(F.col(f"__seen.{v}").alias(v) for v in values))
    out = answer(rows.withColumn("__seen", seen()))
    if large is None:
        return out
    placed = save(ranked(large, [*map(F.col, by), F.col(time), F.col("__side")], "__i").withColumn("__run", F.floor(F.col("__i") / together)), "runs")
    # One row for each run of each large group: about twice as many as there are runs at most.
    keys = [F.col(x).alias(f"__k{i}") for i, x in enumerate(["__run", *by])]
    ends = placed.groupBy(*keys).agg(F.max_by(told, F.when(F.col("__side") == 0, F.col("__i"))).alias("__end"))
    ahead = Window.partitionBy(*(f"__k{i + 1}" for i in range(len(by)))).orderBy("__k0").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumn("__ahead", F.last("__end", ignorenulls=True).over(ahead)).drop("__end")
    same = reduce(lambda a, b: a & b, [F.col(x).eqNullSafe(F.col(f"__k{i}")) for i, x in enumerate(["__run", *by])])
    placed = placed.withColumn("__seen", seen("__run")).join(F.broadcast(ends), same)
    return out.unionByName(answer(placed.withColumn("__seen", F.coalesce("__seen", "__ahead"))))


def in_range(points: DataFrame, ranges: DataFrame, at: str, low: str, high: str, width: float, pairs: int = PAIRS) -> DataFrame:
    """Pairs with low <= at < high: an equality join on cells of `width`, of which each range covers some. Pick a width near the usual range's.

    Cells are counted first. Where they hold more than `pairs` pairs in all, the points and the ranges of a cell are dealt into blocks whose
    sides are the square root of that, and each two blocks that meet are a key of the join: there are about as many tasks as `pairs` go into
    all pairs, whatever few cells these are in."""
    celled = lambda points: points.withColumn("__cell", F.floor(F.col(at) / width))
    cells = F.sequence(F.floor(F.col(low) / width), F.floor(F.col(high) / width))
    spread = lambda ranges: ranges.where(F.col(low) < F.col(high)).withColumn("__cell", F.explode(cells))
    within = (F.col(at) >= F.col(low)) & (F.col(at) < F.col(high))
    counts = lambda rows, name: rows.groupBy("__cell").agg(F.count("*").alias(name))
    sizes = counts(celled(points), "__p").join(counts(spread(ranges), "__r"), "__cell")
    every = sizes.agg(F.sum(F.col("__p").cast("double") * F.col("__r"))).first()[0] or 0
    if every <= pairs:
        return celled(points).join(spread(ranges), "__cell").where(within).drop("__cell")
    side, tasks = math.isqrt(pairs), min(math.ceil(every / pairs), MOST_TASKS)
    # Numbers that deal the rows must stay when a task is run again, so they are saved with them.
    points, ranges = (save(x.withColumn("__deal", F.xxhash64(F.monotonically_increasing_id())), "dealt") for x in (points, ranges))
    blocks = lambda n: F.ceil(F.col(n) / side)
    # A cell that is cut has more rows than a side, so there are fewer of these than rows by that factor.
    cut = sizes.select("__cell", blocks("__p").alias("__np"), blocks("__r").alias("__nr")).where("__np > 1 OR __nr > 1")
    cut = F.broadcast(save(cut, "cells"))

    def dealt(rows: DataFrame, own: str, other: str) -> DataFrame:
        n = lambda side: F.coalesce(F.col(f"__n{side}"), F.lit(1))
        rows = rows.join(cut, "__cell", "left").withColumn(f"__block_{own}", F.pmod("__deal", n(own)))
        rows = rows.withColumn(f"__block_{other}", F.explode(F.sequence(F.lit(0).cast("long"), n(other) - 1)))
        return rows.drop("__np", "__nr", "__deal").repartition(tasks, *BLOCK)

    return dealt(celled(points), "p", "r").join(dealt(spread(ranges), "r", "p"), BLOCK).where(within).drop(*BLOCK)
