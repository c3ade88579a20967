"""Helpers shared by the training-data operators: grouped Arrow tasks and connected components, beside the tables of scratch."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import partitions, ranked, save, small, temporary

__all__ = ["by_group", "by_groups", "components", "crc_of_id", "mapped", "partitions", "ranked", "save", "small", "temporary"]


#: Rows and bytes that go to Python together. With Spark's own numbers, 10,000 rows of any size, batches of whole texts take hundreds of MB.
BATCH_ROWS, BATCH_BYTES = 512, 32 << 20
LIMITS = {"spark.sql.execution.arrow.maxRecordsPerBatch": BATCH_ROWS, "spark.sql.execution.arrow.maxBytesPerBatch": BATCH_BYTES}


def mapped(df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """df.mapInArrow() with batches of BATCH_ROWS rows and BATCH_BYTES at most (a larger row goes alone). Spark reads these settings when
    a job runs, so the session keeps them; smaller ones that it has stay."""
    session = df.sparkSession.conf
    for name, most in LIMITS.items():
        now = session.get(name).removesuffix("b")
        if not now.isdigit() or not 0 < int(now) <= most:
            session.set(name, most)
    return df.mapInArrow(function, schema)


def by_group(df: DataFrame, keys: list[str], function: Callable[[pa.Table], pa.Table | None], schema: str) -> DataFrame:
    """function on the rows of each distinct keys; many small groups share a task and an Arrow batch, unlike applyInPandas.

    A group's rows are held in memory, so callers bound a group by a block number in keys. keys are not null."""

    def each(table: pa.Table, cuts: list[int]) -> pa.Table | None:
        made = [out for a, b in zip(cuts, cuts[1:], strict=False) if (out := function(table.slice(a, b - a))) is not None and out.num_rows]
        return pa.concat_tables(made) if made else None

    return by_groups(df, keys, each, schema)


def by_groups(df: DataFrame, keys: list[str], function: Callable[[pa.Table, list[int]], pa.Table | None], schema: str) -> DataFrame:
    """As by_group(), with a function that takes some whole groups as one table and where each starts, with the table's end at last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            rest.append(batch)
            if len(rest) > 1 and _key(rest[0], 0, keys) == _key(batch, batch.num_rows - 1, keys):
                continue
            table = pa.Table.from_batches(rest)
            cuts = _cuts(table, keys)
            if len(cuts) > 1 and (out := function(table.slice(0, cuts[-1]), cuts)) is not None:
                yield from out.combine_chunks().to_batches()
            rest = table.slice(cuts[-1]).combine_chunks().to_batches()
        if rest:
            table = pa.Table.from_batches(rest)
            if (out := function(table, [*_cuts(table, keys), table.num_rows])) is not None:
                yield from out.combine_chunks().to_batches()

    dealt = df.repartition(partitions(df.sparkSession), *keys).sortWithinPartitions(*keys)
    return mapped(dealt, run, schema)


def _key(batch: pa.RecordBatch, row: int, keys: list[str]) -> tuple:
    return tuple(batch.column(k)[row].as_py() for k in keys)


def _cuts(table: pa.Table, keys: list[str]) -> list[int]:
    import numpy as np

    new = np.zeros(table.num_rows, bool)
    new[0] = True
    for k in keys:
        v = table.column(k).to_numpy()
        new[1:] |= v[1:] != v[:-1]
    return np.flatnonzero(new).tolist()


def components(edges: DataFrame, rounds: int = 100) -> DataFrame:
    """(node, component): component is the least node that can be reached over edges (a, b), both directions; nodes without edges are absent.

    edges should be a saved table: it is read in every round. Each node has a label, at first the least of its neighbours and itself. In
    a round the two labels of each edge go to its ends and to the nodes that those labels name, each node takes the least, then the
    label of its label; that goes on until no edge has two labels. Labels are saved, never collected: a round costs one aggregation,
    combined before the shuffle, so a hub is no hot key, and joins that broadcast the labels where they are few."""
    edges = edges.where("a is not null and b is not null and a <> b").select("a", "b")
    ends = F.array(F.struct(F.col("a").alias("node"), F.least("a", "b").alias("c")), F.struct(F.col("b").alias("node"), F.least("a", "b").alias("c")))
    labels = save(edges.select(F.inline(ends)).groupBy("node").agg(F.min("c").alias("c")), "labels")
    for _ in range(rounds):
        known = small(labels)
        labels = save(labels.join(known.select(F.col("node").alias("c"), F.col("c").alias("next")), "c").select("node", F.col("next").alias("c")), "labels")
        known = small(labels)
        told = edges.join(known.select(F.col("node").alias("a"), F.col("c").alias("ca")), "a").join(known.select(F.col("node").alias("b"), F.col("c").alias("cb")), "b")
        told = told.where("ca <> cb")
        if not told.limit(1).count():
            return labels.select("node", F.col("c").alias("component"))
        sent = F.array(*(F.struct(F.col(n).alias("node"), F.least("ca", "cb").alias("c")) for n in ("a", "b", "ca", "cb")))
        labels = save(told.select(F.inline(sent)).unionByName(labels).groupBy("node").agg(F.min("c").alias("c")), "labels")
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def crc_of_id(column: str) -> Column:
    return F.crc32(F.col(column).cast("string").cast("binary"))
