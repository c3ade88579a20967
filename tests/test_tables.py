"""Groups that are cut into runs give what one window over the group gives."""

import pytest
from pyspark.sql import functions as F

from lattica.operators import tables as L

c = F.col
SCHEMA = "k string, t int, id int, v double"
ROWS = [(None if i % 10 == 3 else "hot" if i % 3 else f"k{i % 7}", None if i == 50 else i * 37 % 101, i, float(i % 13)) for i in range(400)]


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("together", [7, 60])
@pytest.mark.parametrize("by", [["k"], []])
def test_ranks_and_moving_of_large_groups(spark, together, by):
    df = spark.createDataFrame(ROWS, SCHEMA)
    order = [c("t"), c("id")]
    assert rows_of(L.ranks(df, by, order, together=together)) == rows_of(L.ranks(df, by, order))
    for before in (0, 2, 9):
        assert rows_of(L.moving(df, by, order, F.sum("v"), before, "m", together)) == rows_of(L.moving(df, by, order, F.sum("v"), before, "m"))


@pytest.mark.parametrize("together", [1, 60])
def test_as_of_of_large_groups(spark, together):
    left = spark.createDataFrame([r[:3] for r in ROWS], "k string, t int, id int")
    right = spark.createDataFrame([(k, t, i) for k, t, i, _ in ROWS[::3] if t is not None], "k string, t int, w int").dropDuplicates(["k", "t"])
    right = right.unionByName(spark.createDataFrame([("hot", 40, None)], right.schema)).dropDuplicates(["k", "t"])
    want = rows_of(L.as_of(left, right, ["k"], "t", ["w"]))
    assert len(want) == len(ROWS) and any(r[-1] is not None for r in want)
    assert rows_of(L.as_of(left, right, ["k"], "t", ["w"], together)) == want


def test_equal_rows_and_empty_tables(spark):
    same = spark.createDataFrame([("a", 1, 1, 1.0)] * 50, SCHEMA)
    assert sorted(r["rank"] for r in L.ranks(same, ["k"], [c("t")], together=8).collect()) == list(range(1, 51))
    assert sorted(r["m"] for r in L.moving(same, ["k"], [c("t")], F.count("*"), 3, "m", 8).collect()) == [1, 2, 3] + [4] * 47
    none = same.limit(0)
    assert L.ranks(none, ["k"], [c("t")]).count() == L.moving(none, ["k"], [c("t")], F.count("*"), 3, "m").count() == 0
    assert L.as_of(none, same.select("k", "t", c("v").alias("w")), ["k"], "t", ["w"]).count() == 0


@pytest.mark.parametrize("pairs", [1, 90, 2_000])
def test_range_join_of_few_cells(spark, pairs):
    points = spark.sql("SELECT id p, CASE WHEN id % 50 <> 0 THEN (id % 37) / 4D - 3 END x FROM range(300) UNION ALL SELECT -1, 1D UNION ALL SELECT -1, 1D")
    ranges = spark.sql("SELECT id r, (id % 11) / 2D - 2 lo, (id % 11) / 2D + id % 4 - 2 hi FROM range(60) UNION ALL SELECT 99, cast(null as double), 1D")
    want = rows_of(points.join(ranges, (c("x") >= c("lo")) & (c("x") < c("hi"))).select("p", "r"))
    got = L.in_range(points, ranges, "x", "lo", "hi", 5.0, pairs)
    assert got.columns == ["p", "x", "r", "lo", "hi"] and rows_of(got.select("p", "r")) == want != []


def test_one_full_cell_is_spread_over_tasks(spark):
    points, ranges = spark.range(1_000).select("id", F.lit(1.0).alias("x")), spark.range(1_000).select(c("id").alias("r"), F.lit(0.5).alias("lo"), F.lit(1.5).alias("hi"))
    per_task = L.in_range(points, ranges, "x", "lo", "hi", 5.0, 10_000).groupBy(F.spark_partition_id()).count().collect()
    assert sum(r["count"] for r in per_task) == 1_000_000 and max(r["count"] for r in per_task) < 100_000
