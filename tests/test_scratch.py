import pytest
from pyspark.sql import functions as F

from lattica.sources import scratch


def test_tables_are_saved_and_cleared(spark):
    saved = scratch.save(spark.range(5), "five")
    assert saved.count() == 5 and saved.dtypes == spark.range(5).dtypes
    assert scratch.clear(spark) and not scratch.clear(spark)
    assert scratch.save(spark.range(3), "three").count() == 3


def test_ranks_are_global(spark):
    rows = spark.range(1000).withColumn("v", F.pmod(F.xxhash64("id"), F.lit(50)))
    got = scratch.ranked(rows, [F.col("v").desc(), F.col("id")], "r").collect()
    want = sorted(((r["v"], r["id"]) for r in got), key=lambda x: (-x[0], x[1]))
    assert [(r["v"], r["id"]) for r in sorted(got, key=lambda r: r["r"])] == want and sorted(r["r"] for r in got) == list(range(1000))


def test_temporary_tables_go(spark):
    with scratch.temporary(spark):
        lost, kept = scratch.save(spark.range(4), "lost"), scratch.save(spark.range(6), "kept", lasting=True)
        assert lost.count() == 4
    assert kept.count() == 6
    with pytest.raises(Exception, match="PATH_NOT_FOUND|FAILED_READ_FILE|does not exist"):
        lost.collect()


def test_a_cluster_needs_a_shared_folder(spark):
    class Session:
        conf = {"spark.master": "spark://host:7077"}

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        scratch.shared_folder(Session())


def test_equal_rows_are_not_one_range(spark):
    got = scratch.ranked(spark.range(4000).select(F.lit(1).alias("v")), [F.col("v")], "r")
    assert sorted(r["r"] for r in got.collect()) == list(range(4000))
    parts = got.groupBy(F.spark_partition_id()).count().collect()
    assert max(r["count"] for r in parts) < 2500
