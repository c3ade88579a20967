"""Contiguous shards of nearly equal bytes, from global prefix sums of per-partition totals. DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import partitions, save

#: Bytes that a row takes besides its text.
ROW_BYTES = 8


def shards(docs: DataFrame, n_shards: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Cuts the rows, ordered by key, into n_shards contiguous runs of nearly equal bytes.

    Returns key, size, text_crc32, shard (0 to n_shards - 1) and slot (gapless from 0 in each shard). A row goes where the middle of
    its bytes falls among n_shards equal targets, so a shard is off its target by one row's size at most.

    The text is read once and never shuffled. Rows are dealt by range of the key; a task sorts its own range only; what is summed
    globally is one row for each partition. Null texts count as empty (crc32 0). Null keys come first. Rows with one key are ordered by
    crc32 and size; rows equal in all three are alike, so their order among themselves is left open. An empty table gives no rows;
    fewer rows than shards leave shards empty. Other columns are ignored, whatever their names."""
    spark = docs.sparkSession
    content = F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8")
    order = ["k", "text_crc32", "size", "tie"]  # a number tells rows apart that are equal in the rest, so they do not gather in one range
    rows = docs.select(F.col(key).alias("k"), (F.octet_length(content) + ROW_BYTES).cast("long").alias("size"), F.crc32(content).alias("text_crc32"))
    rows = save(rows.withColumn("tie", F.monotonically_increasing_id()), "sizes")
    dealt = save(rows.repartitionByRange(partitions(spark), *order).withColumn("part", F.spark_partition_id()), "ranges")

    # One row for each partition, so the one task that sums them has a bounded load.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = dealt.groupBy("part").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    totals = totals.select(
        "part",
        F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes_before"),
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("rows_before"),
        F.sum("bytes").over(Window.partitionBy()).alias("total"),
    )
    within = Window.partitionBy("part").orderBy(*order)
    placed = dealt.select(
        "k", "size", "text_crc32", "part",
        F.coalesce(F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("bytes_in"),
        (F.row_number().over(within) - 1).alias("row_in"),
    ).join(F.broadcast(totals), "part")
    shard = shard_of(F.col("bytes_before") + F.col("bytes_in"), F.col("size"), F.col("total"), n_shards)
    placed = save(placed.select("k", "size", "text_crc32", shard.alias("shard"), (F.col("rows_before") + F.col("row_in")).alias("row")), "placed")
    firsts = placed.groupBy("shard").agg(F.min("row").alias("first"))  # n_shards rows
    return placed.join(F.broadcast(firsts), "shard").select(F.col("k").alias(key), "size", "text_crc32", "shard", (F.col("row") - F.col("first")).alias("slot"))


def shard_of(before: Column, size: Column, total: Column, n_shards: int) -> Column:
    """Where the middle of a row of that size, which comes after so many bytes of a total, falls among n_shards equal targets.

    Whole numbers of 38 digits, so it is exact up to 10^17 bytes and 10^18 shards; a decimal quotient would be rounded first."""
    wide = lambda c: c.cast("decimal(38,0)")
    middle = wide(wide(before) * 2 + size) * n_shards
    return F.least(F.lit(n_shards - 1), F.call_function("div", wide(middle), wide(wide(total) * 2)).cast("int"))


def op5_byte_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shards(spark.read.parquet(f"{sf_dir}/documents.parquet"), n_shards=24)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


SQL = """
WITH crc_table AS (
  SELECT list(v ORDER BY k) AS tab FROM (
    SELECT k, list_reduce(list_prepend(k, [0,0,0,0,0,0,0,0]), lambda a, b: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END) AS v
    FROM range(256) t(k))
), sized AS (
  SELECT doc_id, (octet_length(encode(coalesce(text, ''))) + 8)::BIGINT AS size,
    xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: ('0x' || h)::BIGINT)),
      lambda a, b: xor(a // 256, tab[xor(a % 256, b) + 1])), 4294967295) AS text_crc32
  FROM documents, crc_table
), placed AS (
  SELECT *, coalesce(sum(size) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::HUGEINT AS before, sum(size) OVER () AS total, row_number() OVER w AS r
  FROM sized WINDOW w AS (ORDER BY doc_id NULLS FIRST, text_crc32, size)
), cut AS (
  SELECT *, least(23, ((2 * before + size) * 24) // (2 * total))::INT AS shard FROM placed
)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, (r - min(r) OVER (PARTITION BY shard))::BIGINT AS slot, NULL::INT AS grown_shard FROM cut
"""
QUERIES = {"op5_byte_shards": op5_byte_shards}
ORACLE = {"op5_byte_shards": SQL}
