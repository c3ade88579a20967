"""Best-fit decreasing packing of tokenized documents into sequences of a fixed length."""

from __future__ import annotations

import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import mapped, partitions, save

#: What the two tokenizer libraries surely read alike; other texts, and very long white space, go to the slower one.
PLAIN = re.compile(r"[^\x00-ԯ]|\s{1000}")
#: Id that ends each document.
END_ID = 0


@lru_cache(1)
def _slow(vocabulary: str):
    import public_tokenizers
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(public_tokenizers.path(f"{vocabulary}.json"))
    made.encode_special_tokens = True
    return made


@lru_cache(1)
def tokenizer(vocabulary: str):
    """A function from text to ids: those of tokenizers with <vocabulary>.json and add_special_tokens=False.

    Texts of plain letters are encoded by tiktoken with the same vocabulary in <vocabulary>.tiktoken, which is several times as fast."""
    import base64

    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path(f"{vocabulary}.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    fast = tiktoken.Encoding(vocabulary, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return lambda text: _slow(vocabulary).encode(text, add_special_tokens=False).ids if PLAIN.search(text) else fast.encode_ordinary(text)


def pieces(docs: DataFrame, capacity: int, vocabulary: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, piece, start, length, ids_crc32: each document's ids and END_ID, cut into pieces of capacity ids if longer; the first piece
    takes what is over. A null text is empty, so it is one piece of one id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokenizer(vocabulary)
        for batch in batches:
            out: list[tuple] = []
            for row, value in enumerate(batch.column(1)):
                ids = np.array([*encode(value.as_py() or ""), END_ID], "<u4")
                first = (len(ids) - 1) % capacity + 1
                cuts = [0, *range(first, len(ids) + 1, capacity)]
                out += [(row, i, a, b - a, zlib.crc32(ids[a:b].tobytes())) for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
            row, *rest = (np.array(x) for x in zip(*out, strict=True)) if out else [np.zeros(0, np.int64)] * 5
            columns = [batch.column(0).take(pa.array(row)), *(pa.array(x.astype(t)) for x, t in zip(rest, ("i4", "i8", "i8", "i8"), strict=True))]
            yield pa.RecordBatch.from_arrays(columns, ["k", "piece", "start", "length", "ids_crc32"])

    kind = docs.schema[key].dataType.simpleString()
    return mapped(docs.select(F.col(key).alias("k"), F.col(text).alias("t")), run, f"k {kind}, piece int, start long, length long, ids_crc32 long")


class OpenBins:
    """Open sequences by the room left, under a segment tree over rooms that finds the least sufficient one in logarithmic time.

    Sequences with equal room are kept as ranges of numbers, so their count costs nothing."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.any = [False] * (2 * self.size)
        self.ranges: dict[int, list[tuple[int, int]]] = defaultdict(list)

    def _mark(self, room: int) -> None:
        at = room + self.size
        self.any[at] = bool(self.ranges[room])
        while at > 1:
            at //= 2
            self.any[at] = self.any[2 * at] or self.any[2 * at + 1]

    def tightest(self, length: int) -> int | None:
        """The least room of an open sequence that is at least length."""
        at = length + self.size
        if self.any[at]:
            return length
        while at > 1 and not (at % 2 == 0 and self.any[at + 1]):
            at //= 2
        if at <= 1:
            return None
        at += 1
        while at < self.size:
            at = 2 * at if self.any[2 * at] else 2 * at + 1
        return at - self.size

    def put(self, room: int, first: int, n: int) -> None:
        self.ranges[room].append((first, n))
        self._mark(room)

    def take(self, room: int, n: int) -> tuple[int, int]:
        """Some n or fewer neighbouring sequences with that room: (first, how many)."""
        first, have = self.ranges[room].pop()
        if have > n:
            self.ranges[room].append((first + n, have - n))
        self._mark(room)
        return first, min(n, have)


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """(length, from rank, to rank, first sequence, offset): pieces of a length with these ranks go to consecutive sequences at an offset.

    This is best-fit decreasing: longest pieces first, each into the tightest open sequence, a new one where none fits. Equal lengths
    are alike, so runs of equal choices are made at once: a sequence that takes a piece has less room and stays the tightest one
    while another piece fits. The work depends on capacity, not on the number of pieces."""
    bins, made, rows = OpenBins(capacity), 0, []
    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            room = bins.tightest(length)
            each = min(left, (room or capacity) // length)
            wanted = left // each
            if room is None:
                room, first, n = capacity, made, wanted
                made += n
            else:
                first, n = bins.take(room, wanted)
            for i in range(each):
                rows.append((length, rank, rank + n, first, capacity - room + i * length))
                rank += n
            left -= n * each
            bins.put(room - each * length, first, n)
    return rows


def pack(docs: DataFrame, capacity: int = 2048, vocabulary: str = "byte_bpe_50k", key: str = "doc_id", text: str = "text") -> DataFrame:
    """pieces() with sequence_id and offset: best-fit decreasing over all pieces of all documents.

    Only the number of pieces of each length goes to the driver (capacity rows at most), and only a plan in ranges of ranks comes back,
    whose size depends on capacity alone. Ranks among equal lengths come from salted counts, so neither a length nor equal rows gather
    in one task.
    An empty table gives no rows; repeated rows are packed each; other columns are ignored."""
    spark = docs.sparkSession
    salted = F.pmod(F.monotonically_increasing_id(), F.lit(partitions(spark))).cast("int")  # equal rows are spread, too
    rows = save(pieces(docs, capacity, vocabulary, key, text).withColumn("salt", salted), "pieces")
    counts = rows.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    counts = save(counts.select("length", "salt", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before")), "counts")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    made = spark.createDataFrame(plan(histogram, capacity), "length long, a long, b long, first long, offset long")
    within = Window.partitionBy("length", "salt").orderBy("k", "piece", "start", "ids_crc32")
    ranked = rows.withColumn("r", F.row_number().over(within) - 1).join(counts.drop("n"), ["length", "salt"]).withColumn("rank", F.col("r") + F.col("before"))
    placed = ranked.join(F.broadcast(made.withColumnRenamed("length", "l")), (F.col("length") == F.col("l")) & (F.col("rank") >= F.col("a")) & (F.col("rank") < F.col("b")))
    return placed.select(F.col("k").alias(key), "piece", "start", "length", "ids_crc32", (F.col("first") + F.col("rank") - F.col("a")).alias("sequence_id"), "offset")


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op3_best_fit_packing": op3_best_fit_packing}
ORACLE: dict[str, str] = {}
