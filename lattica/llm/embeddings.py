"""Near-duplicate vectors: iterative quantisation to balanced binary codes, multi-index Hamming tables, exact cosines at the end."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import by_groups, components, mapped, save, small

#: Vectors that the rotation is learned from, about; a hash of the id chooses them. All vectors are indexed.
FIT_ROWS = 10_000
#: Vectors that a bucket has on average, which sets the bits of a table's key, and the share of pairs just at the threshold to find.
PER_BUCKET, RECALL = 12, 0.95
#: Tables for which a key is made shorter, that is, buckets larger, rather than add more.
MANY_TABLES = 64
#: Vectors of the sample that get a made neighbour at the threshold, on which recall is measured.
PROBES = 2000
#: Vectors of a bucket that are compared in one task with as many others; larger buckets become pairs of blocks.
BLOCK = 1024


@dataclass(frozen=True)
class Codes:
    """mean and rotation: sign((x / |x| - mean) @ rotation) are a unit vector's bits, its code. A code is cut into n_tables substrings of
    `length` bits, one for each table. Vectors meet where a substring agrees, so all codes within a Hamming distance of n_tables - 1
    meet surely, and others likely; `radius` is the distance within which codes of similar vectors are."""

    mean: np.ndarray
    rotation: np.ndarray
    n_tables: int
    length: int
    radius: int

    def bits(self, unit: np.ndarray) -> np.ndarray:
        out = np.empty((len(unit), self.n_tables * self.length), bool)
        for s in range(0, len(unit), 4096):
            out[s : s + 4096] = (unit[s : s + 4096] - self.mean) @ self.rotation > 0
        return out

    def keys(self, bits: np.ndarray) -> np.ndarray:
        """A key for each vector (row) and table."""
        weights = 2.0 ** np.arange(self.length)  # exact: a key is shorter than 53 bits
        return (bits.reshape(len(bits), self.n_tables, self.length).astype(np.float64) @ weights).astype(np.int64)


def quantiser(sample: np.ndarray, rounds: int = 40) -> tuple[np.ndarray, np.ndarray]:
    """(mean, projection): principal axes of the unit vectors, turned so that signs lose least (Procrustes steps between codes and axes)."""
    mean = sample.mean(axis=0)
    centred = sample - mean
    _, axes = np.linalg.eigh(centred.T @ centred)
    turn, _ = np.linalg.qr(np.random.default_rng(11).standard_normal((axes.shape[1],) * 2))
    values = centred @ axes
    for _ in range(rounds):
        codes = np.where(values @ turn > 0, 1.0, -1.0)
        left, _, right = np.linalg.svd(values.T @ codes)
        turn = left @ right
    return mean, axes @ turn


def probes(sample: np.ndarray, threshold: float) -> list[tuple[np.ndarray, np.ndarray]]:
    """Pairs of unit vectors with cosine threshold: vectors of the sample, turned towards any direction, and towards differences of others."""
    random = np.random.default_rng(7)
    base = sample[random.permutation(len(sample))[:PROBES]]
    others = sample[random.integers(len(sample), size=(2, len(base)))]
    out = []
    for away in (random.standard_normal(base.shape), others[0] - others[1]):
        away = away - (away * base).sum(axis=1, keepdims=True) * base
        size = np.linalg.norm(away, axis=1)
        sound = size > 1e-6
        if sound.any():
            out.append((base[sound], threshold * base[sound] + math.sqrt(max(0.0, 1 - threshold**2)) * away[sound] / size[sound, None]))
    return out or [(base, threshold * base)]


def coded(sample: np.ndarray, n_rows: int, threshold: float, per_bucket: float = PER_BUCKET, recall: float = RECALL) -> Codes:
    """Codes for n_rows vectors. A key's length grows with the logarithm of the rows. Tables are added until that share of probes(), of
    the kind that is found less, agrees in one of them: so the angles around the mean count, and what tables have in common. No bit is
    in two tables: beyond the first rotation's bits come those of random turns. If it takes too many tables, keys get shorter; with
    none of their bits left, all vectors meet. The radius is the largest distance of the probes' codes."""
    sample = sample[np.random.default_rng(2).permutation(len(sample))]
    held = min(PROBES, len(sample) // 3)  # not fitted to, else recall looks better than it is
    mean, first = quantiser(sample[held:])
    dimensions = len(mean)
    pairs = probes(sample[:held] if held else sample, threshold)
    length = max(1, min(dimensions, math.ceil(math.log2(max(2.0, n_rows / per_bucket)))))
    while length:
        random, parts, n_tables = np.random.default_rng(5), [], 0
        met = [np.zeros(len(a), bool) for a, _ in pairs]
        apart = [np.zeros(len(a), np.int64) for a, _ in pairs]
        while n_tables < MANY_TABLES and (n_tables < 4 or min(m.mean() for m in met) < recall):
            turn = first if not parts else first @ np.linalg.qr(random.standard_normal((dimensions,) * 2))[0]
            turn = turn[:, random.permutation(dimensions)]
            same = [((a - mean) @ turn > 0) == ((b - mean) @ turn > 0) for a, b in pairs]
            for s in range(0, dimensions - length + 1, length):
                if n_tables < MANY_TABLES and (n_tables < 4 or min(m.mean() for m in met) < recall):
                    parts.append(turn[:, s : s + length])
                    met = [m | x[:, s : s + length].all(axis=1) for m, x in zip(met, same, strict=True)]
                    apart = [d + (~x[:, s : s + length]).sum(axis=1) for d, x in zip(apart, same, strict=True)]
                    n_tables += 1
        if min(m.mean() for m in met) >= recall:
            return Codes(mean, np.concatenate(parts, axis=1), n_tables, length, max(int(d.max()) for d in apart))
        length -= 1
    return Codes(mean, first[:, :0], 1, 0, 0)


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy().astype(np.float64).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """k, v and a 128-bit digest of v's components, which is null where v can't be compared; v is null there, too."""
    for batch in batches:
        column, marks = batch.column(1), []
        for i in range(batch.num_rows):
            values = column[i].values if column[i].is_valid else None
            x = values.to_numpy() + 0.0 if values is not None and not values.null_count else np.zeros(0)  # + 0.0: minus zero is zero
            marks.append(hashlib.blake2b(x.tobytes(), digest_size=16).digest() if x.any() and np.isfinite(x).all() else None)
        marks = pa.array(marks, pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column(0), pc.if_else(marks.is_valid(), column, pa.scalar(None, column.type)), marks], ["k", "v", "digest"])


def similar(vectors: DataFrame, threshold: float = 0.9, key: str = "vec_id", embedding: str = "embedding", recall: float = RECALL) -> DataFrame:
    """key, n_links, component_id and kept: links are pairs of other rows with cosine >= threshold, in double precision, of those found.

    Equal vectors, by a digest, are one class, so copies always link and cost nothing. Each class goes to one bucket of every table by
    its code. In a bucket, blocks of rows are compared by their codes alone; only rows with a near code, in a pair that no earlier table
    has, are compared by their original vectors, so a vector is shipped about once for each block that has a link of it. No pair is
    written: tasks give numbers of links, and for components one edge for each row and block. Vectors that are null, empty, zero or
    hold null or non-finite components link with nothing, nor do vectors of different lengths (each length is a fit of its own). Rows
    repeating a key are rows of their own that share it. Null keys are allowed; they are never the least. An empty table gives no rows;
    other columns are ignored."""
    spark = vectors.sparkSession
    kind = "float" if vectors.schema[embedding].dataType.simpleString() == "array<float>" else "double"
    rows = mapped(vectors.select(F.col(key).cast("long").alias("k"), F.col(embedding).cast(f"array<{kind}>").alias("v")), _marked, f"k long, v array<{kind}>, digest binary")
    rows = save(rows, "vectors")
    classes = rows.where("digest is not null").groupBy("digest").agg(F.first("v").alias("v"), F.min("k").alias("k"), F.count("*").alias("n"))
    classes = save(classes.withColumn("c", F.monotonically_increasing_id()), "classes")
    links = spark.createDataFrame([], "c long, n_links long")
    joined = spark.createDataFrame([], "node long, component long")
    for d, n in sorted((r["d"], r["n"]) for r in classes.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).where("n > 1").collect()):
        counts, edges = _pairs(classes.where(F.size("v") == d).select("c", "v", "n"), n, threshold, recall)
        links, joined = links.unionByName(counts), joined.unionByName(components(edges))

    # A class's component is the least key of all its classes; copies link with each other.
    sets = classes.select("c", "digest", "k", "n").join(joined.withColumnRenamed("node", "c"), "c", "left").withColumn("component", F.coalesce("component", "c"))
    sets = save(sets, "sets")
    least = save(sets.groupBy("component").agg(F.min("k").alias("component_id")), "least")
    told = sets.join(small(least), "component").join(links.groupBy("c").agg(F.sum("n_links").alias("n_links")), "c", "left")
    told = told.select("digest", (F.coalesce("n_links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id")
    # Tables on both sides, so that adaptive execution can split a hot vector's rows.
    out = rows.where("digest is not null").select("k", "digest").join(save(told, "told"), "digest").select("k", "n_links", "component_id")
    alone = rows.where("digest is null").select("k", F.lit(0).cast("long").alias("n_links"), F.col("k").alias("component_id"))
    return out.unionByName(alone).select(F.col("k").alias(key), "n_links", "component_id", F.col("k").eqNullSafe(F.col("component_id")).alias("kept"))


def _pairs(classes: DataFrame, n_rows: int, threshold: float, recall: float) -> tuple[DataFrame, DataFrame]:
    """(c, n_links) and edges (a, b) between classes; a class may have several rows of n_links."""
    share = min(1.0, FIT_ROWS / max(1, n_rows))
    sample = classes.where(F.pmod(F.xxhash64("c", F.lit("fit")), F.lit(1 << 30)) < int(share * (1 << 30)) + 1).select("v").toArrow()
    codes = coded(_unit(_matrix(sample.column("v"))), n_rows, threshold, PER_BUCKET, recall)
    n_tables, n_bits = codes.n_tables, codes.n_tables * codes.length

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                bits = codes.bits(_unit(_matrix(batch.column(0))))
                code = pa.array([row.tobytes() for row in np.packbits(bits, axis=1)], pa.binary())
                at = pa.array(np.repeat(np.arange(batch.num_rows), n_tables))
                t = pa.array(np.tile(np.arange(n_tables, dtype=np.int32), batch.num_rows))
                yield pa.RecordBatch.from_arrays([batch.column(1).take(at), code.take(at), t, pa.array(codes.keys(bits).ravel())], ["c", "code", "t", "key"])

    keyed = save(mapped(classes.select("v", "c"), index, "c long, code binary, t int, key long"), "keys")
    sizes = keyed.groupBy("t", "key").agg(F.count("*").alias("size")).where("size > 1")
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    placed = keyed.join(save(sizes.withColumn("blocks", blocks), "buckets"), ["t", "key"]).withColumn("block", F.pmod(F.xxhash64("c"), F.col("blocks")).cast("int"))
    # Block i meets every block j >= i: a row goes to (block, j) as the left side and to (i, block) as the right side.
    others = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct(F.least(j, F.col("block")).alias("i"), F.greatest(j, F.col("block")).alias("j")))
    placed = placed.select("c", "code", "t", "key", "block", F.explode(others).alias("m")).select("c", "code", "t", "key", "block", "m.i", "m.j")
    group = ["t", "key", "i", "j"]

    def filtered(table: pa.Table, cuts: list[int]) -> pa.Table | None:
        """Rows of a pair whose codes are near and agree in no earlier table."""
        bits = np.unpackbits(np.frombuffer(b"".join(table.column("code").to_pylist()), np.uint8).reshape(table.num_rows, -1), axis=1)[:, :n_bits]
        sign = bits.astype(np.float32) * 2 - 1
        t, block, i, j = (table.column(x).to_numpy() for x in ("t", "block", "i", "j"))
        kept = np.zeros(table.num_rows, bool)
        for x, y in zip(cuts, cuts[1:], strict=False):
            left = x + np.flatnonzero(block[x:y] == i[x])
            right = left if i[x] == j[x] else x + np.flatnonzero(block[x:y] == j[x])
            near = n_bits - sign[left] @ sign[right].T <= 2 * codes.radius
            a, b = np.nonzero(np.triu(near, 1) if i[x] == j[x] else near)
            a, b = left[a], right[b]
            for s in range(0, len(a), 50_000):
                some, other = a[s : s + 50_000], b[s : s + 50_000]
                differ = (bits[some, : t[x] * codes.length] != bits[other, : t[x] * codes.length]).reshape(len(some), t[x], codes.length).any(axis=2)
                fresh = differ.all(axis=1)
                kept[some[fresh]] = kept[other[fresh]] = True
        return table.filter(pa.array(kept)).drop_columns("code") if kept.any() else None

    near = save(by_groups(placed, group, filtered, "c long, t int, key long, block int, i int, j int"), "near")

    def compare(table: pa.Table, cuts: list[int]) -> pa.Table | None:
        unit = _unit(_matrix(table.column("v")))
        c, n, t, block, i, j = (table.column(x).to_numpy() for x in ("c", "n", "t", "block", "i", "j"))
        keys = codes.keys(codes.bits(unit))
        made = []
        for x, y in zip(cuts, cuts[1:], strict=False):
            a, b = _near(unit[x:y], np.flatnonzero(block[x:y] == i[x]), None if i[x] == j[x] else np.flatnonzero(block[x:y] == j[x]), threshold)
            made += [_links(keys[x:y, : t[x]], np.arange(y - x), c[x:y], n[x:y], a, b)] if len(a) else []
        return pa.table({name: np.concatenate(parts) for name, parts in zip(("c", "n_links", "b"), zip(*made, strict=True), strict=True)}) if made else None

    found = save(by_groups(near.join(classes, "c"), group, compare, "c long, n_links long, b long"), "links")
    return found.select("c", "n_links"), found.where("b <> c").select(F.col("c").alias("a"), "b")


def _near(unit: np.ndarray, left: np.ndarray, right: np.ndarray | None, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Links (a, b) of the left block to the right one, or within it if right is None, by their places in unit."""
    near = unit[left] @ unit[left if right is None else right].T >= threshold - 1e-12
    a, b = np.nonzero(np.triu(near, 1) if right is None else near)
    a, b = left[a], left[b] if right is None else right[b]
    exact = np.einsum("ij,ij->i", unit[a], unit[b]) >= threshold
    return a[exact], b[exact]


def _links(earlier: np.ndarray, place: np.ndarray, c: np.ndarray, n: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple:
    """(c, n_links, b) of one bucket's rows by its links (a, b).

    A pair counts only if no earlier table has it, that is, if the rows' keys differ in all of those; place says where earlier has a row.
    b is the least class that the row is linked to, through others of the bucket too."""
    fresh = np.ones(len(a), bool)
    for s in range(0, len(a), 200_000):
        fresh[s : s + 200_000] = ~(earlier[place[a[s : s + 200_000]]] == earlier[place[b[s : s + 200_000]]]).any(axis=1)
    counts = np.bincount(a[fresh], weights=n[b[fresh]], minlength=len(c)) + np.bincount(b[fresh], weights=n[a[fresh]], minlength=len(c))
    order = np.argsort(c)  # so that the least place is the least class
    spot = np.empty(len(c), np.int64)
    spot[order] = np.arange(len(c))
    root = np.arange(len(c))
    while True:
        before = root.copy()
        np.minimum.at(root, spot[a], root[spot[b]])
        np.minimum.at(root, spot[b], root[spot[a]])
        root = root[root]
        if (root == before).all():
            break
    root = root[spot]
    told = np.flatnonzero((counts > 0) | (root != spot))
    return c[told], counts[told].astype(np.int64), c[order[root[told]]]


def _unit(x: np.ndarray) -> np.ndarray:
    if not x.size:
        return x
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def op10_itq_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


QUERIES = {"op10_itq_links": op10_itq_links}
#: All pairs, without codes: recall on the test tables is 1.
SQL = """
WITH RECURSIVE sound AS (
  SELECT vec_id, embedding::DOUBLE[] AS v, row_number() OVER () AS r FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), scaled AS (
  SELECT r, vec_id, len(v) AS d, list_transform(v, lambda x: x / sqrt(list_sum(list_transform(v, lambda y: y * y)))) AS u FROM sound
), link AS (
  SELECT a.r AS x, b.r AS y FROM scaled a JOIN scaled b ON a.d = b.d AND a.r <> b.r WHERE list_dot_product(a.u, b.u) >= 0.9
), reach AS (
  SELECT r AS node, vec_id AS root FROM scaled UNION SELECT y, root FROM reach JOIN link ON node = x
), told AS (
  SELECT node, min(root) AS component_id, (SELECT count(*) FROM link WHERE x = node) AS n_links FROM reach GROUP BY node
)
SELECT vec_id, n_links::BIGINT AS n_links, component_id, vec_id = component_id AS kept FROM scaled JOIN told ON r = node
UNION ALL SELECT vec_id, 0, vec_id, true FROM embeddings WHERE embedding IS NULL OR len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) > 0 OR len(list_filter(embedding, lambda x: x <> 0)) = 0
"""
ORACLE = {"op10_itq_links": SQL}
