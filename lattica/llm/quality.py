"""Quality by importance: the ratio of hashed n-gram models of target and raw text, and a sample by Gumbel top-k."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _words
from ._common import mapped, ranked, save

BUCKETS = 1 << 14
#: Labelled documents that the target model and the threshold learn from, about; a hash of the id chooses them. They are broadcast.
LABELLED = 8000
#: Tokens without evidence that a document's mean takes in besides its own, so that a few odd ones can't condemn a short text.
PRIOR = 20


def token_buckets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, rows) of all tokens and all pairs of neighbouring tokens of a row. A token is a word, or a run of other
    visible bytes. Pairs of twice the same token share bucket 0."""
    kind = np.where(data <= 32, 0, np.where(_words.IN_WORD[data], 1, 2)).astype(np.int8)
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    changes = np.ones(len(data) + 1, bool)
    changes[1:-1] = kind[1:] != kind[:-1]
    cuts = np.flatnonzero(changes | edge)
    starts, ends = cuts[:-1], cuts[1:]
    seen = kind[starts] > 0 if len(starts) else np.zeros(0, bool)
    starts, ends = starts[seen], ends[seen]
    rows = np.searchsorted(offsets, starts, side="right") - 1
    hashed = _words.hashes(data, starts, ends)
    at, pairs = _words.rolling(hashed, rows, 2)
    buckets = (np.concatenate([hashed, pairs]) >> np.uint64(50)).astype(np.int64)
    buckets[len(hashed) :][hashed[at] == hashed[at + 1]] = 0
    return buckets, np.concatenate([rows, rows[at]])


@dataclass(frozen=True)
class Model:
    """ratio: for each bucket the log of its target over its raw probability. threshold: the least mean ratio of a good document.
    share: of the labelled documents, the good ones."""

    ratio: np.ndarray
    threshold: float
    share: float


def _hash01(column: Column, salt: str) -> Column:
    """A number in (0, 1) that depends on the column and the salt."""
    return (F.pmod(F.xxhash64(column, F.lit(salt)), F.lit(1 << 40)) + 0.5) / float(1 << 40)


def _sample(labels: DataFrame, key: str, label: str, n: int) -> DataFrame:
    """k, good and half (0: for the target model, 1: for the threshold) of some n labelled ids, chosen and halved by a hash of the id."""
    known = labels.select(F.col(key).alias("k"), (F.col(label) > 0).alias("good")).where("k is not null and good is not null")
    share = min(1.0, n / max(1, known.count()))
    known = known.where(_hash01(F.col("k"), "sample") < share).groupBy("k").agg(F.min("good").alias("good"))
    return save(known.withColumn("half", (_hash01(F.col("k"), "half") < 0.5).cast("int")), "labelled")


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", labelled: int = LABELLED) -> Model:
    """Raw counts are over all documents; target counts over good ones of half of the sampled labels. The other half sets the threshold:
    the middle of the gap that best separates good from bad ones (most true accepts minus false accepts, the lowest such). Without
    labels of both kinds nothing is below the threshold; without good ones all ratios are 0, without any the share is 1. Null texts have
    no tokens and mean 0."""
    sample = _sample(labels, key, label, labelled)
    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for batch in batches:
            good = batch.column(1).fill_null(False).to_numpy(zero_copy_only=False)
            for first, _, data, offsets in _words.chunks(batch.column(0)):
                buckets, at = token_buckets(data, offsets)
                raw += np.bincount(buckets, minlength=BUCKETS)
                target += np.bincount(buckets[good[first + at]], minlength=BUCKETS)
        seen = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(raw[seen]), pa.array(target[seen])], ["bucket", "raw", "target"])

    marked = rows.join(F.broadcast(sample.where("half = 0")), "k", "left").select("t", "good")  # bounded by `labelled`
    counts = mapped(marked, count, "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
    raw, target = np.full(BUCKETS, 1.0), np.full(BUCKETS, 1.0)
    for r in counts.collect():  # BUCKETS rows at most
        raw[r["bucket"]] += r["raw"]
        target[r["bucket"]] += r["target"]
    ratio = np.log(target / target.sum()) - np.log(raw / raw.sum()) if target.sum() > BUCKETS else np.zeros(BUCKETS)

    others = weighed(rows.join(F.broadcast(sample.where("half = 1")), "k").select("k", "t", "good"), ratio, "t")
    judged = others.groupBy("k").agg(F.avg("mean").alias("mean"), F.first("good").alias("good")).collect()  # one row for each of `labelled` ids
    shares = sample.agg(F.avg(F.col("good").cast("int"))).first()[0]
    return Model(ratio, _threshold(np.array([r["mean"] for r in judged]), np.array([r["good"] for r in judged], bool)), 1.0 if shares is None else shares)


def weighed(docs: DataFrame, ratio: np.ndarray, text: str = "text") -> DataFrame:
    """docs with n_tokens, log_weight (the log of the ratio of the two models' probabilities of the document: the sum of the ratios of
    its tokens and pairs) and mean (that sum by n_tokens and PRIOR more), which replace columns of these names."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, total = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows)
            for first, end, data, offsets in _words.chunks(batch.column(batch.schema.get_field_index("__text"))):
                buckets, at = token_buckets(data, offsets)
                n[first:end] = np.bincount(at, minlength=end - first)
                total[first:end] = np.bincount(at, weights=ratio[buckets], minlength=end - first)
            keep = [i for i, f in enumerate(batch.schema) if f.name != "__text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), pa.array(n), pa.array(total), pa.array(total / (n + PRIOR))], [*(batch.schema.field(i).name for i in keep), "n_tokens", "log_weight", "mean"])

    kept = docs.drop("n_tokens", "log_weight", "mean", "__text")
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in kept.schema)
    return mapped(kept.withColumn("__text", docs[text]), score, fields + "n_tokens long, log_weight double, mean double")


def _threshold(means: np.ndarray, good: np.ndarray) -> float:
    if not good.any() or good.all():
        return -np.inf
    order = np.argsort(means, kind="stable")
    means, good = means[order], good[order]
    rejected_bad = np.concatenate([[0], np.cumsum(~good)]) / (~good).sum()
    rejected_good = np.concatenate([[0], np.cumsum(good)]) / good.sum()
    gain = rejected_bad - rejected_good
    gain[1:-1][means[1:] == means[:-1]] = -1  # no cut between equals
    cut = int(np.argmax(gain))
    if cut == 0:
        return -np.inf
    return float((means[cut - 1] + means[cut]) / 2) if cut < len(means) else float(means[-1])


def select(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", share: float | None = None) -> DataFrame:
    """key, n_tokens, log_weight, mean, perturbed, rank, selected and accepted for every document.

    Gumbel noise that a hash of the key fixes is added to log_weight, and the k documents with the largest sums are selected: a sample
    without replacement in proportion to the importance weights. k is share of all documents; where share is None, it is the share that
    good ones have among the labelled. Ranks count from 0, by the sum, then key; the rank is global without a task that holds all rows.
    accepted is the classifier's decision: whether the mean reaches the learned threshold. Documents with null keys share one noise.
    Repeated rows are ranked each; an empty table gives no rows; other columns are ignored."""
    model = fit(docs, labels, key, text, label)
    rows = weighed(docs.select(F.col(key).alias("k"), F.col(text).alias("t")), model.ratio, "t").drop("t")
    noise = -F.log(-F.log(_hash01(F.col("k"), "gumbel")))
    rows = save(rows.withColumn("perturbed", F.col("log_weight") + noise).withColumn("accepted", F.col("mean") >= F.lit(float(model.threshold))), "scores")
    k = round((model.share if share is None else share) * rows.count())
    out = ranked(rows, [F.col("perturbed").desc(), F.col("k"), F.col("n_tokens")], "rank")
    return out.select(F.col("k").alias(key), "n_tokens", "log_weight", "mean", "perturbed", "rank", (F.col("rank") < k).alias("selected"), "accepted")


def accept(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without the rows that the classifier refuses, with the same columns: their mean log ratio is below the learned threshold.

    Rows are judged each, where they are; nothing is shuffled or ranked, as no number of documents is asked for."""
    model = fit(docs, labels, key, text)
    whole = docs.select(F.struct(*docs.columns).alias("doc"), F.col(text).alias("body"))
    return weighed(whole, model.ratio, "body").where(F.col("mean") >= F.lit(float(model.threshold))).select("doc.*")


def op8_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


QUERIES = {"op8_importance_resampling": op8_importance_resampling}
ORACLE: dict[str, str] = {}
