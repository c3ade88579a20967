"""Language identification in two steps: the family first, then one-versus-one linear support vector machines within it."""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _words
from ._common import by_group, crc_of_id, mapped, save

#: Families of languages by ISO 639-1 code; a language that is not listed is a family of its own.
FAMILIES = {
    "germanic": ["en", "de", "nl", "sv", "da", "no", "is"],
    "romance": ["fr", "es", "pt", "it", "ro", "ca"],
    "slavic": ["ru", "uk", "pl", "cs", "sk", "bg", "sr", "hr", "sl"],
    "uralic": ["fi", "et", "hu"],
    "turkic": ["tr", "az", "kk", "uz"],
}
#: Rows of each language that are learned from, about: they are chosen by a hash of the id, with a share that gives that many.
ROWS_PER_LANGUAGE = 300
#: Languages that are learned, those with most rows: it bounds the machines (780 at most, of 64 KB each), however many values lang has.
LANGUAGES = 40
BUCKETS = 1 << 14
GRAMS = (2, 3, 4)
#: Scale of the mean weights, so that margins of about 1 can be reached.
SCALE = 30.0
UNKNOWN = "und"


def gram_buckets(data: np.ndarray, offsets: np.ndarray) -> Iterator[np.ndarray]:
    """For each length of gram the bucket of the bytes from each place on; bytes outside letters are one blank, A-Z lower-cased.

    Grams may not cross the end of a text: there the place's bucket is that of the gram filled up with blanks."""
    letters = _words.LOWER[data]
    letters[~_words.IN_WORD[data] | ((data >= 48) & (data < 58))] = 32
    last = np.zeros(len(data), bool)
    last[offsets[1:][offsets[1:] > offsets[:-1]] - 1] = True
    following, whole = letters.astype(np.uint32), letters.astype(np.uint32)
    for n in range(2, max(GRAMS) + 1):
        moved = np.full(len(data), 32, np.uint32)
        moved[:-1] = following[1:]
        moved[last] = 32
        following = moved
        whole = whole | (following << np.uint32(8 * (n - 1)))
        if n in GRAMS:
            yield ((whole * np.uint32(2654435761) + np.uint32(n)) * np.uint32(2246822519)) >> np.uint32(18)


def _sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
    return total[offsets[1:]] - total[offsets[:-1]]


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


@dataclass
class Model:
    """families: family to languages. machines: (family pair or language pair) to weights of BUCKETS and a bias; above 0 is the first."""

    families: dict[str, list[str]] = field(default_factory=dict)
    machines: dict[tuple[str, str], np.ndarray] = field(default_factory=dict)

    @property
    def languages(self) -> list[str]:
        return sorted(itertools.chain(*self.families.values()))


def svm(rows: list[tuple[np.ndarray, np.ndarray]], signs: np.ndarray, cost: float = 10.0, epochs: int = 40, tolerance: float = 1e-3) -> np.ndarray:
    """Weights and bias (last) of a linear support vector machine with squared hinge loss, by coordinate descent on the dual."""
    w, bias, alpha = np.zeros(BUCKETS), 0.0, np.zeros(len(rows))
    each = cost * len(rows) / 2 / np.where(signs > 0, max(1, (signs > 0).sum()), max(1, (signs < 0).sum()))
    norms = np.array([v @ v for _, v in rows]) + 1 + 0.5 / each
    order = np.random.default_rng(7)
    for _ in range(epochs):
        largest = 0.0
        for i in order.permutation(len(rows)):
            at, v = rows[i]
            gradient = signs[i] * (w[at] @ v + bias) - 1 + alpha[i] * 0.5 / each[i]
            moved = max(0.0, alpha[i] - gradient / norms[i]) - alpha[i]
            if moved:
                alpha[i] += moved
                w[at] += moved * signs[i] * v
                bias += moved * signs[i]
                largest = max(largest, abs(moved) * norms[i])
        if largest < tolerance:
            break
    return np.append(w, bias)


def family_of(language: str) -> str:
    return next((f for f, members in FAMILIES.items() if language in members), language)


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", rows_per_language: int = ROWS_PER_LANGUAGE, languages: int = LANGUAGES) -> Model:
    """Learns from rows with a language, ROWS_PER_LANGUAGE of each or so: a pass over key and language counts them, a second one picks
    by a hash of the key and makes sparse counts of grams, and each machine is trained in a task of its own on its languages' rows.
    Only the `languages` with most rows (by name between equals) are learned: a label that few rows have is more likely a slip.
    Rows with null text or language or without letters teach nothing. Without rows the model knows no language."""
    docs = docs.select(F.col(key).alias("k"), F.col(text).alias("t"), F.col(lang).alias("l")).where("l is not null and t is not null")
    counts = {r["l"]: r["n"] for r in docs.groupBy("l").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "l").limit(languages).collect()}
    if not counts:
        return Model()
    families: dict[str, list[str]] = {}
    for language in sorted(counts):
        families.setdefault(family_of(language), []).append(language)
    share = F.coalesce(*(F.when(F.col("l") == x, F.lit(min(1.0, rows_per_language / n))) for x, n in counts.items()))
    chosen = docs.where(F.pmod(F.xxhash64("k", F.lit("sample")), F.lit(1 << 30)) < share * (1 << 30)).select("l", "t")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, value = [], []
            for _, _, data, offsets in (x for i in range(batch.num_rows) for x in _words.chunks(batch.column(1).slice(i, 1), 1)):
                n = np.zeros(BUCKETS)
                for buckets in gram_buckets(data, offsets):
                    n += np.bincount(buckets, minlength=BUCKETS)
                at.append(np.flatnonzero(n))
                value.append(SCALE * n[at[-1]] / max(1, len(data)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(at, pa.list_(pa.int32())), pa.array(value, pa.list_(pa.float32()))], ["l", "at", "v"])

    rows = save(mapped(chosen, run, "l string, at array<int>, v array<float>"), "grams")
    pairs = [(a, b, families[a], families[b]) for a, b in itertools.combinations(sorted(families), 2)]
    pairs += [(a, b, [a], [b]) for members in families.values() for a, b in itertools.combinations(members, 2)]
    if not pairs:
        return Model(families)
    uses = [(language, i, sign) for i, (_, _, left, right) in enumerate(pairs) for sign, side in ((1, left), (-1, right)) for language in side]
    machine = docs.sparkSession.createDataFrame(uses, "l string, machine int, sign int")

    def train(group: pa.Table) -> pa.Table | None:
        signs = group.column("sign").to_numpy().astype(float)
        at, v = (group.column(x).combine_chunks() for x in ("at", "v"))
        cuts, at, v = at.offsets.to_numpy(), at.values.to_numpy(), v.values.to_numpy()
        examples = [(at[a:b], v[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]
        return pa.table({"machine": group.column("machine").slice(0, 1), "w": pa.array([svm(examples, signs)], pa.list_(pa.float32()))})

    trained = by_group(rows.join(F.broadcast(machine), "l").select("machine", "sign", "at", "v"), ["machine"], train, "machine int, w array<float>")
    return Model(families, {pairs[r["machine"]][:2]: np.array(r["w"], np.float32) for r in trained.collect()})


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with lang_pred and score, which replace columns of these names. Null texts and texts without a letter are `und`, score 0.

    The family with most one-versus-one votes is taken (larger sum of margins between equals), then the language within it in the same
    way. The score is the product over both steps of the logistic value of twice the least margin by which the winner beats another."""
    names = sorted(model.machines)
    weights = [model.machines[n][:BUCKETS].astype(np.float32) for n in names]
    bias = [model.machines[n][BUCKETS] for n in names]
    families = {f: sorted(m) for f, m in sorted(model.families.items())}

    def winner(options: list[str], margins: dict[tuple[str, str], np.ndarray], n: int) -> tuple[np.ndarray, np.ndarray]:
        """Index of the winner among the options for each text, and its logistic value."""
        votes, sums, least = (np.zeros((len(options), n)), np.zeros((len(options), n)), np.full((len(options), n), np.inf))
        for i, j in itertools.combinations(range(len(options)), 2):
            m = margins[(options[i], options[j])]
            votes[i] += m > 0
            votes[j] += m <= 0
            sums[i] += m
            sums[j] -= m
            least[i], least[j] = np.minimum(least[i], m), np.minimum(least[j], -m)
        best = np.argmax(votes + 0.5 * np.tanh(sums / (1 + len(options))), axis=0)
        return best, 1 / (1 + np.exp(-2 * np.clip(least[best, np.arange(n)], -50, 50)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("__text"))
            languages, scores = np.full(batch.num_rows, UNKNOWN, object), np.zeros(batch.num_rows)
            for first, end, data, offsets in _words.chunks(texts):
                n, size = end - first, np.maximum(1, np.diff(offsets))
                totals = [np.zeros(n) for _ in names]
                for buckets in gram_buckets(data, offsets):
                    for total, w in zip(totals, weights, strict=True):
                        total += _sums(w[buckets], offsets)
                margins = {name: SCALE * t / size + b for name, t, b in zip(names, totals, bias, strict=True)}
                ascii_letter = (data >= 65) & _words.IN_WORD[data] & (data < 128)
                lettered = _sums(ascii_letter, offsets) > 0
                for i in np.flatnonzero(~lettered):
                    lettered[i] = has_letter(texts[first + int(i)].as_py())
                if not families:
                    continue
                order = list(families)
                family, sure = winner(order, margins, n)
                for i, f in enumerate(order):
                    language, within = winner(families[f], margins, n)
                    rows = np.flatnonzero((family == i) & lettered)
                    languages[first + rows] = np.array(families[f], object)[language[rows]]
                    scores[first + rows] = (sure * within)[rows]
            keep = [i for i, f in enumerate(batch.schema) if f.name != "__text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), pa.array(languages, pa.string()), pa.array(scores)], [*(batch.schema.field(i).name for i in keep), "lang_pred", "score"])

    kept = docs.drop("lang_pred", "score", "__text")
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in kept.schema)
    return mapped(kept.withColumn("__text", F.col(text)), run, fields + "lang_pred string, score double")


def held_out(key: str = "doc_id") -> Column:
    """Whether the row must not be learned from; rows without an id are not held out, but they aren't learned from either."""
    return F.coalesce(crc_of_id(key) % 5 == 0, F.lit(False))


def fit_open(docs: DataFrame) -> Model:
    """fit() on the rows that are not held out."""
    return fit(docs.where(crc_of_id("doc_id") % 5 != 0))


def accept(docs: DataFrame, least_score: float = 0.2) -> DataFrame:
    """docs whose language a model fitted to their own open rows can tell, with the same columns: not `und`, and not below least_score."""
    whole = docs.select(F.struct(*docs.columns).alias("doc"), F.col("text"))
    told = predict(whole, fit_open(docs)).where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least_score))
    return told.select("doc.*")


def op4_language_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit_open(docs.select("doc_id", "text", "lang"))
    return predict(docs.select("doc_id", held_out().alias("held_out"), "text"), model).select("doc_id", "held_out", "lang_pred", "score")


QUERIES = {"op4_language_families": op4_language_families}
ORACLE: dict[str, str] = {}
