"""License notices by diagonal voting: rolling word k-gram hashes of texts meet template positions in a join, and offsets take votes."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import _words
from ._common import mapped, save

# The contract's phrases and labels.
PHRASES = [("gpl", "gnu general public license"), ("apache", "apache license"), ("cc-by", "cc by"), ("mit", "mit license")]
# Notices of public licenses, by labels of this operator's own.
NOTICES = [
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("mit-release", "released under the mit license"),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3"),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0"),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0"),
    ("mit-grant", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
]


@dataclass(frozen=True)
class Template:
    """exact: every gram must be on one diagonal (a phrase); else the share `least` of the words must stand near a diagonal, in order."""

    label: str
    text: str
    k: int
    exact: bool = False
    least: float = 1.0

    @property
    def words(self) -> list[bytes]:
        return _words.words(self.text)

    @property
    def grams(self) -> list[bytes]:
        w = self.words
        return [b" ".join(w[i : i + self.k]) for i in range(len(w) - self.k + 1)]


#: Notices of so many words or more take grams of four words and LEAST_SHARE of their words. In shorter ones each word tells (nc from sa,
#: one version from the next), so they need all, in grams of two; other words may stand between.
LONG, LEAST_SHARE = 18, 0.8
TEMPLATES = [*(Template(label, text, 2, True) for label, text in PHRASES), *(Template(label, text, 4, least=LEAST_SHARE) if len(text.split()) >= LONG else Template(label, text, 2) for label, text in NOTICES)]
#: Diagonals that differ by so many words at most, and whose votes are so many words apart at most, are one place.
SLACK, GAP = 4, 12


def in_order(votes: list[tuple[int, int]], k: int) -> int:
    """Words of a template that a text has in the same order, by votes (position in the text, in the template) of its k-word grams.

    It is the longest common subsequence that is made of whole grams and their overlaps: each vote gives min(k, words that it goes on in
    the text, words that it goes on in the template) after the best vote before it, so no word counts twice on either side."""
    best: list[tuple[int, int, int]] = []  # position in the text, in the template, words up to the vote
    ahead: dict[int, int] = {}  # by position in the template, the most words up to a vote that is k or more words back in the text
    done, most = 0, 0
    for pos, at in sorted(votes):
        while done < len(best) and best[done][0] <= pos - k:
            _, a, n = best[done]
            ahead[a] = max(ahead.get(a, 0), n)
            done += 1
        n = max([k, *(m + min(k, at - a) for a, m in ahead.items() if a < at), *(m + min(pos - p, at - a, k) for p, a, m in best[done:] if p < pos and a < at)])
        best.append((pos, at, n))
        most = max(most, n)
    return most


def spans(docs: DataFrame, templates: list[Template], key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each verified span: row, key, template (its index), label, exact, start and end (in words), share of the template's
    words; and a row for each document with template -1 and n_words.

    Every gram of every text meets the template positions in one broadcast join (templates are a driver-side list, so bounded): on the
    hash, and on the words themselves, which tasks attach to grams whose hash some template has, so no collision counts. Votes are
    counted by (document, template, text position - template position); neighbouring diagonals merge into places. An exact template's
    place must have all grams; another's is verified by in_order(): the share of its words that stand there in order, each once.
    Null texts have no words. Repeated rows are judged each. An empty table gives no rows. Other columns are ignored."""
    rows = [(int(h), gram.decode(), t, i) for t, x in enumerate(templates) for i, (h, gram) in enumerate(zip(_gram_hashes(x), x.grams, strict=True))]
    sizes = sorted({x.k for x in templates})
    known = np.array(sorted({h for h, *_ in rows}), np.int64)

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, offsets in _words.chunks(batch.column(2)):
                low = _words.LOWER[data].tobytes()
                starts, ends, at = _words.find(data, offsets)
                hashed = _words.hashes(data, starts, ends)
                begin = np.searchsorted(at, np.arange(end - first))
                counts = np.bincount(at, minlength=end - first)
                yield _batch(batch, np.arange(first, end), np.full(end - first, -1), counts.astype(np.int64), {})
                for k, places, h in _words.rollings(hashed, at, sizes):
                    h = h.view(np.int64)
                    hits = np.flatnonzero(known[np.minimum(np.searchsorted(known, h), len(known) - 1)] == h) if len(known) else np.zeros(0, np.int64)
                    places, h = places[hits], h[hits]
                    texts = {i: b" ".join(low[starts[j] : ends[j]] for j in range(p, p + k)) for i, p in enumerate(places.tolist())}
                    yield _batch(batch, first + at[places], places - begin[at[places]], h, texts)

    source = docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("k"), F.col(text).alias("t"))
    kind = docs.schema[key].dataType.simpleString()
    places = F.broadcast(docs.sparkSession.createDataFrame(rows, "hash long, gram string, template int, at int"))
    votes = mapped(source, grams, f"row long, k {kind}, pos long, hash long, gram string").join(places, ["hash", "gram"], "left")
    votes = votes.where("template is not null or pos = -1").select("row", "k", "pos", "at", F.coalesce("template", F.lit(-1)).alias("template"), F.when(F.col("pos") == -1, F.col("hash")).alias("n_words"))
    votes = save(votes, "votes").repartition("row")  # all that follows is by row and more

    facts = docs.sparkSession.createDataFrame([(i, x.label, x.exact, len(x.words), len(x.grams), x.k, x.least) for i, x in enumerate(templates)], "template int, label string, exact boolean, words int, grams int, size int, least double")
    diagonals = votes.groupBy("row", "k", "template", (F.col("pos") - F.col("at")).alias("diagonal")).agg(
        F.count("*").alias("n"), F.min("pos").alias("a"), F.max("pos").alias("b"), F.max("n_words").alias("n_words"), F.collect_list(F.when(F.col("template") >= 0, F.col("at"))).alias("ats")
    )
    diagonals = diagonals.join(F.broadcast(facts), "template", "left")
    order = Window.partitionBy("row", "template").orderBy("a", "diagonal")
    apart = F.col("exact") | (F.abs(F.col("diagonal") - F.lag("diagonal").over(order)) > SLACK) | (F.col("a") - F.lag("b").over(order) > GAP)
    merged = diagonals.withColumn("apart", F.coalesce(apart, F.lit(True)).cast("int")).withColumn("place", F.sum("apart").over(order))
    found = merged.groupBy("row", "k", "template", "place").agg(
        F.sum("n").alias("n"), F.min("a").alias("start"), F.max(F.col("b") + F.col("size")).alias("end"),
        *(F.first(c).alias(c) for c in ("label", "exact", "words", "grams", "size", "least")), F.first("n_words").alias("n_words"), F.collect_list(F.struct("diagonal", "ats")).alias("votes"),
    )
    # A place with fewer grams than its words need has too few words, whatever their order.
    found = found.where((F.col("template") == -1) | F.when(F.col("exact"), F.col("n") == F.col("grams")).otherwise(F.col("n") * F.col("size") >= F.col("least") * F.col("words")))
    out = mapped(found.drop("grams", "place"), _verify, f"row long, k {kind}, template int, n_words long, label string, exact boolean, start long, end long, least double, share double")
    return out.where((F.col("template") == -1) | (F.col("share") >= F.col("least"))).select("row", F.col("k").alias(key), "template", "label", "exact", "start", "end", "share", "n_words")


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Places with share instead of their votes: 1 for exact ones, null for those of no template."""
    for batch in batches:
        get = lambda name: batch.column(batch.schema.get_field_index(name))
        share: list[float | None] = [1.0 if exact else None for exact in get("exact").to_pylist()]
        kind, size, words, votes = get("exact").to_pylist(), get("size"), get("words"), get("votes")
        for i, exact in enumerate(kind):
            if exact is False:
                share[i] = in_order([(v["diagonal"] + at, at) for v in votes[i].as_py() for at in v["ats"]], size[i].as_py()) / words[i].as_py()
        names = ["row", "k", "template", "n_words", "label", "exact", "start", "end", "least"]
        yield pa.RecordBatch.from_arrays([*map(get, names), pa.array(share, pa.float64())], [*names, "share"])


def _gram_hashes(template: Template) -> np.ndarray:
    hashed = _words.hash_of(_words.words(template.text))
    return _words.rolling(hashed, np.zeros(len(hashed)), template.k)[1].view(np.int64)


def _batch(batch: pa.RecordBatch, rows: np.ndarray, pos: np.ndarray, hashed: np.ndarray, texts: dict[int, bytes]) -> pa.RecordBatch:
    size = np.zeros(len(rows), np.int32)
    for i, gram in texts.items():
        size[i] = len(gram)
    ends = np.concatenate([np.zeros(1, np.int32), np.cumsum(size, dtype=np.int32)])
    grams = pa.StringArray.from_buffers(len(rows), pa.py_buffer(ends.tobytes()), pa.py_buffer(b"".join(texts[i] for i in sorted(texts))))
    at = pa.array(rows)
    return pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(pos), pa.array(hashed), grams], ["row", "k", "pos", "hash", "gram"])


def scan(docs: DataFrame, templates: list[Template] = TEMPLATES, key: str = "doc_id", text: str = "text") -> DataFrame:
    """For each document its key, n_words, n_base, first_word, last_word, base_labels, labels and score: the exact templates' places,
    labels of those and of all verified spans (distinct, sorted, comma-joined), and the largest share of a template found (else 0)."""
    found = spans(docs, templates, key, text)
    base = F.col("exact")
    out = found.groupBy("row", key).agg(
        F.max("n_words").alias("n_words"), F.coalesce(F.sum(base.cast("long")), F.lit(0)).alias("n_base"),
        F.min(F.when(base, F.col("start"))).alias("first_word"), F.max(F.when(base, F.col("start"))).alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(base, F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"), F.coalesce(F.max("share"), F.lit(0.0)).alias("score"),
    )
    return out.drop("row")


def op1_license_diagonals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


SQL = (
    r"""
WITH RECURSIVE template(t, label, k, exact, least, text) AS (VALUES """
    + ", ".join(f"({i}, '{x.label}', {x.k}, {x.exact}, {x.least}, '{x.text}')" for i, x in enumerate(TEMPLATES))
    + rf"""
), doc AS (
  SELECT doc_id, row_number() OVER () AS r,
    coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents
), place AS (
  SELECT t, label, k, exact, least, p - 1 AS spot, len(w) AS words, len(w) - k + 1 AS grams, array_to_string(list_slice(w, p, p + k - 1), ' ') AS g
  FROM (SELECT *, string_split(text, ' ') AS w FROM template), LATERAL unnest(range(1, len(w) - k + 2)) u(p)
), gram AS (
  SELECT r, p - 1 AS pos, k, array_to_string(list_slice(w, p, p + k - 1), ' ') AS g
  FROM doc, (SELECT DISTINCT k FROM template) s, LATERAL unnest(range(1, len(w) - k + 2)) u(p)
), vote AS (
  SELECT r, t, label, exact, least, words, grams, k, pos, spot FROM gram JOIN place USING (k, g)
), diagonal AS (
  SELECT r, t, label, exact, least, words, grams, k, pos - spot AS d, count(*) AS n, min(pos) AS a, max(pos) AS b FROM vote GROUP BY ALL
), cut AS (
  SELECT *, coalesce((exact OR abs(d - lag(d) OVER o) > {SLACK} OR a - lag(b) OVER o > {GAP})::INT, 1) AS apart FROM diagonal WINDOW o AS (PARTITION BY r, t ORDER BY a, d)
), merged AS (
  SELECT *, sum(apart) OVER (PARTITION BY r, t ORDER BY a, d) AS place FROM cut
), near AS (
  SELECT r, t, place, merged.k, pos, spot FROM merged JOIN vote USING (r, t) WHERE NOT merged.exact AND vote.pos - vote.spot = merged.d
), chain AS (
  SELECT r, t, place, k, pos, spot, k AS n FROM near
  UNION
  SELECT c.r, c.t, c.place, c.k, v.pos, v.spot, c.n + least(c.k, v.pos - c.pos, v.spot - c.spot)
  FROM chain c JOIN near v ON v.r = c.r AND v.t = c.t AND v.place = c.place AND v.pos > c.pos AND v.spot > c.spot
), longest AS (
  SELECT r, t, place, max(n) AS n FROM chain GROUP BY ALL
), span AS (
  SELECT r, label, exact, min(a) AS s, CASE WHEN exact THEN 1 ELSE any_value(longest.n) / words END::DOUBLE AS share
  FROM merged LEFT JOIN longest USING (r, t, place) GROUP BY r, t, label, exact, least, words, grams, place
  HAVING CASE WHEN exact THEN sum(merged.n) = grams ELSE any_value(longest.n) / words >= least END
)
SELECT doc_id, len(any_value(w))::BIGINT AS n_words, (count(*) FILTER (WHERE exact))::BIGINT AS n_base,
  (min(s) FILTER (WHERE exact))::BIGINT AS first_word, (max(s) FILTER (WHERE exact))::BIGINT AS last_word,
  coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE exact), '') AS base_labels, coalesce(string_agg(DISTINCT label, ',' ORDER BY label), '') AS labels,
  coalesce(max(share), 0)::DOUBLE AS score
FROM doc LEFT JOIN span USING (r) GROUP BY r, doc_id
"""
)
QUERIES = {"op1_license_diagonals": op1_license_diagonals}
ORACLE = {"op1_license_diagonals": SQL}
