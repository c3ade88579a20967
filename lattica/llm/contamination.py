"""Benchmark decontamination: a generalised suffix automaton of the test items, through which the words of training texts stream."""

from __future__ import annotations

import pickle
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _words
from ._common import by_group, mapped, save

#: Words of items in one automaton, about: a task builds it, and it comes to some 7 MB of arrays.
WORDS_PER_AUTOMATON = 100_000
#: Automata through which texts stream in one pass: what goes through the driver and into a worker at once. More of them take more passes.
AUTOMATA_PER_PASS = 8
#: Low bits of window hashes that a pass looks at first.
LOW_BITS = 22


class Builder:
    """Suffix automaton of several word sequences. A state stands for the substrings that end at the same places of the items.

    A window is what counts as an occurrence: `window` consecutive words of an item, or a shorter item as a whole."""

    def __init__(self, items: Iterable[tuple[str, list[bytes]]], window: int):
        self.window = window
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        items = [(name, words) for name, words in items if words]
        self.number = {w: i for i, w in enumerate(sorted({w for _, words in items for w in words}))}
        coded = [(name, [self.number[w] for w in words]) for name, words in items]
        for _, ids in coded:
            last = 0
            for w in ids:
                last = self._extend(last, w)
        self.names = sorted({name for name, _ in coded})
        place = {name: i for i, name in enumerate(self.names)}
        self.whole: dict[int, list[tuple[int, int]]] = defaultdict(list)  # at a state: shorter items that end there, with their lengths
        self.items: dict[int, set[int]] = defaultdict(set)  # at the state of a full window: the items that have it
        for name, ids in coded:
            state = 0
            for i, w in enumerate(ids):
                state = self.next[state][w]
                if i + 1 >= window:
                    self.items[self._of_window(state)].add(place[name])
            if len(ids) < window and (len(ids), place[name]) not in self.whole[state]:
                self.whole[state].append((len(ids), place[name]))
        self.some_whole = bytearray(len(self.next))  # whether a shorter item ends at the state or at a suffix of it
        for state in sorted(range(1, len(self.next)), key=self.length.__getitem__):
            self.some_whole[state] = state in self.whole or self.some_whole[self.link[state]]
        self.windows: dict[int, np.ndarray] = {}  # by length, the sorted hashes of all windows
        for name, words in items:
            hashed = _words.hash_of(words)
            size = min(window, len(words))
            made = _words.rolling(hashed, np.zeros(len(hashed)), size)[1]
            self.windows[size] = np.concatenate([self.windows.get(size, np.zeros(0, np.uint64)), made])
        self.windows = {n: np.unique(h) for n, h in self.windows.items()}

    def _new(self, length: int, link: int, following: dict[int, int]) -> int:
        self.next.append(following)
        self.length.append(length)
        self.link.append(link)
        return len(self.next) - 1

    def _split(self, state: int, word: int, to: int) -> int:
        """A state for the short substrings of `to`, those that prolong `state` by the word."""
        clone = self._new(self.length[state] + 1, self.link[to], dict(self.next[to]))
        self.link[to] = clone
        while state >= 0 and self.next[state].get(word) == to:
            self.next[state][word] = clone
            state = self.link[state]
        return clone

    def _extend(self, last: int, word: int) -> int:
        if (to := self.next[last].get(word)) is not None:
            return to if self.length[to] == self.length[last] + 1 else self._split(last, word, to)
        made = self._new(self.length[last] + 1, 0, {})
        while last >= 0 and word not in self.next[last]:
            self.next[last][word] = made
            last = self.link[last]
        if last >= 0:
            to = self.next[last][word]
            self.link[made] = to if self.length[to] == self.length[last] + 1 else self._split(last, word, to)
        return made

    def _of_window(self, state: int) -> int:
        while self.length[self.link[state]] >= self.window:
            state = self.link[state]
        return state

    def packed(self) -> bytes:
        """The automaton as arrays: steps sorted by state and word, and each window state's items one after the other."""
        n_words = max(1, len(self.number))
        steps = sorted((state * n_words + w, to) for state, following in enumerate(self.next) for w, to in following.items())
        states = sorted(self.items)
        cuts = np.cumsum([0, *(len(self.items[s]) for s in states)]).astype(np.int32)
        fields = {
            "window": self.window, "vocabulary": b" ".join(self.number), "names": self.names, "whole": dict(self.whole), "some_whole": bytes(self.some_whole),
            "keys": np.array([k for k, _ in steps], np.int64), "targets": np.array([t for _, t in steps], np.int32), "link": np.array(self.link, np.int32),
            "length": np.array(self.length, np.int32), "states": np.array(states, np.int32), "cuts": cuts,
            "items": np.array([i for s in states for i in sorted(self.items[s])], np.int32), "windows": self.windows,
        }
        return pickle.dumps(fields, 5)


class Automaton:
    """A packed suffix automaton. Words are looked up by their bytes, so no hash decides what occurs."""

    def __init__(self, packed: bytes):
        f = pickle.loads(packed)
        self.window, self.names, self.whole, self.some_whole, self.windows = f["window"], f["names"], f["whole"], f["some_whole"], f["windows"]
        self.number = {w: i for i, w in enumerate(f["vocabulary"].split(b" "))} if f["vocabulary"] else {}
        self.n_words = max(1, len(self.number))
        self.keys, self.targets, self.link, self.length, self.states, self.cuts, self.items = (memoryview(f[x]) for x in ("keys", "targets", "link", "length", "states", "cuts", "items"))

    def _step(self, state: int, word: int) -> int:
        """The next state, or -1."""
        key = state * self.n_words + word
        at = bisect_left(self.keys, key)
        return self.targets[at] if at < len(self.keys) and self.keys[at] == key else -1

    def stream(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """(start, end) of each occurrence of a window in the words, and the items whose windows occur."""
        spans, found, state, matched = [], set(), 0, 0
        for at, text in enumerate(words):
            w = self.number.get(text, -1)
            to = self._step(state, w) if w >= 0 else -1
            while to < 0 and state:
                state = self.link[state] if w >= 0 else 0
                matched = self.length[state]
                to = self._step(state, w) if w >= 0 else -1
            if to < 0:
                continue
            state, matched = to, matched + 1
            if matched >= self.window:
                spans.append((at + 1 - self.window, at + 1))
                full = state
                while self.length[self.link[full]] >= self.window:
                    full = self.link[full]
                i = bisect_left(self.states, full)
                found.update(self.items[self.cuts[i] : self.cuts[i + 1]])
            suffix = state
            while suffix > 0 and self.some_whole[suffix]:
                for size, item in self.whole.get(suffix, ()):
                    if size <= matched:
                        spans.append((at + 1 - size, at + 1))
                        found.add(item)
                suffix = self.link[suffix]
        return spans, {self.names[i] for i in found}


class Matcher:
    """Some automata, and arrays of their windows' hashes that tell where a window may be."""

    def __init__(self, automata: list[bytes]):
        self.automata = [Automaton(a) for a in automata]
        self.windows: dict[int, np.ndarray] = {}
        for n in sorted({n for a in self.automata for n in a.windows}):
            self.windows[n] = np.unique(np.concatenate([a.windows[n] for a in self.automata if n in a.windows]))
        self.low = np.zeros(1 << LOW_BITS, bool)
        for hashed in self.windows.values():
            self.low[(hashed >> np.uint64(64 - LOW_BITS)).astype(np.int64)] = True

    def stretches(self, hashed: np.ndarray, rows: np.ndarray) -> Iterator[tuple[Automaton, int, int]]:
        """(automaton, first word, end): longest stretches that places of its windows cover, by hash; every place of a window is in one."""
        places = []
        for n, at, h in _words.rollings(hashed, rows, self.windows):
            maybe = np.flatnonzero(self.low[(h >> np.uint64(64 - LOW_BITS)).astype(np.int64)])
            maybe = maybe[_among(h[maybe], self.windows[n])]
            if len(maybe):
                places.append((n, at[maybe], h[maybe]))
        for a in self.automata if places else []:
            own = [(at[_among(h, a.windows[n])], n) for n, at, h in places if n in a.windows]
            starts = np.concatenate([at for at, _ in own] or [np.zeros(0, np.int64)])
            ends = np.concatenate([at + n for at, n in own] or [np.zeros(0, np.int64)])
            order = np.argsort(starts, kind="stable")
            for x, y in _merged(zip(starts[order].tolist(), ends[order].tolist(), strict=True), rows):
                yield a, x, y


def _among(x: np.ndarray, known: np.ndarray) -> np.ndarray:
    return known[np.minimum(np.searchsorted(known, x), len(known) - 1)] == x if len(known) else np.zeros(len(x), bool)


def _merged(spans: Iterable[tuple[int, int]], rows: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Spans that overlap or touch as one, unless rows says that they are of different rows."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1] and (rows is None or rows[a] == rows[out[-1][0]]):
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


SPANS = "array<struct<start: long, end: long, first_byte: long, end_byte: long>>"
HITS = f"n_words long, n_hit long, spans {SPANS}, items array<string>"
SPAN_TYPE = pa.list_(pa.struct([(x, pa.int64()) for x in ("start", "end", "first_byte", "end_byte")]))


def automata(items: DataFrame, window: int, item: str = "item_id", text: str = "text") -> DataFrame:
    """(g, packed): automata over all items, each of some WORDS_PER_AUTOMATON words and built in a task of its own; a saved table.

    Long items are cut into parts that overlap by window - 1 words, so each window is whole in one of them."""
    most = max(WORDS_PER_AUTOMATON // 4, 2 * window)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for name, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words = _words.words(value.as_py())
                for s in range(0, max(1, len(words) - window + 1), most - window + 1) if words else ():
                    rows.append((name or "", words[s : s + most]))
            yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in rows], pa.string()), pa.array([b" ".join(w) for _, w in rows], pa.binary()), pa.array([len(w) for _, w in rows], pa.int64())], ["item", "words", "n"])

    parts = save(mapped(items.select(F.col(item).cast("string"), F.col(text)), cut, "item string, words binary, n long"), "items")
    groups = -(-(parts.agg(F.sum("n")).first()[0] or 0) // WORDS_PER_AUTOMATON)
    dealt = parts.withColumn("g", F.pmod(F.xxhash64("item", "words"), F.lit(max(1, groups))).cast("int"))

    def build(group: pa.Table) -> pa.Table:
        pairs = [(name, words.split(b" ")) for name, words in zip(group.column("item").to_pylist(), group.column("words").to_pylist(), strict=True)]
        return pa.table({"g": group.column("g").slice(0, 1), "packed": pa.array([Builder(pairs, window).packed()], pa.binary())})

    return save(by_group(dealt, ["g"], build, "g int, packed binary"), "automata")


def find(docs: DataFrame, items: DataFrame, window: int = 13, text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """docs with n_words, n_hit (words inside some occurrence of a window), spans (merged, in words and in bytes of the text) and items
    (ids whose windows occur, as strings, sorted); columns with these names are replaced.

    A window is `window` consecutive words of an item, or an item of fewer words (not none) as a whole. Texts are streamed where they
    are, without a shuffle, through AUTOMATA_PER_PASS automata at a time. One pass does for up to 800,000 item words; if there are
    more, a numbered copy of docs is saved, and what further passes find, hits alone, is joined to it. A null text has no words. Items
    with null text count for nothing, null ids are written as "". Repeated rows are judged each; empty tables on either side give no
    hits."""
    built = automata(items, window, item, item_text)
    names = sorted(r["g"] for r in built.select("g").collect())
    passes = [names[i : i + AUTOMATA_PER_PASS] for i in range(0, len(names), AUTOMATA_PER_PASS)] or [[]]
    source = docs.drop("n_words", "n_hit", "spans", "items", "__text", "__row").withColumn("__text", docs[text])
    if len(passes) == 1:
        return _passed(source, built, passes[0])
    source = save(source.withColumn("__row", F.monotonically_increasing_id()), "numbered")
    more = [_passed(source.select("__row", "__text"), built, p).where("n_hit > 0") for p in passes[1:]]
    more = save(reduce_union(more).groupBy("__row").agg(F.flatten(F.collect_list("spans")).alias("more"), F.flatten(F.collect_list("items")).alias("others")), "hits")
    both = _passed(source, built, passes[0]).join(more, "__row", "left")
    return _joined(both.drop("__row"))


def reduce_union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _passed(source: DataFrame, built: DataFrame, names: list[int]) -> DataFrame:
    """source without __text and with HITS by these automata."""
    packed = [r["packed"] for r in built.where(F.col("g").isin(names)).select("packed").collect()] if names else []  # AUTOMATA_PER_PASS rows at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(packed)
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("__text"))
            n_words, n_hit, spans, names = (np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64), [[]] * batch.num_rows, [[]] * batch.num_rows)
            for first, end, data, offsets in _words.chunks(texts):
                starts, ends, rows = _words.find(data, offsets)
                n_words[first:end] = np.bincount(rows, minlength=end - first)
                begin = np.searchsorted(rows, np.arange(end - first))
                found: dict[int, tuple[list, set]] = defaultdict(lambda: ([], set()))
                for automaton, a, b in matcher.stretches(_words.hashes(data, starts, ends), rows):
                    words = [_words.LOWER[data[starts[i] : ends[i]]].tobytes() for i in range(a, b)]
                    hits, which = automaton.stream(words)
                    if hits:
                        found[int(rows[a])][0].extend((x + a, y + a) for x, y in hits)
                        found[int(rows[a])][1].update(which)
                for row, (hits, which) in found.items():
                    merged = _merged(hits)
                    n_hit[first + row] = sum(b - a for a, b in merged)
                    base, byte = int(begin[row]), int(offsets[row])
                    spans[first + row] = [{"start": a - base, "end": b - base, "first_byte": int(starts[a]) - byte, "end_byte": int(ends[b - 1]) - byte} for a, b in merged]
                    names[first + row] = sorted(which)
            columns = [batch.column(i) for i, f in enumerate(batch.schema) if f.name != "__text"]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(n_words), pa.array(n_hit), pa.array(spans, SPAN_TYPE), pa.array(names, pa.list_(pa.string()))],
                [*(f.name for f in batch.schema if f.name != "__text"), "n_words", "n_hit", "spans", "items"],
            )

    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in source.schema if f.name != "__text")
    return mapped(source, run, fields + HITS)


def _joined(both: DataFrame) -> DataFrame:
    """HITS of the first pass together with `more` spans and `others`, items, of further passes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            get = lambda name: batch.column(batch.schema.get_field_index(name)).to_pylist()
            n_hit, spans, items = get("n_hit"), get("spans"), get("items")
            for i, (more, others) in enumerate(zip(get("more"), get("others"), strict=True)):
                if more:
                    byte = {s["start"]: s["first_byte"] for s in [*spans[i], *more]} | {-s["end"]: s["end_byte"] for s in [*spans[i], *more]}
                    merged = _merged((s["start"], s["end"]) for s in [*spans[i], *more])
                    n_hit[i] = sum(b - a for a, b in merged)
                    spans[i] = [{"start": a, "end": b, "first_byte": byte[a], "end_byte": byte[-b]} for a, b in merged]
                    items[i] = sorted({*items[i], *others})
            kept = [f.name for f in batch.schema if f.name not in ("n_hit", "spans", "items", "more", "others")]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(n)) for n in kept), pa.array(n_hit, pa.int64()), pa.array(spans, SPAN_TYPE), pa.array(items, pa.list_(pa.string()))], [*kept, "n_hit", "spans", "items"])

    kept = both.drop("n_hit", "spans", "items", "more", "others")
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in kept.schema)
    return mapped(both, run, fields + f"n_hit long, spans {SPANS}, items array<string>").select(*kept.columns, "n_hit", "spans", "items")


def contaminated(max_share: float = 0.05) -> Column:
    """The rule on find()'s columns: some word is hit, and the hit words are at least max_share of all, in whole numbers: 0.05 is 1/20."""
    share = Fraction(str(max_share))
    return (F.col("n_hit") > 0) & (F.col("n_hit") * share.denominator >= F.col("n_words") * share.numerator)


#: What stands for a removed span: a word of its own, so that the words around it don't become neighbours.
MARK = " \u2026 "


def remove(docs: DataFrame, items: DataFrame, window: int = 13, max_share: float = 0.05, max_words: int | None = None, text: str = "text") -> DataFrame:
    """docs without their contaminated rows, with the same columns. With max_words, what stays has MARK in place of each span of more
    words than that, and is as it was around it. Null texts stay."""
    whole = docs.select(F.struct(*docs.columns).alias("doc"), F.col(text).alias("body"))
    clean = find(whole, items, window, "body").where(~F.coalesce(contaminated(max_share), F.lit(False)))
    if max_words is not None:
        long = F.filter("spans", lambda s: s["end"] - s["start"] > max_words)
        clean = clean.withColumn("doc", F.col("doc").withField(f"`{text}`", _cut(F.col("body"), long)))
    return clean.select("doc.*")


def _cut(text: Column, spans: Column) -> Column:
    octets = F.encode(text, "UTF-8")
    piece = lambda a, n: F.decode(F.substring(octets, (a + 1).cast("int"), n.cast("int")), "UTF-8")
    firsts = F.concat(F.array(F.lit(0).cast("long")), F.transform(spans, lambda s: s["end_byte"]))
    ends = F.concat(F.transform(spans, lambda s: s["first_byte"]), F.array(F.octet_length(text).cast("long")))
    return F.when(F.size(spans) > 0, F.array_join(F.transform(firsts, lambda a, i: piece(a, F.get(ends, i) - a)), MARK)).otherwise(text)


def op6_suffix_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    hits = find(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    digest = F.sha2(F.array_join("items", ","), 256)
    rule = (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))
    return hits.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), digest.alias("items_sha256"), rule.alias("contaminated"))


SQL = r"""
WITH item AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), doc AS (
  SELECT doc_id, row_number() OVER () AS r,
    coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents
), win AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(list_slice(w, p, p + least(13, len(w)) - 1), ' ') AS g
  FROM item, LATERAL unnest(range(1, greatest(len(w) - 12, 1) + 1)) t(p) WHERE len(w) > 0
), gram AS (
  SELECT r, n, p, array_to_string(list_slice(w, p, p + n - 1), ' ') AS g
  FROM doc, (SELECT DISTINCT n FROM win) s, LATERAL unnest(range(1, len(w) - n + 2)) t(p)
), hit AS (
  SELECT r, p, gram.n AS n, item_id FROM gram JOIN win ON gram.g = win.g AND gram.n = win.n
), hit_words AS (
  SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT DISTINCT r, p, n FROM hit), LATERAL unnest(range(p, p + n)) t(q) GROUP BY r
), hit_items AS (
  SELECT r, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS s FROM (SELECT DISTINCT r, item_id::VARCHAR AS i FROM hit) GROUP BY r
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM doc LEFT JOIN hit_words USING (r) LEFT JOIN hit_items USING (r)
"""
QUERIES = {"op6_suffix_automaton": op6_suffix_automaton}
ORACLE = {"op6_suffix_automaton": SQL}
