"""Near-duplicate documents: BagMinHash signatures of word shingles with their counts, bands, and exact multiset overlap."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _words
from ._common import by_group, components, mapped, save, small

SHINGLE, SIMILARITY = 5, 0.8
#: Bands of registers: two texts of similarity 0.8 miss each other in all bands with probability 5e-6.
BANDS, ROWS = 40, 6
#: Events that the processes of a batch make at once, unless there are more processes.
EVENTS = 20_000
#: What a task holds of one group of candidates, about: larger groups become blocks.
BLOCK_TEXTS, BLOCK_SHINGLES = 100, 400_000
#: What a task holds, of each side, when texts outside a group's largest class meet the others; and sets compared by one product of matrices.
PART_SHINGLES, TILE = 1_000_000, 1024
#: Counters (a power of two) that estimate how often the large groups have their shingles; they go through the driver.
COUNTERS = 1 << 20


def shingles(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(rows, hashes, counts) of each row's distinct shingles, and (n_words, sequence hash) of each row.

    A shingle is k consecutive words; a row of fewer words, but not none, is one shingle."""
    n = len(offsets) - 1
    starts, ends, at = _words.find(data, offsets)
    hashed = _words.hashes(data, starts, ends)
    n_words = np.bincount(at, minlength=n)
    places, grams = _words.rolling(hashed, at, k)
    rows = at[places]
    first = np.searchsorted(at, np.arange(n + 1))
    with np.errstate(over="ignore"):
        index = (np.arange(len(hashed)) - first[at]).astype(np.uint64)
        placed = np.concatenate([[np.uint64(0)], np.cumsum(_words.mix(hashed + index * _words.STEP))])
        sequence = _words.mix(placed[first[1:]] - placed[first[:-1]] + n_words.astype(np.uint64))
    short = np.flatnonzero((n_words > 0) & (n_words < k))
    if len(short):
        rows, grams = np.concatenate([rows, short]), np.concatenate([grams, sequence[short]])
    order = np.lexsort((grams, rows))
    rows, grams = rows[order], grams[order]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:] != rows[:-1]) | (grams[1:] != grams[:-1])
    cuts = np.flatnonzero(new)
    return rows[cuts], grams[cuts], np.diff(np.append(cuts, len(rows))), n_words, sequence


def signatures(rows: np.ndarray, hashed: np.ndarray, counts: np.ndarray, n: int, size: int) -> np.ndarray:
    """BagMinHash: `size` registers for each of n rows, equal in a register with probability the rows' weighted Jaccard similarity.

    The weights from 0 on are cut into [0, 1), [1, 2), [2, 4), [4, 8) and so on. Each shingle has in each cut a Poisson process of
    events that its hash fixes: a time, with a rate in proportion to the cut's width; a register; and a place in the cut, by halves,
    down to one unit. A register keeps the first event below the row's count of the shingle. Events come in order of time, so a
    process ends as soon as its time is above all of the row's registers: few events are made besides the first ones, and a count of a
    million costs twenty processes."""
    levels = np.where(counts > 1, np.ceil(np.log2(np.maximum(counts, 1))).astype(np.int64), 0) + 1
    rows, weight = np.repeat(rows, levels), np.repeat(counts, levels)
    level = np.arange(len(rows)) - np.repeat(np.cumsum(levels) - levels, levels)
    low = np.where(level == 0, 0, 1 << np.maximum(level - 1, 0))
    width = np.maximum(low, 1)
    out, last = np.full(n * size, np.inf), np.full(n, np.inf)
    table = out.reshape(n, size)
    with np.errstate(over="ignore"):
        seed = _words.mix(np.repeat(hashed, levels) + level.astype(np.uint64) * np.uint64(0xA24BAED4963EE407))
        time = np.zeros(len(rows))
        step = 0
        while len(rows):
            # Once few processes go on, each makes some of its next events at once; more than it needs changes nothing.
            more = max(1, min(64, EVENTS // len(rows)))
            bits = _words.mix(seed[:, None] + np.arange(step + 1, step + more + 1, dtype=np.uint64)[None, :] * _words.STEP)
            wait = -np.log((np.float64(0.5) + (bits >> np.uint64(11)).astype(np.float64)) / (1 << 53)) / width[:, None]
            times = np.add.accumulate(np.concatenate([time[:, None], wait], axis=1), axis=1)[:, 1:]
            other = _words.mix(bits ^ np.uint64(0xD1B54A32D192ED03))
            register = ((other & np.uint64(0xFFFFFFFF)) * np.uint64(size)) >> np.uint64(32)
            spot = low[:, None] + (((other >> np.uint64(32)) * width[:, None].astype(np.uint64)) >> np.uint64(32)).astype(np.int64)
            counted = spot < weight[:, None]
            np.minimum.at(out, (rows[:, None] * size + register.astype(np.int64))[counted], times[counted])
            step, time = step + more, times[:, -1]
            live = rows[np.flatnonzero(np.diff(rows, prepend=-1))]  # rows stay in order
            last[live] = table[live].max(axis=1)
            go = time < last[rows]
            rows, weight, low, width, seed, time = rows[go], weight[go], low[go], width[go], seed[go], time[go]
    return table


def band_keys(signature: np.ndarray, bands: int) -> np.ndarray:
    """A 64-bit key for each row and band."""
    bits = np.ascontiguousarray(signature).view(np.uint64).reshape(len(signature), bands, -1)
    with np.errstate(over="ignore"):
        key = np.arange(bands, dtype=np.uint64)[None, :] * _words.STEP + np.uint64(1)
        for r in range(bits.shape[2]):
            key = _words.mix(key * np.uint64(0xA0761D6478BD642F) + bits[:, :, r])
    return key.view(np.int64)


def _signed(docs: DataFrame, k: int, bands: int, rows: int) -> DataFrame:
    """d, n_words, digest (of the words in order) and keys (of the bands; null without words) for each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, offsets in _words.chunks(batch.column(1)):
                n = end - first
                at, grams, counts, n_words, _ = shingles(data, offsets, k)
                keys = band_keys(signatures(at, grams, counts, n, bands * rows), bands)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * bands), pa.array(keys.ravel()), mask=pa.array(n_words == 0))
                digests = pa.array(_words.digests(data, offsets), pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, n), pa.array(n_words.astype(np.int64)), digests, lists], ["d", "n_words", "digest", "keys"])

    return mapped(docs, run, "d long, n_words long, digest binary, keys array<long>")


def _overlap(a: set, b: set, least: float) -> bool:
    """Whether two multisets, as sets of (shingle, copy), have that similarity at least."""
    small_, large = (a, b) if len(a) < len(b) else (b, a)
    if len(small_) < least * len(large):
        return False
    both = len(small_ & large)
    return both >= least * (len(a) + len(b) - both) - 1e-9


def _expanded(grams: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A number for each shingle and copy of it."""
    copy = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)
    with np.errstate(over="ignore"):
        return _words.mix(np.repeat(grams, counts) + copy.astype(np.uint64) * np.uint64(0xE7037ED1A0B428DB)).view(np.int64)


def _linked(sets: list[set], start: list[int], pairs: Iterator[tuple[int, int]], least: float) -> list[tuple[int, int]]:
    """Links (i, j) that join the groups of start (a group's number for each set) as far as pairs of sets are similar."""
    root = list(range(max(start, default=-1) + 1))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    for i, j in pairs:
        a, b = find(start[i]), find(start[j])
        if a != b and _overlap(sets[i], sets[j], least):
            root[max(a, b)] = min(a, b)
            out.append((i, j))
    return out


def classes(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = SHINGLE, similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """key, n_words, text_class, class_id and kept for every document.

    text_class is the least key of the documents with the same words in the same order; class_id the least key that can be reached over
    links, which are pairs of texts whose multisets of k-word shingles have a weighted Jaccard similarity of at least `similarity`, among
    those that agree in some band; kept tells whether key = class_id. Words are those of _words; texts of fewer than k words are one
    shingle; texts without words, or null, and null keys, are classes of their own. Repeated rows (same key and text) share a class and are all
    marked alike; a key with several texts joins their classes. An empty table gives no rows; other columns are ignored.

    Copies, by a 128-bit digest of their words, are reduced to one text before anything else. A bucket (texts with one band key) is
    never expanded: its texts link to its least one in a graph of candidates, whose components are the groups to verify. In a group of
    one block every pair of texts not yet joined is compared exactly, in a task. A larger group is cut into blocks, and dealt anew into
    other ones, which join the classes of the first; then the texts still outside its largest class meet all its texts, in parts of
    PART_SHINGLES. If there are too many of those for one part, the group is split first, see prefixes(): texts that only share
    boilerplate fall apart, as no pair of them can be similar enough. So a text is shuffled with its shingles twice, and once more for
    each part of a group that no filter could split; no pair of one group is missed."""
    source = docs.select(F.col(key).cast("long").alias("d"), F.col(text).alias("t"))
    signed = save(_signed(source, k, bands, rows), "signed")
    worded = signed.where("keys is not null and d is not null")
    texts = save(worded.groupBy("digest").agg(F.min("d").alias("c"), F.first("keys").alias("keys")), "texts")
    groups = _groups(texts.select("c", F.explode("keys").alias("key")))

    found = verified(source, groups, k, similarity)
    told = texts.select("digest", F.col("c").alias("text_class")).join(found.withColumnsRenamed({"node": "text_class"}), "text_class", "left")
    told = save(told, "told")  # a table of its own, so that adaptive execution can split the rows of a much copied text
    out = signed.join(told, "digest", "left").withColumn("plain", F.col("keys").isNull() | F.col("d").isNull())
    own = lambda column: F.when(F.col("plain"), F.col("d")).otherwise(column)
    out = out.select(F.col("d").alias(key), "n_words", own(F.col("text_class")).alias("text_class"), own(F.coalesce("component", "text_class")).alias("class_id"))
    return out.withColumn("kept", F.col(key).eqNullSafe(F.col("class_id")))


def _groups(keyed: DataFrame) -> DataFrame:
    """(c, g): texts c that share a key, directly or over others, are of one group g, their least one; texts that share none are absent.

    keyed has c and key, and is read twice. A bucket is a star around its least text, so it costs a row for each text."""
    buckets = keyed.groupBy("key").agg(F.min("c").alias("m"), F.max("c").alias("x")).where("m < x").select("key", "m")
    near = keyed.join(small(save(buckets, "buckets")), "key").where("c <> m").select(F.col("c").alias("a"), F.col("m").alias("b")).distinct()
    return save(components(save(near, "near")).withColumnsRenamed({"node": "c", "component": "g"}), "groups")


def _blocks(sets: DataFrame) -> DataFrame:
    """(g, blocks) of sets' groups, saved."""
    weights = sets.groupBy("g").agg(F.sum("size").alias("total"), F.count("*").alias("n"))
    blocks = F.greatest(F.ceil(F.col("total") / BLOCK_SHINGLES), F.ceil(F.col("n") / BLOCK_TEXTS)).cast("int")
    return save(weights.select("g", blocks.alias("blocks")), "blocks")


def _outside(sets: DataFrame) -> DataFrame:
    """For each group with texts outside its largest component (main): in how many parts those go, and all of them; a saved table."""
    sizes = save(sets.groupBy("g", "component").agg(F.count("*").alias("n"), F.sum("size").alias("total")), "sizes")
    order = F.struct("n", "component")
    main = sizes.groupBy("g").agg(F.max_by("component", order).alias("main"), F.max_by("total", order).alias("inside"), F.sum("total").alias("total"))
    parts = lambda total: F.ceil(total / PART_SHINGLES).cast("int")
    return save(main.where("total > inside").select("g", "main", parts(F.col("total") - F.col("inside")).alias("lefts"), parts(F.col("total")).alias("rights")), "main")


def prefixes(sets: DataFrame, similarity: float) -> DataFrame:
    """(c, key): two texts of a group g whose similarity is at least `similarity` have a key in common, surely; few others do.

    Two multisets of sizes x and y need an overlap of similarity / (1 + similarity) * (x + y). So, with all shingles in one order, the
    first x - overlap + 1 of one and y - overlap + 1 of the other have one in common. The order is by how often a group has a shingle,
    rarest first, so what comes first is a text's own, not boilerplate. How often is estimated by COUNTERS counters, whatever the
    input, as the order need not be exact, only the same for all. A size has a class, some per cent wide; a text gives keys for each
    class that a partner may have, with the prefix that this class needs."""
    step = -math.log(similarity) / 8

    def counter(tokens: np.ndarray, g: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (_words.mix(tokens + _words.mix(np.array([g]).astype(np.uint64))) >> np.uint64(64 - COUNTERS.bit_length() + 1)).astype(np.int64)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            for i in range(batch.num_rows):
                tokens = batch.column(1)[i].values.to_numpy().view(np.uint64)
                np.add.at(seen, counter(tokens, batch.column(0)[i].as_py()), 1)
        some = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(seen[some])], ["counter", "n"])

    counted = mapped(sets.select("g", "shingles"), count, "counter long, n long").groupBy("counter").agg(F.sum("n").alias("n")).toArrow()
    often = np.zeros(COUNTERS, np.int64)  # COUNTERS rows at most came back
    often[counted.column("counter").to_numpy()] = counted.column("n").to_numpy()

    def keys(c: int, g: int, tokens: np.ndarray) -> np.ndarray:
        size = len(tokens)
        if not size:
            return np.zeros(0, np.uint64)
        n = often[counter(tokens, g)]
        order = np.lexsort((_words.mix(tokens), n))
        tokens, n = tokens[order], n[order]
        own, out = math.floor(math.log(size) / step + 1e-9), []
        for other in range(own - 9, own + 10):
            least = max(math.ceil(similarity * size - 1e-6), math.floor(math.exp(other * step)) - 1)
            most = min(math.floor(size / similarity + 1e-6), math.ceil(math.exp((other + 1) * step)) + 1)
            length = size - math.ceil(similarity / (1 + similarity) * (size + least) - 1e-6) + 1
            if least > most or length <= 0:
                continue
            shared = tokens[:length][n[:length] > 1]  # a shingle of this text only joins nothing
            with np.errstate(over="ignore"):
                classes = _words.mix(np.array([min(own, other) * 4096 + max(own, other), g]).astype(np.uint64))
                out.append(_words.mix(shared ^ (classes[0] + _words.mix(classes[1:])[0])))
        return np.unique(np.concatenate(out)) if out else np.zeros(0, np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                c, g = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                made = keys(c, g, batch.column(2)[i].values.to_numpy().view(np.uint64)).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(made), c, np.int64)), pa.array(made)], ["c", "key"])

    return mapped(sets.select("c", "g", "shingles"), run, "c long, key long")


def verified(source: DataFrame, groups: DataFrame, k: int, similarity: float) -> DataFrame:
    """(node, component) over exact links between texts c of a group g. source has d and t."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, offsets in _words.chunks(batch.column(2)):
                at, grams, counts, _, _ = shingles(data, offsets, k)
                cuts = np.searchsorted(at, np.arange(end - first + 1))
                sets = [_expanded(grams[a:b], counts[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]
                sizes = pa.array(np.array([len(s) for s in sets], np.int64))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, end - first), batch.column(1).slice(first, end - first), sizes, pa.array(sets, pa.list_(pa.int64()))], ["c", "g", "size", "shingles"]
                )

    # One row for each candidate text: documents of one key are alike for this, whichever comes first.
    wanted = source.join(small(groups), source["d"] == groups["c"]).select("c", "g", "t")
    sets = mapped(wanted, run, "c long, g long, size long, shingles array<long>")
    sets = save(sets, "shingles")
    blocks = _blocks(sets)
    sets = sets.join(small(blocks), "g")

    def linked(group: pa.Table) -> pa.Table | None:
        """Links between texts of different classes."""
        c, component = (group.column(x).to_pylist() for x in ("c", "component"))
        if len(set(component)) < 2:
            return None
        own = [set(x) for x in group.column("shingles").to_pylist()]
        number = {x: i for i, x in enumerate(sorted(set(component)))}
        pairs = ((j, i) for i in range(len(c)) for j in range(i))
        out = _linked(own, [number[x] for x in component], pairs, similarity)
        return pa.table({"a": [c[i] for i, _ in out], "b": [c[j] for _, j in out]}, schema=EDGE)

    def dealt(rows: DataFrame, salt: int) -> DataFrame:
        rows = rows.withColumn("block", F.pmod(F.xxhash64("c", F.lit(salt)), F.col("blocks")).cast("int"))
        return by_group(rows.select("g", "block", "c", "component", "shingles"), ["g", "block"], linked, "a long, b long")

    edges = save(dealt(sets.withColumn("component", F.col("c")), 0), "links")
    found = components(edges)
    large = sets.where("blocks > 1")
    if not large.limit(1).count():
        return found
    classed = lambda rows: rows.join(small(found).withColumnRenamed("node", "c"), "c", "left").withColumn("component", F.coalesce("component", "c"))
    edges = edges.unionByName(save(dealt(classed(large), 1), "links"))
    found = components(edges)

    # Texts outside a large group's largest class, in parts, meet all of the group's texts, in parts too.
    main = _outside(classed(large))
    wide = save(main.where("lefts > 1").select("g"), "wide")
    if wide.limit(1).count():  # too many to meet all others: split such groups first
        split = _groups(save(prefixes(large.join(small(wide), "g"), similarity), "prefixes"))
        large = large.join(small(wide), "g", "left_anti").unionByName(large.join(small(wide), "g").drop("g").join(small(split), "c"))
        main = _outside(classed(large))
    rest = classed(large).join(small(main), "g").withColumn("outside", F.col("component") != F.col("main"))
    every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    one = lambda n, salt: F.pmod(F.xxhash64("c", F.lit(salt)), F.col(n)).cast("int")
    sent = rest.where("outside").withColumn("part", one("lefts", 2)).withColumn("block", F.explode(every("rights"))).select("g", "block", "part", "c", "component", "outside", "shingles")
    met = rest.withColumn("outside", F.lit(False)).withColumn("block", one("rights", 0)).withColumn("part", F.explode(every("lefts"))).select(*sent.columns)

    def met_by_others(group: pa.Table) -> pa.Table | None:
        outside = group.column("outside").to_numpy(zero_copy_only=False)
        c, component = group.column("c").to_numpy(), group.column("component").to_numpy()
        tokens = group.column("shingles").combine_chunks()
        cuts, tokens = tokens.offsets.to_numpy(), tokens.values.to_numpy()
        a, b = links_between(tokens, cuts, np.flatnonzero(outside), np.flatnonzero(~outside), component, similarity)
        return pa.table({"a": c[a], "b": c[b]}, schema=EDGE) if len(a) else None

    more = save(by_group(sent.unionByName(met), ["g", "block", "part"], met_by_others, "a long, b long"), "links")
    return components(edges.unionByName(more))


def links_between(tokens: np.ndarray, cuts: np.ndarray, left: np.ndarray, right: np.ndarray, component: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """(a, b), places of links between left and right sets that join the components as far as pairs are similar.

    Set i is tokens[cuts[i] : cuts[i + 1]]. Overlaps of a tile of sets are a product of two matrices that tell which set has which token,
    some columns at a time, so exact comparison of all pairs costs little memory and some tenths of a microsecond a pair."""
    _, column = np.unique(tokens, return_inverse=True)
    _, label = np.unique(component, return_inverse=True)
    size, label = np.diff(cuts), label.copy()
    made_a, made_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]

    def dense(rows: np.ndarray, place: np.ndarray, n: int) -> np.ndarray:
        at = np.repeat(np.arange(len(rows)), size[rows])
        own = np.concatenate([place[column[cuts[r] : cuts[r + 1]]] for r in rows])
        out = np.zeros((len(rows), n + 1), np.float32)  # the last column takes what is not wanted
        out[at, own] = 1
        return out[:, :n]

    for i in range(0, len(left), TILE):
        rows = left[i : i + TILE]
        have = np.zeros(column.max(initial=-1) + 1, bool)
        for r in rows:
            have[column[cuts[r] : cuts[r + 1]]] = True
        for j in range(0, len(right), TILE):
            others = right[j : j + TILE]
            both = np.zeros(len(have), bool)
            for r in others:
                both[column[cuts[r] : cuts[r + 1]]] = True
            shared = np.flatnonzero(have & both)
            overlap = np.zeros((len(rows), len(others)), np.float32)
            for s in range(0, len(shared), TILE):
                some = shared[s : s + TILE]
                place = np.full(len(have), len(some), np.int64)
                place[some] = np.arange(len(some))
                overlap += dense(rows, place, len(some)) @ dense(others, place, len(some)).T
            union = size[rows][:, None] + size[others][None, :] - overlap
            near = (overlap >= least * union - 1e-9) & (label[rows][:, None] != label[others][None, :])
            a, b = np.nonzero(near)
            a, b = rows[a], others[b]
            while len(a):  # one link for each pair of components that still differ
                _, first = np.unique(label[a], return_index=True)
                a_, b_ = a[first[0]], b[first[0]]
                made_a.append(np.array([a_]))
                made_b.append(np.array([b_]))
                label[label == label[a_]] = label[b_]
                differ = label[a] != label[b]
                a, b = a[differ], b[differ]
    return np.concatenate(made_a), np.concatenate(made_b)


EDGE = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without the rows that repeat another one: of each class the row with the least key stays (null keys last, then any one of
    them), with all its columns. Rows are judged each, by a saved number, so repeated keys and null keys are no exception. Copies of a
    text without words are a class; null texts are none."""
    rows = save(docs.withColumn("__row", F.monotonically_increasing_id()), "numbered")
    bare = F.when(~F.col(text).rlike(r"[0-9A-Za-z\x{80}-\x{10FFFF}]"), F.col(text))
    told = classes(rows, "__row", text).select("__row", "class_id").join(rows.select("__row", F.col(key).alias("k"), bare.alias("bare")), "__row")
    told = save(told.withColumn("class_id", F.when(F.col("bare").isNull(), F.col("class_id"))), "told")
    least = told.groupBy("class_id", "bare").agg(F.min(F.struct(F.col("k").isNull().alias("none"), "k", "__row")).alias("least")).select("least.__row")
    gone = save(told.join(least, "__row", "left_anti").select("__row"), "gone")
    return rows.join(small(gone), "__row", "left_anti").drop("__row")


def op7_bag_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: All pairs that share a shingle, without signatures.
SQL = r"""
WITH RECURSIVE doc AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents
), bag AS (
  SELECT doc_id, array_to_string(list_slice(w, p, p + 4), ' ') AS g, count(*) AS n
  FROM doc, LATERAL unnest(range(1, greatest(len(w) - 4, 1) + 1)) t(p) WHERE len(w) > 0 GROUP BY ALL
), total AS (
  SELECT doc_id, sum(n)::DOUBLE AS s FROM bag GROUP BY ALL
), pair AS (
  SELECT a.doc_id AS x, b.doc_id AS y, sum(least(a.n, b.n))::DOUBLE AS o FROM bag a JOIN bag b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL
), link AS (
  SELECT x, y FROM pair JOIN total a ON x = a.doc_id JOIN total b ON y = b.doc_id WHERE o >= 0.8::DOUBLE * (a.s + b.s - o) - 1e-9
), near AS (
  SELECT x, y FROM link UNION ALL SELECT y, x FROM link
), reach AS (
  SELECT doc_id AS node, doc_id AS root FROM doc UNION SELECT y, root FROM reach JOIN near ON node = x
), class AS (
  SELECT node, min(root) AS class_id FROM reach GROUP BY ALL
)
SELECT doc_id, len(w)::BIGINT AS n_words, CASE WHEN len(w) > 0 THEN min(doc_id) OVER (PARTITION BY w) ELSE doc_id END AS text_class, class_id, doc_id = class_id AS kept
FROM doc JOIN class ON doc_id = node
"""
QUERIES = {"op7_bag_minhash": op7_bag_minhash}
ORACLE = {"op7_bag_minhash": SQL}
