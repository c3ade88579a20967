"""Near duplicates of texts and vectors against brute force."""

import math
import random
from collections import Counter

import numpy as np
import pytest

from lattica.llm import embeddings, near_dedup
from lattica.llm._common import components

from .conftest import ODD, words
from .test_texts import opposite


def bag(text, k=5):
    w = words(text)
    return Counter(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else Counter()


def classes(rows, least=0.8):
    """Least id of each id's class, by comparing all pairs."""
    rows = [(i, bag(t)) for i, t in rows if i is not None]
    root = {i: i for i, _ in rows}

    def find(x):
        return x if root[x] == x else find(root[x])

    for n, (i, a) in enumerate(rows):
        for j, b in rows[:n]:
            if a and b and sum((a & b).values()) >= least * sum((a | b).values()):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in root}


def texts(seed):
    pick = random.Random(seed)
    rows, n = [], 100
    for _ in range(25):
        original = [f"v{pick.randrange(500)}" for _ in range(pick.choice([3, 5, 30, 120]))]
        for _ in range(pick.choice([1, 2, 6])):
            copy = list(original)
            for _ in range(pick.choice([0, 0, 1, 3])):
                copy[pick.randrange(len(copy))] = f"v{pick.randrange(500)}"
            rows.append((n, " ".join(copy)))
            n += 1
    return rows


@pytest.mark.parametrize("seed", range(2))
def test_near_copies(spark, docs, seed):
    rows = [*ODD, *texts(seed), (90, "x y " * 50), (91, "x y " * 52), (92, "x y " * 500), (93, "ONE two, three")]
    got = near_dedup.classes(docs(rows)).collect()
    assert len(got) == len(rows)
    assert {r["doc_id"]: r["class_id"] for r in got if r["doc_id"] is not None} == classes(rows)
    assert all(r["kept"] == (r["doc_id"] == r["class_id"]) for r in got)


def test_large_group_in_blocks(spark, docs, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK_TEXTS", 6)
    pick = random.Random(5)
    original = [f"v{i}" for i in range(60)]
    rows = []
    for i in range(80):
        copy = list(original)
        for _ in range(pick.randrange(4)):
            copy[pick.randrange(60)] = f"u{pick.randrange(9)}"
        rows.append((i, " ".join(copy)))
    got = near_dedup.classes(docs(rows), similarity=0.85).collect()
    assert {r["doc_id"]: r["class_id"] for r in got} == classes(rows, 0.85)


def test_boilerplate_falls_apart(spark, docs, monkeypatch):
    """Texts with much boilerplate in common share bands, so they are one group of candidates; no prefix joins them, so none is compared."""
    monkeypatch.setattr(near_dedup, "BLOCK_TEXTS", 20)
    monkeypatch.setattr(near_dedup, "PART_SHINGLES", 30_000)
    pick = random.Random(8)
    common = " ".join(f"v{i}" for i in range(300))
    own = lambda n: " ".join(f"u{pick.randrange(10**9)}" for _ in range(n))
    rows = [(i, f"{common} {own(pick.randrange(80, 110))}") for i in range(300)]
    rows += [(1000 + i, f"{t} {own(3)}") for i, t in rows[:5]]
    bags = [bag(t) for _, t in rows]
    between = [sum((a & b).values()) / sum((a | b).values()) for n, a in enumerate(bags[:60]) for b in bags[:n]]
    assert 0.5 < min(between) and 0.6 < max(between) < 0.8
    compared = []
    linked = near_dedup.by_group
    monkeypatch.setattr(near_dedup, "by_group", lambda frame, *a: compared.append(frame.count()) or linked(frame, *a))
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.classes(docs(rows)).collect()}
    assert got == {i: i % 1000 for i, _ in rows} and compared[:2] == [305, 305] and sum(compared[2:]) <= 20


def test_large_group_without_a_large_class(spark, docs, monkeypatch):
    """Edits all over one text: no filter tells such texts apart, so all meet, in parts."""
    for name, size in (("BLOCK_TEXTS", 10), ("PART_SHINGLES", 3000), ("TILE", 7)):
        monkeypatch.setattr(near_dedup, name, size)
    pick = random.Random(9)
    original = [f"v{i}" for i in range(120)]
    rows = []
    for i in range(60):
        copy = list(original)
        for at in pick.sample(range(120), pick.choice([0, 1, 3, 4])):
            copy[at] = f"u{pick.randrange(10**9)}"
        rows.append((i, " ".join(copy)))
    want = classes(rows)
    assert 5 < len(set(want.values())) < 60
    assert {r["doc_id"]: r["class_id"] for r in near_dedup.classes(docs(rows)).collect()} == want


@pytest.mark.parametrize("similarity", [0.5, 0.8, 0.95])
def test_similar_pairs_share_a_prefix(spark, similarity):
    pick = random.Random(3)
    sets = []
    for _ in range(12):
        base = [pick.randrange(1, 200) for _ in range(pick.choice([4, 30, 90]))]
        for _ in range(8):
            x = {v if pick.random() > 0.3 * (1 - similarity) else pick.randrange(1, 200) for v in base} | {pick.randrange(1, 200) for _ in range(pick.randrange(2 if similarity > 0.9 else 6))}
            sets.append(sorted(x))
    frame = spark.createDataFrame([(i, 7, x) for i, x in enumerate(sets)], "c long, g long, shingles array<long>")
    keys = {}
    for r in near_dedup.prefixes(frame, similarity).collect():
        keys.setdefault(r["c"], set()).add(r["key"])
    pairs = [(i, j) for i in range(len(sets)) for j in range(i) if len({*sets[i]} & {*sets[j]}) >= similarity * len({*sets[i], *sets[j]})]
    assert len(pairs) > 20 and all(keys[i] & keys[j] for i, j in pairs)


def test_words_that_cancel_are_not_copies(spark, docs):
    one, other = opposite()
    got = {r["doc_id"]: (r["text_class"], r["class_id"]) for r in near_dedup.classes(docs([(1, one), (2, other), (3, one.upper())])).collect()}
    assert got == {1: (1, 1), 2: (2, 2), 3: (1, 1)}


def test_keeping_one(spark, docs):
    rows = [*ODD, *texts(3)]
    frame = docs(rows)
    kept = near_dedup.keep_one(frame)
    want = classes(rows)
    assert kept.columns == frame.columns
    assert {r["doc_id"] for r in kept.collect()} == {i for i in want if want[i] == i} | {None}
    assert near_dedup.keep_one(docs([])).collect() == []


def test_keeping_one_by_row(spark, docs):
    one, two, three, four = (" ".join(f"{w}{i}" for i in range(30)) for w in ("ab", "cd", "ef", "gh"))
    rows = [(5, one), (5, one), (None, two), (None, two), (None, one), (3, three), (9, three), (9, four), (1, "!!!"), (2, "!!!"), (6, "???"), (7, None), (8, None)]
    got = sorted(((r["doc_id"], r["text"]) for r in near_dedup.keep_one(docs(rows)).collect()), key=repr)
    assert got == sorted([(5, one), (None, two), (3, three), (9, four), (1, "!!!"), (6, "???"), (7, None), (8, None)], key=repr)


def test_signatures_estimate_weighted_similarity():
    a, b = np.array([1, 2, 3], np.uint64), np.array([2, 3, 4], np.uint64)
    counts = np.array([5, 2, 40]), np.array([1, 33, 7])
    rows = np.array([0, 0, 0, 1, 1, 1])
    signed = near_dedup.signatures(rows, np.concatenate([a, b]), np.concatenate(counts), 2, 20_000)
    want = (min(2, 1) + min(40, 33)) / (5 + 2 + 40 + 7)
    assert abs((signed[0] == signed[1]).mean() - want) < 4 * math.sqrt(want / 20_000)


def test_components(spark):
    pick = random.Random(1)
    pairs = [(pick.randrange(300), pick.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(40)] + [(5, 5), (None, 3)]
    root = list(range(2000))

    def find(x):
        return x if root[x] == x else find(root[x])

    for a, b in pairs:
        if a is not None:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {x: find(x) for a, b in pairs if a is not None and a != b for x in (a, b)}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def vectors(seed, n=400, d=16):
    noise = np.random.default_rng(seed)
    out = noise.standard_normal((n, d))
    for i in range(0, n // 2, 4):
        for j in range(1, 4):
            out[i + j] = out[i] * noise.uniform(0.5, 3) + noise.standard_normal(d) * noise.uniform(0, 0.3)
    return [[float(x) for x in np.float32(v)] for v in out]


@pytest.mark.parametrize("seed", range(2))
def test_vectors(spark, monkeypatch, seed):
    monkeypatch.setattr(embeddings, "BLOCK", 16)
    own = vectors(seed)
    own += [own[0], own[0], [-0.0 if x == 0 else x for x in own[1]]]
    odd = [None, [], [0.0] * 16, [float("nan")] * 16, [float("inf")] + [1.0] * 15, [None] + [1.0] * 15, [1.0, 2.0], [2.0, 4.0]]
    frame = spark.createDataFrame([(i, v, 3, True) for i, v in enumerate([*own, *odd])], "vec_id long, embedding array<float>, n_links int, kept boolean")
    got = {r["vec_id"]: r for r in embeddings.similar(frame).collect()}
    assert len(got) == len(own) + len(odd)
    unit = np.array(own) / np.linalg.norm(own, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.9
    np.fill_diagonal(near, False)
    found = sum(got[i]["n_links"] for i in range(len(own)))
    assert all(got[i]["n_links"] <= near[i].sum() for i in range(len(own)))
    assert found >= 0.9 * near.sum()
    assert got[0]["component_id"] == 0 and got[len(own) - 3]["component_id"] == 0 and not got[len(own) - 2]["kept"]
    n = len(own)
    assert [got[n + i]["n_links"] for i in range(8)] == [0] * 6 + [1, 1] and [got[n + i]["component_id"] - n for i in range(8)] == [0, 1, 2, 3, 4, 5, 6, 6]
    assert embeddings.similar(frame.limit(0)).collect() == []


def test_recall_on_the_table(spark, data):
    frame = spark.read.parquet(f"{data}/embeddings.parquet")
    rows = frame.orderBy("vec_id").collect()
    own = np.array([r["embedding"] for r in rows], float)
    unit = own / np.linalg.norm(own, axis=1, keepdims=True)
    got = {r["vec_id"]: r["n_links"] for r in embeddings.similar(frame, threshold=0.6).collect()}
    near = (unit @ unit.T >= 0.6).sum(1) - 1
    assert all(got[r["vec_id"]] <= n for r, n in zip(rows, near, strict=True))
    assert sum(got.values()) >= 0.9 * near.sum()


def directed(random, n, dimensions=64):
    """Unit vectors around a common direction (mean norm^2 0.5), as embeddings of texts are."""
    x = random.standard_normal((n, dimensions)) * math.sqrt(0.5 / dimensions)
    x[:, 0] += math.sqrt(0.5)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def beside(random, x, cosine):
    away = random.standard_normal(x.shape)
    away -= (away * x).sum(axis=1, keepdims=True) * x
    return cosine * x + math.sqrt(1 - cosine**2) * away / np.linalg.norm(away, axis=1, keepdims=True)


def found(codes, x, y):
    """Which pairs meet in a table and are within the radius."""
    x, y = codes.bits(x), codes.bits(y)
    return (codes.keys(x) == codes.keys(y)).any(axis=1) & ((x != y).sum(axis=1) <= codes.radius)


def test_codes_within_the_tables_number_always_meet():
    random = np.random.default_rng(6)
    codes = embeddings.coded(directed(random, 3000), 100_000, 0.9)
    bits = random.random((500, codes.n_tables * codes.length)) < 0.5
    other = bits.copy()
    for row in other:
        at = random.choice(len(row), codes.n_tables - 1, replace=False)
        row[at] = ~row[at]
    assert (codes.keys(bits) == codes.keys(other)).any(axis=1).all()


@pytest.mark.parametrize("dimensions, mean", [(16, 0.0), (16, 0.4), (384, 0.0), (384, 0.5), (768, 0.5)])
def test_vectors_recall_by_dimensions(dimensions, mean):
    random = np.random.default_rng(7)

    def some(n):
        x = random.standard_normal((n, dimensions)) * np.sqrt((1 - mean) / dimensions) * np.linspace(1.5, 0.5, dimensions)
        x[:, 0] += math.sqrt(mean)
        return x / np.linalg.norm(x, axis=1, keepdims=True)

    codes = embeddings.coded(some(4000), 200_000, 0.9)
    x = some(3000)
    assert all(found(codes, x, beside(random, x, cosine)).mean() >= 0.9 for cosine in (0.9, 0.92))


@pytest.mark.parametrize("n_rows", [50_000, 3_000_000])
def test_vectors_recall_with_a_common_direction(n_rows):
    random = np.random.default_rng(3)
    codes = embeddings.coded(directed(random, 10_000), n_rows, 0.9)
    x = directed(random, 4000)
    for cosine in (0.9, 0.905, 0.915, 0.93):
        assert found(codes, x, beside(random, x, cosine)).mean() >= 0.9
    spread = codes.keys(codes.bits(directed(random, 20_000)))
    assert max(np.unique(spread[:, t], return_counts=True)[1].max() for t in range(spread.shape[1])) < 1000  # no bucket with much of all


def test_vectors_linked_with_a_common_direction(spark):
    random = np.random.default_rng(4)
    x = directed(random, 2000)
    both = np.concatenate([x, beside(random, x, 0.905)])
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(both)], "vec_id long, embedding array<double>")
    got = {r["vec_id"]: r["n_links"] for r in embeddings.similar(frame).collect()}
    exact = (both @ both.T >= 0.9).sum(axis=1) - 1
    assert all(got[i] <= exact[i] for i in got) and sum(got.values()) >= 0.9 * exact.sum()


def test_vectors_of_one_dimension_or_a_low_threshold():
    random = np.random.default_rng(5)
    line = np.where(random.random((500, 1)) < 0.5, 1.0, -1.0)
    codes = embeddings.coded(line, 500, 0.9)
    keys = codes.keys(codes.bits(line))
    assert (keys[line[:, 0] == line[0, 0]] == keys[0]).any(axis=1).all()
    x = directed(random, 2000)
    codes = embeddings.coded(x, 3_000_000, -0.5)
    assert found(codes, x, beside(random, x, -0.5)).mean() >= 0.9
