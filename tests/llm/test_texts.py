"""License scans, decontamination and words against plain loops."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lattica.llm import _words, contamination, licenses

from .conftest import ODD, words


def test_words_of_a_column():
    texts = [None, "", "Ab cd", "cd", "x" * 3000 + " Éa", "a-b_c"]
    for limit in (1, 4, 1 << 18):
        got = []
        for first, _, data, offsets in _words.chunks(pa.array(["skip", *texts]).slice(1), limit):
            starts, ends, rows = _words.find(data, offsets)
            low = _words.LOWER[data].tobytes()
            got += [(first + int(r), low[a:b]) for a, b, r in zip(starts, ends, rows, strict=True)]
            assert (_words.hashes(data, starts, ends, limit) == _words.hash_of([w for r, w in got if r >= first])).all() or not len(starts)
        assert got == [(i, w) for i, t in enumerate(texts) for w in words(t)]


def test_rolling_stays_in_a_row():
    h = np.arange(1, 8, dtype=np.uint64)
    at, grams = _words.rolling(h, np.array([0, 0, 0, 1, 1, 2, 2]), 2)
    assert at.tolist() == [0, 1, 3, 5] and len(set(grams.tolist())) == 4


def base(text):
    w = words(text)
    places = [(i, label) for label, phrase in licenses.PHRASES for p in [phrase.encode().split()] for i in range(len(w)) if w[i : i + len(p)] == p]
    starts = [i for i, _ in places]
    return len(w), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places}))


LICENSED = [
    (20, "Licensed under CC BY-NC 4.0."), (21, "the MIT License and the mit\nlicense; GNU General Public, License! CC-BY cc by"), (22, "gnu general public"),
    (23, "x licensed under the apache license, version 2.0"), (24, "licensed under the very apache license version 2 0"), (25, "MIT MIT License License"), (26, "apache-license " * 300),
]


def test_licenses(spark, docs):
    rows = [*ODD, *LICENSED]
    got = licenses.scan(docs(rows)).collect()
    assert sorted(((r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in got), key=repr) == sorted(((i, *base(t)) for i, t in rows), key=repr)
    by_id = {r["doc_id"]: r for r in got}
    assert by_id[20]["labels"] == "cc-by,cc-by-nc-4.0" and by_id[23]["labels"] == "apache,apache-2.0" and by_id[22]["score"] == 0.0
    assert all(set(r["base_labels"].split(",")) - {""} <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1 for r in got)
    assert licenses.scan(docs([])).collect() == []


def test_neighbouring_diagonals_merge(spark, docs):
    grant = dict(licenses.NOTICES)["mit-grant"].split()
    text = " ".join([*grant[:9], "and", *grant[9:]])
    row = licenses.scan(docs([(1, text)])).first()
    assert row["labels"] == "mit-grant" and row["score"] == 1


def test_repeated_grams_are_no_notice(spark, docs):
    rows = [(n, "permission is hereby granted " * n) for n in (1, 14, 20, 400)] + [(900, " ".join(reversed(dict(licenses.NOTICES)["bsd"].split())))]
    assert [(r["labels"], r["score"]) for r in licenses.scan(docs(rows)).collect()] == [("", 0.0)] * 5


@pytest.mark.parametrize("label, notice", licenses.NOTICES)
def test_one_edit_does_not_hide_a_notice(label, notice):
    """A word put in anywhere but next to an end, as votes of grams see it; in long notices most words may change as well."""
    template = next(t for t in licenses.TEMPLATES if t.label == label)
    for i in range(2, len(template.words) - 1):
        edited = [*template.words[:i], b"q", *template.words[i:]]
        assert licenses.in_order(votes_of(edited, template), template.k) >= template.least * len(template.words)
    changed = [[*template.words[:i], b"q", *template.words[i + 1 :]] for i in range(len(template.words))]
    found = [licenses.in_order(votes_of(w, template), template.k) >= template.least * len(template.words) for w in changed]
    assert sum(found) >= (0.6 * len(found) if len(template.words) >= licenses.LONG else 0)


def votes_of(text, template):
    grams = [template.words[i : i + template.k] for i in range(len(template.words) - template.k + 1)]
    return [(pos, at) for pos in range(len(text)) for at, g in enumerate(grams) if text[pos : pos + template.k] == g]


def aligned(text, template, k):
    """Most words of the template that the text has in order, taken in whole grams of k words or their ends, by trying all chains."""
    best = {}
    for i in range(len(text) - k + 1):
        for j in range(len(template) - k + 1):
            if text[i : i + k] == template[j : j + k]:
                best[i, j] = max([k, *(n + min(k, i - x, j - y) for (x, y), n in best.items() if x < i and y < j)])
    return max(best.values(), default=0)


@pytest.mark.parametrize("seed", range(40))
def test_words_in_order_against_an_aligner(seed):
    dice = random.Random(seed)
    k, letters = dice.choice([2, 4]), [bytes([97 + i]) for i in range(dice.choice([2, 3, 8]))]
    template = licenses.Template("x", " ".join(dice.choice(letters).decode() for _ in range(dice.randint(k, 14))), k)
    text = [dice.choice(letters) for _ in range(dice.randint(0, 40))] + template.words[: dice.randint(0, 14)] + [dice.choice(letters) for _ in range(3)]
    n = licenses.in_order(votes_of(text, template), k)
    assert n == aligned(text, template.words, k)
    common = np.zeros((len(text) + 1, len(template.words) + 1), int)
    for i, w in enumerate(text):
        for j, v in enumerate(template.words):
            common[i + 1, j + 1] = max(common[i, j + 1], common[i + 1, j], common[i, j] + (w == v))
    assert n <= common[-1, -1]  # never more than the longest common subsequence


def brute(text, items, window=13):
    w = words(text)
    hit, found = set(), set()
    for name, item in items:
        v = words(item)
        n = min(window, len(v))
        for win in {tuple(v[i : i + n]) for i in range(len(v) - n + 1)} if n else ():
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) == win:
                    hit |= set(range(i, i + n))
                    found.add(name)
    return len(w), len(hit), sorted(found)


@pytest.mark.parametrize("seed", range(6))
def test_contamination(spark, docs, seed):
    pick = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(pick.choice([2, 3, 12]))]
    say = lambda n: " ".join(pick.choice(vocabulary) for _ in range(n))
    items = [(str(i), say(pick.randint(0, 9))) for i in range(12)] + [("same", "W1 w0-w1"), ("again", "w1 w0 w1"), ("none", None), ("dots", "...")]
    rows = [*ODD, *((100 + i, say(pick.randint(0, 60)) + pick.choice(["", " " + items[pick.randrange(12)][1], " other " + say(20)])) for i in range(25))]
    frame = spark.createDataFrame(items, "item_id string, text string")
    got = contamination.find(docs(rows), frame, window=4).collect()
    assert sorted(((r["doc_id"], r["n_words"], r["n_hit"], r["items"]) for r in got), key=repr) == sorted(((i, *brute(t, items, 4)) for i, t in rows), key=repr)


@pytest.mark.parametrize("per_pass", [1, 8])
def test_more_items_than_one_automaton_holds(spark, docs, monkeypatch, per_pass):
    monkeypatch.setattr(contamination, "WORDS_PER_AUTOMATON", 5)
    items = [("a", "x y z u"), ("b", "z u v w"), ("c", "x")]
    monkeypatch.setattr(contamination, "AUTOMATA_PER_PASS", per_pass)
    text = "x y z u v w x"
    row = contamination.find(docs([(1, text)]), spark.createDataFrame(items, "item_id string, text string"), window=3).first()
    assert (row["n_words"], row["n_hit"], row["items"]) == brute(text, items, 3)


def test_no_items_and_no_documents(spark, docs):
    none = spark.createDataFrame([], "item_id long, text string")
    assert [r["n_hit"] for r in contamination.find(docs(ODD), none).collect()] == [0] * len(ODD)
    assert contamination.find(docs([]), none).collect() == []


@pytest.mark.parametrize("seed", range(2))
def test_long_items_in_parts_and_passes(spark, docs, monkeypatch, seed):
    monkeypatch.setattr(contamination, "WORDS_PER_AUTOMATON", 40)
    monkeypatch.setattr(contamination, "AUTOMATA_PER_PASS", 2)
    pick = random.Random(seed)
    say = lambda n: " ".join(f"w{pick.randrange(9)}" for _ in range(n))
    items = [(str(i), say(pick.choice([2, 5, 30, 90]))) for i in range(12)]
    rows = [*ODD, *((100 + i, " ".join([say(20), *items[i % 12][1].split()[3:40], say(9)])) for i in range(30))]
    got = contamination.find(docs(rows), spark.createDataFrame(items, "item_id string, text string"), window=4).collect()
    assert sorted(((r["doc_id"], r["n_words"], r["n_hit"], r["items"]) for r in got), key=repr) == sorted(((i, *brute(t, items, 4)) for i, t in rows), key=repr)
    for r in got:
        octets = r["text"].encode() if r["text"] else b""
        assert all(len(words(octets[s["first_byte"] : s["end_byte"]].decode())) == s["end"] - s["start"] for s in r["spans"])


def opposite(n=1024):
    """Words that cancel in every sum of powers: a Thue-Morse word and its complement."""
    word = "".join("ab"[i.bit_count() % 2] for i in range(n))
    return word, word.translate(str.maketrans("ab", "ba"))


def test_words_that_cancel_are_different_words(spark, docs):
    one, other = opposite()
    assert len(set(_words.hash_of([one.encode(), other.encode()]).tolist())) == 2
    rows = [(1, f"x {one} y"), (2, f"x {other} y")]
    got = {r["doc_id"]: r["n_hit"] for r in contamination.find(docs(rows), spark.createDataFrame([("i", one)], "item_id string, text string")).collect()}
    assert got == {1: 1, 2: 0}


def test_no_long_span_is_left(spark, docs):
    item = [f"b{i}" for i in range(15)]
    clean = " ".join(f"c{i}" for i in range(900))
    nested = " ".join([*item[:7], *item, *item[7:]])  # what is left around the inner one is the item again
    items = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    kept = contamination.remove(docs([(1, f"{clean} {nested} {clean}"), (2, f"{clean} {' '.join(item)}")]), items, max_words=12)
    assert [r["n_hit"] for r in contamination.find(kept, items).collect()] == [0, 0]


def test_removing(spark, docs):
    item = " ".join(f"b{i}" for i in range(15))
    clean = " ".join(f"c{i}" for i in range(400))
    rows = [(1, item), (2, f"{clean} {item}"), (3, clean), (4, None), (5, f"É {clean}: {item}! {clean}")]
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    kept = contamination.remove(docs(rows), items)
    assert sorted(r["doc_id"] for r in kept.collect()) == [2, 3, 4, 5] and kept.columns == docs(rows).columns
    cut = {r["doc_id"]: r["text"] for r in contamination.remove(docs(rows), items, max_words=13).collect()}
    assert cut[2] == f"{clean}  \u2026 " and cut[5] == f"É {clean}:  \u2026 ! {clean}" and cut[3] == clean and cut[4] is None


@pytest.mark.parametrize("n_words, n_hit", [(140, 7), (280, 14), (300, 15), (20, 1), (281, 14), (100, 4), (0, 0)])
def test_a_twentieth_is_exact(spark, n_words, n_hit):
    row = spark.createDataFrame([(n_words, n_hit)], "n_words long, n_hit long")
    assert row.select(contamination.contaminated()).first()[0] == (n_hit > 0 and 20 * n_hit >= n_words)


def test_digest_of_no_items(spark, data):
    rows = contamination.op6_suffix_automaton(spark, data).where(F.col("n_items") == 0).collect()
    assert rows and all(r["items_sha256"] == hashlib.sha256(b"").hexdigest() and not r["contaminated"] for r in rows)
