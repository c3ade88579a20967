"""Language identification, quality, tool calls and the pipeline."""

import json
import math
import random
import struct

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from lattica.llm import language, quality, tool_calls

from .conftest import ODD


def test_language_on_held_out_rows(spark):
    folder = "/root/testdata/sf0.01"
    got = language.op4_language_families(spark, folder).join(spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out")
    right, n = got.agg(F.sum((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert right >= 0.98 * n > 100


def test_language_edges(spark, docs):
    frame = docs([*ODD, *((300 + i, "der die das und nicht") for i in range(9))]).withColumn("lang", F.when(F.col("doc_id") >= 300, "de").when(F.col("doc_id") == 6, "la"))
    model = language.fit(frame)
    assert model.languages == ["de", "la"]
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language.predict(frame, model).collect()}
    assert [got[i] for i in (1, 2, 3, 4)] == [("und", 0.0)] * 4 and got[305][0] == "de" and got[6][0] == "la" and 0 < got[5][1] <= 1
    assert language.predict(frame.limit(0), model).collect() == []
    nobody = language.fit(frame.where("lang = 'xx'"))
    assert {r["lang_pred"] for r in language.predict(frame, nobody).collect()} == {"und"}
    one = language.fit(frame.where("lang = 'de'"))
    assert {r["lang_pred"] for r in language.predict(frame, one).collect()} == {"und", "de"}
    assert language.accept(frame).columns == frame.columns


def test_languages_with_most_rows_are_learned(spark, docs):
    frame = docs([(i, f"word{i} und so weiter") for i in range(60)]).withColumn("lang", F.when(F.col("doc_id") < 20, "de").when(F.col("doc_id") < 40, "nl").otherwise(F.concat(F.lit("x"), "doc_id")))
    assert language.fit(frame, languages=3).languages == ["de", "nl", "x40"]


def test_predictions_against_plain_votes(spark, docs):
    """Every gram of every text by hand, each machine's margin, votes of families, then of languages within the winner."""
    pick = random.Random(12)
    vocabulary = {x: [f"{x}{pick.randrange(60)}{e}" for e in ("en", "a", "os", "lich") for _ in range(4)] for x in ("en", "de", "fr", "es", "zz")}
    say = lambda x, n: " ".join(pick.choice(vocabulary[x]) for _ in range(n))
    rows = [(i, say(["en", "de", "fr", "es", "zz"][i % 5], pick.randint(1, 12))) for i in range(200)]
    frame = docs([*ODD, *rows]).withColumn("lang", F.element_at(F.array(*map(F.lit, ("en", "de", "fr", "es", "zz"))), (F.col("doc_id") % 5 + 1).cast("int")))
    model = language.fit(frame.where("doc_id >= 10 and doc_id < 150"))
    assert set(model.families) == {"germanic", "romance", "zz"} and len(model.machines) == 5

    def buckets(text):
        low = bytes(b + 32 if 65 <= b <= 90 else b for b in text.encode())
        letters = [b if 97 <= b <= 122 or b >= 128 else 32 for b in low]
        for n in language.GRAMS:
            for i in range(len(letters)):
                gram = [*letters[i : i + n], 32, 32, 32][:n]
                whole = sum(b << (8 * j) for j, b in enumerate(gram))
                yield ((((whole * 2654435761 + n) % 2**32) * 2246822519) % 2**32) >> 18

    def best(options, text):
        margin = {}
        for a, b in model.machines:
            if a in options and b in options:
                w = model.machines[a, b]
                margin[a, b] = language.SCALE * sum(float(w[g]) for g in buckets(text)) / max(1, len(text.encode())) + float(w[-1])
        of = lambda a, b: margin[a, b] if (a, b) in margin else -margin[b, a]
        votes = {a: (sum(of(a, b) > 0 for b in options if b != a), sum(of(a, b) for b in options if b != a)) for a in options}
        top = max(sorted(options), key=lambda a: votes[a])
        return top, 1 / (1 + math.exp(-2 * min([50, *(of(top, b) for b in options if b != top)])))

    for r in language.predict(frame, model).collect():
        if not r["text"] or not any(map(str.isalpha, r["text"])):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
        elif len(r["text"]) < 1000:
            family, sure = best(sorted(model.families), r["text"])
            lang, within = best(sorted(model.families[family]), r["text"])
            assert r["lang_pred"] == lang and abs(r["score"] - sure * within) < 1e-3


def test_grams_do_not_cross_texts():
    data = np.frombuffer(b"abcab", np.uint8)
    together = list(language.gram_buckets(data, np.array([0, 3, 5])))
    apart = [np.concatenate(x) for x in zip(language.gram_buckets(data[:3], np.array([0, 3])), language.gram_buckets(data[3:], np.array([0, 2])), strict=True)]
    assert all((a == b).all() for a, b in zip(together, apart, strict=True))


def test_svm_separates():
    noise = np.random.default_rng(1)
    rows = [(np.array([0, 1]), np.array([x + side, noise.normal()])) for side in (2, -2) for x in noise.normal(size=50) * 0.3]
    signs = np.repeat([1.0, -1.0], 50)
    w = language.svm(rows, signs)
    assert all(s * (w[at] @ v + w[-1]) > 0 for (at, v), s in zip(rows, signs, strict=True))


def quality_rows(n=240):
    pick = random.Random(2)
    good = lambda: " ".join(pick.choice(["red", "green", "blue", "sea", "sky"]) for _ in range(40)) + "."
    bad = lambda: " ".join(pick.choice(["red", "green"]) + "$$$" for _ in range(40))
    return [(i, bad() if i % 6 == 0 else good()) for i in range(1000, 1000 + n)]


def test_quality(spark, docs):
    rows = [*ODD, *quality_rows()]
    labels = spark.createDataFrame([(i, int(i % 6 != 0)) for i, _ in quality_rows()] + [(None, 1), (1001, None)], "doc_id long, quality int")
    got = quality.select(docs(rows), labels).collect()
    assert len(got) == len(rows) and sorted(r["rank"] for r in got) == list(range(len(rows)))
    by_rank = sorted(got, key=lambda r: r["rank"])
    assert all(a["perturbed"] >= b["perturbed"] for a, b in zip(by_rank, by_rank[1:], strict=False))
    told = {r["doc_id"]: r["selected"] for r in got}
    assert all(told[i] == (i % 6 != 0) for i, _ in quality_rows())
    half = quality.select(docs(rows), labels, share=0.5).where("selected").count()
    assert half == round(0.5 * len(rows))
    kept = quality.accept(docs(rows), labels)
    accepted = {r["doc_id"] for r in got if r["accepted"]}
    assert kept.columns == docs(rows).columns and {r["doc_id"] for r in kept.collect()} == accepted
    assert accepted >= {i for i, _ in quality_rows() if i % 6} and not accepted & {i for i, _ in quality_rows() if i % 6 == 0}


def test_quality_against_a_plain_sample(spark, docs):
    """Weights, noise, ranks and decisions by loops."""
    rows = [*ODD, *quality_rows()]
    labels = spark.createDataFrame([(i, int(i % 6 != 0)) for i, _ in quality_rows()], "doc_id long, quality int")
    model = quality.fit(docs(rows), labels)
    got = quality.select(docs(rows), labels, share=0.3).collect()

    def noise(i):
        seed = 42 if i is None else xxhash.xxh64(struct.pack("<q", i), seed=42).intdigest()
        h = xxhash.xxh64(b"gumbel", seed=seed).intdigest()
        h -= (h >> 63) << 64
        return -math.log(-math.log((h % (1 << 40) + 0.5) / (1 << 40)))

    want = []
    for i, text in rows:
        data = np.frombuffer((text or "").encode(), np.uint8)
        weight = sum(model.ratio[b] for b in quality.token_buckets(data, np.array([0, len(data)]))[0])
        n = len(quality.token_buckets(data, np.array([0, len(data)]))[0])
        want.append((weight + noise(i), i, n, weight, weight / (n + quality.PRIOR) >= model.threshold))
    want.sort(key=lambda w: (-w[0], w[1] is not None, w[1] or 0))
    got.sort(key=lambda r: r["rank"])
    assert [(r["doc_id"], r["n_tokens"], r["accepted"]) for r in got] == [(i, n, a) for _, i, n, _, a in want]
    assert np.allclose([(r["perturbed"], r["log_weight"]) for r in got], [(w[0], w[3]) for w in want])
    assert [r["selected"] for r in got] == [n < round(0.3 * len(rows)) for n in range(len(rows))]


def test_more_of_the_weighty_are_sampled(spark, docs):
    """Two kinds of documents whose weights are apart by some units: the Gumbel sample takes the lighter ones about as often as it should."""
    weights = np.repeat([1.0, 0.0], 2000)
    noise = -np.log(-np.log(np.random.default_rng(0).random(4000)))
    frame = spark.createDataFrame([(i,) for i in range(4000)], "k long")
    spark_noise = np.array([r[0] for r in frame.select(-F.log(-F.log(quality._hash01(F.col("k"), "gumbel")))).collect()])
    taken = [np.argsort(-(weights + x))[:500] for x in (noise, spark_noise)]
    assert abs((taken[0] < 2000).mean() - (taken[1] < 2000).mean()) < 0.08


def test_quality_by_row(spark, docs):
    """A rejected row takes no other row of its id along, and null ids are judged as others are."""
    labels = spark.createDataFrame([(i, int(i % 6 != 0)) for i, _ in quality_rows()], "doc_id long, quality int")
    known = dict(quality_rows())
    good, bad = (next(known[i] for i in known if (i % 6 != 0) == g) for g in (True, False))
    rows = [*quality_rows(), (5001, good), (5001, bad), (None, good), (None, bad)]
    kept = [(r["doc_id"], r["text"]) for r in quality.accept(docs(rows), labels).collect()]
    assert kept.count((5001, good)) == 1 and (5001, bad) not in kept
    assert kept.count((None, good)) == 1 and (None, bad) not in kept


def test_quality_without_labels(spark, docs):
    none = spark.createDataFrame([], "doc_id long, quality int")
    got = quality.select(docs(ODD), none).collect()
    assert all(r["selected"] and r["log_weight"] == 0 for r in got)
    assert quality.select(docs([]), none).collect() == []


def test_counts_are_over_all_documents(spark, docs):
    """The ratio of models that a plain count gives."""
    rows = quality_rows(60)
    labels = spark.createDataFrame([(i, int(i % 6 != 0)) for i, _ in rows], "doc_id long, quality int")
    model = quality.fit(docs(rows), labels)
    sample = {r["k"] for r in quality._sample(labels, "doc_id", "quality", quality.LABELLED).where("half = 0 and good").collect()}
    raw, target = np.ones(quality.BUCKETS), np.ones(quality.BUCKETS)
    for i, text in rows:
        data = np.frombuffer(text.encode(), np.uint8)
        counts = np.bincount(quality.token_buckets(data, np.array([0, len(data)]))[0], minlength=quality.BUCKETS)
        raw += counts
        target += counts * (i in sample)
    want = np.log(target / target.sum()) - np.log(raw / raw.sum()) if target.sum() > quality.BUCKETS else 0
    assert np.allclose(model.ratio, want)


MESSAGES = [
    (1, 0, "system", "be kind"), (1, 1, "user", "hi"), (1, 2, "assistant", "hello é"), (1, 3, "user", ""), (1, 4, "user", None), (1, 5, "assistant", "late"), (1, 5, "assistant", "late"),
    (2, 0, "assistant", json.dumps({"tool_calls": [{"id": "b", "name": "add", "arguments": {"x": {"$from": "a"}, "y": 2}}, {"id": "a", "name": "add", "arguments": "{\"y\": 1, \"x\": 2}"}, {"id": "a", "name": "add", "arguments": {"x": 1}}]})),
    (2, 1, "tool", '{"tool_call_id": "b", "content": 5}'), (2, 2, "tool", '{"tool_call_id": "a", "content": {"z": 1, "y": [1.5]}}'), (2, 3, "tool", '{"tool_call_id": "zz"}'), (2, 4, "user", "{not json"),
    (3, 0, "assistant", json.dumps({"tool_calls": [{"id": "p", "name": "add", "arguments": {"x": {"$from": "q"}, "y": 1}}, {"id": "q", "name": "no", "arguments": {"x": {"$from": "p"}}}]})), (3, 1, "tool", '{"tool_call_id": "p"}'), (3, 2, "tool", '{"tool_call_id": "q"}'),
    (None, None, None, None), (4, None, "user", "x"),
]
ADD = {"add": {"x": {"type": "integer", "required": True}, "y": {"type": "integer"}}, "reply": tool_calls.SCHEMAS["reply"]}


def test_tool_calls(spark):
    frame = spark.createDataFrame(MESSAGES, "conv_id long, turn long, role string, text string").withColumns({"id": F.lit("clash"), "status": F.lit(1)})
    rows = tool_calls.link(tool_calls.events(frame, ADD)).collect()
    assert len(rows) == len(MESSAGES) + 3
    told = {(r["conv"], r["kind"], r["id"], r["at"], r["turn"]): r for r in rows}
    first = told[1, "call", "turn:1", 0, 1]
    assert first["status"] == "linked" and first["partner_turn"] == 2 and first["line"] == '{"arguments":{"prompt":"hi"},"id":"turn:1","kind":"call","name":"reply"}'
    assert told[1, "call", "turn:3", 0, 3]["errors"] == "prompt is too short" and told[1, "call", "turn:3", 0, 3]["status"] == "unanswered"
    assert told[1, "call", "turn:4", 0, 4]["errors"] == "prompt is no string"
    assert [r["status"] for r in rows if r["conv"] == 1 and r["turn"] == 5] == ["linked", "linked"]  # repeated rows are alike
    b, a = told[2, "call", "b", 0, 0], told[2, "call", "a", 1, 0]
    assert a["valid"] and b["valid"] and told[2, "call", "a", 2, 0]["status"] == "repeated" and told[2, "result", "zz", 0, 3]["status"] == "orphan"
    place = lambda r: (r["order_turn"], r["order_step"])
    assert place(a) < place(told[2, "result", "a", 0, 2]) < place(b) < place(told[2, "result", "b", 0, 1])
    assert told[3, "call", "p", 0, 0]["status"] == "cyclic" and told[3, "call", "q", 1, 0]["errors"] == "unknown name no"
    assert {r["kind"] for r in rows if r["conv"] in (None, 4)} == {"note"}
    assert tool_calls.link(tool_calls.events(frame.limit(0))).collect() == []


def called(conv, turn, key, *needs):
    """A message with a call that needs others' results."""
    return conv, turn, "assistant", json.dumps({"tool_calls": [{"id": key, "name": "f", "arguments": {f"a{i}": {"$from": n} for i, n in enumerate(needs)}}]})


def gave(conv, turn, key):
    return conv, turn, "tool", json.dumps({"tool_call_id": key, "content": 1})


def linked(spark, messages):
    frame = spark.createDataFrame(messages, "conv_id long, turn long, role string, text string")
    rows = tool_calls.link(tool_calls.events(frame, {"f": {"*": {}}})).collect()
    return {(r["conv"], r["kind"], r["id"]): r for r in rows}


def test_tool_calls_in_a_long_chain(spark):
    # Each call but the last needs the next one.
    chain = [called(1, i, f"c{i}", *([f"c{i + 1}"] if i < 99 else [])) for i in range(100)] + [gave(1, 100 + i, f"c{i}") for i in range(100)]
    told = linked(spark, chain)
    assert {r["status"] for r in told.values()} == {"linked"} and all(told[1, "call", f"c{i}"]["partner_turn"] == 100 + i for i in range(100))
    order = sorted(told.values(), key=lambda r: (r["order_turn"], r["order_step"], r["at"]))
    assert [r["id"] for r in order if r["kind"] == "call"] == [f"c{i}" for i in reversed(range(100))]


@pytest.mark.parametrize("together", [0, 100_000])
def test_tool_calls_on_and_behind_cycles(spark, monkeypatch, together):
    monkeypatch.setattr(tool_calls, "TOGETHER", together)
    messages = [called(1, 0, "p", "q"), called(1, 1, "q", "p"), called(1, 2, "behind", "q"), called(1, 3, "self", "self"), called(1, 4, "before", "free"), called(1, 5, "free", "none")]
    messages += [gave(1, 6, "p"), gave(1, 7, "q"), gave(1, 8, "before"), gave(1, 9, "free")]
    messages += [called(2, 0, "x", "y"), called(2, 1, "y"), called(3, 0, "y"), gave(3, 1, "y"), called(3, 2, "x", "y")]
    told = linked(spark, messages)
    status = {(c, i): r["status"] for (c, k, i), r in told.items() if k == "call"}
    assert status == {(1, i): "cyclic" for i in ("p", "q", "behind", "self")} | {(1, "before"): "linked", (1, "free"): "linked", (2, "x"): "unanswered", (2, "y"): "unanswered", (3, "y"): "linked", (3, "x"): "unanswered"}
    place = {k: (r["order_turn"], r["order_step"]) for k, r in told.items()}
    assert place[1, "call", "p"] == (0, 0) and place[1, "call", "q"] == (1, 0)
    assert place[1, "call", "free"] < place[1, "result", "free"] < place[1, "call", "before"] < place[1, "result", "before"]
    assert place[2, "call", "y"] < place[2, "call", "x"] and place[3, "call", "x"] == (2, 0)


def test_tool_calls_by_task_and_by_rounds_alike(spark, monkeypatch):
    dice = random.Random(6)
    messages = []
    for conv in range(12):
        turns = [None, *range(20)]
        for i in range(8):
            below = [f"c{j}" for j in range(8 if conv % 3 == 0 else i) if dice.random() < 0.25]
            messages.append(called(conv, dice.choice(turns), f"c{i}", *below))
            if dice.random() < 0.7:
                messages.append(gave(conv, dice.choice(turns), f"c{i}"))
    by_task = linked(spark, messages)
    monkeypatch.setattr(tool_calls, "TOGETHER", 0)
    assert by_task == linked(spark, messages)
    assert {r["status"] for r in by_task.values()} >= {"linked", "unanswered", "cyclic"}
    assert not any(r["status"] == "cyclic" for (conv, *_), r in by_task.items() if conv % 3)


ODD_MESSAGES = [
    ("assistant", '{"tool_calls": [{"id": "a", "name": "f", "arguments": {"x": 1e400}}]}'), ("assistant", '{"tool_calls": [{"id": "a", "name": "f", "arguments": "{\\"x\\": 1e400}"}]}'),
    ("assistant", '{"tool_calls": [{"id": "\\ud800", "name": "f"}]}'), ("assistant", '{"tool_calls": [{"id": "b", "name": "\\udfff", "arguments": "{\\"\\\\ud800\\": 1}"}]}'),
    ("assistant", '{"tool_calls": [], "content": "hello"}'), ("assistant", '{"tool_calls": []}'), ("assistant", '{"tool_calls": [{"id": 7, "name": null, "arguments": {"x": [{"$from": "c"}]}}, 5], "content": "also"}'),
    ("user", '{"tool_calls": [{"id": "u", "name": "f", "arguments": {}}]}'), ("tool", '{"tool_call_id": 7, "content": -0.0}'), ("tool", '{"tool_call_id": {"a": [1]}}'), ("tool", "plain"),
    ("assistant", '{"tool_calls": [{"id": "d", "name": "f", "arguments": ' + '{"a":' * 3000 + "1" + "}" * 3000 + "}]}"), ("assistant", '{"tool_calls": ' + "[" * 100000), (None, None), ("system", "x" * 300000), ("tool", '{"tool_call_id": "z", "content": 1' + "0" * 5000 + "}"),
]


def test_every_message_gives_a_row(spark):
    frame = spark.createDataFrame([(1, 1000 + i, r, t) for i, (r, t) in enumerate(ODD_MESSAGES)], "conv_id long, turn long, role string, text string")
    rows = tool_calls.link(tool_calls.events(frame, {"f": {"*": {}}, "reply": tool_calls.SCHEMAS["reply"]})).collect()
    assert {r["turn"] for r in rows} == {1000 + i for i in range(len(ODD_MESSAGES))}
    assert all(json.loads(r["line"]) for r in rows)
    told = {(r["turn"] - 1000, r["kind"], r["at"]): r for r in rows}
    assert (0, "result", 0) in told and told[1, "call", 0]["errors"] == "arguments are no JSON" and (2, "result", 0) in told  # what is no JSON is an answer
    assert json.loads(told[4, "note", 0]["line"])["content"] == "hello" and json.loads(told[5, "note", 0]["line"])["content"] is None
    assert told[6, "call", 0]["id"] == "7" and told[6, "call", 0]["status"] == "linked" and told[6, "call", 0]["open_needs"] == 1 and told[6, "call", 1]["status"] == "unanswered"
    assert json.loads(told[6, "note", 2]["line"])["content"] == "also" and told[8, "result", 0]["partner_turn"] == 1006
    assert told[7, "call", 0]["id"] == "turn:1007" and told[9, "result", 0]["id"] == '{"a":[1]}' and told[10, "note", 0]["line"]


def levels(calls):
    """The level of each call by its needs, and those that lead to a cycle, by plain recursion."""
    out, on = {}, set()

    def level(i):
        if i in on:
            return None
        if i not in out:
            on.add(i)
            below = [level(n) for n in calls[i] if n in calls]
            on.discard(i)
            if None in below:
                return None
            out[i] = max([0, *(b + 2 for b in below)])
        return out[i]

    return {i: level(i) for i in calls}


@pytest.mark.parametrize("together", [0, 100_000])
def test_topological_order_against_a_plain_sort(spark, monkeypatch, together):
    monkeypatch.setattr(tool_calls, "TOGETHER", together)
    dice = random.Random(16)
    graphs, messages = {}, []
    for conv in range(6):
        ids = [f"c{i}" for i in range(25)]
        graphs[conv] = {i: sorted({dice.choice(ids if conv % 2 and dice.random() < 0.1 else ids[:n]) for _ in range(dice.choice([0, 1, 1, 3]))} if n else {"gone"}) for n, i in enumerate(ids)}
        if conv == 0:
            graphs[conv] = {i: [f"c{n - 1}"] if n else [] for n, i in enumerate(ids)}
        turns = dice.sample(range(200), 50)
        for i, needs in graphs[conv].items():
            messages += [called(conv, turns.pop(), i, *needs), gave(conv, turns.pop(), i)]
    dice.shuffle(messages)
    told = linked(spark, messages)
    for conv, calls in graphs.items():
        want = levels(calls)
        assert {i: told[conv, "call", i]["level"] for i in calls} == want
        assert {i for i in calls if told[conv, "call", i]["status"] == "cyclic"} == {i for i in calls if want[i] is None}
        assert all(told[conv, "result", i]["level"] == want[i] + 1 for i in calls if want[i] is not None)
        place = {(k, i): (told[conv, k, i]["order_turn"], told[conv, k, i]["order_step"], told[conv, k, i]["at"]) for k in ("call", "result") for i in calls}
        for i, needs in calls.items():
            if want[i] is not None:
                assert place["call", i] < place["result", i] and all(place["result", n] < place["call", i] for n in needs if n in calls)
            assert told[conv, "call", i]["open_needs"] == sum(n not in calls for n in needs)
    assert any(None in levels(c).values() for c in graphs.values())


def test_a_long_chain_by_rounds(spark, monkeypatch):
    monkeypatch.setattr(tool_calls, "TOGETHER", 0)
    saved = []
    save = tool_calls.save
    monkeypatch.setattr(tool_calls, "save", lambda frame, name: saved.append(name) or save(frame, name))
    told = linked(spark, [called(1, i, f"c{i}", *([f"c{i + 1}"] if i < 199 else [])) for i in range(200)])
    assert [told[1, "call", f"c{i}"]["level"] for i in range(200)] == [2 * (199 - i) for i in range(200)]
    assert saved.count("left") <= 11  # a logarithm of 200, and some


@pytest.mark.parametrize("text", ['{"a": 1, "a": 2}', "[NaN]", "[1e400]", "[-1e999]", '["\\ud800"]', "{", "[" * 200000])
def test_text_that_is_no_json(text):
    with pytest.raises(ValueError):
        tool_calls.parsed(text)


def test_faults():
    rules = {"f": {"n": {"type": "number", "enum": [1, 2]}, "s": {"type": "string", "min_length": 2, "required": True}}}
    assert tool_calls.faults("f", {"n": True, "s": "x", "z": 1}, rules) == ["n is no number", "s is too short", "z is not allowed"]
    assert tool_calls.faults("f", {"n": 3}, rules) == ["n is not one of the allowed values", "s is missing"]
    assert tool_calls.faults("f", [], rules) == ["arguments are no object"] and tool_calls.faults("g", {}, rules) == ["unknown name g"]


def test_pipeline(spark, data):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "quality", "near_dedup", "decontamination", "packing"]
    docs = spark.read.parquet(f"{data}/documents.parquet")
    seen = [docs]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        seen.append(spark.createDataFrame(stage(spark, seen[-1], data).collect(), docs.schema))
    assert all(x.columns == docs.columns for x in seen)
    counts = [x.count() for x in seen]
    assert counts == sorted(counts, reverse=True) and counts[-1] > 0.5 * counts[0]
    from lattica.llm import contamination, near_dedup

    last = seen[-1]
    assert near_dedup.classes(last).where("not kept").count() == 0
    assert contamination.find(last, spark.read.parquet(f"{data}/benchmark.parquet")).where(contamination.contaminated()).count() == 0
    assert contamination.find(last, spark.read.parquet(f"{data}/benchmark.parquet")).where("exists(spans, s -> s.end - s.start > 12)").count() == 0
    bad = seen[1].join(spark.read.parquet(f"{data}/labels.parquet").where("quality = 1"), "doc_id", "left_semi").join(seen[2], "doc_id", "left_anti").count()
    assert bad <= 1  # good documents stay
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, data).collect()} == {r["doc_id"] for r in last.collect()}
