"""Chat formatting: calls and results linked by identifier, put in a topological order, checked against schemas, written as canonical JSON."""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import by_group, mapped, save, small

#: name -> field -> rule; a rule may have type, required, min_length, enum. Fields without a rule are not allowed unless "*" is there.
SCHEMAS: dict[str, dict[str, dict[str, Any]]] = {"reply": {"prompt": {"type": "string", "required": True, "min_length": 1}, "history": {}}}
TYPES = {"string": str, "number": (int, float), "integer": int, "boolean": bool, "array": list, "object": dict, "null": type(None)}
#: Dependencies of a conversation that one task puts in order; conversations with more are ordered by rounds over tables.
TOGETHER = 100_000


def canonical(value: Any) -> str:
    """JSON with sorted keys, without white space, non-ASCII as it is."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def _once(pairs: list[tuple[str, Any]]) -> dict:
    out = dict(pairs)
    if len(out) < len(pairs):
        raise ValueError("repeated key")
    return out


def _finite(text: str) -> float:
    out = float(text)
    if not math.isfinite(out):
        raise ValueError(f"{text} is not finite")
    return out


def parsed(text: str) -> Any:
    """The JSON value in the text; ValueError if it is none, repeats a key, has a number beyond doubles or half a surrogate pair, or is
    nested too deep. What passes can be written by canonical()."""
    try:
        out = json.loads(text, object_pairs_hook=_once, parse_float=_finite, parse_constant=_finite)
        canonical(out).encode()  # a lone surrogate has no UTF-8: UnicodeEncodeError, which is a ValueError
        return out
    except RecursionError:
        raise ValueError("nested too deep") from None


def _name(value: Any) -> str | None:
    """An identifier as text: strings as they are, other values in JSON, null as none."""
    return value if isinstance(value, str) or value is None else canonical(value)


def _wanted(arguments: Any) -> list[str]:
    """The ids of {"$from": id} anywhere in the arguments."""
    out, left = [], [arguments]
    while left:
        value = left.pop()
        if isinstance(value, dict) and isinstance(value.get("$from"), str):
            out.append(value["$from"])
        elif isinstance(value, dict | list):
            left += value.values() if isinstance(value, dict) else value
    return sorted(set(out))


def faults(name: str, arguments: Any, schemas: dict) -> list[str]:
    """What is wrong with a call's arguments, in the order of the fields' names."""
    if name not in schemas:
        return [f"unknown name {name}"]
    if not isinstance(arguments, dict):
        return ["arguments are no object"]
    rules, out = schemas[name], []
    for field in sorted({*rules, *arguments} - {"*"}):
        rule = rules.get(field, rules.get("*"))
        if rule is None:
            out.append(f"{field} is not allowed")
        elif field not in arguments:
            out += [f"{field} is missing"] * bool(rule.get("required"))
        elif isinstance(arguments[field], dict) and "$from" in arguments[field]:
            continue  # another call's result, known only when it runs
        elif "type" in rule and (not isinstance(arguments[field], TYPES[rule["type"]]) or (isinstance(arguments[field], bool) and rule["type"] in ("number", "integer"))):
            out.append(f"{field} is no {rule['type']}")
        elif len(arguments[field]) < rule["min_length"] if "min_length" in rule and hasattr(arguments[field], "__len__") else False:
            out.append(f"{field} is too short")
        elif "enum" in rule and arguments[field] not in rule["enum"]:
            out.append(f"{field} is not one of the allowed values")
    return out


def _events(turn: int | None, role: str | None, text: str | None, schemas: dict) -> Iterator[tuple]:
    """(kind, id, index, name, valid, errors, needs, line) of what a message says; at least one for each message."""
    note = lambda at, content: ("note", None, at, None, True, "", [], canonical({"content": content, "kind": "note", "role": role}))
    body = None
    if role in ("assistant", "tool") and text is not None and text.lstrip()[:1] == "{":
        try:
            body = parsed(text)
        except ValueError:
            body = None
    if role == "assistant" and isinstance(body, dict) and isinstance(body.get("tool_calls"), list):
        calls = body["tool_calls"]
        for i, call in enumerate(calls):
            call = call if isinstance(call, dict) else {}
            given, name, key = call.get("arguments"), _name(call.get("name")) or "", _name(call.get("id"))
            try:
                given = parsed(given) if isinstance(given, str) else given
                wrong = faults(name, given, schemas)
            except ValueError:
                wrong = ["arguments are no JSON"]
            needs = _wanted(given) if isinstance(given, dict) else []
            yield "call", key, i, name, not wrong, "; ".join(wrong), needs, canonical({"arguments": given, "id": key, "kind": "call", "name": name})
        if body.get("content") is not None or not calls:
            yield note(len(calls), body.get("content"))
    elif role == "tool" and isinstance(body, dict) and body.get("tool_call_id") is not None:
        key = _name(body["tool_call_id"])
        yield "result", key, 0, None, True, "", [], canonical({"content": body.get("content"), "id": key, "kind": "result"})
    elif role == "user" and turn is not None:
        key, given = f"turn:{turn}", {"prompt": text} | ({"history": {"$from": f"turn:{turn - 2}"}} if turn >= 2 else {})
        wrong = faults("reply", given, schemas)
        yield "call", key, 0, "reply", not wrong, "; ".join(wrong), _wanted({k: v for k, v in given.items() if k != "prompt"}), canonical({"arguments": given, "id": key, "kind": "call", "name": "reply"})
    elif role == "assistant" and turn is not None:
        key = f"turn:{turn - 1}"
        yield "result", key, 0, None, True, "", [], canonical({"content": text, "id": key, "kind": "result"})
    else:
        yield note(0, text)


EVENT = "conv long, turn long, kind string, id string, at int, name string, valid boolean, errors string, needs array<string>, line string"


def events(messages: DataFrame, schemas: dict = SCHEMAS, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Calls, results and notes in the messages; each message gives at least one of them.

    An assistant's text {"tool_calls": [{"id", "name", "arguments"}], "content"} holds calls, and a note of its content if it has some
    or has no calls; a tool's {"tool_call_id", "content"} is a result. Else a user's turn t calls for a reply under the id turn:t, which
    an assistant's turn t + 1 gives, and needs that of turn:(t - 2) for its history; whatever a user writes, JSON too, is the prompt. All other messages, and
    those without a turn, are notes, as is text that no JSON can be read from or written to (numbers beyond doubles, half surrogate
    pairs, repeated keys, nesting too deep). {"$from": id} anywhere in arguments needs that call's result first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in EVENT.split(", ")]
        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.bool_(), pa.string(), pa.list_(pa.string()), pa.string()]
        for batch in batches:
            rows = [(c, t, *e) for c, t, r, x in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True) for e in _events(t, r, x, schemas)]
            rows = [(c, t, k, i, at, n, v, e, d, line) for c, t, k, i, at, n, v, e, d, line in rows]
            columns = zip(*rows, strict=True) if rows else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, types, strict=True)], names)

    return mapped(messages.select(F.col(conv).cast("long"), F.col(turn).cast("long"), role, text), run, EVENT)


#: A place in a conversation; places are compared by turn (none first), then step.
SPOT = "struct<t: bigint, s: bigint>"


def _spot(turn: Column | str, step: Column) -> Column:
    return F.struct((F.col(turn) if isinstance(turn, str) else turn).cast("long").alias("t"), step.cast("long").alias("s"))


def _later(spot: str, n: Column | int = 1) -> Column:
    return _spot(F.col(f"{spot}.t"), F.col(f"{spot}.s") + n)


def link(found: DataFrame) -> DataFrame:
    """events() with status, partner_turn, open_needs, order_turn, order_step and level.

    Ids hold within a conversation. The first call and the first result of an id (by turn, index, digest of the line) are linked; others
    are repeated. status: linked, unanswered (a call without result), orphan (a result without call), repeated, note, or cyclic (on a
    cycle of dependencies, or in need of one that is, at any depth; such keep their turns). Calls and results without an id, or without
    a conversation, are unanswered and orphans. open_needs counts the needs that no call of the conversation has; they hold nothing up.

    level is the place in the topological order that dependencies alone give: 0 for a call that needs none, one more for its result, and
    for a call one more than the last result it needs; null for notes, repeated and cyclic ones. Sorting a conversation by (order_turn,
    order_step, at) also puts each result after its call and each call after the results it needs, but keeps turns where it can: an
    event keeps its turn unless what it depends on stands later, then it follows that.

    An id's calls and results are reduced to one row before they meet, so neither a hot conversation nor a hot id gathers in a task or
    multiplies. Rows equal in every column are all kept, and all linked alike. An empty table gives no rows."""
    found = save(found.withColumn("digest", F.md5("line")), "events")
    first = F.struct("turn", "at", "digest")
    named = found.where("id is not null and conv is not null and kind <> 'note'")
    ids = named.groupBy("conv", "id").agg(
        F.min(F.when(F.col("kind") == "call", first)).alias("call"), F.min(F.when(F.col("kind") == "result", first)).alias("result"),
    )
    ids = ids.select("conv", "id", *(F.col(f"{k}.{c}").alias(f"{k}_{c}") for k in ("call", "result") for c in ("turn", "at", "digest")), *(F.col(k).isNotNull().alias(f"has_{k}") for k in ("call", "result")))
    ids = save(ids, "ids")

    # Only the linked call's needs count. What they need is where each of them may go at first: its own turn, at level 0.
    calls = ids.where("has_call")
    own = found.where("kind = 'call' and size(needs) > 0").select("conv", "id", "turn", "at", "digest", "needs").join(calls.select("conv", "id", "call_turn", "call_at", "call_digest"), ["conv", "id"])
    own = own.where(F.col("turn").eqNullSafe(F.col("call_turn")) & (F.col("at") == F.col("call_at")) & (F.col("digest") == F.col("call_digest")))
    needs = save(own.select("conv", "id", F.explode("needs").alias("need")).distinct(), "needs")
    spots = calls.select("conv", "id", _spot("call_turn", F.lit(0)).alias("spot"), F.when(F.col("has_result"), _spot("result_turn", F.lit(0))).alias("given"))
    known = needs.join(calls.select("conv", F.col("id").alias("need"), F.lit(True).alias("there")), ["conv", "need"], "left")
    known = save(known, "known")
    open_ = known.where("there is null").groupBy("conv", "id").agg(F.count("*").alias("open_needs"))
    moved = save(_ordered(known.where("there").select("conv", "id", "need"), spots), "moved")
    spots = spots.join(moved.withColumnRenamed("spot", "new"), ["conv", "id"], "left").join(open_, ["conv", "id"], "left")
    spots = spots.select("conv", "id", F.coalesce("new", "spot").alias("spot"), F.coalesce("level", F.lit(0)).cast("long").alias("level"), F.coalesce("cyclic", F.lit(False)).alias("cyclic"), F.coalesce("open_needs", F.lit(0)).cast("long").alias("open_needs"))

    out = found.join(ids.join(spots, ["conv", "id"], "left"), ["conv", "id"], "left")
    call = F.col("kind") == "call"
    same = lambda k: F.coalesce(F.col(f"{k}_turn").eqNullSafe(F.col("turn")) & (F.col(f"{k}_at") == F.col("at")) & (F.col(f"{k}_digest") == F.col("digest")), F.lit(False))
    status = (
        F.when(F.col("kind") == "note", "note")
        .when(F.col("id").isNull() | F.col("conv").isNull(), F.when(call, "unanswered").otherwise("orphan"))
        .when(~F.when(call, same("call")).otherwise(same("result")), "repeated")
        .when(F.col("cyclic"), "cyclic")
        .when(call, F.when(F.col("has_result"), "linked").otherwise("unanswered"))
        .otherwise(F.when(F.col("has_call"), "linked").otherwise("orphan"))
    )
    out = out.withColumn("status", status)
    placed = F.col("status").isin("linked", "unanswered", "cyclic") & F.col("spot").isNotNull()
    here = _spot("turn", F.lit(0))
    spot = F.when(placed, F.when(call, F.col("spot")).otherwise(F.greatest(_later("spot"), here))).otherwise(here)
    level = F.when(call, F.when(placed & (F.col("status") != "cyclic"), F.col("level")).when(F.col("status") == "unanswered", F.lit(0))).when(F.col("status") == "linked", F.col("level") + 1).when(F.col("status") == "orphan", F.lit(0))
    partner = F.when(F.col("status") == "linked", F.when(call, F.col("result_turn")).otherwise(F.col("call_turn")))
    return out.select(
        "conv", "turn", "at", "kind", "id", "name", "status", partner.alias("partner_turn"), "valid", "errors",
        F.when(call & placed, F.col("open_needs")).when(call & (F.col("status") == "unanswered"), F.size("needs").cast("long")).alias("open_needs"),
        spot["t"].alias("order_turn"), spot["s"].alias("order_step"), level.cast("long").alias("level"), "line",
    )


def _ordered(needs: DataFrame, spots: DataFrame) -> DataFrame:
    """(conv, id, spot, level, cyclic) of calls that have needs: where the call goes, at which level, and whether its needs lead to a cycle.

    spots has for each call its own spot and, if it has a result, where that is given. A need's result stands at the later one of
    where it is given and just after the call, so a call stands two steps behind each call that it needs, or one behind what that one
    is given. Conversations with up to TOGETHER needs are ordered in a task, others by rounds over tables."""
    needs = save(needs, "edges")
    sizes = needs.groupBy(F.col("conv").alias("of")).agg(F.count("*").alias("n"))
    many = save(sizes.where(f"n > {TOGETHER}"), "many")
    out = _by_task(needs.join(small(many), F.col("conv") == F.col("of"), "left_anti"), spots)
    if many.limit(1).count():
        out = out.unionByName(_by_rounds(needs.join(small(many), F.col("conv") == F.col("of"), "left_semi"), spots))
    return out


def _by_task(edges: DataFrame, spots: DataFrame) -> DataFrame:
    """_ordered() with all needs of a conversation in one task."""
    columns = ("spot_t", "spot_s", "given_t", "given_s", "has_given")
    ends = edges.select("conv", F.explode(F.array("id", "need")).alias("id")).distinct().join(spots, ["conv", "id"])
    ends = ends.select("conv", "id", F.lit(None).cast("string").alias("need"), "spot.t", "spot.s", F.col("given.t").alias("gt"), F.col("given.s").alias("gs"), F.col("given").isNotNull().alias("g")).toDF("conv", "id", "need", *columns)
    rows = edges.select("conv", "id", "need", *(F.lit(None).cast(k).alias(n) for n, k in zip(columns, ("long",) * 4 + ("boolean",), strict=True))).unionByName(ends)

    def settle(table: pa.Table) -> pa.Table:
        place = lambda t, s: (t is not None, t or 0, s)
        spot, given, wants, users = {}, {}, {}, {}
        for r in table.to_pylist():
            if r["need"] is None:
                spot[r["id"]] = place(r["spot_t"], r["spot_s"])
                given[r["id"]] = place(r["given_t"], r["given_s"]) if r["has_given"] else (False, 0, -1)
            else:
                wants.setdefault(r["id"], []).append(r["need"])
                users.setdefault(r["need"], []).append(r["id"])
        left, level = {i: len(w) for i, w in wants.items()}, dict.fromkeys(spot, 0)
        ready = [i for i in spot if i not in wants]
        while ready:
            need = ready.pop()
            there, t, s = spot[need]
            after = max(given[need], (there, t, s + 1))
            for i in users.get(need, ()):
                spot[i] = max(spot[i], (after[0], after[1], after[2] + 1))
                level[i] = max(level[i], level[need] + 2)
                left[i] -= 1
                if not left[i]:
                    ready.append(i)
        # Those that lead to a cycle stay where they were.
        back = {r["id"]: place(r["spot_t"], r["spot_s"]) for r in table.to_pylist() if r["need"] is None and left.get(r["id"])}
        at = [back.get(i, spot[i]) for i in wants]
        spots = pa.StructArray.from_arrays([pa.array([t if there else None for there, t, _ in at], pa.int64()), pa.array([s for *_, s in at], pa.int64())], ["t", "s"])
        return pa.table({"conv": pa.repeat(table.column("conv")[0], len(at)), "id": pa.array(list(wants), pa.string()), "spot": spots, "level": pa.array([level[i] for i in wants], pa.int64()), "cyclic": pa.array([left[i] > 0 for i in wants], pa.bool_())})

    return by_group(rows, ["conv"], settle, f"conv long, id string, spot {SPOT}, level long, cyclic boolean")


def _by_rounds(edges: DataFrame, spots: DataFrame) -> DataFrame:
    """_ordered() by rounds over tables of edges (conv, id, need, k): id stands k steps behind need, or later.

    In a round, needs that wait for nothing are put into the spots of those that wait for them, and their edges go; and where a need
    waits for just one other call, the edge is led on to that one, so chains of any length take a logarithm of rounds. Where no edge goes in
    a round, all that are left lead to a cycle: without one, some call would wait only for calls that wait for nothing."""
    told = save(spots.join(edges.select("conv", "id").unionByName(edges.select("conv", F.col("need").alias("id"))).distinct(), ["conv", "id"]).withColumn("level", F.lit(0).cast("long")), "spots")
    given = told.where("given is not null").select("conv", F.col("id").alias("need"), _later("given").alias("after"))
    held = edges.join(given, ["conv", "need"]).groupBy("conv", "id").agg(F.max("after").alias("after"))
    now = save(told.join(held, ["conv", "id"], "left").select("conv", "id", F.greatest("spot", "after").alias("spot"), "level"), "now")
    left = save(edges.withColumn("k", F.lit(2).cast("long")), "left")
    n = left.count()
    while n:
        waiting = left.groupBy("conv", "id").agg(F.count("*").alias("n"), F.max(F.struct("need", "k")).alias("one"))
        needed = save(now.join(waiting, ["conv", "id"], "left").select("conv", F.col("id").alias("need"), "spot", "level", F.coalesce("n", F.lit(0)).alias("n"), "one"), "needed")
        met = save(left.join(needed, ["conv", "need"]), "met")
        pushed = met.where("n <= 1").groupBy("conv", "id").agg(F.max(_spot(F.col("spot.t"), F.col("spot.s") + F.col("k"))).alias("after"), F.max(F.col("level") + F.col("k")).alias("high"))
        now = save(now.join(pushed, ["conv", "id"], "left").select("conv", "id", F.greatest("spot", "after").alias("spot"), F.greatest("level", "high").alias("level")), "now")
        led = met.where("n > 0").select("conv", "id", F.when(F.col("n") == 1, F.col("one.need")).otherwise(F.col("need")).alias("need"), F.when(F.col("n") == 1, F.least(F.col("k") + F.col("one.k"), F.lit(1 << 40))).otherwise(F.col("k")).alias("k"))
        placed = met.where("n = 0").limit(1).count()
        left = save(led.groupBy("conv", "id", "need").agg(F.max("k").alias("k")), "left")
        n = left.count() if placed else 0
    cyclic = left.select("conv", "id", F.lit(True).alias("cyclic")).distinct()
    out = now.join(edges.select("conv", "id").distinct(), ["conv", "id"], "left_semi").join(cyclic, ["conv", "id"], "left").join(spots.select("conv", "id", F.col("spot").alias("own")), ["conv", "id"])
    return out.select("conv", "id", F.when(F.col("cyclic"), F.col("own")).otherwise(F.col("spot")).alias("spot"), "level", F.coalesce("cyclic", F.lit(False)).alias("cyclic"))


def op9_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link(events(spark.read.parquet(f"{sf_dir}/conversations.parquet"))).withColumnRenamed("conv", "conv_id")


SQL = """
WITH RECURSIVE event AS (
  SELECT conv_id, turn, text, 0::INT AS at_, CASE role WHEN 'user' THEN 'call' WHEN 'assistant' THEN 'result' ELSE 'note' END AS kind,
    CASE role WHEN 'user' THEN 'turn:' || turn WHEN 'assistant' THEN 'turn:' || (turn - 1) END AS id,
    CASE WHEN role = 'user' AND turn >= 2 THEN 'turn:' || (turn - 2) END AS need, role FROM conversations
), line AS (
  SELECT *, CASE kind
    WHEN 'call' THEN '{"arguments":{' || CASE WHEN need IS NOT NULL THEN '"history":{"$from":"' || need || '"},' ELSE '' END
      || '"prompt":' || coalesce(to_json(text)::VARCHAR, 'null') || '},"id":"' || id || '","kind":"call","name":"reply"}'
    WHEN 'result' THEN '{"content":' || coalesce(to_json(text)::VARCHAR, 'null') || ',"id":"' || id || '","kind":"result"}'
    ELSE '{"content":' || coalesce(to_json(text)::VARCHAR, 'null') || ',"kind":"note","role":' || coalesce(to_json(role)::VARCHAR, 'null') || '}' END AS line FROM event
), ids AS (
  SELECT conv_id, id, min({'t': turn, 'd': md5(line)}) FILTER (WHERE kind = 'call') AS c, min({'t': turn, 'd': md5(line)}) FILTER (WHERE kind = 'result') AS r
  FROM line WHERE id IS NOT NULL GROUP BY ALL
), told AS (
  SELECT line.*, c, r, CASE WHEN kind = 'note' THEN 'note'
    WHEN (CASE kind WHEN 'call' THEN c ELSE r END) <> {'t': turn, 'd': md5(line)} THEN 'repeated'
    WHEN kind = 'call' THEN CASE WHEN r IS NULL THEN 'unanswered' ELSE 'linked' END
    ELSE CASE WHEN c IS NULL THEN 'orphan' ELSE 'linked' END END AS status
  FROM line LEFT JOIN ids USING (conv_id, id)
), edge AS (
  SELECT DISTINCT a.conv_id, a.id, CASE WHEN b.c IS NOT NULL THEN need END AS need
  FROM told a LEFT JOIN ids b ON a.conv_id = b.conv_id AND a.need = b.id WHERE a.kind = 'call' AND a.status <> 'repeated'
), path AS (
  SELECT conv_id, id, 0::BIGINT AS level FROM edge WHERE need IS NULL
  UNION ALL
  SELECT edge.conv_id, edge.id, path.level + 2 FROM path JOIN edge ON edge.conv_id = path.conv_id AND edge.need = path.id
), deepest AS (
  SELECT conv_id, id, max(level) AS level FROM path GROUP BY ALL
)
SELECT conv_id, turn, at_ AS "at", kind, id, CASE kind WHEN 'call' THEN 'reply' END AS name, status,
  CASE WHEN status = 'linked' THEN CASE kind WHEN 'call' THEN r.t ELSE c.t END END AS partner_turn,
  kind <> 'call' OR coalesce(text, '') <> '' AS valid,
  CASE WHEN kind = 'call' AND text IS NULL THEN 'prompt is no string' WHEN kind = 'call' AND text = '' THEN 'prompt is too short' ELSE '' END AS errors,
  CASE WHEN kind = 'call' AND status <> 'repeated' THEN (told.need IS NOT NULL AND edge.need IS NULL)::BIGINT END AS open_needs,
  turn AS order_turn, 0::BIGINT AS order_step,
  CASE WHEN kind = 'note' OR status = 'repeated' THEN NULL WHEN status = 'orphan' THEN 0 WHEN kind = 'call' THEN deepest.level ELSE deepest.level + 1 END AS level, line
FROM told LEFT JOIN deepest USING (conv_id, id) LEFT JOIN edge USING (conv_id, id)
"""
QUERIES = {"op9_tool_calls": op9_tool_calls}
ORACLE = {"op9_tool_calls": SQL}
