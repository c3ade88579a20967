"""Meeting and checking constraints; defaults; import of schemas."""

import pytest
from pyspark.sql import functions as F

from lattica.operators import comprehensions, unification
from lattica.plans.constraints import Anything, Bound, Field, Items, Kind, Nothing, OneOf, Pattern, Record, Passes, Value, between, enum, meet, opened, record, counted, error, every, valid_json, validate, with_schema_defaults, MatchIf, MatchN, OrNull
from lattica.sources.json_schema import constraint


def paths(frame, schema, **options):
    return [sorted((v["path"], v["code"]) for v in r["violations"]) for r in validate(frame, schema, **options).collect()]


def test_meet_is_a_lattice():
    samples = [Anything(), Nothing(), Kind("int"), Kind("string"), Bound(">=", 3), between(1, 5), Value(4), enum(1, 4, 9), Pattern("^a"), record({"a": Kind("int")}), Items(Kind("int"), least=1)]
    for a in samples:
        assert meet(a, a) == a
        assert meet(a, Anything()) == a and isinstance(meet(a, Nothing()), Nothing)
        for b in samples:
            assert isinstance(meet(a, b), Nothing) == isinstance(meet(b, a), Nothing)


def test_meet_finds_empty_ranges():
    assert isinstance(meet(Bound(">", 3), Bound("<", 3)), Nothing)
    assert isinstance(meet(meet(Kind("int"), Bound(">", 3)), Bound("<", 4)), Nothing)
    assert not isinstance(meet(meet(Kind("number"), Bound(">", 3)), Bound("<", 4)), Nothing)
    assert isinstance(meet(Kind("uint8"), Value(300)), Nothing) and meet(Kind("uint8"), Value(200)) is not None
    assert isinstance(meet(Kind("int"), Kind("string")), Nothing) and meet(Kind("number"), Kind("int")) == Kind("int")
    assert isinstance(meet(Kind("int"), Value(1.0)), Nothing)


def test_meet_of_unions_keeps_what_is_left():
    assert meet(enum(1, 2, 3, default=1), Bound(">", 1)) == OneOf((Value(2), Value(3)), 0)
    assert meet(enum(1, 2), enum(2, 3)) == Value(2)
    assert isinstance(meet(enum(1, 2), Bound(">", 5)), Nothing)
    assert meet(enum(1, 2, default=0), enum(1, 2)).default == 0


def test_meet_of_records():
    a, b = record({"x": Kind("int"), "y?": Kind("string")}, closed=False), record({"x": Bound(">", 0), "z": Kind("bool")}, closed=False)
    both = dict(meet(a, b).fields)
    assert set(both) == {"x", "y", "z"} and both["y"].optional and not both["x"].optional
    assert isinstance(meet(record({"x": Kind("int")}), record({"z": Kind("int")}, closed=False)), Nothing)
    assert dict(meet(record({"x": Kind("int")}), record({"z?": Kind("int")}, closed=False)).fields)["z"].constraint == Nothing("field is not allowed")
    assert meet(opened(record({"x": Kind("int")})), record({"z": Kind("int")}, closed=False)).closed is False


def test_checks(spark):
    frame = spark.sql("SELECT * FROM VALUES (1, 'ab', array(1, 2), map('k1', 5), named_struct('p', 1.5D)), (null, 'b', array(1, null), map('q', 5), named_struct('p', cast(null as double))) t(n, s, a, m, r)")
    schema = record({
        "n": meet(Kind("int"), Bound(">", 0)), "s": Pattern("^a"), "a": Items(Kind("int"), least=2, unique=True),
        "m": record({}, patterns={"^k": Bound("<", 9)}), "r": record({"p": Kind("float")}),
    })
    assert paths(frame, schema) == [[], [("a.1", "incomplete"), ("m.q", "eval"), ("n", "incomplete"), ("r.p", "incomplete"), ("s", "eval")]]
    assert paths(frame, record({"n": Kind("int")}, closed=False), concrete=False) == [[], []]
    assert paths(frame.select("n"), record({"n": Kind("string"), "z": Kind("int")}))[0] == [("n", "eval"), ("z", "incomplete")]
    assert paths(frame.select("n").limit(0), record({"n": Kind("int")})) == []
    assert paths(frame.select("n"), record({"n?": Passes("undecided", lambda c: F.lit(None).cast("boolean"))})) == [[("n", "incomplete")], []]


def test_defaults(spark):
    frame = spark.sql("SELECT * FROM VALUES (1, null), (null, 2) t(a, b)")
    got = with_schema_defaults(frame, record({"a": enum(7, 8, default=1), "c": Value("x")})).collect()
    assert [tuple(r) for r in got] == [(1, None, "x"), (8, 2, "x")]
    assert [tuple(r) for r in unification.with_defaults(frame, {"b": (F.col("a") + 1, ["a"]), "a": F.lit(5)}).collect()] == [(1, 2), (5, 2)]
    with pytest.raises(ValueError):
        unification.with_defaults(frame, {"a": (F.col("b"), ["b"]), "b": (F.col("a"), ["a"])})


def test_guards_and_labels(spark):
    frame = spark.sql("SELECT * FROM VALUES ('a', 1), ('a', 1), ('b', 1), ('b', 2), (null, 3) t(k, v)")
    assert sorted(map(tuple, comprehensions.labelled(frame, F.col("k"), F.col("v")).collect())) == [("a", 1, False), ("b", None, True)]
    decided, undecided = comprehensions.guard(frame, F.col("k") == "a")
    assert (decided.count(), undecided.count()) == (2, 1)
    with pytest.raises(ValueError):
        comprehensions.every_pair(frame, frame, most=3)


def test_json_schema():
    schema = {"type": "object", "properties": {"a": {"allOf": [{"type": "integer"}, {"minimum": 2}]}, "b": {"oneOf": [{"const": 1}, {"type": "string"}]}, "c": {"type": "array", "items": {"$ref": "#"}, "maxItems": 3}}, "required": ["a"], "additionalProperties": False}
    got = constraint(schema)
    assert isinstance(got, Record) and got.closed
    fields = dict(got.fields)
    assert fields["a"] == Field(meet(Kind("int"), Bound(">=", 2))) and fields["b"].optional
    assert fields["b"].constraint == OneOf((Value(1), Kind("string"))) and fields["c"].constraint.most == 3
    assert isinstance(constraint(False), Nothing) and constraint(True) == Anything()


def test_json_schema_deeper_than_sixteen_levels(spark):
    schema, kind, value = {"type": "integer", "minimum": 5}, "int", "3"
    for _ in range(20):
        schema, kind, value = {"type": "object", "properties": {"a": schema}}, f"struct<a: {kind}>", f"named_struct('a', {value})"
    rows = spark.range(1).selectExpr(f"cast({value} as {kind}) as v").select("v.*")
    assert [v["code"] for v in validate(rows, constraint(schema)).first()["violations"]] == ["eval"]
    tree = {"$ref": "#/$defs/n", "$defs": {"n": {"type": "object", "properties": {"a": {"$ref": "#/$defs/n"}}}}}
    kind, value = "int", "3"
    for _ in range(30):
        kind, value = f"struct<a: {kind}>", f"named_struct('a', {value})"
    rows = spark.range(1).selectExpr(f"cast({value} as {kind}) as v").select("v.*")
    assert validate(rows, constraint(tree)).first()["violations"]


def test_json_schema_with_null(spark):
    frame = spark.sql("SELECT * FROM VALUES (1, 'a', array('x', null)), (null, null, null) t(n, s, a)")
    schema = {"type": "object", "required": ["n", "s", "a"], "properties": {"n": {"type": ["integer", "null"], "minimum": 2}, "s": {"enum": ["b", None]}, "a": {"anyOf": [{"type": "array", "items": {"type": ["string", "null"]}}, {"type": "null"}]}}}
    assert paths(frame, constraint(schema)) == [[("n", "eval"), ("s", "eval")], []]
    assert paths(frame.select("n"), constraint({"type": "object", "required": ["n"], "properties": {"n": {"enum": [None]}}})) == [[("n", "eval")], []]
    assert paths(frame.select("n"), constraint({"type": "object", "properties": {"n": {"enum": []}}})) == [[("n", "eval")], []]
    assert paths(frame.select("n"), constraint({"type": "object", "required": ["n"], "properties": {"n": {"type": "integer"}}})) == [[], [("n", "incomplete")]]
    assert constraint({"type": "null"}) == OrNull(Nothing("only null is allowed")) and isinstance(constraint({"enum": []}), Nothing)
    assert meet(OrNull(Kind("int")), OrNull(Bound(">", 1))) == OrNull(meet(Kind("int"), Bound(">", 1))) and meet(OrNull(Kind("int")), Value(3)) == Value(3)


def test_json_schema_of_other_fields(spark):
    frame = spark.sql("SELECT 1 AS a, 'x' AS b, 3 AS c, map('k', 1, 'z', 9) AS m")
    schema = {"type": "object", "properties": {"a": {"type": "integer"}, "m": {"type": "object", "properties": {"k": {"type": "integer"}}, "additionalProperties": {"type": "integer", "maximum": 5}}}, "additionalProperties": {"type": "integer"}}
    assert paths(frame, constraint(schema)) == [[("b", "eval"), ("m.z", "eval")]]
    only = record({"a": Kind("int")}, closed=False)
    assert paths(frame.select("a", "c"), meet(Record(rest=Bound(">", 5)), only)) == [[("a", "eval"), ("c", "eval")]]
    for value, good in ((0.3, True), (0.35, False)):
        assert (paths(spark.createDataFrame([(value,)], "x double"), constraint({"properties": {"x": {"multipleOf": 0.1}}})) == [[]]) == good


def test_branches_that_say_what_is_wrong(spark):
    frame = spark.sql("SELECT * FROM VALUES (1), (7) t(n)")
    said = lambda c: [[v["message"] for v in r["violations"]] for r in validate(frame, record({"n": c})).collect()]
    assert said(enum(7, 8) | error("seven or eight")) == [["seven or eight"], []]
    assert said(meet(enum(7, 8) | error("seven or eight"), Bound("<", 8))) == [["seven or eight"], []]
    assert meet(enum(7, 8) | error("no"), Bound("<", 2)) == error("no")
    assert said(MatchN(Bound(">=", 2), (Bound(">", 0), Bound(">", 5)))) == [["not >= 2"], []] and said(MatchIf(Bound(">", 5), Value(8), Value(1))) == [[], ["not 8"]]
    assert every(Kind("int"), Bound(">", 1), Bound("<", 3)) == meet(meet(Kind("int"), Bound(">", 1)), Bound("<", 3)) and every() == Anything()


def test_counts_are_those_of_the_arrays(spark):
    frame = spark.sql("SELECT * FROM VALUES (1, 'ab', array(1, 9)), (null, 'b', array(8, null)), (5, null, null) t(n, s, a)")
    schema = record({"n": meet(Kind("int"), Bound(">", 3)), "s": Pattern("^a$"), "a?": Items(Bound("<", 5)), "z": Kind("int")})
    each = validate(frame, schema).select(F.inline("violations")).groupBy("path", "code", "message").count()
    assert sorted(map(tuple, counted(frame, schema).collect())) == sorted(map(tuple, each.collect())) != []
    assert counted(frame.limit(0), schema).collect() == [] and counted(frame, record({}, closed=False)).collect() == []


def test_text_against_a_schema(spark):
    schema = record({"a": meet(Kind("int"), Bound("<", 5)), "b?": Pattern("^x")})
    texts = ['{"a": 1}', '{"a": 9}', '{"a": "1"}', '{"a": 1, "b": "xy"}', '{"a": 1, "b": "y"}', '{"a": 1, "c": 2}', "{}", "[1]", "{", "", None]
    kind = spark.sql("SELECT named_struct('a', 1L, 'b', '') t").schema["t"].dataType
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(valid_json(F.col("t"), schema, kind)).collect()]
    assert got == [True, False, False, True, False, False, False, False, False, False, None]


def test_ends_of_texts(spark):
    frame = spark.sql("SELECT explode(array('abc', 'abc\\n', 'a$', 'a\\u0085c')) s")
    hits = lambda p: [not x for x in paths(frame, record({"s": Pattern(p)}))]
    assert hits("^[a-z]+$") == [True, False, False, False] and hits("^a[$]$") == hits("^a\\$$") == [False, False, True, False]
    assert hits("^a.c$") == [True, False, False, True] and hits("(?m)c$") == [True, True, False, True]
    assert isinstance(meet(Pattern("^[a-z]+$"), Value("abc\n")), Nothing)


def test_part_keys_beyond_sixteen_bits(spark):
    from lattica.plans.operator_queries import LINE

    lines = spark.sql("SELECT 1L l_orderkey, k l_partkey, 10D l_quantity, 0.05D l_discount, 'A' l_returnflag, now() l_shipdate FROM VALUES (0L), (65535L), (65536L), (119999L), (9000000000L) t(k)")
    assert counted(lines, LINE).collect() == []
    assert counted(lines, record({"l_partkey": Kind("uint16")}, closed=False)).collect() == [("l_partkey", "eval", "not a uint16", 3)]
