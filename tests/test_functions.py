"""What SQL cannot check, and the edges: nulls, empty values, text that does not parse."""

import hashlib
import hmac
import json

import pytest
from pyspark.sql import functions as F

from lattica.functions import digests, encodings, lists, maths, nets, paths, regexps, strconvs, strings, texts, times


def one(spark, *columns, **values):
    frame = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'string' if isinstance(v, str | None) else 'long' if isinstance(v, int) else 'double'}" for k, v in values.items())) if values else spark.range(1)
    return list(frame.select(*columns).first())


def test_strings(spark):
    s = F.col("s")
    got = one(spark, strings.index(s, "b"), strings.last_index(s, "é"), strings.split(s, ""), strings.title(s), strings.byte_slice(s, 1, 2), strings.count(s, ""), s=("éb-éx"))
    assert got == [2, 4, ["é", "b", "-", "é", "x"], "Éb-Éx", "�", 6]
    assert one(spark, strings.split(s, ""), strings.split(s, ","), strings.fields(s), strings.split_n(s, ",", 0), s="") == [[], [""], [], []]
    assert one(spark, strings.split_n(s, "", 2), strings.replace(s, "", "-", 2), strings.replace(s, "a", "X", 1), s="aba") == [["a", "ba"], "-a-ba", "Xba"]
    assert one(spark, strings.index(s, "b"), strings.split(s, ","), strings.has_prefix_any(s, ["a"]), strings.title(s), s=None) == [None] * 4
    assert one(spark, strings.split(s, "\\E."), s="a\\E.b") == [["a", "b"]]


def test_lists(spark):
    a, none = F.array(F.lit(3), F.lit(1), F.lit(3)), F.array().cast("array<int>")
    assert one(spark, lists.chunk(a, 2), lists.chunk(none, 2), lists.drop(a, 9), lists.total(none), lists.product(none), lists.average(none)) == [[[3, 1], [3]], [], [], 0, 1, 0.0]
    assert one(spark, lists.slice_strict(a, 1, 4), lists.item(a, 5), lists.numbers(F.lit(5), F.lit(0), -2), lists.numbers(F.lit(5), F.lit(5))) == [None, None, [5, 3, 1], []]
    with pytest.raises(ValueError):
        lists.take(a, -1)


def test_numbers(spark):
    x = F.col("x")
    assert one(spark, maths.round_away(x), maths.round_even(x), maths.trunc(x), maths.divide(x, F.lit(0)), x=-2.5) == [-3.0, -2.0, -2.0, None]
    assert one(spark, maths.gamma(x), maths.log_gamma(x), maths.frexp(x), x=0.0)[:2] == [None, float("inf")]
    got = one(spark, maths.euclid_div(x, F.lit(-2)), maths.euclid_mod(x, F.lit(-2)), maths.quo(x, F.lit(2)), maths.rem(x, F.lit(2)), x=-7)
    assert got == [4, 1, -3, -1]


def test_conversions(spark):
    s = F.col("s")
    assert one(spark, strconvs.atoi(s), strconvs.parse_float(s), strconvs.parse_bool(s), strconvs.parse_int(s, 16), s="x1") == [None] * 4
    assert one(spark, strconvs.unquote(s), strconvs.quote(strconvs.unquote(s)), s='"a\\\\n\\n"') == ["a\\n\n", '"a\\\\n\\n"']
    assert one(spark, strconvs.format_float(F.lit(1e10)), strconvs.format_int(F.lit(-255), 16)) == ["10000000000.0", "-ff"]


def test_times(spark):
    s = F.col("s")
    assert one(spark, times.duration(s), times.format_duration(times.duration(s)), s="-1h30m0.5s") == [-5400500000000, "-1h30m500ms"]
    assert one(spark, times.duration(s), times.is_time(s), times.parse(s, "2006-01-02"), s="later") == [None, False, None]


def test_codes(spark):
    s = F.col("s")
    for name, function in digests.HASHES.items():
        assert one(spark, digests.sign(name, F.lit("k"), s), s="é") == [hmac.new(b"k", "é".encode(), function).hexdigest()]
    assert one(spark, F.lower(F.hex(digests.sha224(s))), digests.sha512(s), s="abc") == [hashlib.sha224(b"abc").hexdigest(), hashlib.sha512(b"abc").hexdigest()]
    assert one(spark, encodings.base32_encode(s), encodings.base32_decode(encodings.base32_encode(s)), encodings.base32_decode(F.lit("1")), s="aé") == ["MHB2S===", "aé", None]
    assert one(spark, encodings.json_valid(s), encodings.yaml_valid(s), encodings.hex_decode(s), s='{"a":') == [False, False, None]
    assert one(spark, encodings.html_escape(s), encodings.html_unescape(F.lit("&amp;lt;")), s="<'&\">") == ["&lt;&#39;&amp;&quot;&gt;", "&lt;"]


def test_names(spark):
    s = F.col("s")
    assert one(spark, nets.parse_ip(s), nets.is_ipv6(s), nets.is_ipv4(s), nets.split_host_port(s), s="1::g") == [None, False, False, None]
    assert one(spark, paths.base(s), paths.parent(s), paths.extension(s), paths.clean(s), s="/a/.b/") == [".b", "/a", "", "/a/.b"]
    assert one(spark, paths.match(s, "*[a-c].t?t"), regexps.find_submatch(s, "(x)(y)?"), s="qb.txt") == [True, ["x", "x", ""]]
    with pytest.raises(ValueError):
        regexps.match(s, "a(?=b)")
    assert one(spark, texts.execute("{{.a}}-{{ .a }}", {"a": s}), s=None) == [None]


def test_equality(spark):
    from pyspark.sql import types as T

    from lattica.functions import values

    kinds = [T.StructType.fromDDL(x) for x in ("a int, l array<int>, z string", "l array<double>, a double, y int")]
    frame = spark.sql("SELECT named_struct('a', 1, 'l', array(1, null), 'z', cast(null as string)) p, named_struct('l', array(1D, null), 'a', 1D, 'y', n) q FROM VALUES (null), (1) t(n)")
    got = [r[0] for r in frame.select(values.equal(F.col("p"), F.col("q"), *kinds)).collect()]
    assert got == [True, False]
    assert one(spark, values.equal(F.lit(1), F.lit("1"), T.IntegerType(), T.StringType()), values.is_null_value(F.parse_json(F.lit("null")))) == [False, True]


def test_address_of_user_ids_beyond_sixteen_bits(spark, tmp_path):
    from lattica.plans import function_queries

    ids = [0, 65535, 65536, 89999, 2**40, 2**63 - 1]
    spark.createDataFrame(list(enumerate(ids)), "event_id long, user_id long").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    assert [r["value"] for r in function_queries.queries()["fn_net_ipv6"](spark, str(tmp_path)).collect()] == [True] * len(ids)
    assert one(spark, nets.is_ipv6(F.lit("2001:db8::10000")), nets.parse_ip(F.lit("2001:0DB8:0::10000"))) == [False, None]


def test_yaml_that_is_json_is_read_without_the_library(spark):
    import random

    yaml = pytest.importorskip("yaml")
    odd = [
        '{"a": 1, "a": 2}', '{"a": 1} {"b": 2}', "{}]", "{}}", "1 2", "[1 2]", "[1,]", '{"a" 1}', '{"a": 007}', '{"a": 1_0}', '{"a": -0}', '{"a": 1e5}', '{"a": 1.50}', "{a: 1}", '{"a": yes}', '{"a":\t1}', '{"<<": 1, "=": 2}',
        '{"a": "x # y: [z], {w}"}', '["---", "%", "!!int 3", "*x", "yes", "null", "1e5", "2020-01-01", ""]', '{"a": "\\n"}', '{"a": 123456789012345678}', '{"a": -1234567890123456789}', '{"a": 1}\n', "{", "", " ", "a: [1, 2]", '{"": 0}', '{"%s": 1}' % ("k" * 1100),
        '{"a"%s: 1}' % (" " * 1100), '{"a": [[1]]}', '{"a": {"b": 1}}', "null", "[[[1]]]", "[%s]" % ", ".join(["1"] * 600), '{"a": 1 # c\n}',
    ]
    draw = random.Random(7)
    parts = ["{", "}", "[", "]", ",", ":", " ", '"', '"a"', '"b"', '"b": ', "1", "-", "0", "true", "null", ".", "\\", "#", "\t", "\n"]
    made = ["".join(draw.choice(parts) for _ in range(draw.randint(1, 6))) for _ in range(1500)]
    flat = ["{" + draw.choice(["", " "]) + draw.choice([",", ", ", " , "]).join(f'"{draw.choice("abcdef")}"{draw.choice([":", ": ", " : "])}{draw.choice(["1", "-70", "[]", "[1,2]", "null", chr(34) * 2])}' for _ in range(draw.randint(0, 3))) + "}" for _ in range(500)]
    texts = [*odd, *made, *flat]

    def want(t):
        try:
            return json.dumps(yaml.safe_load(t), ensure_ascii=False, default=str)
        except Exception:
            return None

    rows = spark.createDataFrame([(t, want(t)) for t in texts], "t string, want string").select("t", F.to_json(encodings.yaml_unmarshal(F.col("t"))).alias("got"), F.to_json(F.try_parse_json("want")).alias("want"), F.col("t").rlike(encodings.ALIKE).alias("alike"))
    got = rows.collect()
    assert [r for r in got if r["got"] != r["want"]] == [] and sum(r["alike"] for r in got) > 500


def test_equal_yaml_texts_are_parsed_once(spark, monkeypatch, tmp_path):
    log = f"{tmp_path}/calls"

    def load(v):
        with open(log, "a") as f:
            f.write(f"{v}\n")
        return {"a": 1}

    monkeypatch.setattr(encodings, "_load", load)
    rows = spark.range(0, 500, 1, 1).select(F.when(F.col("id") % 2 == 0, "a: 1").otherwise('{"a": 1}').alias("t"))
    assert {r[0] for r in rows.select(F.to_json(encodings.yaml_unmarshal(F.col("t")))).collect()} == {'{"a":1}'}
    with open(log) as f:
        assert f.read() == "a: 1\n"
