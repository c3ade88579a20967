"""JSON, YAML, CSV, base 64 and 32, hexadecimal and HTML. Text that doesn't decode gives null."""

from __future__ import annotations

import base64
import csv
import io
import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

try:  # YAML is read and written only where the library is there; JSON is YAML too
    import yaml
except ImportError:
    yaml = None


def _texts(function) -> object:
    def run(x: pd.Series) -> pd.Series:
        return pd.Series([None if v is None else function(v) for v in x], dtype="object")

    return F.pandas_udf(run, "string")


def json_marshal(c: Column) -> Column:
    """Compact JSON of a struct, map or array; null members are written."""
    return F.to_json(c, {"ignoreNullFields": "false"})


def json_unmarshal(s: Column) -> Column:
    """A variant; null if the text is no JSON."""
    return F.try_parse_json(s)


def json_valid(s: Column) -> Column:
    return F.when(s.isNotNull(), F.try_parse_json(s).isNotNull())


def json_compact(s: Column) -> Column:
    return F.to_json(F.try_parse_json(s))


def json_indent(s: Column, prefix: str = "", indent: str = "  ") -> Column:
    def one(v: str) -> str | None:
        try:
            return prefix + json.dumps(json.loads(v), indent=indent, ensure_ascii=False)
        except ValueError:
            return None

    return _texts(one)(s)


def _load(v: str) -> object:
    if yaml is not None:
        return yaml.safe_load(v)
    return json.loads(v)


_TEXT = r'"[ !#-\[\]-~]*"'
_SCALAR = rf"(?:{_TEXT}|-?[1-9][0-9]{{0,17}}|0|true|false|null)"
_LIST = rf"\[ *(?:{_SCALAR}(?: *, *{_SCALAR})*+)? *\]"
_MEMBER = rf"{_TEXT} *: *(?:{_SCALAR}|{_LIST})"
#: Texts that are the same in JSON and YAML if no key is there twice: a record or a list on one line, of ASCII without escapes and whole
#: numbers, short enough for YAML's keys. What is nested deeper, numbers with a point and the like are left to the library.
ALIKE = rf"^(?=.{{1,1000}}\z) *(?:{_LIST}|\{{ *(?:{_MEMBER}(?: *, *{_MEMBER})*+)? *\}}) *\z"


def yaml_unmarshal(s: Column) -> Column:
    """A variant; null if the text is no YAML. Plain JSON is read by Spark, all else by the library, equal texts of a batch once."""

    def one(v: str) -> str | None:
        try:
            return json.dumps(_load(v), ensure_ascii=False, default=str)
        except Exception:  # the library's errors have no common base of its own
            return None

    def run(x: pd.Series) -> pd.Series:
        known = {v: one(v) for v in x.dropna().unique()}
        return pd.Series([known.get(v) for v in x], dtype="object")

    plain = F.when(s.rlike(ALIKE), F.try_parse_json(s))
    return F.coalesce(plain, F.try_parse_json(F.pandas_udf(run, "string")(F.when(plain.isNull(), s))))


def yaml_valid(s: Column) -> Column:
    return F.when(s.isNotNull(), yaml_unmarshal(s).isNotNull())


def yaml_marshal(c: Column) -> Column:
    """Block YAML of a struct, map or array, or JSON where the library is not there: that is flow YAML."""
    return _texts(lambda v: yaml.safe_dump(json.loads(v), allow_unicode=True, sort_keys=True) if yaml is not None else v)(json_marshal(c))


def base64_encode(x: Column) -> Column:
    return F.base64(x.cast("binary"))


def base64_decode(s: Column) -> Column:
    return F.make_valid_utf8(F.try_to_binary(s, F.lit("base64")).cast("string"))


def base64_url_encode(x: Column) -> Column:
    return F.translate(F.base64(x.cast("binary")), "+/", "-_")


def base64_raw_url_encode(x: Column) -> Column:
    return F.rtrim(base64_url_encode(x), F.lit("="))


def base64_url_decode(s: Column) -> Column:
    """Padding may be missing."""
    plain = F.rtrim(F.translate(s, "-_", "+/"), F.lit("="))
    return base64_decode(F.rpad(plain, (F.ceil(F.length(plain) / 4) * 4).cast("int"), F.lit("=")))


base64_raw_url_decode = base64_url_decode


def _decoded(function, v: str) -> str | None:
    try:
        return function(v.upper() + "=" * (-len(v) % 8)).decode("utf-8", "replace")
    except ValueError:
        return None


def base32_encode(x: Column) -> Column:
    return _texts(lambda v: base64.b32encode(v.encode()).decode())(x.cast("string"))


def base32_decode(s: Column) -> Column:
    return _texts(lambda v: _decoded(base64.b32decode, v))(s)


def base32_hex_encode(x: Column) -> Column:
    return _texts(lambda v: base64.b32hexencode(v.encode()).decode())(x.cast("string"))


def base32_hex_decode(s: Column) -> Column:
    return _texts(lambda v: _decoded(base64.b32hexdecode, v))(s)


def hex_encode(x: Column) -> Column:
    return F.lower(F.hex(x.cast("binary")))


def hex_decode(s: Column) -> Column:
    return F.when(F.length(s) % 2 == 0, F.unhex(s))


def hex_dump(x: Column) -> Column:
    """Pairs of digits with blanks between."""
    return F.rtrim(F.regexp_replace(hex_encode(x), "(..)", "$1 "))


def hex_encoded_len(n: Column) -> Column:
    return n * 2


def hex_decoded_len(n: Column) -> Column:
    return F.floor(n / 2)


def csv_decode(s: Column) -> Column:
    """Rows of cells, with quoting; blank lines are left out."""

    def run(x: pd.Series) -> pd.Series:
        return pd.Series([None if v is None else [r for r in csv.reader(io.StringIO(v)) if r] for v in x], dtype="object")

    return F.pandas_udf(run, "array<array<string>>")(s)


def csv_encode(cells: list[Column]) -> Column:
    """One line; cells with a comma, a quote or a line end are quoted."""
    quoted = []
    for c in cells:
        text = F.coalesce(c.cast("string"), F.lit(""))
        quoted.append(F.when(text.rlike('[,"\n\r]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text))
    return F.concat_ws(",", *quoted)


#: Characters and their entities; the ampersand goes first when escaping and last when reading.
ENTITIES = [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")]


def html_escape(s: Column) -> Column:
    for char, entity in ENTITIES:
        s = F.replace(s, F.lit(char), F.lit(entity))
    return s


def html_unescape(s: Column) -> Column:
    s = F.replace(s, F.lit("&apos;"), F.lit("'"))
    for char, entity in reversed(ENTITIES):
        s = F.replace(s, F.lit(entity), F.lit(char))
    return s
