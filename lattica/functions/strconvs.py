"""Between text and numbers. Text that is none gives null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DIGITS = "0123456789abcdefghijklmnopqrstuvwxyz"


def atoi(s: Column) -> Column:
    s = F.btrim(s)
    return F.when(s.rlike(r"^[+-]?[0-9]+$"), s.try_cast("decimal(38,0)").try_cast("long"))


def itoa(n: Column) -> Column:
    return n.cast("long").cast("string")


def parse_float(s: Column) -> Column:
    return F.btrim(s).try_cast("double")


def format_float(x: Column) -> Column:
    """Without an exponent; whole numbers end in .0."""
    plain = F.rtrim(F.format_string("%.17f", x.cast("double")), F.lit("0"))
    short = x.cast("double").cast("string")
    return F.when(F.contains(short, F.lit("E")), F.when(F.endswith(plain, F.lit(".")), F.concat(plain, F.lit("0"))).otherwise(plain)).otherwise(short)


def parse_bool(s: Column) -> Column:
    word = F.lower(F.btrim(s))
    return F.when(word.isin("1", "t", "true"), True).when(word.isin("0", "f", "false"), False)


def format_bool(b: Column) -> Column:
    return b.cast("string")


def parse_int(s: Column, base: int) -> Column:
    digits = DIGITS[:base]
    s = F.lower(F.btrim(s))
    return F.when(s.rlike(f"^[+-]?[{digits}]+$"), (F.conv(F.regexp_replace(s, r"^[+-]", ""), base, 10).try_cast("decimal(20,0)") * F.when(F.startswith(s, F.lit("-")), -1).otherwise(1)).try_cast("long"))


def parse_uint(s: Column, base: int) -> Column:
    return F.when(~F.startswith(F.btrim(s), F.lit("-")), parse_int(s, base))


def format_int(n: Column, base: int) -> Column:
    text = F.lower(F.conv(F.abs(n).cast("string"), 10, base))
    return F.when(n < 0, F.concat(F.lit("-"), text)).otherwise(text)


def format_uint(n: Column, base: int) -> Column:
    return F.when(n >= 0, format_int(n, base))


def quote(s: Column) -> Column:
    """In double quotes; backslash, quote, newline and tab are escaped."""
    for old, new in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\t", "\\t")):
        s = F.replace(s, F.lit(old), F.lit(new))
    return F.concat(F.lit('"'), s, F.lit('"'))


def unquote(s: Column) -> Column:
    """What quote() or backquotes enclose; null if the text isn't enclosed."""
    inner = F.substring(s, F.lit(2), F.length(s) - 2)
    plain = F.replace(inner, F.lit("\\\\"), F.lit("\0"))
    for old, new in (('\\"', '"'), ("\\n", "\n"), ("\\t", "\t"), ("\0", "\\")):
        plain = F.replace(plain, F.lit(old), F.lit(new))
    enclosed = lambda q: (F.length(s) >= 2) & F.startswith(s, F.lit(q)) & F.endswith(s, F.lit(q))
    return F.when(enclosed('"'), plain).when(enclosed("`"), inner)
