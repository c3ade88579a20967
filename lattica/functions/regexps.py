"""Regular expressions of the kind that needs no backtracking: without look-around and back-references, with Unicode classes."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

BEYOND = re.compile(r"(?<!\\)(?:\\\\)*(?:\(\?(?:[=!>]|<[=!])|\\[1-9]|\\k<|[*+?}]\+)")
SPECIAL = r"([\\.+*?()|\[\]{}^$#&~-])"


def is_valid_pattern(pattern: str) -> bool:
    try:
        re.compile(pattern)
    except re.error:
        return False
    return not BEYOND.search(pattern)


def compiled(pattern: str) -> str:
    """The pattern as Spark takes it; ValueError if it is none or needs backtracking."""
    if not is_valid_pattern(pattern):
        raise ValueError(f"not a supported pattern: {pattern}")
    return "(?Ud)" + to_end(pattern.replace("(?P<", "(?<"))


def to_end(pattern: str) -> str:
    """$ outside classes means the end of the text, not the place before a last line end as well; with (?d) only \\n ends a line for a dot."""
    if re.search(r"\(\?[a-zA-Z]*m", pattern):
        return pattern  # of lines, as asked for
    out, at, within = [], 0, False
    while at < len(pattern):
        c = pattern[at]
        if c == "\\":
            out.append(pattern[at : at + 2])
            at += 2
            continue
        within = c == "[" or (within and c != "]")
        out.append("\\z" if c == "$" and not within else c)
        at += 1
    return "".join(out)


def valid(s: Column) -> Column:
    return F.pandas_udf(lambda x: pd.Series([None if v is None else is_valid_pattern(v) for v in x], dtype="object"), "boolean")(s)


def match(s: Column, pattern: str) -> Column:
    """Whether it occurs anywhere."""
    return s.rlike(compiled(pattern))


def find(s: Column, pattern: str) -> Column:
    """The first match; null if there is none."""
    return F.regexp_substr(s, F.lit(compiled(pattern)))


def find_all(s: Column, pattern: str, n: int = -1) -> Column:
    every = F.regexp_extract_all(s, F.lit(compiled(pattern)), F.lit(0))
    return every if n < 0 else F.slice(every, 1, n)


def replace_all(s: Column, pattern: str, new: str) -> Column:
    """$1 and ${name} in new stand for groups."""
    return F.regexp_replace(s, compiled(pattern), new)


def quote_meta(s: Column) -> Column:
    return F.regexp_replace(s, SPECIAL, r"\\$1")


def find_submatch(s: Column, pattern: str) -> Column:
    """[whole match, groups ...]; empty without a match."""
    p = compiled(pattern)
    groups = re.compile(pattern).groups
    return F.when(s.rlike(p), F.array(*(F.regexp_extract(s, p, i) for i in range(groups + 1)))).when(s.isNotNull(), F.array().cast("array<string>"))
