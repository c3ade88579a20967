"""Slash-separated paths."""

from __future__ import annotations

import posixpath

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def clean(p: Column) -> Column:
    """The shortest path with the same meaning; of an empty one a dot."""

    def one(v: str | None) -> str | None:
        return None if v is None else posixpath.normpath(("/" + v.lstrip("/")) if v.startswith("//") else v)

    return F.pandas_udf(lambda x: pd.Series([one(v) for v in x], dtype="object"), "string")(p)


def base(p: Column) -> Column:
    """The last name; the whole path if it has none."""
    name = F.substring_index(F.rtrim(p, F.lit("/")), "/", -1)
    return F.when(name.isin("", "..", "."), p).otherwise(name)


def parent(p: Column) -> Column:
    """What stands before the last name; a dot if that is nothing, / below the root."""
    before = F.regexp_extract(p, r"^(.*?)/*[^/]+/*$", 1)
    return F.when(before != "", before).when(F.startswith(p, F.lit("/")), "/").otherwise(".")


def extension(p: Column) -> Column:
    """With its dot; empty if the last name has none but a first one."""
    return F.regexp_extract(F.substring_index(F.rtrim(p, F.lit("/")), "/", -1), r"^.+(\.[^.]*)$", 1)


def glob_pattern(glob: str) -> str:
    """The regular expression of a glob with * ? and [...], none of which crosses a slash."""
    out, i = "", 0
    while i < len(glob):
        c = glob[i]
        if c == "[":
            end = glob.index("]", i + 2)
            inner = glob[i + 1 : end].replace("\\", "\\\\")
            out += "[^/" + inner[1:] + "]" if inner[0] in "^!" else "[" + inner + "]"
            i = end
        else:
            out += {"*": "[^/]*", "?": "[^/]"}.get(c) or ("\\" + c if c in r"\.+()|{}^$]" else c)
        i += 1
    return f"^{out}$"


def match(p: Column, glob: str) -> Column:
    return p.rlike(glob_pattern(glob))


def split(p: Column) -> Column:
    """[directory with its slash, last name]."""
    return F.array(F.regexp_extract(p, r"^(.*/)?", 1), F.substring_index(p, "/", -1))


def is_absolute(p: Column) -> Column:
    return F.startswith(p, F.lit("/"))


def join(parts: Column) -> Column:
    """Joined by slashes; an absolute part starts anew."""
    step = lambda a, x: F.when(F.startswith(x, F.lit("/")) | (a == ""), x).when(F.endswith(a, F.lit("/")), F.concat(a, x)).otherwise(F.concat(a, F.lit("/"), x))
    return F.aggregate(parts, F.lit(""), step)
