"""Text made from rows: templates and aligned tables."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def execute(template: str, values: dict[str, Column]) -> Column:
    """The template with {{.name}} replaced by the values as strings; null if one of those it names is null."""
    out = F.lit(template)
    for name, value in values.items():
        for mark in (f"{{{{.{name}}}}}", f"{{{{ .{name} }}}}"):
            if mark in template:
                out = F.replace(out, F.lit(mark), value.cast("string"))
    return out


def interpolate(*parts: Column | str) -> Column:
    """Strings and columns (text, whole numbers, doubles, truth values) one after the other."""
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


def align(s: Column) -> Column:
    """Lines with tabs as columns that are as wide as their widest cell and two blanks."""

    def one(text: str | None) -> str | None:
        if text is None:
            return None
        rows = [line.split("\t") for line in text.replace("\\n", "\n").replace("\\t", "\t").split("\n")]
        widths: dict[int, int] = {}
        for row in rows:
            for i, cell in enumerate(row[:-1]):
                widths[i] = max(widths.get(i, 0), len(cell) + 2)
        return "\n".join("".join(cell.ljust(widths[i]) if i < len(row) - 1 else cell for i, cell in enumerate(row)) for row in rows)

    return F.pandas_udf(lambda x: pd.Series([one(v) for v in x], dtype="object"), "string")(s)
