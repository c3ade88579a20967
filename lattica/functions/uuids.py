"""UUIDs as text of 36 characters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FORM = r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}\z"


def valid(s: Column) -> Column:
    return s.rlike(FORM)


def version(s: Column) -> Column:
    return F.when(valid(s), F.conv(F.substring(s, 15, 1), 16, 10).cast("int"))


def urn(s: Column) -> Column:
    return F.when(valid(s), F.concat(F.lit("urn:uuid:"), F.lower(s)))
