"""Times as RFC 3339 strings, durations as integer nanoseconds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NANOSECOND = 1
MICROSECOND = 1000 * NANOSECOND
MILLISECOND = 1000 * MICROSECOND
SECOND = 1000 * MILLISECOND
MINUTE = 60 * SECOND
HOUR = 60 * MINUTE
# The grammar of RFC 3339: full-date, partial-time and time-offset; a blank may stand for the T.
_DATE, _TIME, _OFFSET = "[0-9]{4}(?:-[0-9]{2}){2}", "[0-9]{2}(?::[0-9]{2}){2}(?:[.][0-9]+)?", "(?:Z|[-+][0-9]{2}:[0-9]{2})"
RFC3339 = rf"^{_DATE}[ T]{_TIME}{_OFFSET}\z"
# Units of durations and their nanoseconds.
UNITS = {"ns": NANOSECOND, "us": MICROSECOND, "µs": MICROSECOND, "μs": MICROSECOND, "ms": MILLISECOND, "s": SECOND, "m": MINUTE, "h": HOUR, "d": 24 * HOUR}
_TERM = r"(\d+(?:\.\d+)?)(ns|us|µs|μs|ms|s|m|h|d)"
#: Layouts by the names that formats usually have here, as Spark patterns.
LAYOUTS = {"2006-01-02": "yyyy-MM-dd", "2006-01-02 15:04:05": "yyyy-MM-dd HH:mm:ss", "2006-01-02T15:04:05Z": "yyyy-MM-dd'T'HH:mm:ss'Z'"}


def is_time(s: Column) -> Column:
    return s.rlike(RFC3339)


def is_duration(s: Column) -> Column:
    return s.rlike(rf"^[+-]?(?:{_TERM})+\z")


def duration(s: Column) -> Column:
    """Nanoseconds of text such as 1h30m or -1.5s; null if it is none."""
    numbers, units = F.regexp_extract_all(s, F.lit(_TERM), F.lit(1)), F.regexp_extract_all(s, F.lit(_TERM), F.lit(2))
    unit = F.create_map(*(F.lit(v) for pair in UNITS.items() for v in pair))
    sizes = F.transform(numbers, lambda n, i: n.cast("double") * unit[F.get(units, i)])
    total = F.aggregate(sizes, F.lit(0.0), lambda a, x: a + x)
    return F.when(is_duration(s), (total * F.when(F.startswith(s, F.lit("-")), -1).otherwise(1)).cast("long"))


def unix(seconds: Column) -> Column:
    """RFC 3339 in UTC."""
    return F.date_format(F.convert_timezone(F.current_timezone(), F.lit("UTC"), F.timestamp_seconds(seconds).cast("timestamp_ntz")), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def parse(s: Column, layout: str) -> Column:
    """RFC 3339 of text in one of LAYOUTS; RFC 3339 text stays as it is; null where neither fits."""
    read = F.try_to_timestamp(s, F.lit(LAYOUTS[layout]))
    return F.when(is_time(s), s).otherwise(F.date_format(read, "yyyy-MM-dd'T'HH:mm:ss'Z'"))


def format_duration(n: Column) -> Column:
    """Such as 1h30m or 500ms; 0s of 0."""
    rest, parts = F.abs(n), []
    for unit, size in (("h", HOUR), ("m", MINUTE), ("s", SECOND), ("ms", MILLISECOND), ("µs", MICROSECOND), ("ns", NANOSECOND)):
        count = ((rest - F.pmod(rest, F.lit(size))) / size).cast("long")
        parts.append(F.when(count > 0, F.concat(count.cast("string"), F.lit(unit))).otherwise(F.lit("")))
        rest = F.pmod(rest, F.lit(size))
    text = F.concat(*parts)
    return F.when(n == 0, "0s").when(n < 0, F.concat(F.lit("-"), text)).otherwise(text)


def year(s: Column) -> Column:
    return F.substring(s, 1, 4).try_cast("int")


def month(s: Column) -> Column:
    return F.substring(s, 6, 2).try_cast("int")


def day(s: Column) -> Column:
    return F.substring(s, 9, 2).try_cast("int")


def text_of(timestamp: Column) -> Column:
    """RFC 3339 of a timestamp column, as UTC (the session's zone)."""
    return F.date_format(timestamp, "yyyy-MM-dd'T'HH:mm:ss'Z'")
