"""Strings. Offsets count from 0; those of bytes are of the UTF-8 form."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPACE = r"(?U)\s+"
#: Bytes that repeat() makes at most; longer results are null.
MOST_BYTES = 1 << 24


def to_upper(s: Column) -> Column:
    return F.upper(s)


def to_lower(s: Column) -> Column:
    return F.lower(s)


def contains(s: Column, part: str) -> Column:
    return F.contains(s, F.lit(part))


def has_prefix(s: Column, prefix: str) -> Column:
    return F.startswith(s, F.lit(prefix))


def has_suffix(s: Column, suffix: str) -> Column:
    return F.endswith(s, F.lit(suffix))


def has_prefix_any(s: Column, prefixes: list[str]) -> Column:
    return _any([has_prefix(s, p) for p in prefixes], s)


def has_suffix_any(s: Column, suffixes: list[str]) -> Column:
    return _any([has_suffix(s, p) for p in suffixes], s)


def _any(tests: list[Column], s: Column) -> Column:
    out = F.when(s.isNotNull(), F.lit(False))
    for t in tests:
        out = t | out
    return out


def join(parts: Column, separator: str) -> Column:
    """Null if any part is null."""
    return F.when(~F.exists(parts, lambda x: x.isNull()), F.array_join(parts, separator))


def trim(s: Column, cutset: str) -> Column:
    return F.btrim(s, F.lit(cutset))


def trim_left(s: Column, cutset: str) -> Column:
    return F.ltrim(s, F.lit(cutset))


def trim_right(s: Column, cutset: str) -> Column:
    return F.rtrim(s, F.lit(cutset))


def trim_prefix(s: Column, prefix: str) -> Column:
    return F.when(has_prefix(s, prefix), F.substring(s, len(prefix) + 1, F.length(s))).otherwise(s)


def trim_suffix(s: Column, suffix: str) -> Column:
    return F.when(has_suffix(s, suffix), F.left(s, F.length(s) - len(suffix))).otherwise(s)


def _literals(parts: list[str]) -> str:
    return "|".join(re.escape(p) for p in parts if p)


def trim_prefix_any(s: Column, prefixes: list[str]) -> Column:
    """Takes off listed prefixes as long as one fits; at each step the first in the list that does."""
    return F.regexp_replace(s, f"^(?:{_literals(prefixes)})+", "") if any(prefixes) else s


def trim_suffix_any(s: Column, suffixes: list[str]) -> Column:
    return F.regexp_replace(s, f"(?:{_literals(suffixes)})+\\z", "") if any(suffixes) else s


def trim_space(s: Column) -> Column:
    """Takes off all Unicode white space at both ends."""
    return F.regexp_replace(s, r"(?U)^\s+|\s+\z", "")


def repeat(s: Column, n: int) -> Column:
    return F.when(F.octet_length(s) * n <= MOST_BYTES, F.repeat(s, n)) if n >= 0 else F.lit(None).cast("string")


def replace_all(s: Column, old: str, new: str) -> Column:
    return F.replace(s, F.lit(old), F.lit(new)) if old else replace(s, old, new, -1)


def replace(s: Column, old: str, new: str, n: int) -> Column:
    """The first n occurrences, all if n is negative. An empty old stands before each character and at the end."""
    if n == 0:
        return s
    parts = split_n(s, old, n + 1 if n > 0 else -1) if old else None
    if parts is not None:
        return F.array_join(parts, new)
    chars = F.concat(F.split(s, ""), F.array(F.lit("")))
    limit = n if n > 0 else 1 << 30
    return F.array_join(F.transform(F.when(s == "", F.array(F.lit(""))).otherwise(chars), lambda c, i: F.when(i < limit, F.concat(F.lit(new), c)).otherwise(c)), "")


def fields(s: Column) -> Column:
    return F.filter(F.split(s, SPACE), lambda x: x != "")


def split(s: Column, separator: str) -> Column:
    return split_n(s, separator, -1)


def split_n(s: Column, separator: str, n: int) -> Column:
    """At most n parts, the last with the rest; all if n is negative, none if it is 0. An empty separator cuts between characters."""
    none = F.array().cast("array<string>")
    if n == 0:
        return F.when(s.isNotNull(), none)
    if separator:
        return F.split(s, "\\Q" + separator.replace("\\E", "\\E\\\\E\\Q") + "\\E", n)
    chars = F.when(s == "", none).otherwise(F.split(s, ""))
    if n < 0:
        return chars
    head = F.slice(chars, 1, n - 1) if n > 1 else none
    return F.when(F.size(chars) <= n, chars).otherwise(F.concat(head, F.array(F.substring(s, n, F.length(s)))))


def index(s: Column, part: str) -> Column:
    """Byte offset of the first occurrence, else -1."""
    at = F.instr(s, part)
    return F.when(at == 0, -1).otherwise(F.octet_length(F.substring(s, F.lit(1), at - 1)))


def last_index(s: Column, part: str) -> Column:
    """Byte offset of the last occurrence, else -1."""
    at = F.instr(F.reverse(s), part[::-1])
    before = F.length(s) - at - len(part) + 1
    return F.when(F.lit(part) == "", F.octet_length(s)).when(at == 0, -1).otherwise(F.octet_length(F.substring(s, F.lit(1), before)))


def compare(a: Column, b: Column) -> Column:
    """-1, 0 or 1, by bytes."""
    return F.when(a < b, -1).when(a > b, 1).when(a == b, 0)


def count(s: Column, part: str) -> Column:
    """Occurrences that don't overlap; of an empty part one more than there are characters."""
    if not part:
        return F.length(s) + 1
    return ((F.length(s) - F.length(F.replace(s, F.lit(part), F.lit("")))) / len(part)).cast("int")


def title(s: Column) -> Column:
    """Upper case after each character that is no letter or digit, lower case elsewhere."""
    chars = F.split(F.lower(s), "")
    before = lambda i: F.get(chars, i - 1)
    cased = F.transform(chars, lambda c, i: F.when((i == 0) | ~F.rlike(F.coalesce(before(i), F.lit("a")), F.lit(r"[\p{L}\p{N}]")), F.upper(c)).otherwise(c))
    return F.array_join(cased, "")


def contains_any(s: Column, chars: str) -> Column:
    return F.translate(s, chars, "") != s


def equal_fold(a: Column, b: Column) -> Column:
    """Equal but for the case of A-Z."""
    return F.translate(a, UPPER, LOWER) == F.translate(b, UPPER, LOWER)


def rune_count(s: Column) -> Column:
    return F.char_length(s)


def byte_at(s: Column, i: int) -> Column:
    """The byte's value, null outside the string."""
    octets = F.encode(s, "UTF-8")
    return F.when((F.lit(i) >= 0) & (F.octet_length(s) > i), F.conv(F.hex(F.substring(octets, i + 1, 1)), 16, 10).cast("int"))


def byte_slice(s: Column, a: int, b: int) -> Column:
    """Bytes a to b, clamped; what is no UTF-8 becomes U+FFFD."""
    a = max(0, a)
    return F.make_valid_utf8(F.substring(F.encode(s, "UTF-8"), a + 1, max(0, b - a)).cast("string"))


def runes(s: Column) -> Column:
    return split(s, "")


def slice_runes(s: Column, a: int, b: int) -> Column:
    a = max(0, a)
    return F.substring(s, a + 1, max(0, b - a))


def to_valid_utf8(octets: Column) -> Column:
    return F.make_valid_utf8(octets.cast("string"))


def min_runes(s: Column, n: int) -> Column:
    return F.char_length(s) >= n


def max_runes(s: Column, n: int) -> Column:
    return F.char_length(s) <= n
