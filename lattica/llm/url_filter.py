"""Url rules by cascades of Bloom filters that are exact over the corpus's own keys. DataFrame operations only."""

from __future__ import annotations

import json
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import save

#: (verdict, host, path) of the query's rules.
RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]
#: Bits in a byte of a bit map: every byte stays ASCII, so that ascii() reads it.
PER_BYTE = 7


@dataclass(frozen=True)
class Level:
    """A Bloom filter over strings: n_hashes places, which depend on salt, among n_bits bits."""

    n_bits: int
    n_hashes: int
    salt: int
    bits: bytes = b""

    def places(self, key: Column) -> list[Column]:
        return [F.pmod(F.xxhash64(key, F.lit(self.salt), F.lit(i)), F.lit(self.n_bits)) for i in range(self.n_hashes)]

    def encode(self, keys: DataFrame) -> Level:
        """This filter with the column key of keys in it. What comes to the driver is bounded by n_bits."""
        places = keys.select(F.explode(F.array(*self.places(F.col("key")))).alias("p"))
        rows = places.groupBy(F.floor(F.col("p") / PER_BYTE).cast("int").alias("at")).agg(F.bit_or(F.pow(F.lit(2), F.col("p") % PER_BYTE).cast("int")).alias("b")).collect()
        bits = bytearray(self.n_bits // PER_BYTE + 1)
        for row in rows:
            bits[row["at"]] = row["b"]
        return Level(self.n_bits, self.n_hashes, self.salt, bytes(bits))

    def has(self, key: Column) -> Column:
        bits, test = F.lit(bytearray(self.bits)), F.lit(True)
        for p in self.places(key):
            byte = F.ascii(F.substring(bits, F.floor(p / PER_BYTE).cast("int") + 1, F.lit(1)).cast("string"))
            test = test & (F.getbit(byte, (p % PER_BYTE).cast("int")) == 1)
        return test


def sized(n_keys: int, n_others: int, salt: int) -> Level:
    """A level that lets about as many of n_others through as it has keys; half of them at least are stopped."""
    per_key = max(1.0, math.log2(max(2.0, n_others / max(1, n_keys))))
    return Level(max(64, math.ceil(1.45 * per_key * n_keys)), max(1, round(per_key)), salt)


def keys_of(spark: SparkSession, keys: list[str]) -> DataFrame:
    """The keys as a column key: one literal, however many they are."""
    return spark.range(1).select(F.explode(F.from_json(F.lit(json.dumps(keys)), "array<string>")).alias("key"))


def cascades(listed: dict[str, list[str]], universe: DataFrame, n_universe: int, max_levels: int = 64) -> dict[str, list[Level]]:
    """For each name the filters that together tell exactly which keys of universe (a column key) are listed under it.

    Level 1 encodes the listed keys; level 2 the keys of universe that level 1 lets through wrongly; level 3 the listed keys that
    level 2 lets through; and so on, until a level lets nothing wrong through. Only level 1 reads the universe, once for all names; about as
    many keys are left as are listed, and later levels read those. A level has some 1.5 to 5 bytes for each listed key, less than the list
    that the caller holds."""
    spark = universe.sparkSession
    inside = {name: keys_of(spark, keys) for name, keys in listed.items() if keys}
    levels = {name: [sized(len(listed[name]), n_universe, 0).encode(own)] for name, own in inside.items()}
    passed = [F.when(levels[name][0].has(F.col("key")), F.lit(name)) for name in inside]
    left = universe.select("key", F.array_compact(F.array(*passed)).alias("names")).where("size(names) > 0").distinct() if inside else None
    left = save(left, "passed") if inside else None
    for name, own in inside.items():
        wrong = save(left.where(F.array_contains("names", name)).select("key").join(own, "key", "left_anti"), "wrong")
        outside, n_in, n_out = own, wrong.count(), len(listed[name])
        while n_in and len(levels[name]) < max_levels:
            level = sized(n_in, n_out, len(levels[name])).encode(wrong)
            levels[name].append(level)
            wrong, outside, n_out = save(outside.where(level.has(F.col("key"))), "wrong"), wrong, n_in
            n_in = wrong.count()
        if n_in:
            raise RuntimeError(f"{n_in} keys are still told wrong after {max_levels} levels")
    return levels


def listed_in(levels: list[Level], key: Column) -> Column:
    """Whether the key is listed: it is if the first level that stops it is an even one, or none of an odd number stops it."""
    out = F.lit(len(levels) % 2 == 1)
    for i, level in reversed(list(enumerate(levels))):
        out = F.when(level.has(key), out).otherwise(F.lit(i % 2 == 1))
    return F.coalesce(out, F.lit(False))


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The host: after the first :// up to / ? # or the end, A-Z lower-cased; the path: from there up to ? # or the end. Else both empty."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    low = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return low, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def judge(pages: DataFrame, rules: list[tuple[str, str, str]], url: str = "url", unlisted: str = "allow") -> DataFrame:
    """pages with host, path, rule and verdict, which replace columns of these names.

    A rule (verdict, host, path) fits its host and all subdomains if the url's path starts with its path; the longest host + path
    wins, between equals the longer host. rule is null where none fits; the verdict is then unlisted. What could be a rule's key (the
    url's last labels, as many as some rule has, with the path's first characters, as many as some rule has) is looked up in two
    cascades, of allowed and of blocked keys, built over all such keys of pages. There is no join with pages, however many rules there are.

    Null urls and urls without :// have an empty host and path. Repeated rows are judged alike; an empty table stays empty; no rules
    leave every page unlisted. Two verdicts for one key are an error. Very long urls cost no more keys than others."""
    keys = {h + p: v for v, h, p in rules}
    if len(keys) < len({(v, h + p) for v, h, p in rules}):
        raise ValueError("a rule is both allowed and blocked")
    host, path = host_and_path(F.col(url))
    pages = pages.withColumns({"host": host, "path": path}).withColumns({"host": F.coalesce("host", F.lit("")), "path": F.coalesce("path", F.lit(""))})
    labels = F.length("host") - F.length(F.replace("host", F.lit("."), F.lit(""))) + 1
    candidates = [
        F.when((labels >= n) & (F.length("path") >= size), F.concat(F.substring_index("host", ".", -n), F.substring("path", 1, size)))
        for n in sorted({h.count(".") + 1 for _, h, _ in rules})
        for size in sorted({len(p) for _, h, p in rules if h.count(".") + 1 == n})
    ]
    if not rules:
        return pages.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(unlisted)})

    universe = pages.select(F.explode(F.array(*candidates)).alias("key")).where("key is not null")
    listed = {verdict: sorted(k for k, v in keys.items() if v == verdict) for verdict in ("allow", "block")}
    tried, found = F.array_compact(F.array(*candidates)), []
    known = lambda levels: lambda c: listed_in(levels, c)
    told = lambda verdict: lambda c: F.struct(F.length(c).alias("n"), F.instr(c, "/").alias("h"), c.alias("key"), F.lit(verdict).alias("verdict"))
    for verdict, levels in cascades(listed, universe, pages.count() * len(candidates)).items():
        # One expression for all candidates, however many levels there are, so that plans and generated code stay small.
        found.append(F.transform(F.filter("__tried", known(levels)), told(verdict)))
    best = F.array_max(F.concat(*found))
    return pages.withColumn("__tried", tried).withColumn("__best", best).withColumns({"rule": F.col("__best.key"), "verdict": F.coalesce("__best.verdict", F.lit(unlisted))}).drop("__best", "__tried")


def op2_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return judge(pages, RULES).select("page_id", "host", "path", "rule", "verdict")


SQL = r"""
WITH cut AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM cut
), rules(verdict, h, p) AS (
  VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')
)
SELECT page_id, host, path, any_value(best.k) AS rule, coalesce(any_value(best.v), 'allow') AS verdict FROM (
  SELECT page_id, host, path, row_number() OVER () AS row,
    (SELECT max({'n': length(h || p), 'k': h || p, 'v': verdict}) FROM rules WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)) AS best
  FROM parts) GROUP BY row, page_id, host, path
"""
QUERIES = {"op2_url_rules": op2_url_rules}
ORACLE = {"op2_url_rules": SQL}
