"""Digests and message authentication codes of strings or binaries."""

from __future__ import annotations

import hashlib
import hmac

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

HASHES = {"SHA1": hashlib.sha1, "SHA224": hashlib.sha224, "SHA256": hashlib.sha256, "SHA384": hashlib.sha384, "SHA512": hashlib.sha512, "MD5": hashlib.md5}


def sha256(x: Column) -> Column:
    """Binary, as is sha224(); the others are lower-case hexadecimal text."""
    return F.unhex(F.sha2(x, 256))


def sha224(x: Column) -> Column:
    return F.unhex(F.sha2(x, 224))


def md5(x: Column) -> Column:
    return F.md5(x)


def sha1(x: Column) -> Column:
    return F.sha1(x)


def sha512(x: Column) -> Column:
    return F.sha2(x, 512)


def sign(name: str, key: Column, message: Column) -> Column:
    """RFC 2104 code by one of HASHES, in hexadecimal."""
    function = HASHES[name]

    def run(k: pd.Series, m: pd.Series) -> pd.Series:
        return pd.Series([None if a is None or b is None else hmac.new(bytes(a), bytes(b), function).hexdigest() for a, b in zip(k, m, strict=True)], dtype="object")

    return F.pandas_udf(run, "string")(key.cast("binary"), message.cast("binary"))
