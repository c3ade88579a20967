"""Network addresses and names."""

from __future__ import annotations

import ipaddress

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
IPV4 = f"^{OCTET}(?:\\.{OCTET}){{3}}\\z"
LABEL = "[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?"
FQDN = f"^{LABEL}(?:\\.{LABEL})+\\.?\\z"


def is_ipv4(s: Column) -> Column:
    """Four decimal numbers without leading zeros."""
    return s.rlike(IPV4)


def _address(text: str | None, kind) -> str | None:
    try:
        return None if text is None or "%" in text else str(kind(text.strip()))
    except ValueError:
        return None


def is_ipv6(s: Column) -> Column:
    """Without a zone."""

    def run(x: pd.Series) -> pd.Series:
        return pd.Series([None if v is None else v == v.strip() and _address(v, ipaddress.IPv6Address) is not None for v in x], dtype="object")

    return F.pandas_udf(run, "boolean")(s)


def is_ip(s: Column) -> Column:
    return is_ipv4(s) | is_ipv6(s)


def parse_ip(s: Column) -> Column:
    """The canonical text; null if it is no address."""
    return F.pandas_udf(lambda x: pd.Series([_address(v, ipaddress.ip_address) for v in x], dtype="object"), "string")(s)


def split_host_port(s: Column) -> Column:
    """[host, port]; null without a port, or if a host with colons has no brackets."""
    bracketed, plain = r"^\[([^\]]*)\]:([^:]*)\z", r"^([^:]*):([^:]*)\z"
    return F.when(s.rlike(bracketed), F.array(F.regexp_extract(s, bracketed, 1), F.regexp_extract(s, bracketed, 2))).when(
        s.rlike(plain), F.array(F.regexp_extract(s, plain, 1), F.regexp_extract(s, plain, 2))
    )


def join_host_port(host: Column, port: Column) -> Column:
    return F.when(F.contains(host, F.lit(":")), F.concat(F.lit("["), host, F.lit("]:"), port)).otherwise(F.concat(host, F.lit(":"), port))


def is_fqdn(s: Column) -> Column:
    return s.rlike(FQDN) & (F.length(F.rtrim(s, F.lit("."))) <= 253)
