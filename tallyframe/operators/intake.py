"""What may be fetched, and what a fetched file is."""

from __future__ import annotations

import ipaddress

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe.functions.scalars import col, url_suffix
from tallyframe.schema import SUFFIXES

#: Bytes of a document at most.
MOST_BYTES = 50 * 1024 * 1024
PDF_MAGIC = b"%PDF-"


def url_problem(url: Column) -> Column:
    """Why a URL isn't fetched at all, or null."""
    scheme, host = F.lower(F.try_parse_url(url, F.lit("PROTOCOL"))), F.try_parse_url(url, F.lit("HOST"))
    return F.when(~F.coalesce(scheme.isin("http", "https"), F.lit(False)), "scheme").when(F.coalesce(host, F.lit("")) == "", "host")


@F.pandas_udf(T.BooleanType())
def _public_v6(address: pd.Series) -> pd.Series:
    def one(text):
        try:
            ip = ipaddress.ip_address(text)
        except ValueError:
            return None
        return not (ip.is_private or ip.is_loopback or ip.is_link_local or ip.is_reserved or ip.is_multicast or ip.is_unspecified)

    return address.map(one, na_action="ignore").astype("boolean")


#: IPv4 ranges that aren't public (first address, bits), and those inside them that are.
PRIVATE_V4 = (
    ("0.0.0.0", 8), ("10.0.0.0", 8), ("127.0.0.0", 8), ("169.254.0.0", 16), ("172.16.0.0", 12), ("192.0.0.0", 24), ("192.0.2.0", 24), ("192.168.0.0", 16), ("198.18.0.0", 15),
    ("198.51.100.0", 24), ("203.0.113.0", 24), ("224.0.0.0", 4), ("240.0.0.0", 4),
)
PUBLIC_V4 = (("192.0.0.9", 32), ("192.0.0.10", 32))


def _inside(number: Column, ranges: tuple[tuple[str, int], ...]) -> Column:
    out = F.lit(False)
    for first, bits in ranges:
        low = int(ipaddress.ip_address(first))
        out = out | number.between(low, low + (1 << (32 - bits)) - 1)
    return out


def public_address(address: Column | str) -> Column:
    """Whether a literal address lies outside private, loopback, link-local, reserved, multicast and unspecified ranges; null for no address.

    IPv4 is arithmetic on its four numbers; only texts with a colon reach Python.
    """
    address = col(address)
    parts = F.split(address, r"\.")
    number = F.lit(0).cast("bigint")
    for k in range(4):
        number = number * 256 + F.get(parts, F.lit(k)).try_cast("bigint")
    octet = r"(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
    v4 = address.rlike(rf"^{octet}\.{octet}\.{octet}\.{octet}$")
    return F.when(v4, ~_inside(number, PRIVATE_V4) | _inside(number, PUBLIC_V4)).otherwise(_public_v6(F.when(F.contains(address, F.lit(":")), address)))


def host_problems(resolved: DataFrame) -> DataFrame:
    """(url, problem): of rows (url, address), one for each address a host resolves to, why a URL isn't fetched, or null.

    Every address must be public; a host without any doesn't resolve.
    """
    public = F.bool_and(F.coalesce(public_address(F.col("address")), F.lit(False)))
    seen = resolved.groupBy("url").agg(F.count("address").alias("n"), public.alias("public"))
    return seen.select("url", F.when(F.col("n") == 0, "unresolved").when(~F.col("public"), "not public").alias("problem"))


def suffix(url: Column, content: Column) -> Column:
    """The URL's suffix if it is a known one, else by the first bytes."""
    found = url_suffix(url)
    return F.when(found.isin(*SUFFIXES), found).when(F.substring(content, 1, 5) == F.lit(PDF_MAGIC), ".pdf").otherwise(".png")


def too_large(size: Column, most: int = MOST_BYTES) -> Column:
    return F.coalesce(size > most, F.lit(False))
