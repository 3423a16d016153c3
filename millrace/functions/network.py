"""Internet addresses and their ranges."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import wide


def ip4_text(ip: Column) -> Column:
    n = ip.cast("long")
    part = lambda s: F.call_function("shiftright", n, F.lit(s)).bitwiseAND(F.lit(255)).cast("string")
    return F.concat_ws(".", *[part(s) for s in (24, 16, 8, 0)])


def _host(mask: Column) -> Column:
    """The largest host number of a 32-bit network."""
    return (F.pow(F.lit(2.0), F.lit(32) - mask).cast("long") - 1).cast("long")


def first_ip4(ip: Column, mask: Column) -> Column:
    n = ip.cast("long")
    return n - F.pmod(n, _host(mask) + 1)


def last_ip4(ip: Column, mask: Column) -> Column:
    return first_ip4(ip, mask) + _host(mask)


def first_ip6(ip: Column, mask: Column) -> Column:
    return wide.last_of_ip6(ip, mask, True)


def last_ip6(ip: Column, mask: Column) -> Column:
    return wide.last_of_ip6(ip, mask, False)


def in_cidr4(item: Column, ip: Column, mask: Column) -> Column:
    return item.cast("long").between(first_ip4(ip, mask), last_ip4(ip, mask))
