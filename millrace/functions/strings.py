"""Byte strings: ASCII case, byte lengths and offsets, literal separators."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F


def lower(s: Column) -> Column:
    return F.translate(s, string.ascii_uppercase, string.ascii_lowercase)


def upper(s: Column) -> Column:
    return F.translate(s, string.ascii_lowercase, string.ascii_uppercase)


def length(s: Column) -> Column:
    return F.octet_length(s).cast("long")


def _bytes(s: Column) -> Column:
    return F.encode(s, "utf-8")


def _text(b: Column) -> Column:
    return F.decode(b, "utf-8")


def substring(s: Column, start: Column, stop: Column) -> Column:
    """Bytes [start, stop): negative bounds count from the end (again and again), larger ones are cut."""
    n = F.octet_length(s)
    clamp = lambda v: F.when(n == 0, 0).when(v < 0, F.pmod(v.cast("long"), F.when(n > 0, n))).otherwise(F.least(v.cast("long"), n))
    a, b = clamp(start).cast("int"), clamp(stop).cast("int")
    return F.when(a >= b, F.lit("")).otherwise(_text(F.substring(_bytes(s), a + 1, b - a)))


def split_at(n: Column, s: Column) -> Column:
    b = _bytes(s)
    return F.struct(_text(F.substring(b, F.lit(1), n.cast("int"))).alias("_1"), _text(F.substring(b, n.cast("int") + 1, F.octet_length(s))).alias("_2"))


def split_on(sep: Column, s: Column) -> Column:
    """Parts around a literal separator; no parts for an empty separator."""
    quoted = F.concat(F.lit("\\Q"), sep, F.lit("\\E"))
    return F.when(F.octet_length(sep) == 0, F.array().cast("array<string>")).otherwise(F.split(s, quoted, -1))


def find(from_start: Column, needle: Column, hay: Column) -> Column:
    """Byte offset of the first or last occurrence, or null; an empty needle is at 0 or at the end."""
    n = F.octet_length(needle)
    first = F.instr(hay, needle)
    before = F.octet_length(F.substring(hay, F.lit(1), first - 1))
    at = F.instr(F.reverse(hay), F.reverse(needle))
    after = F.octet_length(F.substring(F.reverse(hay), F.lit(1), at - 1))
    return (
        F.when(n == 0, F.when(from_start, 0).otherwise(F.octet_length(hay)))
        .when(from_start, F.when(first > 0, before))
        .otherwise(F.when(at > 0, F.octet_length(hay) - after - n))
        .cast("int")
    )


def index(char: Column, s: Column) -> Column:
    return find(F.lit(True), char, s).cast("long")


def nth_char(i: Column, s: Column) -> Column:
    ok = (i >= 0) & (i < F.octet_length(s))
    return F.when(ok, _text(F.substring(_bytes(s), F.when(ok, i).cast("int") + 1, F.lit(1))))
