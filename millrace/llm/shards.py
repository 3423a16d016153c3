"""Sharding by histogram sort, with DataFrame operations only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import flat, saved, take

SHARDS = 8
#: A splitter may lie this share of a shard's bytes beside its target.
TOLERANCE = 0.01
#: Probes between two refinements: each pass counts the bytes below 2**BITS boundaries of an interval.
BITS = 13
#: Bytes of an order range that the rows are exchanged into, about.
RANGE = 8_000_000
#: Ranges that a group of equal texts divides, as a broadcast may hold them (16 bytes each).
HEAVY = 500_000


@dataclass(frozen=True)
class Splitter:
    """Rows with (h1, h2) below (or for ``h2`` None, h1 below) the key lie before; so many bytes and rows do."""

    h1: int
    h2: int | None
    size: int
    rows: int


def order_key(text: Column, doc_id: Column) -> tuple[Column, Column]:
    """Equal texts stand together, in a spread order; within them, ids stand in a spread order."""
    return F.xxhash64(text), F.xxhash64(doc_id, F.lit("id"))


def _histogram(rows: DataFrame, key: str, low: int, high: int) -> tuple[int, list[tuple[int, int, int]]]:
    """Counts of rows and bytes in at most 2**BITS equal intervals of [low, high]: width, and (begin, bytes, rows) each."""
    width = max(1, -(-(high - low + 1) // (1 << BITS)))
    # the distance from the low end can pass 2**63: decimals hold it
    bucket = F.floor((F.col(key).cast("decimal(20,0)") - F.lit(low).cast("decimal(20,0)")) / F.lit(width).cast("decimal(20,0)")).cast("int")
    found = rows.groupBy(bucket.alias("bucket")).agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect()
    return width, sorted((low + r["bucket"] * width, int(r["size"]), int(r["n"])) for r in found)


def _refine(rows: DataFrame, key: str, low: int, high: int, base: tuple[int, int], targets: list[tuple[float, float]]) -> list:
    """For each target (bytes, slack): a Splitter near enough; or, for those inside one key's rows, (key, counts below, targets)."""
    width, bars = _histogram(rows, key, low, high)
    out: list = []
    size, n = base
    k = 0
    for begin, more, count in bars:
        inside = []
        while k < len(targets) and (targets[k][0] < size + more or begin == bars[-1][0]):
            t, slack = targets[k]
            k += 1
            before, after = abs(t - size), abs(size + more - t)
            if min(before, after) > slack and count > 1:
                inside.append((t, slack))
            elif before <= after:
                out.append(Splitter(begin, None, size, n))
            else:
                out.append(Splitter(begin + width, None, size + more, n + count))
        if inside and width == 1:
            out.append((begin, (size, n), inside))
        elif inside:
            end = min(begin + width - 1, high)
            out += _refine(rows.where(F.col(key).between(begin, end)), key, begin, end, (size, n), inside)
        size, n = size + more, n + count
    return out


def splitters(rows: DataFrame, targets: list[tuple[float, float]]) -> list[Splitter]:
    """One boundary in the order (h1, h2) for each target (bytes, slack): the bytes below it are within the slack.

    rows: h1, h2, size. Each pass sums bytes and rows in 8192 intervals (partial sums; at most 8192 rows come back),
    and goes on inside an interval only for targets that no boundary is near enough to. A target inside a single h1, a large group of equal texts, goes on by h2. Rows of one (h1, h2) are never told apart: there
    the nearest of both ends is taken.
    """
    low, high = -(2**63), 2**63 - 1
    out: list[Splitter] = []
    for found in _refine(rows, "h1", low, high, (0, 0), targets):
        if isinstance(found, Splitter):
            out.append(found)
            continue
        h1, base, inside = found
        for deep in _refine(rows.where(F.col("h1") == h1), "h2", low, high, base, inside):
            if isinstance(deep, Splitter):
                out.append(Splitter(h1, deep.h1, deep.size, deep.rows))
            else:
                h2, (size, n), held = deep
                end = rows.where((F.col("h1") == h1) & (F.col("h2") == h2)).agg(F.sum("size"), F.count("*")).first()
                for t, _ in held:
                    near = t - size <= size + end[0] - t
                    out.append(Splitter(h1, h2, size, n) if near else Splitter(h1, h2 + 1, size + end[0], n + end[1]))
    return sorted(out, key=lambda s: (s.rows, s.size))


def below(s: Splitter, h1: Column, h2: Column) -> Column:
    """Does a row lie before the splitter?"""
    if s.h1 > 2**63 - 1:
        return F.lit(True)
    if s.h2 is None:
        return h1 < F.lit(s.h1)
    if s.h2 > 2**63 - 1:
        return h1 <= F.lit(s.h1)
    return (h1 < F.lit(s.h1)) | ((h1 == F.lit(s.h1)) & (h2 < F.lit(s.h2)))


def shard(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shards: int = SHARDS, tolerance: float = TOLERANCE) -> DataFrame:
    """All columns of ``docs``, then size, shard and slot: shards 0, 1, ... of nearly equal bytes.

    The size of a row is the number of UTF-8 bytes of its text (null: none) plus 1. Rows stand in the order of hashes
    of text and doc_id, so that equal texts stand together; a group of equal texts lies in one shard unless a
    boundary that keeps it whole would lie more than the tolerance from its target (then it is divided by doc_id, as
    a group larger than a shard must be). slot counts the rows of a shard from 0 in that order.

    Sizes and keys are written once; each counting pass reads only them. Then the rows are exchanged once, by ranges
    of equal width on the axis of h1, as many as there are pieces of 8 MB in the table: hashes spread evenly, so a range is
    too large only where a group of equal texts lies in it, and is then divided by h1 and by ranges of h2. Rows
    are numbered within their range; the ranges' exact row counts before them in the shard, summed from the keys,
    make the numbers those of the shard. No range, hot text or not, holds much more than 16 MB, however large the table. Rows equal in text and doc_id
    have no stated order. Null texts and null ids are values like others. No rows give no rows.
    """
    rows, at = flat(docs)
    t = F.col(at[text])
    rows = rows.withColumn("size", F.coalesce(F.octet_length(t), F.lit(0)).cast("long") + 1)
    h1, h2 = order_key(t, F.col(at[doc_id]))
    keys = take(docs, t=text, i=doc_id)
    k1, k2 = order_key(F.col("t"), F.col("i"))
    slim = saved(keys.select(k1.alias("h1"), k2.alias("h2"), (F.coalesce(F.octet_length("t"), F.lit(0)).cast("long") + 1).alias("size")), "keys")
    total = slim.agg(F.sum("size")).first()[0] or 0
    ends = splitters(slim, [(total * k / shards, tolerance * total / shards) for k in range(1, shards)]) if total else []
    bits = max(0, (-(-total // RANGE) - 1).bit_length())
    heavy = _heavy(slim, bits)
    place = ["shard", "part", "k1", "k2"]
    ranges = _ranged(slim, ends, bits, heavy).groupBy(*place).agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("part", "k1", "k2").rowsBetween(Window.unboundedPreceding, -1)
    ranges = saved(ranges.select(*place, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start")), "ranges")
    met = _ranged(rows.withColumn("h1", h1).withColumn("h2", h2), ends, bits, heavy).join(ranges, place)
    number = F.row_number().over(Window.partitionBy(*place).orderBy("h1", "h2")) - 1
    named = [c for c in rows.columns if c != "size"]
    return met.select(*named, "size", "shard", (number + F.col("start")).cast("long").alias("slot")).toDF(*docs.columns, "size", "shard", "slot")


def _bits(key: Column, n: int | Column) -> Column:
    """The first ``n`` bits of a signed key, in the order of keys."""
    flipped = key.bitwiseXOR(F.lit(-(2**63)))
    if isinstance(n, int):
        return F.shiftrightunsigned(flipped, 64 - n) if n else F.lit(0).cast("long")
    return F.when(n == 0, F.lit(0)).otherwise(F.call_function("shiftrightunsigned", flipped, F.lit(64) - n))


def _heavy(slim: DataFrame, bits: int) -> DataFrame:
    """Ranges of far more than their share of bytes: part, and how many bits of h2 divide a text's rows there."""
    found = slim.groupBy(_bits(F.col("h1"), bits).alias("part")).agg(F.sum("size").alias("size")).where(F.col("size") > 2 * RANGE)
    found = saved(found.select("part", F.ceil(F.log2(F.col("size") / RANGE)).cast("int").alias("deep")), "heavy")
    return F.broadcast(found) if found.count() <= HEAVY else found


def _ranged(rows: DataFrame, ends: list[Splitter], bits: int, heavy: DataFrame) -> DataFrame:
    """Rows with their shard and range: part, and in heavy parts k1 (the text) and k2; they order as (h1, h2) do."""
    shard = F.lit(0)
    for s in ends:
        shard = shard + F.when(below(s, F.col("h1"), F.col("h2")), 0).otherwise(1)
    met = rows.withColumn("shard", shard.cast("int")).withColumn("part", _bits(F.col("h1"), bits)).join(heavy, "part", "left")
    met = met.withColumn("k1", F.when(F.col("deep").isNull(), F.lit(0)).otherwise(F.col("h1")))
    return met.withColumn("k2", F.when(F.col("deep").isNull(), F.lit(0)).otherwise(_bits(F.col("h2"), F.col("deep")))).drop("deep")
