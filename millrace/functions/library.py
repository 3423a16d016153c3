"""Derived functions: membership, emptiness, percentiles, compensated sums, ranges of addresses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.compile import CONTAINERS, Value, item_of, need, of
from ..plans.types import Maybe, develop, equal, plain
from . import network


def coalesce(*cols: Column) -> Column:
    return F.coalesce(*cols)


def cases(*pairs, otherwise) -> Column:
    """(condition, value) pairs in order."""
    out = F
    for c, v in pairs:
        out = out.when(c, v)
    return out.otherwise(otherwise)


def repeat(start: Column | int, stop: Column | int, init: Column, step) -> Column:
    """A counted loop over start, ..., stop - 1: step(state, i) makes the next state."""
    a, b = (F.lit(x) if isinstance(x, int) else x for x in (start, stop))
    numbers = F.when(a < b, F.sequence(a, b - 1)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(numbers, init, step)


def kahan_sum(xs: Column) -> Column:
    """The sum of an array with Neumaier's compensation, in the order of the array."""

    def step(acc, x):
        s = acc["s"] + x
        lost = F.when(F.abs(acc["s"]) >= F.abs(x), (acc["s"] - s) + x).otherwise((x - s) + acc["s"])
        return F.struct(s.alias("s"), (acc["c"] + lost).alias("c"))

    return F.aggregate(xs, F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("c")), step, lambda acc: acc["s"] + acc["c"])


def percentile_rank(p: float, n: Column) -> Column:
    """The place of a percentile among n sorted items: half away from zero."""
    return F.floor(F.lit(p) * 0.01 * (n - 1) + 0.5).cast("int")


def percentiles(xs: Column, ps: list[float]) -> Column:
    """Items of a sorted array at percentiles, never between two; NULL for NULL, NULL items for an empty array."""
    need(all(0 <= p <= 100 for p in ps), "percentiles lie between 0 and 100")
    ordered = F.array_sort(xs)
    at = lambda p: F.when(F.size(xs) > 0, F.get(ordered, F.when(F.size(xs) > 0, percentile_rank(p, F.size(xs))).otherwise(0)))
    return F.when(xs.isNotNull(), F.array(*[at(p) for p in ps]))


def grouped_percentiles(df, keys: list[str], value: str, ps: list[float]):
    """Percentiles of each group without gathering a group: counts of distinct values, then running counts by key.

    Columns: the keys, and p_<percentile> each. Null values are left out.
    """
    from pyspark.sql import Window

    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_n"))
    w = Window.partitionBy(*keys).orderBy(value)
    counts = counts.withColumn("_to", F.sum("_n").over(w)).withColumn("_all", F.sum("_n").over(Window.partitionBy(*keys)))
    place = lambda p: F.floor(F.lit(p) * 0.01 * (F.col("_all") - 1) + 0.5)
    pick = lambda p: F.min(F.when(F.col("_to") > place(p), F.col(value))).alias(f"p_{p:g}")
    return counts.groupBy(*keys).agg(*[pick(p) for p in ps])


def is_empty(v: Value) -> Value:
    if v.kind in ("string", "bytes"):
        return of("bool", F.octet_length(v.col) == 0, v.mn.nullable)
    need(v.kind in CONTAINERS, f"{v.mn} is never empty")
    return of("bool", F.when(v.col.isNotNull(), F.size(v.col) == 0), v.mn.nullable)


def first_ip4(v: Column) -> Column:
    return network.first_ip4(v["ip"], v["mask"])


def last_ip4(v: Column) -> Column:
    return network.last_ip4(v["ip"], v["mask"])


def first_ip6(v: Column) -> Column:
    return network.first_ip6(v["ip"], v["mask"])


def last_ip6(v: Column) -> Column:
    return network.last_ip6(v["ip"], v["mask"])


def _in_cidr(item: Value, c: Value) -> Column:
    t = develop(c.mn.typ)
    ip = develop(t.items[0].typ).kind
    a, m = c.col["ip"], c.col["mask"]
    if ip == "u32":
        return network.in_cidr4(item.col, a, m)
    return item.col.between(network.first_ip6(a, m), network.last_ip6(a, m))


def _is_cidr(m: Maybe) -> bool:
    t = develop(m.typ)
    return t.kind == "rec" and t.names == ("ip", "mask")


def is_in(item: Value, container: Value) -> Value:
    """Membership by type: text in text, an item in a list (NULL items skipped), an address in a range, a scalar in
    itself. A NULL container gives NULL, an empty one false, else a NULL item NULL.
    """
    c, i = container, item
    kind = c.kind
    if kind in CONTAINERS:
        inner = item_of(c)
        some = lambda x: F.coalesce(is_in(Value(i.col, Maybe(i.mn.typ)), Value(x, Maybe(inner.typ))).col, F.lit(False))
        found = F.exists(c.col, some)
        col = F.when(c.col.isNull(), None).when(F.size(c.col) == 0, False).when(i.col.isNull(), None).otherwise(found)
    elif kind == "string" and i.kind in ("string", "char"):
        col = F.contains(c.col, i.col)
    elif _is_cidr(c.mn):
        col = _in_cidr(i, c)
    elif kind == "sum" and all(_is_cidr(x) for x in develop(c.mn.typ).items):
        t = develop(c.mn.typ)
        if i.kind == "sum":
            u = develop(i.mn.typ)
            parts = [(i.col["tag"] == k) & (c.col["tag"] == k) & _in_cidr(Value(i.col[u.names[k]], u.items[k]), Value(c.col[n], x)) for k, (n, x) in enumerate(zip(t.names, t.items))]
        else:
            parts = [(c.col["tag"] == k) & _in_cidr(i, Value(c.col[n], x)) for k, (n, x) in enumerate(zip(t.names, t.items)) if develop(develop(x.typ).items[0].typ).kind == i.kind]
        col = parts[0]
        for p in parts[1:]:
            col = col | p
    else:
        from ..operators.convert import convert

        if not equal(i.mn.typ, c.mn.typ):
            i = convert(i, Maybe(c.mn.typ, True))
        col = i.col == c.col
    return of("bool", col, i.mn.nullable or c.mn.nullable)


def hex_digit(n: Column) -> Column:
    """One digit of 0 to 15."""
    return F.lower(F.hex(n.cast("long")))


def of_hex_digit(c: Column) -> Column:
    return F.conv(c, 16, 10).cast("short")


def random_value(t: Maybe, seed: int, depth: int = 3) -> Column:
    """A random value of a type: short lower-case texts, up to 7 items, NULL half of the time where it may be."""
    from ..plans.compile import Value as V
    from ..plans.compile import build_sum, to_int
    from ..plans.types import INTEGERS, to_spark

    if t.typ.kind == "this":
        raise TypeError(f"no random value of {t}")
    d = develop(t.typ)
    r = lambda k: F.rand(seed * 31 + k)
    if d.kind in INTEGERS:
        whole = (F.floor(r(1) * float(1 << 32)).cast("decimal(20,0)") * F.lit("4294967296").cast("decimal(11,0)") + F.floor(r(2) * float(1 << 32)).cast("decimal(20,0)")).cast("decimal(38,0)")
        col = to_int(V(whole.cast("decimal(20,0)"), plain("u64")), d.kind)
    elif d.kind == "bool":
        col = r(1) < 0.5
    elif d.kind == "float":
        col = r(1)
    elif d.kind in ("string", "char", "bytes"):
        letters = F.concat(*[F.chr(F.floor(r(k) * 26 + 97).cast("long")) for k in range(1, 16)])
        col = F.substring(letters, F.lit(1), F.lit(1) if d.kind == "char" else F.floor(r(99) * 16).cast("int"))
        col = F.encode(col, "utf-8") if d.kind == "bytes" else col
    elif d.kind in CONTAINERS:
        n = int(d.extra) if d.kind == "vec" else 7
        items = F.array(*[random_value(d.items[0], seed * 101 + k, depth - 1) for k in range(n)])
        col = items if d.kind == "vec" else F.slice(items, F.lit(1), F.floor(r(1) * 8).cast("int"))
    elif d.kind in ("tup", "rec"):
        names = d.names or [f"_{i}" for i in range(1, len(d.items) + 1)]
        col = F.struct(*[random_value(x, seed * 103 + k, depth - 1).alias(n) for k, (n, x) in enumerate(zip(names, d.items))])
    elif d.kind == "sum":
        pick = F.floor(r(1) * len(d.items)).cast("int")
        col = F.lit(None).cast(to_spark(t))
        for k, x in enumerate(d.items):
            col = F.when(pick == k, build_sum(d, k, random_value(x, seed * 107 + k, depth - 1) if x.typ.kind != "void" else None)).otherwise(col)
    else:
        raise TypeError(f"no random value of {t}")
    return F.when(r(7) < 0.5, col) if t.nullable else col
