"""Incremental sets as table operations: sliding, tumbling, sampling, hash, ordered and weighted top sets.

Rows of a table have no order of their own, so sets that depend on it take an ordering. ``keys`` may be empty: the
whole table is then one group, met by partial results or by ranges of the order, never by one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import network
from .store import saved


#: Rows of a piece of an order.
PIECE = 100_000


def _cols(order) -> list[Column]:
    return [F.col(o) if isinstance(o, str) else o for o in ([order] if isinstance(order, (str, Column)) else order)]


def sliding(df: DataFrame, keys: list[str], order, n: int) -> DataFrame:
    """The last ``n`` rows of each group. Each task keeps n rows of a group before the exchange."""
    last = [c.desc_nulls_last() for c in _cols(order)]
    if not keys:
        return df.orderBy(*last).limit(n)
    w = Window.partitionBy(*keys).orderBy(*last)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def sliding_lists(df: DataFrame, keys: list[str], order, n: int, item: Column | str, into: str = "items") -> DataFrame:
    """The last ``n`` items of each group as an array, oldest first."""
    cols = _cols(order)
    kept = sliding(df.withColumn("_item", F.col(item) if isinstance(item, str) else item), keys, order, n)
    fields = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(cols)], F.col("_item").alias("item"))
    return kept.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(fields)), lambda x: x["item"]).alias(into))


def running(df: DataFrame, keys: list[str], order, n: int, item: str, into: str = "items") -> DataFrame:
    """Each row with the window of its group's last ``n`` items up to it, oldest first."""
    if keys:
        w = Window.partitionBy(*keys).orderBy(*_cols(order)).rowsBetween(-(n - 1), 0)
        return df.withColumn(into, F.collect_list(item).over(w))
    # pieces of the order, each with the last rows of the piece before it
    size = max(PIECE, n)
    rows = numbered(df, order, "_n").withColumn("_piece", F.floor(F.col("_n") / size))
    carried = (F.col("_n") % size >= size - (n - 1)) if n > 1 else F.lit(False)
    places = F.when(carried, F.array(F.col("_piece"), F.col("_piece") + 1)).otherwise(F.array(F.col("_piece")))
    w = Window.partitionBy("_in").orderBy("_n").rowsBetween(-(n - 1), 0)
    return rows.withColumn("_in", F.explode(places)).withColumn(into, F.collect_list(item).over(w)).where(F.col("_in") == F.col("_piece")).drop("_n", "_piece", "_in")


def numbered(df: DataFrame, order, into: str = "n") -> DataFrame:
    """Rows numbered from 0 in an order over the whole table, without a task that sees all: ranges are sorted apart,
    counted, and shifted by the rows before them. The ranges' counts are one number for each range.
    """
    cols = _cols(order)
    ranged = saved(df.repartitionByRange(*cols).sortWithinPartitions(*cols).withColumn("_part", F.spark_partition_id()), "ranges")
    local = ranged.withColumn("_rn", F.row_number().over(Window.partitionBy("_part").orderBy(*cols)) - 1)
    counts = ranged.groupBy("_part").agg(F.count("*").alias("_c")).orderBy("_part").collect()
    starts, total = {}, 0
    for r in counts:
        starts[r["_part"]] = total
        total += r["_c"]
    if not starts:
        return local.withColumn(into, F.col("_rn").cast("long")).drop("_part", "_rn")
    shift = F.element_at(F.create_map(*[F.lit(x) for kv in starts.items() for x in kv]), F.col("_part"))
    return local.withColumn(into, (F.col("_rn") + shift).cast("long")).drop("_part", "_rn")


def tumbling(df: DataFrame, keys: list[str], order, n: int, into: str = "bucket") -> DataFrame:
    """Rows with the number of their bucket of ``n`` rows in order: group by it for one result a bucket."""
    if not keys:
        return numbered(df, order, "_n").withColumn(into, F.floor(F.col("_n") / n).cast("long")).drop("_n")
    w = Window.partitionBy(*keys).orderBy(*_cols(order))
    return df.withColumn(into, F.floor((F.row_number().over(w) - 1) / n).cast("long"))


def tumbling_time(df: DataFrame, keys: list[str], time: str, duration: str, *aggs: Column) -> DataFrame:
    """Aggregates of buckets of time: columns start, end, the keys and the aggregates."""
    made = df.groupBy(F.window(time, duration).alias("_w"), *keys).agg(*aggs)
    return made.select(F.col("_w.start").alias("start"), F.col("_w.end").alias("end"), *[f"`{c}`" for c in made.columns[1:]])


def sampling(df: DataFrame, keys: list[str], n: int, seed: int = 0, by: list[str] | None = None) -> DataFrame:
    """A uniform sample of ``n`` rows of each group: those of the largest hashes of the columns ``by`` (all of them, if
    not said) and the seed. It depends on the rows alone, so a task that runs again draws the same; rows equal in ``by``
    share a hash, so name columns that tell rows apart.
    """
    cells = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in (by or df.columns)]
    rows = df.withColumn("_r", F.md5(F.concat_ws("|", *cells, F.lit(str(seed))).cast("binary")))
    return sliding(rows, keys, "_r", n).drop("_r")


def hash_set(df: DataFrame, keys: list[str], item: str, into: str = "items") -> DataFrame:
    """The distinct items of each group, sorted."""
    return df.groupBy(*keys).agg(F.array_sort(F.collect_set(item)).alias(into))


def members(df: DataFrame, column: str, of: DataFrame, of_column: str, inside: bool = True) -> DataFrame:
    """Rows whose value is in (or not in) a column of another table; Spark picks the join by the sizes."""
    other = of.select(F.col(of_column).alias("_member")).distinct()
    return df.join(other, df[column].eqNullSafe(F.col("_member")), "left_semi" if inside else "left_anti")


def members_of_nets(df: DataFrame, ip: str, nets: DataFrame, cidr: str, wide: bool = False, inside: bool = True) -> DataFrame:
    """Rows whose address lies in (or outside of) the networks of another table, a column of (ip, mask) records.

    A range join: both sides carry the first 16 bits of addresses as a key, so that Spark joins by equality, and the range decides within a key.
    A network of fewer than 16 bits stands under each of its keys, 65,536 at most. ``wide``: 128-bit addresses. NULL addresses lie in none.
    """
    c = F.col(cidr)
    first, last = (network.first_ip6, network.last_ip6) if wide else (network.first_ip4, network.last_ip4)
    key = (lambda x: F.conv(F.hex(F.substring(x, F.lit(1), F.lit(2))), 16, 10).cast("int")) if wide else (lambda x: F.call_function("shiftright", x.cast("long"), F.lit(16)).cast("int"))
    ranges = nets.where(c.isNotNull()).select(c["ip"].alias("_ip"), c["mask"].alias("_mask")).distinct().select(first(F.col("_ip"), F.col("_mask")).alias("_first"), last(F.col("_ip"), F.col("_mask")).alias("_last"))
    ranges = ranges.withColumn("_key", F.explode(F.sequence(key(F.col("_first")), key(F.col("_last")))))
    met = (key(F.col(ip)) == F.col("_key")) & F.col(ip).between(F.col("_first"), F.col("_last"))
    return df.join(ranges, met, "left_semi" if inside else "left_anti")


def heap(df: DataFrame, keys: list[str], item: str, drop: int = 0, n: int | None = None, into: str = "items") -> DataFrame:
    """Items of each group in ascending order, without the ``drop`` smallest, ``n`` at most."""
    if n is None:
        ordered = F.array_sort(F.collect_list(item))
        return df.groupBy(*keys).agg(F.slice(ordered, F.lit(drop + 1), F.greatest(F.size(ordered) - drop, F.lit(0))).alias(into))
    if not keys:
        least = df.select(F.col(item).alias("_item")).orderBy(F.col("_item").asc_nulls_last()).limit(drop + n)
        return least.agg(F.slice(F.array_sort(F.collect_list("_item")), drop + 1, n).alias(into))
    w = Window.partitionBy(*keys).orderBy(F.col(item).asc_nulls_last())
    rows = df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= drop + n)
    return rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.when(F.col("_rn") > drop, F.col(item)))).alias(into))


def top(df: DataFrame, keys: list[str], item: str, weight: Column | str, size: int, sigmas: float = 0.0) -> DataFrame:
    """The ``size`` heaviest items of each group: keys, item, weight, rank; equal weights by ascending item.

    Exact: weights are summed for each item. Weight 0 counts for nothing. With ``sigmas``, only items of at least the
    mean weight plus so many standard deviations are listed.
    """
    w = F.col(weight) if isinstance(weight, str) else weight
    sums = df.groupBy(*keys, item).agg(F.sum(w).alias("weight")).where("weight != 0")
    if sigmas:
        stats = sums.groupBy(*keys).agg((F.avg("weight") + sigmas * F.stddev_pop("weight")).alias("_least"))
        sums = (sums.join(stats, keys) if keys else sums.crossJoin(F.broadcast(stats))).where("weight >= _least").drop("_least")
    heaviest = [F.col("weight").desc(), F.col(item).asc()]
    if not keys:
        kept = sums.orderBy(*heaviest).limit(size)
        # at most ``size`` rows: one task is enough to number them
        return kept.withColumn("rank", F.row_number().over(Window.orderBy(*heaviest)))
    ranked = sums.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*heaviest)))
    return ranked.where(F.col("rank") <= size)


def top_sketch(df: DataFrame, item: str, size: int, max_size: int) -> DataFrame:
    """Approximate heaviest items by number of rows, in bounded memory: columns item, count."""
    got = df.agg(F.expr(f"approx_top_k({item}, {size}, {max_size})").alias("t"))
    return got.select(F.explode("t").alias("x")).select(F.col("x.item").alias("item"), F.col("x.count").alias("count"))


def scaled_by_rows(df: DataFrame, keys: list[str], order, weight: str, factor: float) -> DataFrame:
    """Weights as they are once all rows of the group are in, when each new row scales all weights before its own."""
    cols = _cols(order)
    if keys:
        w = Window.partitionBy(*keys).orderBy(*[c.desc_nulls_last() for c in cols])
        later = F.row_number().over(w) - 1
        return df.withColumn("_later", later).withColumn(weight, F.col(weight) * F.pow(F.lit(float(factor)), F.col("_later"))).drop("_later")
    rows = numbered(df, cols, "_n")
    last = rows.agg(F.max("_n").alias("_last"))  # one row
    return rows.crossJoin(F.broadcast(last)).withColumn(weight, F.col(weight) * F.pow(F.lit(float(factor)), F.col("_last") - F.col("_n"))).drop("_n", "_last")


def scaled(weight: Column, age: Column, half_life: float) -> Column:
    """A weight that halves over time, for decayed tops."""
    return weight * F.pow(F.lit(0.5), age / half_life)
