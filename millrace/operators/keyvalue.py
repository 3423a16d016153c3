"""Key-value tables: loading the last value of each key from text, dumping, and looking up."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.types import Maybe, parse, to_spark
from ..sources.base import codec, decode_column, encode_column
from . import accumulators


def split(spark: SparkSession, path: str, key_value: str = "\n", entries: str = "\n") -> DataFrame:
    """Raw columns key, value, place (the order of the entries in a file) of a dump.

    With two different delimiters, an entry is a key, the first delimiter and a value. With the same for both, keys
    and values take turns: the lines are numbered over the parts of a file, so that each knows its turn.
    """
    if key_value != entries:
        rows = spark.read.option("lineSep", entries).text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
        rows = rows.where("value != ''").withColumn("place", F.struct("file", "block", F.monotonically_increasing_id()))
        parts = F.split_part("value", F.lit(key_value), F.lit(1))
        rest = F.substring("value", F.length(parts) + F.lit(len(key_value) + 1), F.length("value"))
        return rows.select(parts.alias("key"), rest.alias("value"), "place")
    lines = spark.read.option("lineSep", entries).text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"))
    turns = accumulators.numbered(lines, ["file", "block", "id"], "n")
    first = turns.groupBy("file").agg(F.min("n").alias("n0"))
    turns = turns.join(first, "file").withColumn("turn", F.col("n") - F.col("n0"))
    said = lambda odd: F.max(F.when(F.col("turn") % 2 == odd, F.col("value")))
    pairs = turns.groupBy("file", F.floor(F.col("turn") / 2).cast("long").alias("pair")).agg(said(0).alias("key"), said(1).alias("value"))
    return pairs.where("value is not null").select("key", "value", F.struct("file", F.lit(0).cast("long").alias("block"), F.col("pair").alias("n")).alias("place"))


def last_wins(df: DataFrame, key: str, order, *values: str) -> DataFrame:
    """One row of each key: the values of its last row in order, by partial maxima."""
    cols = [F.col(o) if isinstance(o, str) else o for o in ([order] if not isinstance(order, (list, tuple)) else order)]
    best = F.max(F.struct(*[c.alias(f"o{i}") for i, c in enumerate(cols)], *[F.col(v).alias(f"v{i}") for i, v in enumerate(values)])).alias("b")
    return df.groupBy(key).agg(best).select(key, *[F.col(f"b.v{i}").alias(v) for i, v in enumerate(values)])


def load(spark: SparkSession, path: str, key: Maybe | str, value: Maybe | str, key_value: str = "\n", entries: str = "\n", encoding: str = "s-expr", **options) -> DataFrame:
    """Typed columns key and value; of entries with one key the last one in its file stays."""
    k, v = (parse(x) if isinstance(x, str) else x for x in (key, value))
    raw = last_wins(split(spark, path, key_value, entries), "key", "place", "value")
    kc, vc = codec(encoding, k, **options), codec(encoding, v, **options)
    return raw.select(decode_column(F.encode("key", "utf-8"), kc).alias("key"), decode_column(F.encode("value", "utf-8"), vc).alias("value"))


def dump(df: DataFrame, key: Maybe | str, value: Maybe | str, key_value: str = "\n", encoding: str = "s-expr", **options) -> DataFrame:
    """One text column ``entry``: encoded key, delimiter, encoded value."""
    k, v = (parse(x) if isinstance(x, str) else x for x in (key, value))
    text = lambda c, m: F.decode(encode_column(F.col(c), codec(encoding, m, **options)), "utf-8")
    return df.select(F.concat(text("key", k), F.lit(key_value), text("value", v)).alias("entry"))


def query(df: DataFrame, key: Maybe | str, wanted) -> DataFrame:
    """The rows of one key; the filter reaches the table's files."""
    k = parse(key) if isinstance(key, str) else key
    return df.where(F.col("key") == F.lit(wanted).cast(to_spark(k)))
