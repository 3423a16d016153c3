"""Connected components by alternating stars, as joins and aggregates only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, stored


#: Edges from which on a round writes its minima. The rows are the same with fewer; only a hot node takes longer.
MANY = 500_000


def _sum(edges: DataFrame) -> tuple:
    r = edges.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0))).first()
    return r[0], r[1]


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """The smallest node that each node of ``edges`` (columns a, b) reaches: columns node, component.

    Large stars tie each larger neighbour to a node's smallest neighbour, small stars tie each smaller one; both keep
    components as they are, and the edges become one star each. Per round the rows stay within the number of edges,
    each hot node is met by partial minima and by joins that Spark can split, and nothing is gathered on the driver
    but a count and a checksum. Nodes without edges do not appear. Edges with a null end and loops are ignored.
    """
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("a is not null and b is not null and a != b").distinct()
    e, folder = stored(e, "edges")
    before = _sum(e)
    for _ in range(rounds):
        if not before[0]:
            break
        written: list[str] = []

        def held(minima: DataFrame) -> DataFrame:
            """Minima that a join of many edges meets are written first: else Spark cannot split a hot node's."""
            if before[0] < MANY:
                return minima
            minima, made = stored(minima, "minima")
            written.append(made)
            return minima

        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = held(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = both.join(least, "u").where("v > u and v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = held(large.groupBy("u").agg(F.min("v").alias("m")))
        tied = large.join(least, "u")
        small = tied.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        older = folder
        e, folder = stored(small.where("u != v").distinct(), "edges")
        after = _sum(e)
        forget(e.sparkSession, [older, *written])
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components have not settled in {rounds} rounds")
    leaf = e.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("node"), "component")
    return leaf.union(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
