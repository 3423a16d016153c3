"""The same aggregations over streams: time windows with watermarks, and count windows with state."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as S
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def _windowed(df: DataFrame, keys: list[str], window: Column, time: str, late: str, aggs) -> DataFrame:
    made = df.withWatermark(time, late).groupBy(window.alias("_w"), *keys).agg(*aggs)
    return made.select(F.col("_w.start").alias("start"), F.col("_w.end").alias("end"), *[f"`{c}`" for c in made.columns[1:]])


def tumbling(df: DataFrame, keys: list[str], time: str, size: str, late: str, *aggs: Column) -> DataFrame:
    """Aggregates of windows that do not overlap; rows later than ``late`` are dropped, and windows end with it."""
    return _windowed(df, keys, F.window(time, size), time, late, aggs)


def hopping(df: DataFrame, keys: list[str], time: str, size: str, slide: str, late: str, *aggs: Column) -> DataFrame:
    return _windowed(df, keys, F.window(time, size, slide), time, late, aggs)


def sessions(df: DataFrame, keys: list[str], time: str, gap: str, late: str, *aggs: Column) -> DataFrame:
    return _windowed(df, keys, F.session_window(time, gap), time, late, aggs)


def last_n(df: DataFrame, key: str, order: str, item: str, n: int) -> DataFrame:
    """A sliding window of the last ``n`` items of each key over a stream: key, order of the last item, items.

    The state of a key is at most n pairs. Rows of one batch are taken in order.
    """
    kinds = {f.name: f.dataType for f in df.schema}
    out = S.StructType([S.StructField(key, kinds[key]), S.StructField("at", kinds[order]), S.StructField("items", S.ArrayType(kinds[item]))])
    state = S.StructType([S.StructField("orders", S.ArrayType(kinds[order])), S.StructField("items", S.ArrayType(kinds[item]))])

    def step(k, batches, held: GroupState):
        orders, items = map(list, held.get) if held.exists else ([], [])
        pairs = list(zip(orders, items))
        for batch in batches:
            pairs += list(zip(batch[order].tolist(), batch[item].tolist()))
            # the sort is stable: equal orders stay as they came
            pairs = sorted(pairs, key=lambda p: p[0])[-n:]
        held.update(([p[0] for p in pairs], [p[1] for p in pairs]))
        yield pd.DataFrame({key: [k[0]], "at": [pairs[-1][0]], "items": [[p[1] for p in pairs]]})

    return df.select(key, order, item).groupBy(key).applyInPandasWithState(step, out, state, "update", GroupStateTimeout.NoTimeout)
