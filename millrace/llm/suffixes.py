"""Suffix-array deduplication: byte strings that occur more than once, by longest previous factors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import GOLDEN, mix, saved, take, tune

LENGTH = 400
GRAM = 32
#: Window starts that one numpy step handles.
PIECE = 1 << 19
#: Bytes of contexts that one suffix array takes; a larger group of one anchor goes the way of window hashes.
ARRAY = 4_000_000

with np.errstate(over="ignore"):
    _BYTE = mix(np.arange(1, 257, dtype=np.uint64) * GOLDEN)
    _B1, _B2 = np.uint64(0x2545F4914F6CDD1D | 1), np.uint64(0x9FB21C651E98DF25 | 1)
    _I1, _I2 = np.uint64(pow(int(_B1), -1, 1 << 64)), np.uint64(pow(int(_B2), -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}


def _power(name: str, base: np.uint64, n: int) -> np.ndarray:
    if name not in _powers or len(_powers[name]) < n:
        with np.errstate(over="ignore"):
            x = np.full(max(n, 1 << 16), base, np.uint64)
            x[0] = 1
            _powers[name] = np.cumprod(x)
    return _powers[name][:n]


class Rolling:
    """Hashes of any substrings of a byte array, from prefix sums: two bases, 64 bits each."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        with np.errstate(over="ignore"):
            x = _BYTE[data]
            self.h = [np.concatenate((np.zeros(1, np.uint64), np.cumsum(x * _power(p, b, n)))) for p, b in (("p1", _B1), ("p2", _B2))]
        self.n = n

    def of(self, begin: np.ndarray, end: np.ndarray, which: int = 0) -> np.ndarray:
        with np.errstate(over="ignore"):
            inverse = _power(*(("i1", _I1), ("i2", _I2))[which], self.n + 1)
            return mix((self.h[which][end] - self.h[which][begin]) * inverse[begin])


def anchors(text: bytes, length: int = LENGTH, gram: int = GRAM, piece: int = PIECE):
    """(low, high, anchor, anchor hash, context hash) arrays: window starts low..high share an anchor.

    The anchor of a window of ``length`` bytes is the place of its gram of the least hash (44 bits; the first of
    equals). It depends on the window's bytes only, so equal windows have equal grams at equal offsets. The context
    hash covers the bytes of all windows of the run and the run's place relative to the anchor.
    """
    data = np.frombuffer(text, np.uint8)
    n = len(data)
    parts = []
    for at in range(0, n - length + 1, piece):
        part = data[at : at + piece + length - 1]
        roll = Rolling(part)
        m = len(part)
        starts = np.arange(m - gram + 1)
        grams = roll.of(starts, starts + gram)
        key = (grams & np.uint64(0xFFFFFFFFFFF00000)) | starts.astype(np.uint64)
        span, have = length - gram + 1, 1
        while have * 2 <= span:
            key = np.minimum(key[:-have], key[have:])
            have *= 2
        if have < span:
            key = np.minimum(key[: len(key) - (span - have)], key[span - have :])
        where = (key & np.uint64(0xFFFFF)).astype(np.int64)
        low = np.flatnonzero(np.diff(where, prepend=-1))
        high = np.append(low[1:], len(where)) - 1
        anchor = where[low]
        with np.errstate(over="ignore"):
            context = mix(roll.of(low, high + length, 1) + mix(((anchor - low) * 1024 + high - low).astype(np.uint64)) * GOLDEN)
        parts.append((low + at, high + at, anchor + at, grams[anchor], context))
    if not parts:
        return tuple(np.empty(0, d) for d in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
    return tuple(np.concatenate(x) for x in zip(*parts))


def suffix_ranks(data: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Ranks of all suffixes by their first ``length`` bytes (the number of suffixes before the first equal one), and
    the places whose bytes occur at another place too.

    Prefix doubling: ranks by 8, 16, 32, ... bytes, and one last step to exactly ``length``. Suffixes that are alone
    already keep their rank. Ranks of suffixes shorter than ``length`` are not meaningful.
    """
    n = len(data)
    have = min(8, length)
    padded = np.concatenate((data, np.zeros(8, np.uint8))).astype(np.uint64)
    key = np.zeros(n, np.uint64)
    for k in range(have):
        key = key << np.uint64(8) | padded[k : k + n]
    order = np.argsort(key)
    first = np.flatnonzero(np.diff(key[order], prepend=~key[order[:1]]) != 0)
    size = np.diff(np.append(first, n))
    rank = np.empty(n, np.int64)
    rank[order] = np.repeat(first, size)
    live = order[np.repeat(size, size) > 1]
    while have < length and len(live):
        step = min(have, length - have)
        after = live + step
        second = np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
        key = rank[live] * (n + 1) + second
        by = np.argsort(key)
        live, key = live[by], key[by]
        old = rank[live]
        at = np.arange(len(live))
        start = np.maximum.accumulate(np.where(np.diff(old, prepend=-1) != 0, at, 0))
        first = np.flatnonzero(np.diff(key, prepend=-1) != 0)
        size = np.diff(np.append(first, len(live)))
        rank[live] = old + np.repeat(first, size) - start
        live = live[np.repeat(size, size) > 1]
        have += step
    return rank, live


def previous_factors(data: np.ndarray, length: int = LENGTH, starts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """For each place, an earlier and a later place where the same ``length`` bytes begin, or -1.

    The longest previous factor of a place, as far as ``length``, is met at the previous or next smaller place in
    suffix order. Suffixes that agree on ``length`` bytes are neighbours in that order, sorted by place: the previous
    smaller place is the neighbour before, if it agrees, and there is no next smaller one; likewise for later ones.
    Places fewer than ``length`` bytes from the end have none, nor have places outside the mask ``starts``.
    """
    rank, live = suffix_ranks(data, length)
    live = live[live <= len(data) - length]
    if starts is not None:
        live = live[starts[live]]
    order = live[np.argsort(rank[live] * (len(data) + 1) + live)]
    same = np.diff(rank[order]) == 0
    earlier, later = np.full(len(data), -1), np.full(len(data), -1)
    earlier[order[1:][same]] = order[:-1][same]
    later[order[:-1][same]] = order[1:][same]
    return earlier, later


KEY = [("doc_id", pa.int64()), ("hash", pa.int64())]
RUN = pa.schema([*KEY, ("low", pa.int64()), ("high", pa.int64()), ("anchor", pa.int64()), ("gram", pa.int64()), ("context", pa.int64())])


def _runs(length: int):
    def run(batches):
        for batch in batches:
            ids, hashes = batch.column("doc_id").to_pylist(), batch.column("hash").to_pylist()
            out, held = [], 0
            for i, h, text in zip(ids, hashes, batch.column("text")):
                low, high, at, gram, context = anchors(text.as_py(), length)
                n = len(low)
                if n:
                    out.append(pa.RecordBatch.from_arrays([pa.array([i] * n, pa.int64()), pa.array([h] * n, pa.int64()), pa.array(low), pa.array(high), pa.array(at), pa.array(gram.view(np.int64)), pa.array(context.view(np.int64))], schema=RUN))
                    held += n
                if held > 20_000:
                    yield pa.Table.from_batches(out).combine_chunks().to_batches()[0]
                    out, held = [], 0
            if out:
                yield pa.Table.from_batches(out).combine_chunks().to_batches()[0]

    return run


CONTEXT = pa.schema([("gram", pa.int64()), *KEY, ("low", pa.int64()), ("high", pa.int64()), ("bytes", pa.binary())])


def _contexts(length: int):
    def run(batches):
        for batch in batches:
            for i, h, text, wanted in zip(*(batch.column(c) for c in ("doc_id", "hash", "text", "wanted"))):
                whole = text.as_buffer()
                rows = wanted.as_py()
                for at in range(0, len(rows), 5000):
                    some = rows[at : at + 5000]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([r["gram"] for r in some], pa.int64()), pa.array([i.as_py()] * len(some), pa.int64()), pa.array([h.as_py()] * len(some), pa.int64()), pa.array([r["low"] for r in some], pa.int64()), pa.array([r["high"] for r in some], pa.int64()), pa.array([bytes(whole[r["low"] : r["high"] + length]) for r in some], pa.binary())],
                        schema=CONTEXT,
                    )

    return run


SPAN = pa.schema([*KEY, ("begin", pa.int64()), ("end", pa.int64())])


def _spans(rows: list[tuple], hit: np.ndarray, owner: np.ndarray, place: np.ndarray, length: int) -> pa.RecordBatch:
    """Maximal runs of window starts (ascending places of contexts) as spans of bytes of their documents."""
    new = np.ones(len(hit), bool)
    new[1:] = (np.diff(hit) != 1) | (np.diff(owner) != 0)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(hit))[: len(first)] - 1
    o = owner[first]
    low = np.array([r[3] for r in rows], np.int64)[o]
    return pa.RecordBatch.from_arrays([pa.array([rows[k][1] for k in o], pa.int64()), pa.array([rows[k][2] for k in o], pa.int64()), pa.array(low + place[first]), pa.array(low + place[last] + length)], schema=SPAN)


def _matched(rows: list[tuple], length: int, first: bool) -> pa.RecordBatch:
    """Spans that repeated windows of some contexts cover; ``first``: only windows with an earlier copy."""
    rows = sorted(rows, key=lambda r: (r[1] is None, r[1] or 0, r[2], r[3]))
    data = np.frombuffer(b"".join(r[5] for r in rows), np.uint8)
    sizes = np.array([len(r[5]) for r in rows])
    owner = np.repeat(np.arange(len(rows)), sizes)
    place = np.arange(len(data)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    # a window lies within its context
    earlier, later = previous_factors(data, length, place <= np.repeat(sizes - length, sizes))
    hit = np.flatnonzero((earlier >= 0) if first else (earlier >= 0) | (later >= 0))
    return _spans(rows, hit, owner[hit], place[hit], length)


def _arrays(length: int, first: bool, most: int = 1 << 20):
    """Suffix arrays over whole groups of one gram after another, about ``most`` bytes at a time."""

    def run(batches):
        rows, group, held = [], None, 0
        for batch in batches:
            for r in zip(*(batch.column(c).to_pylist() for c in CONTEXT.names)):
                if r[0] != group:
                    if held >= most:
                        yield _matched(rows, length, first)
                        rows, held = [], 0
                    group = r[0]
                rows.append(r)
                held += len(r[5])
        if rows:
            yield _matched(rows, length, first)

    return run


def _windows(length: int):
    """Every window of the contexts by its hash (128 bits)."""

    def run(batches):
        for batch in batches:
            for r in zip(*(batch.column(c).to_pylist() for c in CONTEXT.names)):
                roll = Rolling(np.frombuffer(r[5], np.uint8))
                s = np.arange(len(r[5]) - length + 1)
                a, b = (roll.of(s, s + length, k).view(np.int64) for k in (0, 1))
                yield pa.RecordBatch.from_arrays([pa.array([r[1]] * len(s), pa.int64()), pa.array([r[2]] * len(s), pa.int64()), pa.array(s + r[3]), pa.array(a), pa.array(b)], ["doc_id", "hash", "low", "a", "b"])

    return run


def repeated_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, keep: str = "none") -> DataFrame:
    """Columns doc_id, hash (of the text), begin, end: spans of bytes that windows of ``length`` bytes cover which
    begin elsewhere too. keep="none": every such window; keep="first": all but the first one in the order of doc_id
    (null last), text hash and place.

    1. Windows are grouped by anchor: one run for about 180 windows. A run whose context (all bytes of its windows)
       occurs again is settled by counting 128-bit hashes, in partial sums; so exact copies cost no more.
    2. Of each anchor gram with several contexts, one of them unsettled, each different context is fetched once and
       the windows compared in suffix order (previous and next places as above), groups of a gram together, about 1 MB
       in one array.
    3. A group of over 4 MB of different contexts is compared by its windows' hashes instead, in a shuffle: exact too.
    """
    rows = take(docs, doc_id=doc_id, text=text).where("text is not null").select("doc_id", F.xxhash64("text").alias("hash"), F.encode("text", "utf-8").alias("text"))
    tune(docs.sparkSession)
    long_ones = rows.where(F.length("text") >= length)
    ddl = "doc_id long, hash long, low long, high long, anchor long, gram long, context long"
    runs = saved(long_ones.mapInArrow(_runs(length), ddl).drop("anchor"), "runs")
    order = F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "hash", "low", "high")
    counts = runs.groupBy("gram", "context").agg(F.count("*").alias("n"), F.min(order).alias("rep"))
    weight = F.col("rep.high") - F.col("rep.low") + length
    keyed = counts.groupBy("gram").agg(F.sum("n").alias("total"), F.count("*").alias("contexts"), F.count_if(F.col("n") == 1).alias("open"), F.sum(weight).alias("bytes")).where("total > 1")
    stat = saved(counts.join(keyed, "gram"), "contexts")

    settled = runs.join(stat.where("n > 1").select("gram", "context", "rep"), ["gram", "context"])
    if keep == "first":
        settled = settled.where(~F.col("rep").eqNullSafe(order))
    spans = settled.select("doc_id", "hash", F.col("low").alias("begin"), (F.col("high") + length).alias("end"))

    wanted = stat.where("contexts > 1" if keep == "first" else "contexts > 1 and open > 0").select("gram", "rep.*", (F.col("bytes") > ARRAY).alias("wide"))
    for wide in (False, True):
        asked = wanted.where("wide" if wide else "not wide").groupBy("doc_id", "hash").agg(F.collect_list(F.struct("gram", "low", "high")).alias("wanted"))
        asked = asked.select(F.col("doc_id").alias("i"), F.col("hash").alias("h"), "wanted")
        found = long_ones.join(asked, F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("hash") == F.col("h"))).select("doc_id", "hash", "text", "wanted")
        found = found.mapInArrow(_contexts(length), "gram long, doc_id long, hash long, low long, high long, bytes binary")
        if not wide:
            parts = found.repartition("gram").sortWithinPartitions("gram")
            spans = spans.union(parts.mapInArrow(_arrays(length, keep == "first"), "doc_id long, hash long, begin long, end long"))
        elif not wanted.where("wide").isEmpty():
            windows = saved(found.mapInArrow(_windows(length), "doc_id long, hash long, low long, a long, b long"), "windows")
            at = F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "hash", "low")
            again = windows.groupBy("a", "b").agg(F.count("*").alias("n"), F.min(at).alias("rep")).where("n > 1")
            met = windows.join(again, ["a", "b"])
            if keep == "first":
                met = met.where(~F.col("rep").eqNullSafe(at))
            spans = spans.union(met.select("doc_id", "hash", F.col("low").alias("begin"), (F.col("low") + length).alias("end")))
    return spans


def _cut(batches):
    for batch in batches:
        kept, removed, runs = [], [], []
        for text, ranges in zip(batch.column("text"), batch.column("ranges").to_pylist()):
            whole = text.as_buffer()
            data = b"" if whole is None else bytes(whole)
            pairs = sorted((r["begin"], r["end"]) for r in ranges or ())
            parts, at, gone, n, reach = [], 0, 0, 0, -1
            for begin, end in pairs:
                if begin > reach:
                    n += 1
                    parts.append(data[at:begin])
                    at = reach = end
                    gone += end - begin
                elif end > reach:
                    gone += end - reach
                    at = reach = end
            parts.append(data[at:])
            kept.append(b"".join(parts))
            removed.append(gone)
            runs.append(n)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(kept, pa.binary()), pa.array(removed, pa.int64()), pa.array(runs, pa.int64())], ["doc_id", "kept", "n_removed", "n_spans"])


def cut(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, keep: str = "none") -> DataFrame:
    """One row per row of ``docs``: doc_id, kept (bytes left of the UTF-8 text, which may split a character), n_removed,
    n_spans (maximal removed runs). A null text is empty. Rows equal in doc_id and text are two documents for
    counting and get the same result under keep="none"; under "first" they count as one place.
    """
    found = repeated_spans(docs, doc_id, text, length, keep).groupBy("doc_id", "hash").agg(F.collect_list(F.struct("begin", "end")).alias("ranges"))
    found = found.select(F.col("doc_id").alias("i"), F.col("hash").alias("h"), "ranges")
    rows = take(docs, doc_id=doc_id, text=text).select("doc_id", F.xxhash64("text").alias("hash"), F.encode(F.coalesce("text", F.lit("")), "utf-8").alias("text"))
    met = rows.join(found, F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("hash") == F.col("h")), "left")
    return met.select("doc_id", "text", "ranges").mapInArrow(_cut, "doc_id long, kept binary, n_removed long, n_spans long")
