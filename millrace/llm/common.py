"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import re
import tempfile
import uuid
from contextlib import contextmanager

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

GOLDEN = np.uint64(0x9E3779B97F4A7C15)
SHINGLE = 5


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def tune(spark: SparkSession, rows: int = 512) -> None:
    """Bound what one Arrow batch holds: texts can be long. The session keeps the setting, as results are lazy."""
    spark.conf.set(BATCH, str(rows))


@contextmanager
def batches_of(spark: SparkSession, rows: int):
    """Batches of so many rows for what is written within; whatever happens, the setting before comes back."""
    before = spark.conf.get(BATCH)
    spark.conf.set(BATCH, str(rows))
    try:
        yield
    finally:
        spark.conf.set(BATCH, before)


def take(df: DataFrame, **names: str) -> DataFrame:
    """Only the named columns, under new names: ``take(df, key="doc_id")``.

    Columns are found by position, so that other columns whose names clash (also in case only) do no harm.
    """
    flat = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    return flat.select(*[F.col(f"c{df.columns.index(old)}").alias(new) for new, old in names.items()])


def flat(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """The table with columns c0, c1, ..., and where each name has gone (the first of equal names)."""
    where: dict[str, str] = {}
    for i, name in enumerate(df.columns):
        where.setdefault(name, f"c{i}")
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))]), where


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share (spark.checkpoint.dir). Only a local session, as in tests, may do without:
    it gets a temporary one; on a cluster a folder of one machine would lose rows, so that is an error.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        named = spark.sparkContext.getCheckpointDir()
    if named is None:
        master = spark.sparkContext.master
        if not re.match(r"local($|\[)", master):
            raise RuntimeError(f"set spark.checkpoint.dir to a folder that all machines of {master} share")
        named = tempfile.mkdtemp(prefix="checkpoints-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


#: Files of a stored table for each core of the cluster, at most.
FILES = 4
#: Folders written by stored() that are still there.
_folders: list[str] = []


def _path(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), path


def stored(df: DataFrame, what: str) -> tuple[DataFrame, str]:
    """Write a table to the shared folder and read it back: cuts the lineage, survives lost executors. Also the folder.

    It goes when the driver ends, or earlier by ``forget``. Partitions beyond some for each core are written together,
    one after another in a task: files stay few, of which each costs a shared store (and a local one, that starts a
    process to set its permissions) some calls.
    """
    spark = df.sparkSession
    folder = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    files, path = _path(spark, folder)
    files.deleteOnExit(path)
    _folders.append(folder)
    df.coalesce(FILES * max(1, spark.sparkContext.defaultParallelism)).write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder), folder


def saved(df: DataFrame, what: str) -> DataFrame:
    return stored(df, what)[0]


def joined(rows: DataFrame, firsts: DataFrame, on: list[str], what: str) -> DataFrame:
    """Rows with what an aggregate over the same keys says of them. The aggregate is written first: a join right after
    it would be dealt as it is, and Spark could not split the rows of a hot key.
    """
    return rows.join(saved(firsts, what), on)


def folders() -> list[str]:
    """What stored() has written and nobody has removed."""
    return list(_folders)


def forget(spark: SparkSession, gone: list[str]) -> None:
    """Remove folders of which nothing is read any more."""
    for folder in gone:
        files, path = _path(spark, folder)
        files.delete(path, True)
        files.cancelDeleteOnExit(path)
        if folder in _folders:
            _folders.remove(folder)


def exploded(df: DataFrame, array: Column, into: str) -> DataFrame:
    """A row for each item of an array that holds no nulls. A plain explode would make the optimizer compute the array
    once more for a filter on its size.
    """
    return df.select(*df.columns, F.explode_outer(array).alias(into)).where(F.col(into).isNotNull())


def fold(doc_id: str, modulus: int) -> Column:
    """crc32 of an id as text, modulo a number; null ids give null."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % modulus


def text_key(text: Column) -> Column:
    """128 bits of a text, as 16 bytes; null for null."""
    return F.unhex(F.md5(text.cast("binary")))


def words(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def word_hashes(text: Column) -> Column:
    """A 64-bit hash of each word: Python need not see the strings."""
    return F.transform(words(text), lambda w: F.xxhash64(w))


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64: uint64 to well-spread uint64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(values: np.ndarray, offsets: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``size`` words, and the row of each.

    values: word hashes of all rows, one after another; offsets: where rows begin, and the end. A row of fewer words
    has one shingle, of all its words; a row of none has none.
    """
    w = values.astype(np.uint64, copy=False)
    n = np.diff(offsets)
    row = np.repeat(np.arange(len(n)), n)
    at = np.arange(len(w)) - np.repeat(offsets[:-1], n)
    with np.errstate(over="ignore"):
        h = np.zeros(max(0, len(w) - size + 1), np.uint64)
        for k in range(size):
            h = h * np.uint64(0x100000001B3) + w[k : k + len(h)]
        full = (n[row[: len(h)]] - at[: len(h)]) >= size
        out, rows = [mix(h[full])], [row[: len(h)][full]]
        for short in range(1, size):
            r = np.flatnonzero(n == short)
            if len(r):
                h = np.full(len(r), short, np.uint64)
                for k in range(short):
                    h = h * np.uint64(0x100000001B3) + w[offsets[r] + k]
                out.append(mix(h + GOLDEN))
                rows.append(r)
    h, row = np.concatenate(out), np.concatenate(rows)
    order = np.argsort(row, kind="stable")
    return h[order], row[order]


def bags(h: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (row, shingle) pairs in order, with counts: rows, shingles, counts."""
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    first = np.ones(len(h), bool)
    first[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    at = np.flatnonzero(first)
    return row[at], h[at], np.diff(np.append(at, len(h)))


def lists(column) -> tuple[np.ndarray, np.ndarray]:
    """The values and offsets of an Arrow list column without nulls inside; null lists count as empty."""
    import pyarrow as pa

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null([])
    offsets = column.offsets.to_numpy().astype(np.int64)
    values = column.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]] if len(column) else np.empty(0, np.int64)
    return values, (offsets - offsets[0] if len(offsets) else np.zeros(1, np.int64))


def give_back() -> None:
    """Freed memory goes back to the system: a Python worker lives on between stages, beside others."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only some C libraries have it
    if trim is not None:
        trim(0)


def spans(offsets: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Cut rows into runs of at most ``most`` values each; a longer row stands alone."""
    out, begin = [], 0
    for i in range(1, len(offsets)):
        if offsets[i] - offsets[begin] > most and i - 1 > begin:
            out.append((begin, i - 1))
            begin = i - 1
    if begin < len(offsets) - 1:
        out.append((begin, len(offsets) - 1))
    return out
