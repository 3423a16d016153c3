"""Row encodings: what a codec does, and tables and columns of encoded values."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import wide
from ..functions.numbers import in_range
from ..plans.types import DEFINITIONS, INTEGERS, Maybe, SchemaError, develop, parse, to_schema, to_spark


class DecodeProblem(ValueError):
    """Bytes that are no value of the type, with the place."""


class Codec:
    """One encoding of one type. Values: int, float, str, bytes, bool, None, lists, tuples, dicts, (label, value) sums."""

    name = ""
    #: Can records be framed by a delimiter, so that a file is read in parts?
    framed = False

    def __init__(self, m: Maybe | str, **options):
        self.m = parse(m) if isinstance(m, str) else m
        self.options = options
        self.definitions = dict(DEFINITIONS)

    def __setstate__(self, state: dict) -> None:
        DEFINITIONS.update(state["definitions"])
        self.__dict__.update(state)

    def decode(self, data: bytes, at: int = 0) -> tuple[object, int]:
        """The value at a place, and where it ends."""
        raise NotImplementedError

    def encode(self, value) -> bytes:
        raise NotImplementedError

    def size(self, value) -> int:
        """Bytes of the encoded value."""
        return len(self.encode(value))

    def skip(self, data: bytes, at: int) -> int:
        """Where the next value begins, or the end."""
        return at

    def values(self, data: bytes) -> Iterator[object]:
        """All values, one after another; trailing blanks are none, and progress is certain."""
        at = self.skip(data, 0)
        while at < len(data):
            value, end = self.decode(data, at)
            if end <= at:
                raise DecodeProblem(f"nothing is read at byte {at}")
            yield value
            at = self.skip(data, end)

    def one(self, data: bytes):
        value, end = self.decode(data, self.skip(data, 0))
        if self.skip(data, end) < len(data):
            raise DecodeProblem(f"{len(data) - end} bytes are left over")
        return value


CODECS: dict[str, type[Codec]] = {}


def register(c: type[Codec]) -> type[Codec]:
    """Also for codecs of users: make ``name`` known to readers and writers."""
    CODECS[c.name] = c
    return c


def codec(name: str, m: Maybe | str, **options) -> Codec:
    if name not in CODECS:
        raise SchemaError(f"no encoding is called {name}; there are {sorted(CODECS)}")
    return CODECS[name](m, **options)


def to_row(value, m: Maybe):
    """A codec's value as Spark takes it."""
    if value is None:
        return None
    if m.typ.kind == "this":
        return codec("json", m).encode(value).decode("utf-8", "surrogateescape")
    t = develop(m.typ)
    if t.kind in INTEGERS:
        if INTEGERS[t.kind] == 128:
            return wide.pack(value, t.kind == "i128")
        if t.kind == "u64":
            from decimal import Decimal

            return Decimal(value)
        return value
    match t.kind:
        case "vec" | "arr" | "lst" | "set":
            return [to_row(x, t.items[0]) for x in value]
        case "tup":
            return {f"_{i}": to_row(x, k) for i, (x, k) in enumerate(zip(value, t.items), 1)}
        case "rec":
            return {n: to_row(value[n], k) for n, k in zip(t.names, t.items)}
        case "sum":
            out: dict = {"tag": value[0]}
            for i, (n, k) in enumerate(zip(t.names, t.items)):
                if k.typ.kind != "void":
                    out[n] = to_row(value[1], k) if i == value[0] else None
            return out
    return value


def from_row(value, m: Maybe):
    """What Spark gives as a codec's value."""
    if m.typ.kind == "this":
        return None if value is None else codec("json", m).one(value.encode("utf-8", "surrogateescape"))
    t = develop(m.typ)
    if value is None or isinstance(value, float) and value != value and t.kind != "float":
        return None
    if t.kind in INTEGERS:
        return wide.unpack(bytes(value), t.kind == "i128") if INTEGERS[t.kind] == 128 else int(value)
    match t.kind:
        case "vec" | "arr" | "lst" | "set":
            return [from_row(x, t.items[0]) for x in value]
        case "tup":
            return tuple(from_row(_part(value, f"_{i}"), k) for i, k in enumerate(t.items, 1))
        case "rec":
            return {n: from_row(_part(value, n), k) for n, k in zip(t.names, t.items)}
        case "sum":
            tag = int(_part(value, "tag"))
            k = t.items[tag]
            return (tag, None if k.typ.kind == "void" else from_row(_part(value, t.names[tag]), k))
        case "bytes":
            return bytes(value)
        case "float":
            return float(value)
        case "bool":
            return bool(value)
    return value


def _part(value, name: str):
    return value[name]


def _columns(m: Maybe) -> bool:
    return develop(m.typ).kind in ("rec", "tup")


def in_width(n: int, m: Maybe) -> int:
    """An integer that text spells: one beyond the declared width is no value of the type."""
    low, high = in_range(k) if (k := develop(m.typ).kind) in INTEGERS else (0, (1 << 63) - 1)
    if not low <= n <= high:
        raise DecodeProblem(f"{n} is no {m}")
    return n


def _arrow(m: Maybe):
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(to_spark(m))


PLACE = "struct<file:string,block:bigint,line:bigint,k:int>"


def _decoded(blob: bytes, whole: bool):
    made: Codec = pickle.loads(blob)
    kind = pa.struct([("file", pa.string()), ("block", pa.int64()), ("line", pa.int64()), ("k", pa.int32())])

    def run(batches):
        value = _arrow(made.m)
        for batch in batches:
            rows, places = [], []
            for data, file, block, line in zip(*(batch.column(c) for c in ("content", "file", "block", "line"))):
                at = {"file": file.as_py(), "block": block.as_py(), "line": line.as_py()}
                for k, v in enumerate(made.values(data.as_py()) if whole else [made.one(data.as_py())]):
                    rows.append(to_row(v, made.m))
                    places.append({**at, "k": k})
                    if len(rows) >= 10_000:
                        yield pa.RecordBatch.from_arrays([pa.array(rows, value), pa.array(places, kind)], ["value", "place"])
                        rows, places = [], []
            yield pa.RecordBatch.from_arrays([pa.array(rows, value), pa.array(places, kind)], ["value", "place"])

    return run


def read(spark: SparkSession, path: str, name: str, m: Maybe | str, delimiter: str | None = None, place: str | None = None, **options) -> DataFrame:
    """The values in files. With a ``delimiter`` of records (CSV has the newline) files are split, at any size. Without
    one, records cannot be told apart from the middle: each file is then one piece of work, of 2 GB at most, so
    write large inputs as several files. ``place``: a column that orders the values as files have them.
    """
    made = codec(name, m, **options)
    if delimiter is None and made.framed:
        delimiter = options.get("newline", "\n")
    if delimiter:
        source = spark.read.option("lineSep", delimiter).text(path).where("value != ''").select(F.encode("value", "utf-8").alias("content"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    else:
        source = spark.read.format("binaryFile").load(path).select("content", F.col("path").alias("file"), F.lit(0).cast("long").alias("block"))
    return _table(source.withColumn("line", F.monotonically_increasing_id()), made, True, place)


def _table(source: DataFrame, made: Codec, whole: bool, place: str | None = None) -> DataFrame:
    from pyspark.sql import types as S

    out = source.mapInArrow(_decoded(pickle.dumps(made), whole), S.StructType([S.StructField("value", to_spark(made.m), True), S.StructField("place", S._parse_datatype_string(PLACE), True)]))
    named = [F.col("value").getField(f.name).alias(f.name) for f in to_schema(made.m)] if _columns(made.m) else ["value"]
    return out.select(*named, *([F.col("place").alias(place)] if place else []))


def encode_column(value: Column, made: Codec) -> Column:
    """The bytes of a column of values (a struct for records and tuples).

    Text encodings of most types are made by Spark's own functions; the others by Python, a batch at a time.
    """
    from .columns import text_column

    text = text_column(value, made)
    if text is not None:
        return F.encode(text, "utf-8")
    blob = pickle.dumps(made)

    @F.arrow_udf("binary")
    def run(v: pa.Array) -> pa.Array:
        c = _loaded(blob)
        return pa.array([c.encode(from_row(x, c.m)) for x in v.to_pylist()], pa.binary())

    return run(value)


def decode_column(data: Column, made: Codec) -> Column:
    """The value that each row's bytes are; NULL for NULL. A batch at a time."""
    blob = pickle.dumps(made)

    @F.arrow_udf(to_spark(made.m))
    def run(v: pa.Array) -> pa.Array:
        c = _loaded(blob)
        return pa.array([None if x is None else to_row(c.one(x), c.m) for x in v.to_pylist()], _arrow(c.m))

    return run(data)


_cache: dict[bytes, Codec] = {}


def _loaded(blob: bytes) -> Codec:
    if blob not in _cache:
        _cache[blob] = pickle.loads(blob)
    return _cache[blob]


def packed(df: DataFrame, m: Maybe) -> Column:
    """The columns of a table as one value."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns]) if _columns(m) else F.col("value")


def write(df: DataFrame, path: str, name: str, m: Maybe | str, delimiter: str = "\n", **options) -> None:
    """Text encodings as lines, binary ones as a table of bytes; the encoding ``null`` discards all."""
    if name == "null":
        df.write.format("noop").mode("overwrite").save()
        return
    made = codec(name, m, **options)
    data = encode_column(packed(df, made.m), made).alias("value")
    out = df.select(data)
    if name in ("row-binary", "ringbuf"):
        out.write.mode("overwrite").parquet(path)
    else:
        out.select(F.decode("value", "utf-8").alias("value")).write.mode("overwrite").option("lineSep", delimiter).text(path)


def sizes(df: DataFrame, name: str, m: Maybe | str, **options) -> Column:
    made = codec(name, m, **options)
    return F.octet_length(encode_column(packed(df, made.m), made)).cast("long")
