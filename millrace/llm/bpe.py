"""Byte-level BPE by a shuffle of distinct words."""

from __future__ import annotations

import base64
import pickle
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, take, tune

#: Characters of text in a block; words are distinct within a block before they are shuffled.
BLOCK = 6_000_000


class Vocabulary:
    """Ranks of a .tiktoken file, by path; each worker reads a broadcast copy (about 1 MB, bounded by the file)."""

    MOST = 64_000_000

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            self.raw = zlib.compress(f.read(self.MOST + 1), 6)
        if len(zlib.decompress(self.raw)) > self.MOST:
            raise ValueError(f"a vocabulary of over {self.MOST} bytes")
        self.pattern = pattern
        self._made = None

    def __getstate__(self):
        return {"raw": self.raw, "pattern": self.pattern, "_made": None}

    def parts(self):
        """(compiled pattern, ranks by bytes, bytes by rank)."""
        if self._made is None:
            import regex

            ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in zlib.decompress(self.raw).splitlines() if x.strip())}
            table: list[bytes | None] = [None] * (max(ranks.values(), default=-1) + 1)
            for piece, rank in ranks.items():
                table[rank] = piece
            self._made = (regex.compile(self.pattern), ranks, table)
        return self._made


def merge(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Join the adjacent pair of the lowest rank (the leftmost of equals) until none has a rank.

    A heap of pairs with lazy removal, so that a word of n bytes takes n log n steps.
    """
    import heapq

    if word in ranks:
        return [ranks[word]]
    n = len(word)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    end = list(range(1, n + 1))
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    alive = [True] * n
    while heap:
        _, i, stop = heapq.heappop(heap)
        if not alive[i] or after[i] >= n or end[after[i]] != stop:
            continue
        j = after[i]
        alive[j], end[i], after[i] = False, stop, after[j]
        if after[i] < n:
            before[after[i]] = i
            if (r := ranks.get(word[i : end[after[i]]])) is not None:
                heapq.heappush(heap, (r, i, end[after[i]]))
        if before[i] >= 0 and (r := ranks.get(word[before[i] : end[i]])) is not None:
            heapq.heappush(heap, (r, before[i], end[i]))
    return [ranks[word[i : end[i]]] for i in range(n) if alive[i]]


def _pack(x: np.ndarray) -> bytes:
    """Integers as byte planes, compressed."""
    import zstandard

    planes = np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()
    return zstandard.ZstdCompressor(level=3).compress(planes)


def _unpack(x: bytes) -> np.ndarray:
    import zstandard

    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(x), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").reshape(-1)


#: Ranks below this are symbols of their own; larger ones are a symbol for their bit length and the bits after the first.
#: The 24 symbols left are for lengths up to 31 bits: all that an array's places need.
OWN, LOW_BIT, BITS = 232, 7, 24
#: Bytes of words whose ids a task remembers; beyond, it forgets them all and starts again.
KNOWN = 32_000_000


def _squeeze(x: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=3).compress(x)


def _loose(x: bytes, kind) -> np.ndarray:
    import zstandard

    return np.frombuffer(zstandard.ZstdDecompressor().decompress(x), kind)


def _pack_ranks(x: np.ndarray) -> list[bytes]:
    """Numbers of which small ones are frequent: symbols, then for each bit length the rest of its numbers."""
    bits = np.zeros(len(x), np.int64)
    large = x >= OWN
    bits[large] = np.floor(np.log2(x[large])).astype(np.int64)
    out = [_squeeze(np.where(large, OWN + bits - LOW_BIT, x).astype(np.uint8).tobytes())]
    if len(x) and bits.max() >= LOW_BIT + BITS:
        raise ValueError("a block has 2**31 different words or more")
    for k in range(LOW_BIT, LOW_BIT + BITS):
        out.append(_pack(x[bits == k] - (1 << k)) if (bits == k).any() else b"")
    return out


def _unpack_ranks(parts: list[bytes]) -> np.ndarray:
    symbol = _loose(parts[0], np.uint8).astype(np.int64)
    out = symbol.copy()
    for k, part in zip(range(LOW_BIT, LOW_BIT + BITS), parts[1:]):
        if part:
            out[symbol == OWN + k - LOW_BIT] = _unpack(part).astype(np.int64) + (1 << k)
    return out


ROW = pa.schema([("part", pa.int32()), ("block", pa.int64()), ("kind", pa.int32()), ("rows", pa.binary()), ("data", pa.binary())])


def _explode(sent, width: int, size: int):
    def run(batches):
        from pyspark import TaskContext

        pattern = sent.value.parts()[0]
        number = TaskContext.get().partitionId() << 33

        def block(keys, texts):
            nonlocal number
            ids: dict[str, int] = {}
            positions, counts = [], []
            for t in texts:
                found = pattern.findall(t)
                positions.append(np.array([ids.setdefault(w, len(ids)) for w in found], np.int32))
                counts.append(len(found))
            # words by frequency, so that small numbers are frequent ones
            at = np.concatenate(positions)
            order = np.argsort(-np.bincount(at, minlength=len(ids)), kind="stable")
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            raw = list(ids)
            ids.clear()
            raw = [raw[i].encode() for i in order.tolist()]
            part = np.fromiter((zlib.crc32(w) for w in raw), np.int64, len(raw)) % width
            out = {c: [] for c in ROW.names}

            def row(*values):
                for c, v in zip(ROW.names, values):
                    out[c].append(v)

            head = np.array([[0 if k is None else k for k in keys], [k is not None for k in keys], counts], np.int64).tobytes()
            row(number % width, number, -1, pickle.dumps((head, _pack(part))), pickle.dumps(_pack_ranks(rank[at])))
            for p in np.unique(part):
                mine = np.flatnonzero(part == p)
                row(int(p), number, int(p), _pack(np.array([len(raw[i]) for i in mine])), _squeeze(b"".join(raw[i] for i in mine)))
            number += 1
            return pa.RecordBatch.from_pydict(out, schema=ROW)

        keys, texts, held = [], [], 0
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                text = text or ""
                if held and held + len(text) > size:
                    yield block(keys, texts)
                    give_back()
                    keys, texts, held = [], [], 0
                keys.append(key)
                texts.append(text)
                held += len(text)
        if keys:
            yield block(keys, texts)
        give_back()

    return run


def _encode(sent):
    def run(batches):
        import zstandard

        ranks = sent.value.parts()[1]
        known: dict[bytes, bytes] = {}
        held = 0
        for batch in batches:
            out = []
            for kind, rows, data in zip(batch.column("kind").to_pylist(), batch.column("rows").to_pylist(), batch.column("data").to_pylist()):
                if kind >= 0:
                    joined = zstandard.ZstdDecompressor().decompress(data)
                    ids, begin = [], 0
                    for end in np.cumsum(_unpack(rows)).tolist():
                        word = joined[begin:end]
                        begin = end
                        got = known.get(word)
                        if got is None:
                            got = known[word] = np.array(merge(word, ranks), np.uint32).tobytes()
                            held += len(word) + len(got) + 150
                        ids.append(got)
                    rows = _pack(np.array([len(x) // 4 for x in ids]))
                    data = _pack(np.frombuffer(b"".join(ids), np.uint32))
                    if held > KNOWN:
                        known.clear()
                        held = 0
                out.append((rows, data))
            yield pa.RecordBatch.from_arrays([batch.column("part"), batch.column("block"), batch.column("kind"), pa.array([x for x, _ in out], pa.binary()), pa.array([x for _, x in out], pa.binary())], schema=ROW)
        known.clear()
        give_back()

    return run


def _reassemble(table: pa.Table) -> pa.Table:
    kinds, rows, data = (table.column(c).to_pylist() for c in ("kind", "rows", "data"))
    give_back()
    k = kinds.index(-1)
    head, part = pickle.loads(rows[k])
    keys, valid, counts = np.frombuffer(head, np.int64).reshape(3, -1)
    part = _unpack(part)
    at = _unpack_ranks(pickle.loads(data[k]))
    words, lengths, ids = [], [], []
    for kind, r, d in zip(kinds, rows, data):
        if kind >= 0:
            words.append(np.flatnonzero(part == kind))
            lengths.append(_unpack(r).astype(np.int64))
            ids.append(_unpack(d))
    none = np.empty(0, np.int64)
    word, length, pool = (np.concatenate(x) if x else none for x in (words, lengths, ids))
    begin, size = np.zeros(len(word), np.int64), np.zeros(len(word), np.int64)
    begin[word], size[word] = np.cumsum(length) - length, length
    n = size[at]
    flat = pool[np.repeat(begin[at] - (np.cumsum(n) - n), n) + np.arange(n.sum())] if len(at) else none
    token_ends = np.concatenate(([0], np.cumsum(n)))
    ends = token_ends[np.concatenate(([0], np.cumsum(counts)))]
    return pa.table({"_key": pa.array(keys, mask=valid == 0), "ids": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat.astype(np.int32)))})


def encode(docs: DataFrame, text: str, key: str, vocabulary: Vocabulary, block: int = BLOCK) -> DataFrame:
    """Columns _key (the long column ``key``) and ids (array of int): the tokens of each text.

    Texts are split by the vocabulary's pattern; each block of texts (``block`` characters, or one longer text) sends its
    distinct words, by hash, to the task that encodes them, which merges each distinct word of the corpus once (again only after
    it has had to forget 32 MB of them), and
    sends the ids back to the block, where the positions have stayed in order. Words, positions and ids travel packed.
    A hot word travels once for each block. Null texts are empty; an empty text has an empty array.
    """
    spark = docs.sparkSession
    tune(spark)
    sent = spark.sparkContext.broadcast(vocabulary)
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    kind = "part int, block long, kind int, rows binary, data binary"
    words = take(docs, key=key, text=text).select(F.col("key").cast("long"), "text").mapInArrow(_explode(sent, width, block), kind)
    ids = words.repartition(width, "part").mapInArrow(_encode(sent), kind)
    return ids.groupBy("block").applyInArrow(_reassemble, "_key long, ids array<int>")


def decode(rows: DataFrame, ids: str, vocabulary: Vocabulary, into: str = "_bytes") -> DataFrame:
    """All columns of ``rows`` and ``into``: the bytes that the ids stand for; a null array gives null.

    The token table, bounded by the vocabulary file, is met where its rank is its place: a constant array of the
    tokens' bytes in the plan, so that ids are joined to it without a shuffle and without Python. An id without a
    token raises.
    """
    table = vocabulary.parts()[2]
    # tokens as hexadecimal text; a rank that has none is empty
    spelled = F.split(F.lit(",".join("" if t is None else t.hex() for t in table)), ",")
    missing = F.raise_error(F.lit("an id has no token")).cast("string")
    token = lambda i: F.coalesce(F.nullif(F.get(spelled, i), F.lit("")), missing)
    return rows.withColumn(into, F.unhex(F.array_join(F.transform(F.col(ids), token), "")))
