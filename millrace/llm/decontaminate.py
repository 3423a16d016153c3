"""Benchmark passages in documents: pigeonhole pieces, then Myers' bit-parallel distance."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import GOLDEN, flat, mix, take, tune

BUDGET = 0.05
#: Characters of items in one broadcast (an index takes about three bytes for each), and in all.
BLOCK, MOST = 16_000_000, 256_000_000
#: A piece is met by its first characters, as many of these as it has.
LENGTHS = (16, 8, 4, 2)
#: Characters of texts that one numpy step handles; a longer text stands alone.
STEP = 200_000
KIND = "array<struct<item_id:long,distance:int>>"


def normal(text: Column) -> Column:
    """Lower-case words of letters and digits with one blank between and around them."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " ")), F.lit(" "))


def budget(length: int, share: float = BUDGET) -> int:
    return int(length * share)


def pieces(item: str, errors: int) -> list[tuple[int, str]]:
    """``errors`` + 1 pieces of nearly equal length, with their places: one of them survives that many edits."""
    n = len(item)
    cuts = [n * k // (errors + 1) for k in range(errors + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:])]


def nearest(pattern: str, text: str) -> int:
    """The least edit distance between ``pattern`` and any substring of ``text`` (Myers, one column a character)."""
    m = len(pattern)
    if not m:
        return 0
    masks: dict[str, int] = {}
    for i, c in enumerate(pattern):
        masks[c] = masks.get(c, 0) | 1 << i
    full, high = (1 << m) - 1, 1 << (m - 1)
    up, down, score = full, 0, m
    best = m
    for c in text:
        eq = masks.get(c, 0)
        diagonal = (((eq & up) + up) ^ up) | eq | down
        plus = down | ~(diagonal | up)
        minus = up & diagonal
        if plus & high:
            score += 1
        elif minus & high:
            score -= 1
            if score < best:
                best = score
        plus <<= 1
        minus <<= 1
        up = (minus | ~(diagonal | plus)) & full
        down = plus & diagonal & full
    return best


def _runs(codes: np.ndarray):
    """Hashes of all runs of 2, 4, 8 and 16 codes, by length."""
    with np.errstate(over="ignore"):
        h, n = mix(codes.astype(np.uint64) + GOLDEN), 1
        while n < max(LENGTHS):
            h = mix(h[:-n] * GOLDEN + h[n:]) if len(h) > n else h[:0]
            n *= 2
            yield n, h


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


class Index:
    """The pieces of some items, sorted by the hash of their beginnings."""

    def __init__(self, items: list[tuple[int, str]], share: float = BUDGET):
        self.items, self.share = items, share
        parts = [(i, at, len(piece)) for i, (_, item) in enumerate(items) for at, piece in pieces(item, budget(len(item), share))]
        self.parts = np.array(parts, np.int64).reshape(-1, 3)
        lengths = self.parts[:, 2]
        # items are longer than two characters, and so are their pieces
        self.by: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        text = "".join(item for _, item in items)
        begin = np.cumsum([0, *(len(item) for _, item in items)])[self.parts[:, 0]] + self.parts[:, 1]
        for n, h in _runs(_codes(text)):
            most = 2 * n if n < max(LENGTHS) else np.iinfo(np.int64).max
            mine = np.flatnonzero((lengths >= n) & (lengths < most))
            if len(mine):
                values = h[begin[mine]]
                order = np.argsort(values, kind="stable")
                bits = min(24, max(12, int(len(mine) * 8).bit_length()))
                sieve = np.zeros(1 << bits, bool)
                sieve[values >> np.uint64(64 - bits)] = True
                self.by[n] = (values[order], mine[order], sieve)

    def hits(self, codes: np.ndarray):
        """(place, piece) pairs at which the beginning of a piece stands."""
        for n, h in _runs(codes):
            if n not in self.by or not len(h):
                continue
            values, which, sieve = self.by[n]
            maybe = np.flatnonzero(sieve[h >> np.uint64(65 - len(sieve).bit_length())])
            low, high = (np.searchsorted(values, h[maybe], side) for side in ("left", "right"))
            count = high - low
            entry = np.repeat(low - np.cumsum(count) + count, count) + np.arange(int(count.sum()))
            yield from zip(np.repeat(maybe, count).tolist(), which[entry].tolist())

    def find(self, texts: list[str]) -> list[list[tuple[int, int]]]:
        """For each normal text, (item id, distance) of the items that occur in it within their budgets."""
        begins = np.cumsum([0, *map(len, texts)])
        near: dict[tuple[int, int], set[int]] = {}
        places = list(self.hits(_codes("".join(texts))))
        rows = (np.searchsorted(begins, [p for p, _ in places], "right") - 1).tolist()
        for (place, piece), r in zip(places, rows):
            i, at, n = self.parts[piece].tolist()
            item, begin = self.items[i][1], place - int(begins[r])
            if texts[r].startswith(item[at : at + n], begin):
                near.setdefault((r, i), set()).add(begin - at)
        out: list[list[tuple[int, int]]] = [[] for _ in texts]
        for (r, i), found in near.items():
            distance = self.distance(texts[r], self.items[i][1], sorted(found))
            if distance is not None:
                out[r].append((self.items[i][0], distance))
        return [sorted(x) for x in out]

    def distance(self, text: str, item: str, begins: list[int]) -> int | None:
        """The least distance of the item around the places where it may begin, if it is within the budget."""
        errors = budget(len(item), self.share)
        best, reach = errors + 1, -1
        windows: list[list[int]] = []
        for begin in begins:
            low, high = max(0, begin - errors), begin + len(item) + errors
            if windows and low <= reach:
                windows[-1][1] = high
            else:
                windows.append([low, high])
            reach = high
        for low, high in windows:
            best = min(best, nearest(item, text[low:high]))
            if not best:
                break
        return best if best <= errors else None


def _items(benchmark: DataFrame, item_id: str, text: str) -> list[list[tuple[int, str]]]:
    """Distinct normal items in blocks of bounded size; items without a word are none."""
    rows = take(benchmark, item=item_id, text=text).where("item is not null").select("item", normal(F.col("text")).alias("text")).where("length(text) > 2").distinct()
    size = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    if size > MOST:
        raise ValueError(f"a benchmark of {size} characters: match at most {MOST} at a time, one part after another")
    blocks: list[list[tuple[int, str]]] = []
    held = 0
    for r in rows.orderBy("item", "text").toLocalIterator():
        if not blocks or held + len(r["text"]) > BLOCK:
            blocks.append([])
            held = 0
        blocks[-1].append((r["item"], r["text"]))
        held += len(r["text"])
    return blocks


def _search(sent):
    @F.arrow_udf(KIND)
    def search(column: pa.Array) -> pa.Array:
        texts = column.to_pylist()
        index, out, some, held = sent.value, [], [], 0
        for k, t in enumerate(texts):
            some.append(t)
            held += len(t)
            if held >= STEP or k == len(texts) - 1:
                out += [[{"item_id": i, "distance": d} for i, d in x] for x in index.find(some)]
                some, held = [], 0
        return pa.array(out, pa.list_(pa.struct([("item_id", pa.int64()), ("distance", pa.int32())])))

    return search


def matches(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", share: float = BUDGET, into: str = "_matches") -> DataFrame:
    """All columns of ``docs`` and ``into``: an array of (item_id, distance) of the test items found in the text.

    Documents and items are compared as lower-case words with single blanks, an item with a blank at both ends. An
    item of n characters may differ from some passage by up to n * share edits (rounded down). It is cut into one
    piece more than that, so one piece is in the passage unchanged; each hit is verified by the edit distance of the
    whole item. Pieces are met by the hash of their first 16, 8, 4 or 2 characters, then in full. The benchmark is sent to all tasks
    as indexes of its pieces, one for each 16 MB of text; one of over 256 MB is an error, and can be met in parts.

    Null or wordless texts match nothing; null, wordless or null-id items match nothing; repeated items count once.
    """
    spark = docs.sparkSession
    tune(spark)
    found = F.array().cast(KIND)
    clean = normal(F.col(text))
    for block in _items(benchmark, item_id, item_text):
        found = F.concat(found, _search(spark.sparkContext.broadcast(Index(block, share)))(clean))
    return docs.withColumn(into, found)


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", share: float = BUDGET) -> DataFrame:
    """The rows of ``docs``, all columns, in which no test item occurs."""
    rows, at = flat(docs)
    return matches(rows, benchmark, at[text], share=share).where(F.size("_matches") == 0).drop("_matches").toDF(*docs.columns)
