"""Near-duplicate documents: BagMinHash signatures, bands, and exact multiset overlap."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import GOLDEN, bags, flat, joined, lists, mix, saved, shingles, spans, take, text_key, tune, word_hashes
from .components import components

BANDS, ROWS = 40, 6
NEVER = np.int64(1 << 62)
SLOTS = BANDS * ROWS
SIMILAR = 0.8
#: Up to this many members, a bucket emits all its pairs: at most SMALL - 1 for each member.
SMALL = 12
#: An estimate from SLOTS slots lies this far below the truth with a probability of 3e-9 (5.8 deviations at 0.8).
SLACK = 0.15
#: Members of a block of a large bucket: two blocks meet in one task.
BLOCK = 1024
#: Words that one numpy step handles (a longer text stands alone), and points of the processes.
STEP, POINTS = 200_000, 150_000
#: Text keys that a broadcast may hold (8 MB of keys).
KEYS = 500_000


def signatures(row: np.ndarray, element: np.ndarray, weight: np.ndarray, rows: int, slots: int = SLOTS) -> np.ndarray:
    """BagMinHash: for each row and slot, the time of the first point that the row's weighted elements own there.

    The weight axis of an element is cut at 0, 1, 2, 4, 8, ...; over each interval below its weight runs a Poisson
    process of the interval's width as rate, seeded by element and interval. A point has a time, a slot and, by
    halving the interval again and again down to unit weights, a place on the axis; it counts where the place lies
    below the weight. Two rows share a slot's first point with the probability of their weighted Jaccard similarity.
    A process stops when it is later than every slot of its row. Rows without elements keep endless times.

    Times are whole numbers of 2**-32, so that sums do not depend on how steps are batched: the same element makes
    the same times in every task.
    """
    sig = np.full((rows, slots), NEVER)
    parts, low = [], 0
    at = np.arange(len(element))
    while len(at):
        width = max(1, low)
        parts.append((at, np.full(len(at), low), np.full(len(at), width)))
        low += width
        at = at[weight[at] > low]
    if not parts or not len(element):
        return sig
    who, lo, width = (np.concatenate(x) for x in zip(*parts))
    with np.errstate(over="ignore"):
        seed = mix(element[who].astype(np.uint64) + mix(lo.astype(np.uint64) + np.uint64(1)) * GOLDEN)
        limit, owner = weight[who], row[who]
        time, step = np.zeros(len(who), np.int64), 0
        while len(owner):
            many = int(min(64, max(1, POINTS // len(owner))))
            state = mix(seed[:, None] + np.arange(step + 1, step + many + 1, dtype=np.uint64) * GOLDEN)
            step += many
            wait = -np.log(((state >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / width[:, None]
            t = time[:, None] + np.cumsum(np.floor(wait * 2.0**32).astype(np.int64) + 1, axis=1)
            slot = mix(state ^ np.uint64(0xA5A5A5A5A5A5A5A5)) % np.uint64(slots)
            good = np.ones(t.shape, bool)
            part = np.flatnonzero(lo + width > limit)
            if len(part):
                place = lo[part, None] + np.floor((mix(state[part] ^ np.uint64(0x5851F42D4C957F2D)) >> np.uint64(11)).astype(np.float64) * 2.0**-53 * width[part, None])
                good[part] = place < limit[part, None]
            r, c = np.nonzero(good)
            np.minimum.at(sig.reshape(-1), owner[r] * slots + slot[r, c].astype(np.int64), t[r, c])
            time = t[:, -1]
            live = time < sig.max(axis=1)[owner]
            seed, limit, owner, time, lo, width = (x[live] for x in (seed, limit, owner, time, lo, width))
    return sig


def overlap(a: np.ndarray, b: np.ndarray) -> float:
    """Weighted Jaccard similarity of two sorted arrays that hold each shingle as often as it occurs."""
    if not len(a) or not len(b):
        return 0.0
    both = np.concatenate((a, b))
    x, nx = np.unique(a, return_counts=True)
    y, ny = np.unique(b, return_counts=True)
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    common = int(np.minimum(nx[i], ny[j]).sum())
    return common / (len(both) - common)


def _sign(batches):
    for batch in batches:
        values, offsets = lists(batch.column("hashes"))
        keys = batch.column("th")
        for begin, end in spans(offsets, STEP):
            cut = offsets[begin : end + 1]
            h, row = shingles(values[cut[0] : cut[-1]], cut - cut[0])
            size = np.bincount(row, minlength=end - begin)
            r, e, w = bags(h, row)
            sig = signatures(r, e, w, end - begin)
            bits = mix(sig.view(np.uint64))
            band = np.zeros((end - begin, BANDS), np.uint64)
            with np.errstate(over="ignore"):
                for k in range(ROWS):
                    band = mix(band * GOLDEN + bits[:, k::ROWS])
            full = np.flatnonzero(size)
            short = bits.astype(np.uint16)
            yield pa.RecordBatch.from_arrays(
                [
                    keys.slice(begin, end - begin).take(pa.array(full)),
                    pa.array(size[full], pa.int64()),
                    pa.ListArray.from_arrays(pa.array(np.arange(len(full) + 1) * BANDS, pa.int32()), pa.array(band[full].reshape(-1).view(np.int64))),
                    pa.array([short[i].tobytes() for i in full], pa.binary()),
                ],
                ["th", "size", "bands", "sig"],
            )


def _shingled(batches):
    for batch in batches:
        values, offsets = lists(batch.column("hashes"))
        keys = batch.column("th")
        for begin, end in spans(offsets, STEP):
            cut = offsets[begin : end + 1]
            h, row = shingles(values[cut[0] : cut[-1]], cut - cut[0])
            ends = np.searchsorted(row, np.arange(end - begin + 1))
            yield pa.RecordBatch.from_arrays([keys.slice(begin, end - begin), pa.array([np.sort(h[ends[i] : ends[i + 1]]).tobytes() for i in range(end - begin)], pa.binary())], ["th", "bag"])


def _close(batches):
    for batch in batches:
        x, y = batch.column("sig"), batch.column("sig2")
        a = np.frombuffer(b"".join(x.to_pylist()), np.uint16).reshape(-1, SLOTS)
        b = np.frombuffer(b"".join(y.to_pylist()), np.uint16).reshape(-1, SLOTS)
        good = np.flatnonzero((a == b).mean(axis=1) >= SIMILAR - SLACK)
        yield pa.RecordBatch.from_arrays([batch.column("a").take(pa.array(good)), batch.column("b").take(pa.array(good))], ["a", "b"])


def _verify(similar: float):
    def run(batches):
        for batch in batches:
            x, y = batch.column("bag"), batch.column("bag2")
            good = [i for i in range(len(batch)) if overlap(np.frombuffer(x[i].as_py(), np.uint64), np.frombuffer(y[i].as_py(), np.uint64)) >= similar]
            yield pa.RecordBatch.from_arrays([batch.column("a").take(pa.array(good, pa.int64())), batch.column("b").take(pa.array(good, pa.int64()))], ["a", "b"])

    return run


def _cross(similar: float):
    """Links between members of different classes in one pair of blocks of a bucket, as a spanning forest.

    Pairs are told apart by their signatures first; a pair is met in the first band whose key (64 bits, as the buckets
    have it) it shares. Pairs that the links found here have joined already are not verified again.
    """

    def run(table: pa.Table) -> pa.Table:
        band, i, j = (table.column(c)[0].as_py() for c in ("band", "i", "j"))
        block = table.column("block").to_numpy()
        th, of = table.column("th").to_pylist(), table.column("c").to_pylist()
        number = {c: k for k, c in enumerate(dict.fromkeys(of))}
        code = np.array([number[c] for c in of])
        sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), np.uint16).reshape(-1, SLOTS)
        keys = lists(table.column("bands"))[0].reshape(-1, BANDS)
        size = table.column("size").to_numpy()
        bags_of = table.column("bag")
        left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
        parent = list(range(len(number)))

        def root(x: int) -> int:
            while parent[x] != x:
                parent[x] = x = parent[parent[x]]
            return x

        a, b = [], []
        for x in left:
            others = right[right > x] if i == j else right
            others = others[code[others] != code[x]]
            fit = np.minimum(size[x], size[others]) >= similar * np.maximum(size[x], size[others])
            others = others[fit]
            if not len(others):
                continue
            near = others[(sig[others] == sig[x]).mean(axis=1) >= similar - SLACK]
            mine = None
            for y in near[(keys[near] == keys[x]).argmax(axis=1) == band]:
                p, q = root(code[x]), root(code[y])
                if p == q:
                    continue
                if mine is None:
                    mine = np.frombuffer(bags_of[int(x)].as_py(), np.uint64)
                if overlap(mine, np.frombuffer(bags_of[int(y)].as_py(), np.uint64)) >= similar:
                    parent[q] = p
                    a.append(th[x])
                    b.append(th[y])
        return pa.table({"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary())})

    return run


def _between(large: DataFrame, classes: DataFrame, signed: DataFrame, texts: DataFrame, similar: float) -> DataFrame | None:
    """Links between the classes that large buckets still hold, or None where none holds two.

    A bucket of n members is cut into blocks of about 1024 by hash, and each pair of blocks is one group: a member
    goes to as many groups as there are blocks. No pair leaves its group but as a link.
    """
    named = large.join(classes.withColumnRenamed("node", "th"), "th", "left").withColumn("c", F.coalesce("component", "th")).drop("component")
    split = named.groupBy("band", "key").agg(F.min("c").alias("c0"), F.max("c").alias("c1"), F.count("*").alias("m")).where("c0 != c1")
    met = saved(joined(named, split.select("band", "key", "m"), ["band", "key"], "split"), "open")
    if met.isEmpty():
        return None
    blocks = F.ceil(F.col("m") / BLOCK).cast("int")
    met = met.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("th"), F.col("blocks")).cast("int"))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("band", "key", "th", "c", "size", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    needed = met.select("th").distinct()
    kept = _bags(texts, needed).join(signed.select("th", "sig", "bands"), "th")
    groups = met.join(saved(kept, "bags"), "th").groupBy("band", "key", "i", "j")
    return saved(groups.applyInArrow(_cross(similar), "a binary, b binary"), "links")


def _bags(texts: DataFrame, needed: DataFrame) -> DataFrame:
    """Sorted shingles of the texts whose keys are needed: columns th, bag.

    The keys are counted; up to KEYS of them (16 bytes each) are sent to all tasks, more are met by a shuffle of the
    texts.
    """
    needed = saved(needed, "needed")
    if needed.count() <= KEYS:
        needed = F.broadcast(needed)
    met = texts.join(needed, "th", "left_semi").dropDuplicates(["th"])
    return met.select("th", word_hashes(F.col("text")).alias("hashes")).mapInArrow(_shingled, "th binary, bag binary")


def _links(pairs: DataFrame, sigs: DataFrame, texts: DataFrame, similar: float) -> DataFrame:
    """Those pairs of text keys (a, b) whose shingle multisets overlap enough."""
    left = sigs.select(F.col("th").alias("a"), "sig")
    right = sigs.select(F.col("th").alias("b"), F.col("sig").alias("sig2"))
    near = saved(pairs.join(left, "a").join(right, "b").mapInArrow(_close, "a binary, b binary"), "near")
    needed = near.select(F.col("a").alias("th")).union(near.select(F.col("b").alias("th"))).distinct()
    bag = saved(_bags(texts, needed), "bags")
    both = near.join(bag.select(F.col("th").alias("a"), "bag"), "a").join(bag.select(F.col("th").alias("b"), F.col("bag").alias("bag2")), "b")
    return saved(both.mapInArrow(_verify(similar), "a binary, b binary"), "links")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", similar: float = SIMILAR) -> DataFrame:
    """One row per row of ``docs``: doc_id, class_id, n_texts (different texts in the class), kept.

    Two texts are linked when the multisets of their five-word shingles (lower-case runs of letters and digits) have a
    weighted Jaccard similarity of ``similar`` or more; a class is what links reach. Equal texts are one node from the
    start, so that groups of exact copies cost nothing further. class_id is the smallest doc_id of the class (null
    when all are null); kept marks the row that has it (among null ids, the smallest text hash).

    A bucket of up to 12 texts gives all its pairs. A larger one gives a star around its smallest text; where
    its members are then still in several classes, its members meet in blocks and every pair between classes is told
    by signatures and, if near, verified: a true link in a bucket is tested or lies within a class already. Two things
    lose a link of similarity 0.8, and fewer above: 40 bands of 6 rows share none with a probability of 5e-6, and the
    estimate of 240 slots falls below 0.65 with one of 3e-9. What is left is verified exactly.

    Null texts link with nothing, each its own class. Texts without a word link only when equal. Texts of one to four
    words have one shingle. Rows equal in doc_id and text share their result. An empty table gives no rows.
    """
    spark = docs.sparkSession
    tune(spark)
    rows = take(docs, doc_id=doc_id, text=text)
    texts = rows.where("text is not null").select(text_key(F.col("text")).alias("th"), "text")
    slim = saved(rows.select("doc_id", text_key(F.col("text")).alias("th")), "rows")
    signed = saved(texts.select("th", word_hashes(F.col("text")).alias("hashes")).mapInArrow(_sign, "th binary, size long, bands array<long>, sig binary").dropDuplicates(["th"]), "signed")
    sigs = signed.select("th", "sig")

    banded = signed.select("th", "size", F.posexplode("bands").alias("band", "key"))
    seen = banded.groupBy("band", "key").agg(F.count("*").alias("n"), F.min("th").alias("center")).where("n > 1")
    members = saved(joined(banded, seen, ["band", "key"], "buckets"), "members")
    small = members.where(f"n <= {SMALL}")
    other = small.select("band", "key", F.col("th").alias("b"), F.col("size").alias("size2"))
    paired = small.join(other, ["band", "key"]).where(F.col("th") < F.col("b")).where(_fits("size", "size2", similar)).select(F.col("th").alias("a"), "b")
    star = members.where(f"n > {SMALL}").where("th != center").select(F.least("th", "center").alias("a"), F.greatest("th", "center").alias("b"))
    tested = saved(paired.union(star).distinct(), "pairs")
    links = _links(tested, sigs, texts, similar)
    classes = saved(components(links), "classes")

    large = members.where(f"n > {SMALL}").select("band", "key", "th", "size")
    more = _between(large, classes, signed, texts, similar)
    if more is not None:  # a class is known by its star already
        stars = classes.where("node != component").select(F.col("node").alias("a"), F.col("component").alias("b"))
        classes = saved(components(stars.union(more)), "classes")

    named = slim.join(classes.withColumnRenamed("node", "th"), "th", "left").withColumn("c", F.coalesce("component", "th")).drop("component")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "th")
    of = named.where("c is not null").groupBy("c", "th").agg(F.min(order).alias("m")).groupBy("c").agg(F.min("m").alias("m"), F.count("*").alias("n_texts"))
    out = named.join(saved(of, "heads"), "c", "left")  # written, so that the join of a large class can be split
    alone = F.col("c").isNull()
    return out.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("m.doc_id")).alias("class_id"),
        F.when(alone, F.lit(1)).otherwise(F.col("n_texts")).cast("long").alias("n_texts"),
        F.when(alone, F.lit(True)).otherwise(F.col("m.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("m.th") == F.col("th"))).alias("kept"),
        "th",
    )


def _fits(x: str, y: str, similar: float):
    """Sizes that allow the similarity."""
    return F.least(x, y) >= F.greatest(x, y) * F.lit(similar)


def deduplicate(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", similar: float = SIMILAR) -> DataFrame:
    """The rows of ``docs``, all columns, with one row of each class of near duplicates; null texts all stay."""
    kept = near_duplicates(docs, doc_id, text, similar).where("kept and th is not null").select(F.col("doc_id").alias("_id"), F.col("th").alias("_th")).distinct()
    rows, at = flat(docs)
    rows = rows.withColumn("_key", text_key(F.col(at[text])))
    known = rows.where(F.col("_key").isNotNull())
    met = known.join(kept, (F.col("_key") == F.col("_th")) & F.col(at[doc_id]).eqNullSafe(F.col("_id")), "left_semi").dropDuplicates(["_key"])
    return met.union(rows.where(F.col("_key").isNull())).drop("_key").toDF(*docs.columns)
