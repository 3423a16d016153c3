"""Substring deduplication by runs of sentences, and by passages of words wherever their sentences begin."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import GOLDEN, exploded, flat, give_back, joined, lists, mix, saved, spans, take, tune

RUN = 3
LEAST_WORDS = 10
#: A sentence ends with the blank after its full stop, or with its line. The pieces joined give the text again.
BREAK = r"(?<=[.!?…。]\s)|(?<=\n)"

#: A word keeps the blanks after it. Words joined give the text again.
WORD = r"(?<=\s)(?=\S)"
BLANKS = " \t\n\x0b\f\r"
#: A boundary is the last least hash of two words in some NEAR consecutive places; a passage runs from a boundary to the next one
#: PASSAGE words or more away. In n words that two documents share, the boundaries from word NEAR - 1 to word n - 1 - NEAR are the
#: same in both, and there is one in any NEAR places. So 4 * NEAR + PASSAGE - 2 words (46) always hold a passage that both have, and of
#: more words at most 2 * NEAR - 2 at the beginning and 3 * NEAR - 1 at the end (12 and 20) lie outside of such passages.
NEAR, PASSAGE = 7, 20
#: Words whose runs are handed on together (a longer text stands alone).
STEP = 200_000
#: Repeated hashes are marked in so many bits (8 MB), so that only runs which may be repeated are sent on.
MARKS = 26


def pieces(text: Column) -> Column:
    return F.split(text, BREAK)


def plain(piece: Column) -> Column:
    """What is compared of a sentence: lower case, blanks as one."""
    return F.trim(F.regexp_replace(F.lower(piece), r"\s+", " "))


def _key(text: str) -> Column:
    return F.xxhash64(F.col(text))


def repeated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", run: int = RUN, least_words: int = LEAST_WORDS) -> DataFrame:
    """Columns doc_id, key (a hash of the text), places: the pieces of the text (counted from 0) to remove.

    Every run of ``run`` consecutive sentences of ``least_words`` words or more in all is hashed (96 bits, from those of
    its sentences) and counted over all documents by partial sums. Of the places where a hash occurs, the first is that of the smallest doc_id
    (null last), then text hash, then place in the text. All sentences of every other place are to be removed.
    A text of fewer sentences has no runs. Rows equal in doc_id and text are one document.
    """
    rows = take(docs, doc_id=doc_id, text=text).where("text is not null").withColumn("key", _key("text"))
    said = F.filter(F.transform(pieces(F.col("text")), lambda p, i: F.struct(i.alias("i"), plain(p).alias("s"))), lambda x: x["s"] != "")
    # each sentence is hashed once; a run is known by the hashes of its sentences
    blanks = lambda s: F.length(s) - F.length(F.translate(s, " ", ""))
    hashed = F.transform(said, lambda x: F.struct(x["i"].alias("i"), F.xxhash64(x["s"]).alias("a"), F.hash(x["s"]).alias("b"), (blanks(x["s"]) + 1).alias("n")))
    rows = rows.select("doc_id", "key", hashed.alias("said"))
    of = lambda part, between=", ": between.join(f"get(said, k + {j}).{part}" for j in range(run))
    # no filter on the number of sentences: pushed down, it would split every text twice
    found = F.expr(f"""filter(
        transform(sequence(0, greatest(size(said) - {run}, 0)), k -> named_struct(
            'place', get(said, k).i, 'last', get(said, k + {run - 1}).i, 'h', xxhash64({of("a")}), 'h2', hash({of("b")}), 'n', {of("n", " + ")})),
        r -> r.last is not null and r.n >= {least_words})
    """)
    runs = saved(exploded(rows, found, "r").select("doc_id", "key", "r.place", "r.last", "r.h", "r.h2"), "runs")
    at = F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "key", "place")
    seen = runs.groupBy("h", "h2").agg(F.count("*").alias("n"), F.min(at).alias("first")).where("n > 1")
    later = joined(runs, seen, ["h", "h2"], "firsts").where(~F.col("first").eqNullSafe(at))
    return later.groupBy("doc_id", "key").agg(F.collect_set(F.struct("place", "last")).alias("ranges")).select(
        "doc_id", "key", F.expr("array_distinct(flatten(transform(ranges, r -> sequence(r.place, r.last))))").alias("places")
    )


def cut(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", run: int = RUN, least_words: int = LEAST_WORDS) -> DataFrame:
    """All columns of ``docs`` with the text without the repeated sentences, and n_sentences, n_removed.

    Blank pieces stay with the text; a text from which all is removed becomes empty; null texts stay null with no
    sentences. The two new names may clash with columns of ``docs``; they are the last ones.
    """
    gone = repeated(docs, doc_id, text, run, least_words).select(F.col("doc_id").alias("_id"), F.col("key").alias("_k"), "places")
    rows, at = flat(docs)
    t = at[text]
    rows = rows.withColumn("_h", _key(t))
    met = rows.join(gone, F.col(at[doc_id]).eqNullSafe(F.col("_id")) & (F.col("_h") == F.col("_k")), "left")
    met = met.withColumn("_p", pieces(F.col(t)))
    kept = F.expr(f"if(places is null, {t}, array_join(transform(array_except(sequence(0, size(_p) - 1), places), i -> _p[i]), ''))")
    # what is not blank has a letter or mark left when it is made plain
    spoken = lambda p: p.rlike(r"\S")
    whole = F.coalesce(F.size(F.filter("_p", spoken)), F.lit(0))
    gone_n = F.when(F.col("places").isNull(), 0).otherwise(F.size(F.filter("places", lambda i: spoken(F.get("_p", i)))))
    cols = [kept if c == t else F.col(c) for c in rows.columns if c != "_h"]
    return met.select(*cols, F.when(F.col(t).isNull(), 0).otherwise(whole).cast("long"), gone_n.cast("long")).toDF(*docs.columns, "n_sentences", "n_removed")


def _hashes(text: Column) -> Column:
    """For each sentence, a hash of each word in lower case without blanks; 0 where nothing is left."""
    bare = lambda w: F.rtrim(w, F.lit(BLANKS))  # noqa: E731  a word has blanks after it only, or is nothing else
    word = lambda w: F.when(bare(w) == "", F.lit(0).cast("long")).otherwise(F.xxhash64(bare(w)))
    return F.transform(pieces(F.lower(text)), lambda p: F.transform(F.split(p, WORD), word))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    base = 0x9E3779B97F4A7C15
    of = lambda b: np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(n, b, np.uint64)]))
    with np.errstate(over="ignore"):
        return of(base), of(pow(base, -1, 1 << 64))


def runs(h: np.ndarray, of: np.ndarray, run: int = RUN, least_words: int = LEAST_WORDS, powers: tuple | None = None) -> tuple[np.ndarray, ...]:
    """Runs of sentences and passages of one text: first word, word after the last, and 64 and 32 bits of hash.

    h: the words' hashes, 0 for blanks; of: the sentence of each.
    """
    at = np.flatnonzero(h)
    n = len(at)
    up, down = _powers(n) if powers is None else powers
    with np.errstate(over="ignore"):
        x = mix(h[at] + GOLDEN)
        sums = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(y * up[:n])]) for y in (x, mix(x))]
        begin = np.flatnonzero(np.diff(of[at], prepend=-1))
        end = np.append(begin[1:], n)[: len(begin)]
        a, b, salt = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
        if len(begin) >= run:
            a, b = begin[: len(begin) - run + 1], end[run - 1 :]
            salt = np.ones(len(a), np.uint64)
            for k in range(run):  # where sentences end is part of a run
                salt = mix(salt * GOLDEN + (end - begin)[k : k + len(a)].astype(np.uint64))
            long = b - a >= least_words
            a, b, salt = a[long], b[long], salt[long]
        if n > NEAR:
            near = np.lib.stride_tricks.sliding_window_view(mix(x[:-1] * GOLDEN + x[1:]), NEAR)
            cuts = np.unique(np.arange(len(near)) + NEAR - 1 - np.argmin(near[:, ::-1], axis=1))
            to = np.searchsorted(cuts, cuts + PASSAGE)
            whole = to < len(cuts)
            a, b = np.concatenate([a, cuts[whole]]), np.concatenate([b, cuts[to[whole]]])
            salt = np.concatenate([salt, np.zeros(int(whole.sum()), np.uint64)])
        one, two = (mix((s[b] - s[a]) * down[a] + salt) for s in sums)
    return at[a].astype(np.int32), (at[b - 1] + 1).astype(np.int32), one.view(np.int64), (two >> np.uint64(32)).astype(np.uint32).view(np.int32)


def _found(run: int, least_words: int):
    """Batches of doc_id, key and hashes (for each sentence, of each word) to the runs of each text."""

    def work(batches):
        for batch in batches:
            column = batch.column("hashes")
            ends = column.offsets.to_numpy().astype(np.int64)
            words, at = lists(column.values.slice(ends[0], ends[-1] - ends[0]))
            ends = ends - ends[0]
            words = words.astype(np.int64, copy=False).view(np.uint64)
            of = np.repeat(np.arange(len(at) - 1), np.diff(at))
            texts = at[ends]
            powers = _powers(int(np.diff(texts).max(initial=0)))
            for begin, end in spans(texts, STEP):
                got = [runs(words[i:j], of[i:j], run, least_words, powers) for i, j in zip(texts[begin:end], texts[begin + 1 : end + 1])]
                whose = pa.array(np.repeat(np.arange(begin, end), [len(g[0]) for g in got]))
                columns = [pa.array(np.concatenate([g[k] for g in got])) for k in range(4)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(whose), batch.column("key").take(whose), *columns], ["doc_id", "key", "a", "b", "h", "h2"])
        give_back()

    return work


def repeated_words(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", run: int = RUN, least_words: int = LEAST_WORDS) -> DataFrame:
    """Columns doc_id, key (a hash of the text), ranges: first and last words (counted from 0) of what to remove.

    The runs of sentences of ``repeated``, and every passage; the first place of each stays, as there. The hashes are counted
    alone at first, and only runs whose hash is marked as repeated are compared in all 96 bits.
    """
    tune(docs.sparkSession)
    rows = take(docs, doc_id=doc_id, text=text).where("text is not null").withColumn("key", _key("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    hashed = rows.select("doc_id", "key", _hashes(F.col("text")).alias("hashes"))
    found = saved(hashed.mapInArrow(_found(run, least_words), f"doc_id {kind}, key long, a int, b int, h long, h2 int"), "runs")
    bucket, bit = F.expr(f"shiftright(h & {2**MARKS - 1}L, 15)"), F.expr("h & 32767L")
    marks = found.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select(bucket.alias("bucket"), bit.alias("bit"))
    marks = marks.repartition("bucket").groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("marks"))
    found = found.withColumn("bucket", bucket).join(F.broadcast(marks), "bucket")
    found = found.where("shiftright(cast(conv(hex(substring(marks, cast((h & 32767L) div 8 as int) + 1, 1)), 16, 10) as int), cast(h & 7L as int)) & 1 = 1")
    found = saved(found.select("doc_id", "key", "a", "b", "h", "h2"), "marked")
    at = F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "key", "a")
    seen = found.groupBy("h", "h2").agg(F.count("*").alias("n"), F.min(at).alias("first")).where("n > 1")
    later = joined(found, seen, ["h", "h2"], "firsts").where(~F.col("first").eqNullSafe(at))
    return later.groupBy("doc_id", "key").agg(F.collect_set(F.struct("a", (F.col("b") - 1).alias("b"))).alias("ranges"))


def cut_words(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", run: int = RUN, least_words: int = LEAST_WORDS) -> DataFrame:
    """``docs`` with the text without the words of repeated runs of sentences and of repeated passages.

    A passage goes from its first word to its last, though its sentences begin before it or end after it.
    """
    gone = repeated_words(docs, doc_id, text, run, least_words).select(F.col("doc_id").alias("_id"), F.col("key").alias("_k"), "ranges")
    rows, at = flat(docs)
    t = at[text]
    met = rows.withColumn("_h", _key(t)).join(gone, F.col(at[doc_id]).eqNullSafe(F.col("_id")) & (F.col("_h") == F.col("_k")), "left")

    @F.arrow_udf("string")
    def left(words: pa.Array, ranges: pa.Array) -> pa.Array:
        out = []
        for w, spans in zip(words.to_pylist(), ranges.to_pylist()):
            if w is None:
                out.append(None)
                continue
            stays = np.ones(len(w), bool)
            for r in spans:
                stays[r["a"] : r["b"] + 1] = False
            out.append("".join(x for x, s in zip(w, stays) if s))
        return pa.array(out, pa.string())

    split = F.when(F.col("ranges").isNotNull(), F.flatten(F.transform(pieces(F.col(t)), lambda p: F.split(p, WORD))))
    kept = F.when(F.col("ranges").isNull(), F.col(t)).otherwise(left(split, F.col("ranges")))
    return met.select(*[kept if c == t else F.col(c) for c in rows.columns]).toDF(*docs.columns)
