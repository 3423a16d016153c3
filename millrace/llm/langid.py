"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import take, tune

UNKNOWN = "und"
GRAMS = (1, 2, 3)
BUCKETS = 1 << 15
#: Characters that one numpy step handles: its arrays stay near 1 MB.
PIECE = 1 << 17
BLOCK = 64
SMOOTHING = 0.25
KIND = "best string, top double, rest double, letters boolean"

_letters: np.ndarray | None = None


def _letter_table() -> np.ndarray:
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _letters


def _pieces(texts, most: int = PIECE):
    """Groups of (row, codes, starts) of about ``most`` characters: grams count where they start below ``starts``.

    A text is lower-cased, everything but letters becomes a blank, and a blank stands at both ends; a longer text is
    cut into pieces that share their last characters, so that each gram counts once.
    """
    table, group, held = _letter_table(), [], 0
    for row, text in enumerate(texts):
        if not text:
            continue
        codes = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
        codes = np.where(table[codes], codes, np.uint32(32))
        for at in range(0, len(codes), most):
            part = codes[at : at + most + max(GRAMS) - 1]
            group.append((row, part, min(most, len(codes) - at)))
            held += len(part)
            if held >= most:
                yield group
                group, held = [], 0
    if group:
        yield group


def grams(group) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all n-grams of a group, the index into the group of each, and which pieces have a letter.

    Grams are in the order of their sizes; within a size, pieces stand one after another.
    """
    n = np.array([len(c) for _, c, _ in group])
    codes = np.concatenate([c for _, c, _ in group])
    piece = np.repeat(np.arange(len(group)), n)
    left = np.repeat(np.cumsum(n), n) - np.arange(len(codes))
    early = np.arange(len(codes)) - np.repeat(np.cumsum(n) - n, n) < np.array([s for _, _, s in group])[piece]
    letter = np.bincount(piece, codes != 32, len(group)) > 0
    out, owner = [], []
    with np.errstate(over="ignore"):
        h = np.zeros(len(codes), np.uint32)
        for size in range(1, max(GRAMS) + 1):
            moved = codes[size - 1 :]
            h = h[: len(moved)] * np.uint32(0x01000193) + moved
            if size in GRAMS:
                good = early[: len(moved)] & (left[: len(moved)] >= size)
                x = h[good] * np.uint32(0x9E3779B1) + np.uint32(size * 0x85EBCA6B & 0xFFFFFFFF)
                x ^= x >> np.uint32(15)
                x *= np.uint32(0x2C1B3C6D)
                x ^= x >> np.uint32(13)
                out.append(x & np.uint32(BUCKETS - 1))
                owner.append(piece[: len(moved)][good])
    return np.concatenate(out), np.concatenate(owner), letter


@dataclass
class Model:
    """Log-probabilities: languages in order, priors, and one (BUCKETS, languages) matrix for each block of languages."""

    langs: list[str]
    prior: np.ndarray
    blocks: list[np.ndarray] = field(repr=False)


def _count(batches):
    sums: dict[str, np.ndarray] = {}
    docs: dict[str, int] = {}
    for batch in batches:
        langs = batch["lang"].tolist()
        seen = np.zeros(len(langs), bool)
        for group in _pieces(batch["text"]):
            bucket, owner, letter = grams(group)
            rows = np.array([r for r, _, _ in group])
            seen[rows[letter]] = True
            names = sorted({langs[r] for r in rows})
            code = np.array([names.index(langs[r]) for r in rows])[owner]
            total = np.bincount(code * BUCKETS + bucket, minlength=len(names) * BUCKETS).reshape(len(names), BUCKETS)
            for i, name in enumerate(names):
                sums[name] = sums[name] + total[i] if name in sums else total[i]
        for i in np.flatnonzero(seen):
            docs[langs[i]] = docs.get(langs[i], 0) + 1
    for name, total in sums.items():
        if name in docs:
            at = np.flatnonzero(total)
            yield pd.DataFrame({"lang": name, "bucket": np.append(at, -1).astype(np.int32), "n": np.append(total[at], docs[name])})


def train(docs: DataFrame, text: str = "text", lang: str = "lang") -> Model:
    """Count n-grams of every row with a text and a language; all rows count.

    Each task sums its rows before the shuffle. The driver receives languages x 32768 sums, in blocks of 64 languages
    (at most 8 MB of log-probabilities each). Rows without a letter teach nothing; no rows at all give a model without
    languages.
    """
    tune(docs.sparkSession)
    rows = take(docs, text=text, lang=lang).where("text is not null and lang is not null")
    sums = rows.mapInPandas(_count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    from .common import saved

    sums = saved(sums, "grams")
    docs_of = {r["lang"]: r["n"] for r in sums.where("bucket = -1").select("lang", "n").toLocalIterator()}
    langs = sorted(docs_of)
    blocks = []
    for at in range(0, len(langs), BLOCK):
        block = langs[at : at + BLOCK]
        part = sums.where(F.col("lang").isin(block) & (F.col("bucket") >= 0)).toPandas()
        n = np.full((BUCKETS, len(block)), SMOOTHING)
        n[part["bucket"].to_numpy(int), part["lang"].map(block.index).to_numpy(int)] += part["n"].to_numpy(float)
        blocks.append(np.log(n / n.sum(axis=0)).astype(np.float32))
    prior = np.log(np.array([docs_of[x] for x in langs], float) / max(1, sum(docs_of.values())))
    return Model(langs, prior, blocks)


def score_texts(texts, matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log-likelihoods (texts x languages), and which texts have a letter."""
    n, langs = len(texts), matrix.shape[1]
    total, letters = np.zeros((n, langs)), np.zeros(n, bool)
    for group in _pieces(texts, max(4096, 4 * PIECE // max(4, langs))):
        bucket, owner, letter = grams(group)
        rows = np.array([r for r, _, _ in group])
        letters[rows[letter]] = True
        # rows of the matrix for the grams that occur, summed by piece: grams stand by size, then by piece
        cut = np.flatnonzero(np.diff(owner, prepend=-1))
        np.add.at(total, rows[owner[cut]], np.add.reduceat(matrix[bucket], cut, axis=0, dtype=np.float64))
    return total, letters


def _step(sent, langs: list[str], prior: np.ndarray):
    """Score one block of languages against what the blocks before have found."""

    @F.pandas_udf(KIND)
    def step(texts: pd.Series, was: pd.DataFrame) -> pd.DataFrame:
        ll, letters = score_texts(texts.tolist(), sent.value)
        ll = ll + prior
        at = ll.argmax(axis=1)
        top = ll[np.arange(len(ll)), at]
        rest = np.exp(ll - top[:, None]).sum(axis=1)
        old, old_rest = was["top"].to_numpy(float), was["rest"].to_numpy(float)
        none = np.isnan(old)
        new = np.where(none, top, np.fmax(top, old))
        gap = np.where(none, 0.0, np.exp(np.nan_to_num(old) - np.where(none, 0, new)) * np.nan_to_num(old_rest))
        best = np.where(none | (top > old), np.array(langs, object)[at], was["best"].to_numpy(object))
        return pd.DataFrame({"best": best, "top": new, "rest": np.exp(top - new) * rest + gap, "letters": letters})

    return step


def predict(spark: SparkSession, docs: DataFrame, model: Model, text: str, prefix: str = "_") -> DataFrame:
    """All columns of ``docs`` and ``{prefix}lang``, ``{prefix}score``: the likeliest language and its posterior.

    A null text, an empty one or one without a letter gets ``und`` and 0, as does every text when the model knows no
    language. Equal posteriors go to the first language in order. Blocks of languages are scored one after another;
    each broadcast holds at most 64 x 32768 floats.
    """
    tune(spark)
    state = F.struct(F.lit(None).cast("string").alias("best"), F.lit(None).cast("double").alias("top"), F.lit(None).cast("double").alias("rest"), F.lit(False).alias("letters"))
    out = docs.withColumn(f"{prefix}state", state)
    for i, matrix in enumerate(model.blocks):
        langs, prior = model.langs[i * BLOCK : i * BLOCK + BLOCK], model.prior[i * BLOCK : i * BLOCK + BLOCK]
        sent = spark.sparkContext.broadcast(matrix)

        step = _step(sent, langs, prior)
        out = out.withColumn(f"{prefix}state", step(F.col(text), F.col(f"{prefix}state")))
    s = F.col(f"{prefix}state")
    known = s["letters"] & s["best"].isNotNull()
    out = out.withColumn(f"{prefix}lang", F.when(known, s["best"]).otherwise(UNKNOWN))
    out = out.withColumn(f"{prefix}score", F.when(known, F.least(F.lit(1.0), 1.0 / s["rest"])).otherwise(0.0))
    return out.drop(f"{prefix}state")


