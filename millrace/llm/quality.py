"""Quality scores from a sparse rule ensemble."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import take

#: Labelled rows that a model is fitted on, those of the smallest hash of doc_id: a documented bound.
SAMPLE = 20_000
TREES, DEPTH, RATE, LEAST = 40, 3, 0.3, 8
PENALTY = 0.0005
THRESHOLD = 0.3


def statistics(text: Column) -> dict[str, Column]:
    """Numbers about a text, all from built-in functions; those of an empty or null text are 0."""
    t = F.coalesce(text, F.lit(""))
    n = F.greatest(F.length(t), F.lit(1)).cast("double")
    count = lambda chars: (F.length(t) - F.length(F.translate(t, chars, ""))).cast("double")
    tokens = F.filter(F.split(t, r"\s+"), lambda w: w != "")
    lines = F.filter(F.split(t, "\n"), lambda x: x != "")
    words = F.greatest(F.size(tokens), F.lit(1)).cast("double")
    return {
        "chars": F.length(t).cast("double"),
        "words": F.size(tokens).cast("double"),
        "word_length": n / words,
        "distinct_words": F.size(F.array_distinct(tokens)) / words,
        "upper": count("ABCDEFGHIJKLMNOPQRSTUVWXYZ") / n,
        "digits": count("0123456789") / n,
        "stops": count(".,;:?'\"-()") / words,
        "marks": count("!#$%&*+/<=>@[\\]^_`{|}~") / words,
        "bars": count("|") / words,
        "line_length": n / F.greatest(F.size(lines), F.lit(1)),
        "distinct_lines": F.size(F.array_distinct(lines)) / F.greatest(F.size(lines), F.lit(1)),
    }


@dataclass(frozen=True)
class Rule:
    """A conjunction: (statistic, is it above, threshold) each, and the weight in the sum."""

    parts: tuple[tuple[str, bool, float], ...]
    weight: float


@dataclass(frozen=True)
class Model:
    bias: float
    rules: tuple[Rule, ...]

    def column(self, stats: dict[str, Column]) -> Column:
        """The probability of label 1, as one expression over columns of statistics."""
        total = F.lit(self.bias)
        for rule in self.rules:
            holds = F.lit(True)
            for name, above, cut in rule.parts:
                holds = holds & ((stats[name] > cut) if above else (stats[name] <= cut))
            total = total + F.when(holds, rule.weight).otherwise(0.0)
        return 1.0 / (1.0 + F.exp(-total))


def _tree(x: np.ndarray, bins: np.ndarray, cuts: list[np.ndarray], grad: np.ndarray, hess: np.ndarray, depth: int, at: np.ndarray, path: tuple, paths: list, out: np.ndarray) -> None:
    """Grow one node by the best gain of a second-order step; record each node's path; leaves write their step."""
    best = (1e-6, -1, -1)
    g, h = grad[at].sum(), hess[at].sum()
    if depth and len(at) >= 2 * LEAST:
        for f in range(x.shape[1]):
            b = bins[at, f]
            sg = np.cumsum(np.bincount(b, grad[at], len(cuts[f]) + 1))[:-1]
            sh = np.cumsum(np.bincount(b, hess[at], len(cuts[f]) + 1))[:-1]
            n = np.cumsum(np.bincount(b, minlength=len(cuts[f]) + 1))[:-1]
            gain = sg**2 / (sh + 1) + (g - sg) ** 2 / (h - sh + 1) - g**2 / (h + 1)
            gain[(n < LEAST) | (len(at) - n < LEAST)] = -1
            if len(gain) and gain.max() > best[0]:
                best = (float(gain.max()), f, int(gain.argmax()))
    if best[1] < 0:
        out[at] = -g / (h + 1)
        return
    _, f, k = best
    left = bins[at, f] <= k
    for side, above in ((at[left], False), (at[~left], True)):
        longer = (*path, (f, above, float(cuts[f][k])))
        paths.append(longer)
        _tree(x, bins, cuts, grad, hess, depth - 1, side, longer, paths, out)


def fit_rules(names: list[str], x: np.ndarray, y: np.ndarray) -> Model:
    """Boosted trees, their paths as rules, and logistic weights under an L1 penalty (accelerated proximal steps).

    One class only, or no rows, gives a model without rules: the smoothed share of label 1.
    """
    share = (y.sum() + 0.5) / (len(y) + 1)
    bias = float(np.log(share / (1 - share)))
    if len(y) < 2 * LEAST or y.min() == y.max():
        return Model(bias, ())
    cuts = []
    for f in range(x.shape[1]):
        v = np.unique(x[:, f])
        mid = (v[1:] + v[:-1]) / 2
        cuts.append(np.unique(mid[np.linspace(0, len(mid) - 1, min(64, len(mid))).astype(int)]) if len(mid) else np.empty(0))
    bins = np.stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(cuts)], axis=1)
    paths: list[tuple] = []
    score = np.full(len(y), bias)
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-score))
        step = np.zeros(len(y))
        _tree(x, bins, cuts, p - y, p * (1 - p), DEPTH, np.arange(len(y)), (), paths, step)
        score += RATE * step
    made: dict[bytes, tuple] = {}
    columns = []
    for path in paths:
        tight: dict[tuple[int, bool], float] = {}
        for f, above, cut in path:
            tight[f, above] = cut if (f, above) not in tight else (max if above else min)(cut, tight[f, above])
        on = np.ones(len(y), bool)
        for (f, above), cut in tight.items():
            on &= (x[:, f] > cut) if above else (x[:, f] <= cut)
        if 0 < on.sum() < len(y) and (key := np.packbits(on).tobytes()) not in made:
            made[key] = tuple((names[f], above, cut) for (f, above), cut in tight.items())
            columns.append(on)
    if not columns:
        return Model(bias, ())
    r = np.stack(columns, axis=1).astype(np.float64)
    scale = np.maximum(r.std(axis=0), 0.02)
    z = r / scale
    w, v, b, vb, t = np.zeros(z.shape[1]), np.zeros(z.shape[1]), bias, bias, 1.0
    rate = 4 * len(y) / (np.linalg.norm(z, 2) ** 2 + len(y))
    for _ in range(800):
        e = (1 / (1 + np.exp(-(z @ v + vb))) - y) / len(y)
        new = v - rate * (z.T @ e)
        new = np.sign(new) * np.maximum(np.abs(new) - rate * PENALTY, 0)
        nb = vb - rate * e.sum()
        nt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, vb = new + (t - 1) / nt * (new - w), nb + (t - 1) / nt * (nb - b)
        w, b, t = new, nb, nt
    rules = tuple(Rule(parts, float(weight)) for parts, weight in zip(made.values(), w / scale) if abs(weight) > 1e-9)
    return Model(float(b), rules)


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", sample: int = SAMPLE) -> Model:
    """Fit on labelled rows, at most ``sample`` of them (by hash of doc_id, so that the choice repeats).

    The chosen labels, ``sample`` rows of an id and a label, go to all tasks, so that no text is shuffled. Only the
    statistics reach the driver, at most ``sample`` rows of them: where documents share an id, those of the smallest
    ids and statistics. Rows with a null id, text or label teach nothing.
    """
    known = take(labels, _id=doc_id, y=label).where("_id is not null and y is not null")
    known = known.orderBy(F.xxhash64("_id"), "_id", "y").limit(sample)
    stats = statistics(F.col("text"))
    rows = take(docs, _id=doc_id, text=text).where("text is not null").join(F.broadcast(known), "_id").select("_id", "y", *[c.alias(n) for n, c in stats.items()])
    rows = rows.orderBy(*rows.columns).limit(sample).toPandas()
    return fit_rules(list(stats), rows[list(stats)].to_numpy(float), rows["y"].to_numpy(float))


def scored(docs: DataFrame, model: Model, text: str, prefix: str = "_") -> DataFrame:
    """All columns of ``docs`` and ``{prefix}score``: the probability of label 1, for empty and null texts too."""
    stats = statistics(F.col(text))
    rows = docs.withColumn(f"{prefix}stats", F.struct(*[c.alias(n) for n, c in stats.items()]))
    return rows.withColumn(f"{prefix}score", model.column({n: F.col(f"{prefix}stats.{n}") for n in stats})).drop(f"{prefix}stats")
