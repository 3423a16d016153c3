"""Notices in the middle of long texts, at the least containment that counts."""

import random

import pytest

from millrace.llm import licenses


@pytest.mark.parametrize("apart", [False, True])
def test_templates_at_least_containment(spark, apart):
    rng = random.Random(3)
    other = lambda: [f"w{rng.randrange(10**6)}" for _ in range(rng.randrange(60, 120))]
    rows = []
    for name, t in licenses.TEMPLATES.items():
        words = t.split()
        # the last words go as long as four fifths of the shingles stay
        shingles = lambda w: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}
        plain = "".join(c if c.isalnum() else " " for c in t.lower()).split()
        short = plain if len(shingles(plain)) > 1 else words
        while len(short) > 5 and len(shingles(plain) & shingles(short[:-1])) >= 0.8 * len(shingles(plain)):
            short = short[:-1]
        if apart and len(shingles(plain)) > 4 * 5:  # in two halves, far from each other, of which the second repeats four words
            half = len(plain) // 2
            rows += [(f"{name}/{k}", name, " ".join([*other(), *plain[: half + 4], *other(), *plain[half:], *other()])) for k in range(20)]
        elif not apart:
            rows += [(f"{name}/{k}", name, " ".join([*other(), *short, *other()])) for k in range(200)]
    frame = spark.createDataFrame(rows, "doc_id string, name string, text string")
    missed = [r["doc_id"] for r in licenses.licenses(frame).collect() if r["name"] not in [m["license"] for m in r["_licenses"]]]
    assert missed == []
