"""Repeated passages that hold no run of three whole sentences."""

import random

import pytest

import corpus_pipeline
from millrace.llm import sentences

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in enumerate(texts)], SCHEMA)


def cut(spark, texts):
    return {r.doc_id: r.text for r in corpus_pipeline.substring_dedup(spark, frame(spark, texts), "").collect()}


def prose(rng, n):
    return [f"w{rng.randrange(10**6)}" for _ in range(n)]


@pytest.mark.parametrize("size", [50, 60])
@pytest.mark.parametrize("stops", [(), (25,), (3, 40)])
def test_planted_passages_go(spark, size, stops):
    rng = random.Random(size)
    texts, own = [], []
    for _ in range(20):
        passage = prose(rng, size)
        for k in stops:
            passage[k] += "."
        for _ in range(2):  # in the middle of sentences of different lengths
            before, after = prose(rng, rng.randrange(30, 90)), prose(rng, rng.randrange(30, 90))
            own.append((before, passage, after))
            texts.append(" ".join(before + passage + after) + ".")
    got = cut(spark, texts)
    for i, (before, passage, after) in enumerate(own):
        words = got[i].removesuffix(".").split()
        if i % 2 == 0:
            assert got[i] == texts[i]
            continue
        assert words[: len(before)] == before and words[-len(after) :] == after
        assert len(words) - len(before) - len(after) <= 5 * sentences.NEAR - 3
        assert size - len(words) + len(before) + len(after) >= sentences.PASSAGE


def test_runs_of_sentences_still_go(spark):
    """Where no passage is repeated, what goes is what runs of sentences take."""
    rng = random.Random(2)
    same = "One two three four. Five six seven. Eight nine ten."
    texts = [" ".join(prose(rng, 9)) + f". {same} " + " ".join(prose(rng, 9)) + "." for _ in range(3)] + [None, "", " \n\n ", "a.\n\n b"]
    want = {r.doc_id: r.text for r in sentences.cut(frame(spark, texts)).collect()}
    assert cut(spark, texts) == want and want[1] != texts[1]
