"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing names, for each operator and stage."""

import random

import pytest

import corpus_pipeline
from millrace.llm import bpe, decontaminate, langid, licenses, neardup, quality, queries, sentences, shards, suffixes, vectors
from millrace.llm.common import take

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, TEXT string, score double, _key long, shard int, places string, ids string"
RNG = random.Random(4)
LONG = " ".join(RNG.choice(["alpha", "beta", "gamma", "delta", "eps"]) + str(i % 977) + "." * (i % 9 == 8) for i in range(60_000))
TEXTS = [None, "", "   ", "12 34 !!", "One.", "a b c d", "Some plain words. That go on here. And end with a stop now.", LONG]


def table(spark, rows):
    return spark.createDataFrame([(i, t, lang, "s", None if t is None else len(t), "x", 0.5, 1, 2, "p", "q") for i, t, lang in rows], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en" if i % 2 else None) for i, t in enumerate(TEXTS)]
    rows += [(None, TEXTS[6], "en"), (3, "again " * 30, "xx"), (3, "again " * 30, "xx"), (None, None, None), (90, LONG, "en")]
    return table(spark, rows).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return table(spark, [])


def test_language_id(spark, docs, empty):
    model = langid.train(docs)
    out = langid.predict(spark, take(docs, doc_id="doc_id", text="text"), model, "text").collect()
    assert len(out) == docs.count()
    for r in out:
        known = r["text"] is not None and any(c.isalpha() for c in r["text"])
        assert (r["_lang"] in model.langs) == known and (r["_lang"] == "und") == (not known) and 0 <= r["_score"] <= 1
    nothing = langid.train(empty)
    assert nothing.langs == []
    assert {r["_lang"] for r in langid.predict(spark, take(docs, text="text"), nothing, "text").collect()} == {"und"}
    assert langid.predict(spark, take(empty, text="text"), model, "text").count() == 0


def test_decontamination(spark, docs, empty):
    bench = spark.createDataFrame([(1, TEXTS[6]), (1, TEXTS[6]), (2, None), (3, ""), (None, "One"), (4, "zzz yyy xxx www")], "item_id long, text string")
    found = {(r["doc_id"], m["item_id"], m["distance"]) for r in decontaminate.matches(take(docs, doc_id="doc_id", text="text"), bench).collect() for m in r["_matches"]}
    assert found == {(6, 1, 0), (None, 1, 0)}
    kept = decontaminate.decontaminate(docs, bench)
    assert kept.columns == docs.columns and kept.count() == docs.count() - 2
    assert decontaminate.decontaminate(docs, bench.where("false")).count() == docs.count()
    assert decontaminate.decontaminate(empty, bench).count() == 0


def test_licenses(spark, docs, empty):
    assert licenses.licenses(docs).columns[-1] == "_licenses"
    assert licenses.licenses(docs).where("size(_licenses) > 0").count() == 0
    assert licenses.licenses(empty).count() == 0
    one = table(spark, [(1, "x\nReleased under the MIT License.\ny", None), (2, "the MIT License", None)])
    assert [[m["license"] for m in r["_licenses"]] for r in licenses.licenses(one).collect()] == [["MIT"], []]


def test_near_duplicates(spark, docs, empty):
    out = neardup.near_duplicates(docs)
    rows = out.collect()
    assert len(rows) == docs.count()
    by = {(r["doc_id"], None if r["th"] is None else bytes(r["th"])): r for r in rows}
    assert {r["class_id"] for r in rows if r["doc_id"] == 90} == {7}
    assert sum(r["kept"] for r in rows if r["doc_id"] == 3 and r["class_id"] == 3) >= 1
    assert by[None, None]["class_id"] is None and by[None, None]["kept"]
    kept = neardup.deduplicate(docs)
    assert kept.columns == docs.columns
    ids = sorted((r["doc_id"] is None, r["doc_id"] or 0, r[1] or "") for r in kept.collect())
    assert [i for n, i, _ in ids if not n] == [0, 1, 2, 3, 3, 4, 5, 6, 7]
    assert [t for n, _, t in ids if n] == [""]
    assert neardup.near_duplicates(empty).count() == 0 and neardup.deduplicate(empty).count() == 0


def test_sentences(spark, docs, empty):
    out = sentences.cut(docs)
    assert out.columns == [*docs.columns, "n_sentences", "n_removed"]
    rows = {(r[0], r[-1]): r for r in out.collect()}
    assert len(out.collect()) == docs.count()
    gone = [r for r in out.collect() if r[0] is None and r[1] is not None]
    assert gone[0][1] == "" and gone[0][-1] == 3  # the copy with a null id comes last
    assert rows[6, 0][1] == TEXTS[6] and rows[7, 0][1] == LONG
    assert [r[1] for r in out.collect() if r[0] == 90] == [""]
    assert sentences.cut(empty).count() == 0


def test_suffixes(spark, docs, empty):
    rows = suffixes.cut(docs).collect()
    assert len(rows) == docs.count()
    n = len(LONG.encode())
    assert {(r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in rows if r["doc_id"] in (7, 90)} == {(n, 1, b"")}
    first = {r["doc_id"]: r["n_removed"] for r in suffixes.cut(docs, keep="first").collect() if r["doc_id"] in (7, 90)}
    assert first[90] == n and first[7] == 0
    assert suffixes.cut(empty).count() == 0


def test_quality(spark, docs, empty):
    labels = spark.createDataFrame([(i, i % 2, None) for i in range(9)] + [(None, 1, 1), (2, None, 0)], "doc_id long, quality int, toxic int")
    model = quality.train(docs, labels)
    rows = quality.scored(take(docs, text="text"), model, "text").collect()
    assert len(rows) == docs.count() and all(0 <= r["_score"] <= 1 for r in rows)
    assert quality.train(empty, labels).rules == ()
    assert quality.scored(take(empty, text="text"), model, "text").count() == 0


def test_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, [1.0, 0.01], 1), (4, [1.0, 0.0], 2), (5, [1.0, 0.0], None), (6, None, 1), (7, [], 1), (8, [0.0, 0.0], 1), (9, [1.0, None], 1), (10, [nan, 1.0], 1), (11, [inf, 1.0], 1), (12, [1.0], 1), (13, [0.0, 1.0], 1), (13, [0.0, 1.0], 1), (None, [1.0, 0.0], 1), (14, [-0.0, 1.0], 1)]
    frame = spark.createDataFrame([(*r, "k", 3) for r in rows], "vec_id long, embedding array<float>, label int, key string, part int")
    out = vectors.near_vectors(frame)
    got = sorted(((r["vec_id"] or 0, r["n_links"], r["component_id"], r["kept"]) for r in out.collect()), key=str)
    assert (1, 2, 1, True) in got and (2, 2, 1, False) in got and (3, 2, 1, False) in got and (14, 2, 13, False) in got
    assert got.count((13, 2, 13, True)) == 2
    assert all((i, 0, i, True) in got for i in (4, 5, 6, 7, 8, 9, 10, 11, 12)) and (0, 0, None, True) in got
    assert vectors.near_vectors(frame.where("false")).count() == 0


def test_bpe(spark, docs, empty):
    words = queries.vocabulary()
    out = bpe.decode(bpe.encode(docs, "text", "doc_id", words), "ids", words)
    got = sorted((r["_key"] is None, r["_key"] or 0, bytes(r["_bytes"]).decode()) for r in out.collect())
    want = sorted((r[0] is None, r[0] or 0, r[1] or "") for r in docs.collect())
    assert got == want
    assert bpe.encode(empty, "text", "doc_id", words).count() == 0
    assert bpe.decode(spark.createDataFrame([(None,), ([],)], "ids array<int>"), "ids", words).select("_bytes").collect()[0][0] is None


def test_shards(spark, docs, empty):
    out = shards.shard(docs)
    assert out.columns == [*docs.columns, "size", "shard", "slot"]
    rows = out.collect()
    assert len(rows) == docs.count()
    for s in {r[-2] for r in rows}:
        assert sorted(r[-1] for r in rows if r[-2] == s) == list(range(sum(r[-2] == s for r in rows)))
    assert shards.shard(empty).count() == 0


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages(spark, tmp_path, docs, empty, name, stage):
    spark.createDataFrame([(1, "no such words in any text at all")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    out = stage(spark, docs, str(tmp_path))
    assert name == "byte_bpe" or out.columns == docs.columns
    out.collect()
    assert stage(spark, empty, str(tmp_path)).count() == 0


def test_pipeline_of_nulls(spark, tmp_path):
    docs = spark.createDataFrame([(None, None, None, None, None)] * 3, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(None, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
