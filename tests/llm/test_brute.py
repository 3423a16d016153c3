"""Results that are told apart by plain versions: languages, rules, shards, packed numbers, and links in large buckets."""

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from millrace.llm import bpe, common, components, decontaminate, langid, neardup, quality, queries, shards, vectors
from millrace.llm.common import table

SF = "/root/testdata/sf0.001"


def test_language_is_plain_naive_bayes(spark):
    docs = table(spark, SF, "documents").toPandas()
    learnt = docs[np.array([zlib.crc32(str(i).encode()) % 4 != 2 for i in docs.doc_id]) & docs.lang.notna() & docs.text.notna()]

    def buckets(text):
        codes = [ord(c) if c.isalpha() else 32 for c in f" {text.lower()} "]
        out = Counter()
        for n in langid.GRAMS:
            for k in range(len(codes) - n + 1):
                h = 0
                for c in codes[k : k + n]:
                    h = (h * 0x01000193 + c) & 0xFFFFFFFF
                x = (h * 0x9E3779B1 + (n * 0x85EBCA6B)) & 0xFFFFFFFF
                x = ((x ^ (x >> 15)) * 0x2C1B3C6D) & 0xFFFFFFFF
                out[(x ^ (x >> 13)) & (langid.BUCKETS - 1)] += 1
        return out

    counts, seen = {}, Counter()
    for lang, text in zip(learnt.lang, learnt.text):
        if any(c.isalpha() for c in text):
            counts.setdefault(lang, Counter()).update(buckets(text))
            seen[lang] += 1
    langs = sorted(seen)
    prior = {x: np.log(seen[x] / sum(seen.values())) for x in langs}
    total = {x: sum(counts[x].values()) + langid.SMOOTHING * langid.BUCKETS for x in langs}
    got = queries.op1_language_id(spark, SF).toPandas().set_index("doc_id")
    for i, text in list(zip(docs.doc_id, docs.text))[:60]:
        if not text or not any(c.isalpha() for c in text):
            assert (got.lang_pred[i], got.score[i]) == ("und", 0.0)
            continue
        mine = buckets(text)
        ll = np.array([prior[x] + sum(n * np.log((counts[x][b] + langid.SMOOTHING) / total[x]) for b, n in mine.items()) for x in langs])
        assert got.lang_pred[i] == langs[ll.argmax()]
        assert abs(got.score[i] - 1 / np.exp(ll - ll.max()).sum()) < 1e-2
        assert got.held_out[i] == (zlib.crc32(str(i).encode()) % 4 == 2)


def test_many_languages_are_scored_in_blocks(spark, monkeypatch):
    rows = [(k, f"{chr(97 + k % 26) * 3}{chr(97 + k // 26) * 4} " * 5, f"l{k:02d}") for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    whole = langid.predict(spark, docs, langid.train(docs), "text").orderBy("doc_id").toPandas()
    monkeypatch.setattr(langid, "BLOCK", 7)
    parts = langid.predict(spark, docs, langid.train(docs), "text").orderBy("doc_id").toPandas()
    assert list(whole._lang) == list(parts._lang) == [r[2] for r in rows]
    assert np.allclose(whole._score, parts._score)


def test_quality_rules_in_numpy(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    model = quality.train(docs, labels.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0))
    rows = docs.select("doc_id", *[c.alias(n) for n, c in quality.statistics(F.col("text")).items()]).toPandas().set_index("doc_id")
    score = np.full(len(rows), model.bias)
    for rule in model.rules:
        on = np.ones(len(rows), bool)
        for name, above, cut in rule.parts:
            on &= (rows[name] > cut).to_numpy() if above else (rows[name] <= cut).to_numpy()
        score += rule.weight * on
    got = queries.op7_quality(spark, SF).toPandas().set_index("doc_id").loc[rows.index]
    assert model.rules and np.allclose(got.score, 1 / (1 + np.exp(-score)))
    assert (got.predicted == (got.score >= 0.3)).all()
    assert list(got.held_out) == [zlib.crc32(str(i).encode()) % 5 == 0 for i in rows.index]


def test_quality_learns_from_no_more_than_its_sample(spark):
    docs = spark.createDataFrame([(i % 5, f"text {i} " * (i % 7)) for i in range(200)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(5)], "doc_id long, quality int")
    assert quality.train(docs, labels, sample=40).bias == quality.train(docs, labels, sample=40).bias
    assert quality.train(docs.limit(0), labels).rules == ()


@pytest.mark.parametrize("size", [32_000_000, 20_000, 700])
def test_shards_are_cut_from_a_sorted_list(spark, monkeypatch, size):
    """Shard, slot, size and checksum of every row, whatever the ranges, one text with a third of all rows."""
    monkeypatch.setattr(shards, "RANGE", size)
    rows = [(i, "the same text in many rows") for i in range(1000)] + [(5000 + i, f"text {i} " * (i % 40)) for i in range(2000)] + [(9000, None), (None, "lost")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = shards.shard(docs).toPandas()
    keyed = docs.select("doc_id", *[k.alias(f"h{n}") for n, k in enumerate(shards.order_key(F.col("text"), F.col("doc_id")), 1)]).toPandas()
    full = got.assign(id=got.doc_id.fillna(-1)).merge(keyed.assign(id=keyed.doc_id.fillna(-1)).drop(columns="doc_id"), on="id").sort_values(["h1", "h2"])
    assert len(full) == len(rows) and full.shard.is_monotonic_increasing
    for _, g in full.groupby("shard"):
        assert list(g.slot) == list(range(len(g)))
    load = full.groupby("shard")["size"].sum()
    assert len(load) == shards.SHARDS and abs(load - load.mean()).max() <= 0.02 * load.mean() + full["size"].max()
    want = {i: len((t or "").encode()) + 1 for i, t in rows if i is not None}
    assert all(want[i] == n for i, n in zip(got.doc_id, got["size"]) if i == i)


def test_shard_query_columns(spark):
    got = queries.op10_histogram_shards(spark, SF).toPandas().set_index("doc_id")
    docs = table(spark, SF, "documents").toPandas()
    for i, t in zip(docs.doc_id, docs.text):
        assert got.text_crc32[i] == zlib.crc32((t or "").encode()) and got["size"][i] == len((t or "").encode()) + 1
    assert set(got.law) == {"bytes"} and got.grown_shard.isna().all()


def test_packed_numbers_of_any_size():
    some = [0, 3, 231, 232, 255, 2**8, 2**22, 2**23 - 1, 2**23, 9_000_000, 2**30, 2**31 - 1]
    assert bpe._unpack_ranks(bpe._pack_ranks(np.array(some))).tolist() == some
    assert bpe._unpack_ranks(bpe._pack_ranks(np.zeros(0, np.int64))).tolist() == []
    with pytest.raises(ValueError):
        bpe._pack_ranks(np.array([2**31]))


def test_blocks_of_any_size_encode_alike(spark):
    words = queries.vocabulary()
    docs = table(spark, SF, "documents").repartition(2)
    whole = bpe.encode(docs, "text", "doc_id", words).orderBy("_key").collect()
    assert bpe.encode(docs, "text", "doc_id", words, 3000).orderBy("_key").collect() == whole


def test_a_band_that_only_short_signatures_share_hides_no_link():
    """Two texts meet in the bucket of band 3; in 16 bits their signatures agree in all bands, in 64 bits not before it."""
    bag = np.sort(np.random.default_rng(1).integers(0, 2**63, 50).astype(np.uint64)).tobytes()
    sig = np.arange(neardup.SLOTS, dtype=np.uint16).tobytes()
    one = np.arange(neardup.BANDS, dtype=np.int64)
    two = np.where(np.arange(neardup.BANDS) < 3, one + 1000, one)
    met = pa.table({
        "band": pa.array([3, 3]), "i": pa.array([0, 0]), "j": pa.array([0, 0]), "block": pa.array([0, 0]),
        "th": pa.array([b"a", b"b"]), "c": pa.array([b"a", b"b"]), "size": pa.array([50, 50]), "sig": pa.array([sig, sig]),
        "bands": pa.array([one.tolist(), two.tolist()], pa.list_(pa.int64())), "bag": pa.array([bag, bag]),
    })
    assert neardup._cross(0.8)(met).to_pydict() == {"a": [b"a"], "b": [b"b"]}
    assert neardup._cross(0.8)(met.set_column(0, "band", pa.array([5, 5]))).num_rows == 0  # met in band 3 already


def test_components_with_written_minima(spark, monkeypatch):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 160)] + [(7, 7), (None, 3)], "a long, b long")
    plain = sorted(map(tuple, components.components(edges).collect()))
    monkeypatch.setattr(components, "MANY", 0)
    assert sorted(map(tuple, components.components(edges).collect())) == plain
    assert {c for _, c in plain} == {0, 100} and len(plain) == 41 + 60


def test_a_benchmark_of_several_blocks(spark, monkeypatch):
    docs, items = table(spark, SF, "documents").select("doc_id", "text"), table(spark, SF, "benchmark")
    found = lambda: {(r["doc_id"], m["item_id"], m["distance"]) for r in decontaminate.matches(docs, items).collect() for m in r["_matches"]}
    whole = found()
    monkeypatch.setattr(decontaminate, "BLOCK", 300)
    monkeypatch.setattr(decontaminate, "STEP", 500)
    assert len(decontaminate._items(items, "item_id", "text")) > 3 and found() == whole and whole
    monkeypatch.setattr(decontaminate, "MOST", 1000)
    with pytest.raises(ValueError):
        found()


def test_intermediate_tables_go(spark):
    before = set(common.folders())
    out = corpus_pipeline.run(spark, SF)
    left = [f for f in common.folders() if f not in before]
    assert len(left) == 1 and left[0].rsplit("/", 1)[-1].startswith("byte_bpe") and out.count() > 0
    common.forget(spark, left)
    assert [f for f in common.folders() if f not in before] == []


def test_a_cluster_needs_a_shared_folder():
    nothing = type("Conf", (), {"get": lambda self, name, default=None: None})()
    context = type("Context", (), {"getConf": lambda self: nothing, "getCheckpointDir": lambda self: None, "master": "spark://somewhere:7077"})()
    session = type("Session", (), {"sparkContext": context, "conf": nothing})()
    with pytest.raises(RuntimeError):
        common.shared_dir(session)


def test_batch_sizes_come_back(spark):
    before = spark.conf.get(common.BATCH)
    with pytest.raises(ZeroDivisionError), common.batches_of(spark, 1):
        assert spark.conf.get(common.BATCH) == "1"
        1 / 0
    assert spark.conf.get(common.BATCH) == before


def test_shards_of_vectors_in_groups(spark, monkeypatch):
    """Many small shards and blocks, more blocks than groups: every link of three dense labels."""
    rng = np.random.default_rng(4)
    x = np.repeat(rng.normal(size=(30, 16)), 20, axis=0) + rng.normal(size=(600, 16)) * 0.02
    rows = [(i, v.tolist(), int(i % 3)) for i, v in enumerate(x)]
    got = vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), shard=60, block=20).orderBy("vec_id").collect()
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    linked = (u @ u.T >= vectors.COSINE) & (np.arange(600)[:, None] % 3 == np.arange(600)[None] % 3) & ~np.eye(600, dtype=bool)
    assert [r.n_links for r in got] == linked.sum(axis=1).tolist() and linked.sum() > 2000
    reach = np.arange(600)
    for _ in range(600):
        new = np.minimum(reach, np.where(linked, reach[None], 600).min(axis=1))
        if (new == reach).all():
            break
        reach = new
    assert [r.component_id for r in got] == reach.tolist()
