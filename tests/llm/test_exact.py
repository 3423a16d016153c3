"""Operators against plain versions, held-out accuracy and exact round trips, over whole small tables."""

import base64
import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from millrace.llm import bpe, decontaminate, licenses, neardup, queries, shards, suffixes, vectors
from millrace.llm.common import bags, shingles, table
from millrace.llm.components import components

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, SF, "documents").orderBy("doc_id").toPandas()


def plain(text):
    return " " + " ".join(re.findall(r"[^\W_]+", (text or "").lower())) + " "


def test_language_accuracy(spark, docs):
    out = queries.op1_language_id(spark, SF).toPandas().merge(docs, on="doc_id")
    out = out[out.held_out]
    assert len(out) and (out.lang_pred == out.lang).mean() > 0.95


def test_decontamination_is_brute_force(spark, docs):
    bench = table(spark, SF, "benchmark").toPandas()
    edited = []
    rng = random.Random(1)
    for i, t in list(zip(bench.item_id, bench.text))[:12]:
        x = list(t)
        for _ in range(int(0.03 * len(x))):
            x[rng.randrange(len(x))] = "q"
        edited.append((10_000 + int(i), "before " + "".join(x) + " after"))
    some = [(int(a), b) for a, b in zip(docs.doc_id, docs.text) if len(b) < 1500][:25] + edited
    frame = spark.createDataFrame(some, "doc_id long, text string")
    got = {(r["doc_id"], m["item_id"]) for r in decontaminate.matches(frame, table(spark, SF, "benchmark")).collect() for m in r["_matches"]}

    def distance(p, t):  # the plain table, row by row
        t = np.frombuffer(t.encode("utf-32-le"), np.uint32)
        row = np.zeros(len(t) + 1, int)
        for i, c in enumerate(p, 1):
            new = np.minimum(row[1:] + 1, row[:-1] + (t != ord(c)))
            new = np.concatenate(([i], new))
            new = np.minimum.accumulate(new - np.arange(len(new))) + np.arange(len(new))
            row = new
        return row.min()

    want = {(d, int(i)) for d, t in some for i, b in zip(bench.item_id, bench.text) if distance(plain(b), plain(t)) <= decontaminate.budget(len(plain(b)))}
    assert got == want and {(10_000 + i, i) for i in range(12)} <= got


def test_nearest():
    assert decontaminate.nearest("abc", "xxabcxx") == 0
    assert decontaminate.nearest("abcdef", "xxabdefxx") == 1
    assert decontaminate.nearest("abc", "") == 3


def test_licenses_are_brute_force(spark, docs):
    texts = list(docs.text) + ["x " * 7 + t + " y" for t in licenses.TEMPLATES.values()]

    def grams(t):
        w = plain(t).split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets = {n: grams(t) for n, t in licenses.TEMPLATES.items()}
    want = {(i, n) for i, t in enumerate(texts) for n, s in sets.items() if len(s & grams(t)) >= 0.8 * len(s)}
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {(r["doc_id"], m["license"]) for r in licenses.licenses(frame).collect() for m in r["_licenses"]}
    assert got == want and len(want) > len(sets)


def test_signatures_are_unbiased():
    rng = np.random.default_rng(3)
    for _ in range(4):
        e = np.arange(40, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        a, b = rng.integers(1, 40, 40), rng.integers(1, 40, 40)
        b[:25] = a[:25]
        sig = neardup.signatures(np.repeat([0, 1], 40), np.concatenate((e, e)), np.concatenate((a, b)), 2, 4000)
        true = np.minimum(a, b).sum() / np.maximum(a, b).sum()
        assert abs((sig[0] == sig[1]).mean() - true) < 0.04


def test_signatures_do_not_depend_on_batches():
    rng = np.random.default_rng(6)
    e = rng.integers(0, 2**63, 5000).astype(np.uint64)
    w = rng.integers(1, 9, 5000)
    row = np.sort(rng.integers(0, 60, 5000))
    whole = neardup.signatures(row, e, w, 60)
    for r in range(60):
        at = row == r
        assert (neardup.signatures(np.zeros(at.sum(), int), e[at], w[at], 1)[0] == whole[r]).all()


def test_overlap_and_bags():
    w = np.array([1, 2, 3, 4, 5, 6, 1, 2, 3, 4, 5, 6, 7, 8], np.int64)
    h, row = shingles(w, np.array([0, 12, 14]))
    assert Counter(row.tolist()) == {0: 8, 1: 1}
    r, x, n = bags(h, row)
    assert n.sum() == 9 and n.max() == 2
    assert neardup.overlap(np.array([1, 1, 2], np.uint64), np.array([1, 2, 2], np.uint64)) == 2 / 4


def test_large_buckets_lose_no_link(spark):
    # a chain of texts in one bucket region: neighbours are similar, ends are not
    rng = random.Random(5)
    words = [f"w{i}" for i in range(4000)]
    chain, rows = [rng.choice(words) for _ in range(150)], []
    for k in range(40):
        rows.append((k, " ".join(chain)))
        chain = chain[2:] + [rng.choice(words) for _ in range(2)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["class_id"] for r in neardup.near_duplicates(frame).collect()} == {0}


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(60)]
    parent = {}

    def root(i):
        while parent.setdefault(i, i) != i:
            i = parent[i]
        return i

    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: root(i) for e in edges if e[0] != e[1] for i in e}


@pytest.mark.parametrize("keep", ["none", "first"])
@pytest.mark.parametrize("wide", [False, True])
def test_suffixes_are_brute_force(spark, monkeypatch, keep, wide):
    if wide:
        monkeypatch.setattr(suffixes, "ARRAY", 0)
    rng = random.Random(7)
    block = ["".join(rng.choice("abcdé ") for _ in range(n)) for n in (60, 45, 90, 30)]
    rows = [(i, "".join(rng.choice([*block, "".join(rng.choice("abcd ") for _ in range(25))]) for _ in range(rng.randrange(9)))) for i in range(60)]
    rows += [(70, "ab" * 100), (71, "x" * 39), (72, "x" * 41)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    seen = {}
    for i, t in rows:
        b = t.encode()
        for k in range(len(b) - 39):
            seen.setdefault(b[k : k + 40], []).append((i, k))
    want = {}
    for i, t in rows:
        b = t.encode()
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - 39):
            at = seen[b[k : k + 40]]
            if len(at) > 1 and (keep == "none" or at[0] != (i, k)):
                gone[k : k + 40] = True
        kept = bytes(x for x, g in zip(b, gone) if not g)
        want[i] = (kept, int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()))
    got = {r["doc_id"]: (bytes(r["kept"]), r["n_removed"], r["n_spans"]) for r in suffixes.cut(frame, length=40, keep=keep).collect()}
    assert got == want


def test_anchor_pieces_agree():
    rng = random.Random(1)
    text = "".join(rng.choice("abcdefg \n") for _ in range(5000)).encode()
    a, b = suffixes.anchors(text, 100, 16), suffixes.anchors(text, 100, 16, 700)
    starts = lambda x: {(s, k) for lo, hi, k in zip(*x[:3]) for s in range(lo, hi + 1)}
    assert starts(a) == starts(b)


def test_quality_on_held_out(spark):
    sf = "/root/testdata/sf0.01"
    out = queries.op7_quality(spark, sf).toPandas().merge(table(spark, sf, "labels").toPandas(), on="doc_id")
    out = out[out.held_out]
    good, bad = out.score[out.quality == 1].to_numpy(), out.score[out.quality == 0].to_numpy()
    assert len(bad) and (good[:, None] > bad[None]).mean() + 0.5 * (good[:, None] == bad[None]).mean() > 0.9


def test_vectors_recall(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(1500, 24))
    x[500:900] = x[0] + 0.03 * rng.normal(size=(400, 24))
    x[900:1000] = x[900]
    frame = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    u = x / np.linalg.norm(x, axis=1)[:, None]
    true = ((u @ u.T) >= 0.98).sum(axis=1) - 1
    got = vectors.near_vectors(frame, shard=400, block=300).orderBy("vec_id").toPandas()
    assert got.n_links.sum() >= 0.99 * true.sum() and (got.n_links <= true).all()


def test_bpe_is_tiktoken(spark, docs):
    import public_tokenizers as p

    with open(p.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    code = tiktoken.Encoding("own", pat_str=p.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = queries.op9_byte_bpe(spark, SF).toPandas().set_index("doc_id")
    for i, t in zip(docs.doc_id, docs.text):
        ids = code.encode_ordinary(t)
        assert got.n_tokens[i] == len(ids) and got.ids_sha256[i] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got.decoded_sha256[i] == hashlib.sha256(t.encode()).hexdigest()
    rng = random.Random(9)
    for _ in range(300):
        w = "".join(rng.choice("aabcé !0x 中'") for _ in range(rng.randrange(1, 200)))
        assert [i for m in re.findall(r"(?s).+", w) for i in bpe.merge(m.encode(), ranks)] == code._core_bpe.encode_single_piece(w.encode())


def test_shards_law(spark):
    sf = "/root/testdata/sf0.01"
    out = queries.op10_histogram_shards(spark, sf).toPandas()
    docs = table(spark, sf, "documents").select("doc_id", F.octet_length("text").alias("n")).toPandas()
    assert sorted(out.doc_id) == sorted(docs.doc_id)
    assert (out.merge(docs, on="doc_id").eval("size - n") == 1).all()
    load = out.groupby("shard")["size"].sum()
    assert list(load.index) == list(range(8)) and load.max() - load.min() <= 2 * docs.n.max() + 0.02 * load.sum() / 8
    assert all(sorted(g.slot) == list(range(len(g))) for _, g in out.groupby("shard"))


def test_shards_split_a_hot_text(spark):
    rows = [(i, "same text here") for i in range(4000)] + [(10_000 + i, f"other text {i}") for i in range(4000)]
    out = shards.shard(spark.createDataFrame(rows, "doc_id long, text string")).toPandas()
    load = out.groupby("shard")["size"].sum()
    assert load.max() <= 1.05 * load.mean()


def test_pipeline(spark, docs):
    rows = {}
    frame = table(spark, SF, "documents")
    for name, stage in corpus_pipeline.STAGES:
        frame = stage(spark, frame, SF).cache()
        rows[name] = frame.toPandas()
    assert len(rows["language_id"]) >= 0.97 * len(docs)
    near = queries.op4_near_duplicates(spark, SF).toPandas()
    if len(rows["language_id"]) == len(docs):
        assert set(rows["near_dedup"].doc_id) == set(near.doc_id[near.kept])
    assert set(rows["substring_dedup"].doc_id) == set(rows["near_dedup"].doc_id)
    assert (rows["substring_dedup"].text.str.len() == rows["substring_dedup"].n_chars).all()
    bench = [plain(t) for t in table(spark, SF, "benchmark").toPandas().text]
    assert not any(b in plain(t) for t in rows["decontamination"].text for b in bench)
    last = rows["byte_bpe"].set_index("doc_id").decoded_sha256.to_dict()
    assert last == {i: hashlib.sha256(t.encode()).hexdigest() for i, t in zip(rows["decontamination"].doc_id, rows["decontamination"].text)}


def test_balls_find_every_link_of_dense_groups():
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(40, 32))
    spread = np.concatenate([np.repeat(centres[:2], 300, axis=0), centres]) + 0.0
    x = spread + rng.normal(size=spread.shape) * np.where(np.arange(len(spread)) < 600, 0.09, 0.0)[:, None]
    x /= np.linalg.norm(x, axis=1)[:, None]
    ids, copies = np.arange(len(x)) * 3, rng.integers(1, 4, len(x))
    shard = vectors.Shard(vectors.Graph(x.astype(np.float32)), x)
    n, a, b = vectors.block_links(shard, ids, copies, ids, x)
    linked = (x @ x.T >= vectors.COSINE) & ~np.eye(len(x), dtype=bool)
    assert linked.sum() > 50_000 and n.tolist() == (linked @ copies).tolist()
    assert len(shard.span) < len(x) // 2

    def least(pairs):
        parent = {}
        for p, q in pairs:
            p, q = (_root(parent, p), _root(parent, q))
            parent[max(p, q)] = min(p, q)
        return [_root(parent, i) for i in ids.tolist()]

    assert least(zip(a, b)) == least((ids[p], ids[q]) for p, q in zip(*np.nonzero(linked)))


def _root(parent: dict, i: int) -> int:
    while parent.get(i, i) != i:
        i = parent[i]
    return int(i)
