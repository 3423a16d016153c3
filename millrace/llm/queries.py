"""The queries of this subpackage, thin over its operators, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontaminate, langid, licenses, neardup, quality, sentences, shards, suffixes, vectors
from .common import exploded, fold, table, take


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = F.coalesce(fold("doc_id", 4) == 2, F.lit(False))
    model = langid.train(docs.where(~held))
    rows = take(docs, doc_id="doc_id", text="text")
    return langid.predict(spark, rows, model, "text").select("doc_id", held.alias("held_out"), F.col("_lang").alias("lang_pred"), F.col("_score").alias("score"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = take(table(spark, sf_dir, "documents"), doc_id="doc_id", text="text")
    found = decontaminate.matches(docs, table(spark, sf_dir, "benchmark"))
    return exploded(found, F.col("_matches"), "m").select("doc_id", "m.item_id", "m.distance")


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = take(table(spark, sf_dir, "documents"), doc_id="doc_id", text="text")
    return exploded(licenses.licenses(docs), F.col("_licenses"), "m").select("doc_id", "m.license", "m.containment")


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents")).drop("th")


def op5_sentence_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = take(table(spark, sf_dir, "documents"), doc_id="doc_id", text="text")
    return sentences.cut(docs).select("doc_id", "n_sentences", "n_removed", "text")


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = suffixes.cut(table(spark, sf_dir, "documents"))
    n = F.octet_length("kept").cast("long") + F.col("n_removed")
    return left.select("doc_id", n.alias("n_bytes"), "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = F.coalesce(fold("doc_id", 5) == 0, F.lit(False))
    model = quality.train(docs, table(spark, sf_dir, "labels").where(~held))
    rows = quality.scored(take(docs, doc_id="doc_id", text="text"), model, "text")
    return rows.select("doc_id", held.alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= quality.THRESHOLD).cast("int").alias("predicted"))


def op8_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_vectors(table(spark, sf_dir, "embeddings"))


def vocabulary() -> bpe.Vocabulary:
    import public_tokenizers

    return bpe.Vocabulary(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def digests(coded: DataFrame) -> DataFrame:
    """What the digest columns say of _key, ids, _bytes."""
    text = F.array_join(F.transform("ids", lambda i: i.cast("string")), " ")
    return coded.select(F.col("_key").alias("doc_id"), F.size("ids").cast("long").alias("n_tokens"), F.sha2(text.cast("binary"), 256).alias("ids_sha256"), F.sha2("_bytes", 256).alias("decoded_sha256"))


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = vocabulary()
    ids = bpe.encode(table(spark, sf_dir, "documents"), "text", "doc_id", words)
    return digests(bpe.decode(ids, "ids", words))


def op10_histogram_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = take(table(spark, sf_dir, "documents"), doc_id="doc_id", text="text")
    return shards.shard(docs).select(
        "doc_id", "size", F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


QUERIES = {f.__name__: f for f in (op1_language_id, op2_decontamination, op3_license_scan, op4_near_duplicates, op5_sentence_dedup, op6_suffix_dedup, op7_quality, op8_vector_dedup, op9_byte_bpe, op10_histogram_shards)}

SQL = {
    "op4_near_duplicates": r"""
WITH RECURSIVE texts AS (
  SELECT text, min(doc_id) AS node, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w
  FROM documents WHERE text IS NOT NULL GROUP BY text),
shingled AS (
  SELECT node, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))
                           WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM texts),
bag AS (SELECT node, s, count(*) AS n FROM shingled GROUP BY node, s),
total AS (SELECT node, sum(n) AS t FROM bag GROUP BY node),
common AS (SELECT x.node AS a, y.node AS b, sum(least(x.n, y.n)) AS c FROM bag x JOIN bag y ON x.s = y.s AND x.node <> y.node GROUP BY 1, 2),
links AS (SELECT a, b FROM common JOIN total p ON a = p.node JOIN total q ON b = q.node
          WHERE CAST(c AS DOUBLE) / CAST(p.t + q.t - c AS DOUBLE) >= 0.8),
reach(node, r) AS (SELECT node, node FROM texts UNION SELECT l.b, reach.r FROM reach JOIN links l ON l.a = reach.node),
class AS (SELECT node, min(r) AS class_id FROM reach GROUP BY node),
sized AS (SELECT class_id, count(*) AS n_texts FROM class GROUP BY class_id)
SELECT d.doc_id, coalesce(c.class_id, d.doc_id) AS class_id, CAST(coalesce(z.n_texts, 1) AS BIGINT) AS n_texts,
       coalesce(c.class_id, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN texts t ON d.text = t.text LEFT JOIN class c ON c.node = t.node LEFT JOIN sized z ON z.class_id = c.class_id
""",
    "op5_sentence_dedup": r"""
WITH parts AS (SELECT doc_id, text, string_split(regexp_replace(text, '([.!?…。]\s|\n)', '\1' || chr(1), 'g'), chr(1)) AS p FROM documents),
piece AS (SELECT doc_id, unnest(range(1, len(p) + 1)) AS i, unnest(p) AS part FROM parts),
said AS (SELECT doc_id, i, trim(regexp_replace(lower(part), '\s+', ' ', 'g')) AS s FROM piece),
runs AS (SELECT doc_id, i AS place, lead(i, 2) OVER w AS last, s || chr(10) || lead(s, 1) OVER w || chr(10) || lead(s, 2) OVER w AS run
         FROM said WHERE s <> '' WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
later AS (SELECT doc_id, place, last FROM (
            SELECT *, row_number() OVER (PARTITION BY run ORDER BY doc_id, place) AS k FROM runs
            WHERE last IS NOT NULL AND len(regexp_split_to_array(run, '[ \n]')) >= 10) WHERE k > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(place, last + 1)) AS i FROM later),
kept AS (SELECT piece.doc_id, string_agg(part, '' ORDER BY piece.i) AS text FROM piece ANTI JOIN gone ON piece.doc_id = gone.doc_id AND piece.i = gone.i GROUP BY piece.doc_id),
counted AS (SELECT said.doc_id, count_if(s <> '') AS n, count_if(s <> '' AND gone.i IS NOT NULL) AS r FROM said LEFT JOIN gone ON said.doc_id = gone.doc_id AND said.i = gone.i GROUP BY said.doc_id)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_sentences, CAST(coalesce(r, 0) AS BIGINT) AS n_removed,
       CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text
FROM documents d LEFT JOIN counted c ON c.doc_id = d.doc_id LEFT JOIN kept k ON k.doc_id = d.doc_id
""",
    "op6_suffix_dedup": r"""
WITH hexed AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
windows AS (SELECT doc_id, unnest(range(1, len(h) // 2 - 398)) AS i, h FROM hexed WHERE len(h) >= 800),
digest AS (SELECT doc_id, i, md5_number(substr(h, 2 * i - 1, 800)) AS w FROM windows),
again AS (SELECT w FROM digest GROUP BY w HAVING count(*) > 1),
hit AS (SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 400 THEN 0 ELSE 1 END AS fresh FROM digest SEMI JOIN again USING (w)),
grouped AS (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM hit),
spans AS (SELECT doc_id, g, min(i) AS b, max(i) + 399 AS e FROM grouped GROUP BY doc_id, g),
ordered AS (SELECT *, lead(b) OVER (PARTITION BY doc_id ORDER BY b) AS nb, row_number() OVER (PARTITION BY doc_id ORDER BY b) AS k FROM spans),
pieces AS (SELECT o.doc_id, string_agg(CASE WHEN k = 1 THEN substr(h, 1, 2 * (b - 1)) ELSE '' END || substr(h, 2 * e + 1, CASE WHEN nb IS NULL THEN len(h) ELSE 2 * (nb - e - 1) END), '' ORDER BY b) AS kept,
                  sum(e - b + 1) AS n, count(*) AS c FROM ordered o JOIN hexed x ON x.doc_id = o.doc_id GROUP BY o.doc_id)
SELECT x.doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, CAST(coalesce(c, 0) AS BIGINT) AS n_spans,
       sha256(unhex(coalesce(kept, h))) AS kept_sha256
FROM hexed x LEFT JOIN pieces p ON p.doc_id = x.doc_id
""",
    "op8_vector_dedup": r"""
WITH RECURSIVE v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
good AS (SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_dot_product(e, e) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
          WHERE list_dot_product(a.e, b.e) / sqrt(list_dot_product(a.e, a.e) * list_dot_product(b.e, b.e)) >= 0.98),
reach(node, r) AS (SELECT vec_id, vec_id FROM v UNION SELECT l.b, reach.r FROM reach JOIN links l ON l.a = reach.node),
class AS (SELECT node, min(r) AS component_id FROM reach GROUP BY node),
counted AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT v.vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, component_id, component_id = v.vec_id AS kept
FROM v JOIN class ON class.node = v.vec_id LEFT JOIN counted ON counted.a = v.vec_id
""",
}
