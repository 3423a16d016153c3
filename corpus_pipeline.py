"""A corpus from raw documents to tokens: five stages, each over all that the one before has kept.

Every stage takes an empty table to an empty one, takes ids for values (null and repeated ones too), and keeps columns
that it does not know. What it does with repeated rows, null and empty texts is said below.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import bpe, decontaminate, langid, neardup, queries, sentences
from millrace.llm.common import flat, folders, forget, stored, table

#: Documents whose likeliest language is less likely than this are rejected.
SURE = 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a language that the model tells; those without a letter or without a clear language go, so null and
    empty texts do. Repeated rows share their fate. Where no row has a language, none is told and all go.
    """
    model = langid.train(docs)
    rows, at = flat(docs)
    told = langid.predict(spark, rows, model, at["text"])
    return told.where((F.col("_lang") != langid.UNKNOWN) & (F.col("_score") >= SURE)).select(*rows.columns).toDF(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: that of the smallest id (null last). Of repeated rows one stays;
    null texts all stay.
    """
    return neardup.deduplicate(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without sentences and passages that stand in an earlier document (or earlier in the text); n_chars follows.

    Earlier is the smaller id (null last), then text hash. No row goes: a text of which nothing is left becomes empty.
    Rows equal in id and text are one document, and keep the same text; null texts stay null.
    """
    rows, at = flat(sentences.cut_words(docs))
    rows = rows.withColumn(at["n_chars"], F.length(at["text"]).cast(docs.schema["n_chars"].dataType))
    return rows.select(*rows.columns[: len(docs.columns)]).toDF(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item occurs; null and empty texts have none, and an empty benchmark rejects nothing."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and digests of the ids and of the decoded bytes, a row for each row; a null text is an empty one."""
    words = queries.vocabulary()
    return queries.digests(bpe.decode(bpe.encode(docs, "text", "doc_id", words, 2_000_000), "ids", words))


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("substring_dedup", substring_dedup), ("decontamination", decontamination), ("byte_bpe", byte_bpe)]

#: Language identification fits a model, and BPE merges byte pairs: SQL expresses neither.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written to the shared folder; once that is done, the stage's input and other tables go."""
    docs, others = table(spark, sf_dir, "documents"), folders()
    for name, stage in STAGES:
        docs, written = stored(stage(spark, docs, sf_dir), name)
        forget(spark, [f for f in folders() if f != written and f not in others])
    return docs
