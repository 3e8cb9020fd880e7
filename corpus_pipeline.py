"""A training corpus from raw documents: five stages of quarrylog.llm operators, each over all that the one before kept.

Nulls, ties, empty inputs: a null or empty text is not toxic, but has no language, so it goes in the second stage; a null doc_id is
never learned from and is judged by its text; rows that repeat are copies, of which the third stage leaves one; very long texts are judged
and cut whole; other columns, whatever their names, keep their values until the last stage; an empty table gives an empty mix. The last
stage writes the mixed corpus in slot order: which words of which document each slot holds, with their text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylog.llm import decontam, langid, mixing, ngram_join, toxicity
from quarrylog.llm.shared import packed, stash

#: Scores from which a document is rejected as toxic, and below which its language is not sure enough.
TOXIC, LEAST_SURE = 0.7, 0.4


def apart(docs: DataFrame) -> tuple[DataFrame, list[Column]]:
    """The texts, each with the rest of its row as one struct, and the columns that make rows of them again."""
    names = [c for c in docs.columns if c != "text"]
    own, kept = packed(names)
    return docs.select("text", own), [dict(zip(names, kept, strict=True)).get(c, F.col("text")) for c in docs.columns]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    learned = ~toxicity.held_out(F.col("doc_id"), 3, 1)
    field = toxicity.train(docs.where(learned), spark.read.parquet(f"{sf_dir}/labels.parquet").where(learned))
    rows, columns = apart(docs)
    return toxicity.tag(rows, field).where(F.col("score") < TOXIC).select(*columns)


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    network = langid.train(docs.where(~langid.held_out(F.col("doc_id"), 4, 2)))
    sure = (F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SURE)
    rows, columns = apart(docs)
    return langid.identify(rows, network).where(sure).select(*columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.without_copies(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_texts(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("language", keep_known_languages),
    ("near copies", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
]

#: SQL can't express the fitted stages; tests/llm holds near copies and decontamination against brute force, and the fitted stages against their operators.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stash(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return docs
