"""A training corpus from raw documents: toxicity, quality rules, near duplicates, benchmark leaks, tokens."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratabar.llm import bpe, decontaminate, jaccard_join, quality, toxicity
from stratabar.llm.common import remove, shared_dir, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that score below the threshold, with all their columns. The lexicon is learned from docs and the
    labels. Null and empty texts have no hits and stay; repeated rows stay or go alike; an empty table gives no rows;
    columns named as the score or its terms are left as they are."""
    lexicon = toxicity.fit_toxicity(docs, table(spark, sf_dir, "labels"))
    return toxicity.score_toxicity(docs, lexicon, carry=True).filter(F.col("score") < toxicity.THRESHOLD).select("row.*")


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that pass the base rules and the classifier, with all their columns. Null, empty and very short texts
    fail the base rules and go; repeated rows stay or go alike; an empty table gives no rows; columns named as a measure
    or verdict are left as they are."""
    model = quality.fit_quality(docs, table(spark, sf_dir, "labels"))
    return quality.with_verdict(quality.score_quality(docs, model, carry=True)).filter("kept").select("row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates, that of the least id, with all its columns. Null texts and texts
    without words are no duplicates and stay; of rows that repeat id and text one stays; an empty table gives no rows."""
    return jaccard_join.one_of_each(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents into which no benchmark item leaks, with all their columns. Null and empty texts stay; repeated rows
    stay or go alike; an empty table gives no rows."""
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each document, one row per input row. Null texts count as empty;
    an empty table gives no rows; other columns are not carried."""
    return bpe.digests(bpe.round_trip(docs, public_tokenizers.path("word_bpe_49k.json")))


STAGES = [
    ("toxicity", drop_toxic),
    ("quality_rules", drop_low_quality),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("benchmark_decontamination", drop_leaks),
    ("bpe", encode),
]

#: SQL can express none of the stages; tests hold each against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stage's rows are written to the shared folder and read again by the next; returns the last one's. What a stage
    has read is deleted once the next one's rows are written; the folder named in spark.checkpoint.dir keeps the rows
    that the result is made of."""
    docs, folder, before = table(spark, sf_dir, "documents"), f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}", None
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:
            remove(spark, f"{folder}/{before}")
        before = name
    return STAGES[-1][1](spark, docs, sf_dir)
