"""Training corpus in five stages: toxicity, quality rules, line dedup, near duplicates by fingerprints, packing."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailquill.llm import line_dedup, packing, quality, simhash, toxicity
from mailquill.llm.common import fresh
from mailquill.llm.queries import TOXIC_FROM, toxicity_model
from mailquill.session import intermediate_data, materialize


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below the threshold. The model learns from labelled rows that are not held out."""
    score = fresh(docs, "toxicity")
    scored = docs.withColumn(score, toxicity.score(docs, toxicity_model(spark, sf_dir, docs)))
    return scored.where(F.col(score) < TOXIC_FROM).drop(score)


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, with their whole text."""
    verdict = fresh(docs, "verdict")
    judged = docs.withColumn(verdict, quality.quality(F.col("text")))
    return judged.where(F.col(f"{verdict}.kept")).drop(verdict)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages that are found before, in an earlier document or their own."""
    return line_dedup.remove_repeated_chunks(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates, that with the smallest id."""
    return simhash.keep_one(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece with its sequence and offset."""
    return packing.pack_digest(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("quality_rules", drop_poor),
    ("line_dedup", drop_repeated_lines),
    ("simhash_near_dedup", drop_near_duplicates),
    ("best_fit_packing", pack),
]

#: The toxicity model, the fingerprints and the tokenizer are beyond SQL; tests compare stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str, output: str | None = None) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read again.

    With ``output`` the last result is written there and everything in between is removed. Without it the tables of the run
    stay in the shared folder until the caller removes them, since the result is read from them.
    """
    if output is None:
        return _staged(spark, sf_dir)
    with intermediate_data(spark):
        return materialize(_staged(spark, sf_dir), path=output)


def _staged(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    name, last = STAGES[-1]
    return materialize(last(spark, docs, sf_dir), name)
