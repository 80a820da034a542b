"""From raw documents to a training mix: quality, line dedup, near-dedup, decontamination, mixing.

Every stage takes (spark, docs, sf_dir) and works on all that the stage before it
kept. Its result is written as Parquet and read again as the next one's documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from shiftlens.llm import decontaminate, line_dedup, mixing, quality, simhash
from shiftlens.llm.common import delete, new_path, scratch, table

#: SQL can't express the classifier, the rolling hashes or banded alignment; tests hold each stage against brute force.
ORACLE_SQL = None


def keep_good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def remove_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated multi-line passages go; every document stays."""
    out = line_dedup.dedup_lines(docs).select(*docs.columns)
    return out.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("long"))


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8 or more) stays."""
    return simhash.keep_one(docs, width=5, distance=None)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, word for word or nearly, go."""
    return decontaminate.drop_leaked(docs, table(spark, sf_dir, "benchmark"))


def mix_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: each document with the words that it gives, repeats counted; those that give none go."""
    mixed = mixing.mix_sources(docs, keep=("text", "lang"))
    return mixed.where("taken > 0").select("doc_id", "text", "lang", "source", "size", "source_size", "target", "taken")


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("quality", keep_good_quality),
    ("line_dedup", remove_repeated_lines),
    ("near_dedup", keep_one_of_near_duplicates),
    ("decontamination", drop_benchmark_leaks),
    ("mixing", mix_to_weights),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order on the documents of ``sf_dir``, each result written and read again.

    What a stage wrote on its way goes once its result stands, and a result once the next one does.
    """
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = new_path(spark, f"stage-{name}")
        with scratch(spark):
            out = stage(spark, docs, sf_dir)
            out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
        if before:
            delete(spark, before)
        before = path
    return docs
