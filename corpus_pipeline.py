"""The corpus pipeline: quality rules, exact and near deduplication, source mix, packing.

Each stage takes the documents that its predecessor kept and returns those that it keeps, with their columns; the last
returns the places of all pieces. `run` writes every stage's result as Parquet in the shared folder and reads it back;
what a stage wrote on the way is removed then.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from convseries.llm import exact_dedup, mixing, near_dedup, packing, quality
from convseries.llm.common import scratch, staged
from convseries.llm.queries import tokenizer_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the risk-controlled cutoffs."""
    return quality.drop_low_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact_dedup.drop_exact_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return near_dedup.drop_near_copies(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as the mix takes them, some twice."""
    return mixing.apply_mix(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every piece."""
    return packing.pack(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [("quality rules", quality_rules), ("exact dedup", exact_copies), ("near dedup", near_copies), ("source mix", source_mix), ("best-fit packing", best_fit_packing)]

#: SQL can express neither the exact binomial cutoffs nor the tokenizer; a test holds every stage against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        with scratch(spark) as made:
            docs = staged(stage(spark, docs, sf_dir), f"stage-{k}")
            made.pop()  # the result itself, the last that was made
    return STAGES[-1][1](spark, docs, sf_dir)
