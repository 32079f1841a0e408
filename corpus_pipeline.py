"""The corpus pipeline: quality rules, near-dedup, decontamination, mixing, token files.

Each stage takes the rows its predecessor kept, as they were written, and returns rows with the columns of documents; the last
returns the index of its token files as read back from them.  Every stage takes null ids, repeated rows, empty tables and columns of
any other name; an empty table stays empty.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from evimatch.llm import decontaminate, mixing, neardup, quality, tokens
from evimatch.llm.tables import Scratch, columns, fresh


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the classifier, trained on the labelled rows of this stage's own input.

    A null or empty text fails the base rules and goes; repeated rows are judged alike.
    """
    return quality.passing(docs, quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: the one with the smallest doc_id (nulls last), once; empty texts all stay."""
    return neardup.one_of_each(docs, size=5)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any benchmark window; those with one go as a whole.  Null and empty texts hold none and stay."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated by their source's rate, all sources weighing the same, in a global random order; empty texts go."""
    return mixing.mix(docs, copy_col=fresh(docs, "copy_no"), key_col=fresh(docs, "mix_key")).select(*columns(docs))


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files in the order in which the mixing stage was written; the index as read back."""
    return tokens.read_tokens(tokens.write_tokens(docs, order=tokens.as_stored(docs)))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mix_sources", mix_sources),
    ("token_files", token_files),
]

#: SQL cannot express the classifier or the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's rows are written to the shared folder and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = scratch.table(stage(spark, docs, sf_dir), name)
    return docs
