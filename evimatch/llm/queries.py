"""The subpackage's queries, by name: each applies its operator to the whole of its table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evimatch.llm import alignment, decontaminate, divergence, kdshards, licenses, mixing, neardup, pages, passages, quality, tokens, topk, urlfilter
from evimatch.llm.oracles import MIX_WEIGHTS, ORACLES, URL_ENTRIES


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.read_tokens(tokens.write_tokens(_table(spark, sf_dir, "documents")))


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")


def op3_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.extract(_table(spark, sf_dir, "pages"))


def op4_url_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages carry no fetch time, so one is derived from page_id: 2024-01-01 plus (37 * page_id mod 366) days."""
    captures = _table(spark, sf_dir, "pages").select("page_id", "url", F.expr("timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, cast(pmod(page_id * 37, 366) as int))").alias("fetched_at"))
    entries = spark.createDataFrame(URL_ENTRIES, "kind string, pattern string, action string, at string")
    return urlfilter.judge(captures, entries)


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return quality.quality(docs, quality.train(docs, _table(spark, sf_dir, "labels")))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(_table(spark, sf_dir, "documents"), MIX_WEIGHTS, default=1.0)
    return mixed.select("doc_id", F.col("copy_no").cast("long").alias("copy_no"), "mix_key", F.length("text").cast("long").alias("text_chars"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_table(spark, sf_dir, "documents"))


def op8_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeated_passages(_table(spark, sf_dir, "documents")).drop("kept_text")


def op9_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kdshards.kd_shards(_table(spark, sf_dir, "documents"), 8)


def op10_contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digest(decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")))


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.digest(_table(spark, sf_dir, "documents"))


def op12_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each row whose id is divisible by 50, the 5 best of all other rows."""
    return topk.top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence(_table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_token_files, op2_near_duplicates, op3_main_text, op4_url_lists, op5_quality_rules, op6_mixing, op7_license_scan, op8_repeated_passages, op9_kd_shards, op10_contamination, op11_alignment, op12_top_k, op13_divergence)}
ORACLE_SQL = ORACLES
