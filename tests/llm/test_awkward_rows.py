"""Very long texts, empty tables, repeated rows and columns with clashing names, for operators and stages."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from evimatch.llm import decontaminate, kdshards, licenses, mixing, neardup, passages, quality, tokens, urlfilter

NAMES = ("gone", "copy_no", "mix_key", "t", "d", "node", "label", "__row", "shard", "n", "i", "__id", "__t", "__k", "__key", "__u", "__steps", "__copy", "k", "u", "row", "steps", "low", "first", "copy", "own_id", "out_hash")


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(12)
    long = " ".join(f"v{rng.randrange(9000)}" for _ in range(250_000))
    few = [f"a short text number {i} with some more words" for i in range(4)]
    rows = [(1, long), (2, long), (2, long), (3, few[0]), (3, few[0]), (None, few[1]), (None, None), (4, ""), (5, "w" * 2_000_000), (6, " ".join(few))]
    frame = spark.createDataFrame([(i, t, "s", "en") for i, t in rows], "doc_id long, text string, source string, lang string")
    return frame.withColumns({c: F.lit("clash") for c in NAMES}).repartition(3)


def test_operators_take_them(spark, docs):
    bench = spark.createDataFrame([(1, "with some more words")], "item_id long, text string")
    n = docs.count()
    near = neardup.near_duplicates(docs).collect()
    assert len(near) == n and {r.component_id for r in near if r.doc_id in (1, 2)} == {1}
    assert neardup.one_of_each(docs, size=4).count() == n - 3
    removed = {r.doc_id: r.n_removed for r in passages.repeated_passages(docs).collect()}
    assert removed[2] == 250_000 and removed[1] == 0
    assert decontaminate.digest(decontaminate.contamination(docs, bench)).where("contaminated").count() == 4
    assert decontaminate.clean(docs, bench).columns == docs.columns
    assert quality.quality(docs, None).count() == n and kdshards.kd_shards(docs, 3).count() == n
    assert licenses.scan(docs).count() == 0 and licenses.scan(docs.withColumn("text", F.lit("Released under the MIT License."))).agg(F.sum("n_windows")).first()[0] == 7  # distinct ids, null among them
    mixed = mixing.mix(docs)
    assert sorted(mixed.columns) == sorted(docs.columns) and mixed.count() > 0
    read = tokens.read_tokens(tokens.write_tokens(docs)).collect()
    assert len(read) == n and len({r.ids_crc32 for r in read if r.doc_id in (1, 2)}) == 1
    seen = docs.select(F.col("doc_id").alias("page_id"), F.lit("http://a.org/x").alias("url"), F.lit("2024-05-05").alias("fetched_at"), *[f"`{c}`" for c in NAMES])
    entries = spark.createDataFrame([("domain", "org", "add", "2024-01-01")], "kind string, pattern string, action string, at string")
    assert urlfilter.judge(seen, entries).where("blocked").count() == n and urlfilter.judge(seen.limit(0), entries).count() == 0


def test_stages_take_them_and_empty_tables(spark, docs, tmp_path):
    spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "number 0 with some more words")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES:
        for rows in (docs, docs.limit(0), docs.withColumnRenamed("text", "Text")):
            out = stage(spark, rows, str(tmp_path))
            assert name == "token_files" or out.columns == rows.columns
            assert out.count() > 0 or rows is not docs or name == "quality_rules"
            assert out.count() == 0 or "Text" in rows.columns or rows is docs
            assert name in ("token_files", "quality_rules") or {r[0] for r in out.select("gone").collect()} <= {"clash"}
            assert name != "mix_sources" or {tuple(r) for r in out.select(*[f"`{c}`" for c in NAMES if c not in ("copy_no", "mix_key")]).distinct().collect()} <= {("clash",) * (len(NAMES) - 2)}
