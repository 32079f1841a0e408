"""Rows that a cut, a limit or a grouping would lose."""

import duckdb
import numpy as np
from pyspark.sql import functions as F

from evimatch.llm import decontaminate, mixing, urlfilter
from evimatch.llm.oracles import ORACLES


def test_mixing_repeats_tiny_sources(spark):
    rows = [(i, "h" * 100_000, "hot") for i in range(8)] + [(100, "a few words", "tiny"), (101, "more", "tiny"), (102, "x", "one"), (None, None, "none")]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    got = [tuple(r) for r in got.select("doc_id", F.col("copy_no").cast("long"), "mix_key", F.length("text").cast("long")).collect()]
    duck = duckdb.connect()
    duck.execute("create table documents (doc_id bigint, text varchar, source varchar)")
    duck.executemany("insert into documents values (?, ?, ?)", rows)
    want = duck.execute(ORACLES["op6_mixing"]).fetchall()
    assert sorted(got) == sorted(want)
    copies = sum(r[0] == 102 for r in got)
    assert abs(copies - 800_016 / 3) < 6 * (800_016 / 3) ** 0.5


def test_large_rates_are_inverted_like_small_ones():
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(["s"]), pa.array([1]), pa.array([650.0])], names=["source", "bytes", "rate"])
    (out,) = mixing._inverted([batch])
    low, steps = out.column(3)[0].as_py(), np.array(out.column(4)[0].as_py())
    k = np.arange(1, low + len(steps))
    whole = np.cumsum(np.exp(-650.0 + np.concatenate(([0.0], np.cumsum(np.log(650.0 / k))))))
    assert np.abs(whole[low:] - steps).max() < 1e-12 and whole[low - 1] < 1e-25 and abs(steps[-1] - 1) < 1e-12


def test_url_lists_take_deep_prefixes(spark):
    entries = spark.createDataFrame([("prefix", "ok.org/a/b/c/d/e/", "add", "2024-01-01"), ("prefix", "ok.org/1/2/3/4/5/6/7", "add", "2024-01-01"), ("host", "no.org", "add", "2024-01-01")], "kind string, pattern string, action string, at string")
    urls = ["http://ok.org/a/b/c/d/e", "http://ok.org/a/b/c/d/e/f/g?x", "http://ok.org/a/b/c/d", "http://ok.org/a/b/c/d/ee", "http://ok.org/1/2/3/4/5/6/7/8/9", "http://ok.org/1/2/3/4/5/6", "http://no.org/a/b/c/d/e/f"]
    seen = spark.createDataFrame([(i, u, "2024-05-01") for i, u in enumerate(urls)], "page_id long, url string, fetched_at string")
    got = {r.page_id: r.matched for r in urlfilter.judge(seen, entries).collect()}
    deep = "prefix:ok.org/a/b/c/d/e"
    assert got == {0: deep, 1: deep, 2: "", 3: "", 4: "prefix:ok.org/1/2/3/4/5/6/7", 5: "", 6: "host:no.org"}
    assert {r.matched for r in urlfilter.judge(seen, entries.where("kind = 'host'")).collect()} == {"", "host:no.org"}
    assert not any(r.blocked for r in urlfilter.judge(seen, entries.limit(0)).collect())


def test_contamination_is_the_same_for_any_block_size(spark):
    said = " ".join(f"p{i}" for i in range(30))
    rows = [(None, said), (None, "nothing here"), (None, None), (None, f"x {said[:60]} y"), (5, said), (5, "other words"), (5, f"a {said}"), (6, ""), (7, "one two")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(1, said), (2, "one two"), (3, " ".join(f"p{i}" for i in range(12, 25))), (None, "other")], "item_id long, text string")
    found = [sorted(map(repr, decontaminate.contamination(docs, bench, block_windows=n).select("doc_id", "n_words", "hits", "items").collect())) for n in (200_000, 7, 2)]
    assert len(found[0]) == len(rows) and found[0] == found[1] == found[2]
    assert sum("items=[]" not in r for r in found[0]) == 5


def test_pipeline_keeps_one_row_of_each_group(spark):
    import corpus_pipeline

    def text(k):
        return " ".join(f"t{k}w{i}" for i in range(60))

    near = text(1).replace("t1w59", "changed")
    rows = [(3, text(1)), (3, text(1)), (9, near), (None, text(1)), (None, text(2)), (None, text(2)), (7, text(3)), (7, text(4)), (8, text(3)), (5, text(3)), (6, text(5)), (None, text(6)), (10, ""), (11, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("source", F.lit("s")).repartition(5)
    kept = corpus_pipeline.near_dedup(spark, docs, "")
    assert kept.columns == docs.columns
    want = [(3, text(1)), (None, text(2)), (7, text(4)), (5, text(3)), (6, text(5)), (None, text(6)), (10, ""), (11, None)]
    assert sorted(map(repr, ((r.doc_id, r.text) for r in kept.collect()))) == sorted(map(repr, want))
