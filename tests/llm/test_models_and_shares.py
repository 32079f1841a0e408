"""Held-out accuracy and calibration of the classifier, and the shares that mixing reaches."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from evimatch.llm import mixing, quality
from evimatch.llm.oracles import MIX_WEIGHTS

SF = "/root/testdata/sf0.1"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def held_out(spark):
    """(accuracy, accuracy of always saying good, calibration error in ten bins) on a fifth of the labels that training does not see."""
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    away = F.pmod(F.xxhash64("doc_id", F.lit("held")), F.lit(5)) == 0
    model = quality.train(docs, labels.where(~away))
    scored = quality.quality(docs.join(labels.where(away).select("doc_id"), "doc_id", "left_semi"), model)
    rows = scored.join(labels, "doc_id").select("p_good", "quality").collect()
    p, y = np.array([r.p_good for r in rows]), np.array([r.quality for r in rows])
    bins = np.minimum((p * 10).astype(int), 9)
    error = sum(abs(p[bins == b].mean() - y[bins == b].mean()) * (bins == b).sum() for b in range(10) if (bins == b).any()) / len(p)
    return float(((p >= 0.5) == (y > 0)).mean()), float(y.mean()), float(error)


def test_held_out_labels(spark):
    right, always, error = held_out(spark)
    print(f"held out: accuracy {right:.4f}, share of good rows {always:.4f}, calibration error {error:.4f}")
    assert right >= always + 0.02 and error <= 0.1


def test_shares_reach_the_weights(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r.source: r.b for r in mixing.mix(docs, MIX_WEIGHTS, default=1.0).groupBy("source").agg(F.sum(F.octet_length("text")).alias("b")).collect()}
    sources = [r.source for r in docs.select("source").distinct().collect()]
    weights = {s: MIX_WEIGHTS.get(s, 1.0) for s in sources}
    for s in sources:
        share, target = got.get(s, 0) / sum(got.values()), weights[s] / sum(weights.values())
        assert abs(share - target) <= 0.25 * target + 0.002, (s, share, target)
    assert "src3" not in got and abs(got["src0"] / sum(got.values()) - 4 / sum(weights.values())) < 0.02
