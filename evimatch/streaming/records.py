"""Records of cards as their readings arrive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evimatch.operators import assembly

#: What a reading brings: the strips' text and how surely it was read, and the words of both sides.
READING = "card_id long, text string, top_conf double, bottom_conf double, words array<struct<side:string,word_id:long,text:string,conf:double,x0:double,y0:double,x1:double,y1:double>>"


def appender(cards: DataFrame, sets: DataFrame, path: str, card_height: float = 1000.0) -> Callable[[DataFrame, int], None]:
    """For foreachBatch on a stream of READING: a batch's records go to a folder of its own under path.

    A batch that is repeated after a failure writes its folder anew, so no record comes twice and none is lost.
    """

    def append(readings: DataFrame, batch_id: int) -> None:
        words = readings.select("card_id", F.explode("words").alias("w")).select("card_id", "w.*")
        done = assembly.records(readings.drop("words"), words, cards, sets, card_height)
        done.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return append


def latest(spark: SparkSession, path: str) -> DataFrame:
    """One record a card: that of the last batch which read it."""
    found = spark.read.parquet(path)
    fields = [c for c in found.columns if c not in ("batch", "card_id")]
    return found.groupBy("card_id").agg(F.max_by(F.struct(*fields), "batch").alias("r")).select("card_id", "r.*")
