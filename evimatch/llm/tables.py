"""Where intermediate tables go, and small helpers shared by the operators."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, else a folder of our own in a local run; an error elsewhere."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        at = "/tmp/evimatch-shared"
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


@contextmanager
def _dropping_shuffles(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what runs inside go as soon as it ends, since its result is on disk by then."""
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


#: Bytes of a batch of rows between Spark and Python, unless the session says otherwise: what a task holds twice, however long its rows.
ARROW_BYTES, _ARROW, _ARROW_DEFAULT = 4 << 20, "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"
#: Rows of two or three numbers that are broadcast at most: some 30 MB.
BROADCAST_ROWS = 400_000


class Scratch:
    """Tables written to the shared folder to cut lineage: a lost executor costs a re-read, not a re-computation.

    What is no longer read can be dropped; the folder is deleted when the JVM ends.
    """

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark = spark
        self.path = f"{shared_dir(spark)}/evimatch/{name}-{uuid.uuid4().hex[:12]}"
        self._at = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._at(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.deleteOnExit(self._at(self.path))
        if spark.conf.get(_ARROW, _ARROW_DEFAULT) == _ARROW_DEFAULT:
            spark.conf.set(_ARROW, str(ARROW_BYTES))

    def table(self, df: DataFrame, name: str) -> DataFrame:
        at = f"{self.path}/{name}"
        with _dropping_shuffles(self.spark):
            df.write.mode("overwrite").parquet(at)
        return self.spark.read.schema(df.schema).parquet(at)

    def drop(self, *names: str) -> None:
        """Delete tables that nothing reads any more."""
        for name in names:
            self._fs.delete(self._at(f"{self.path}/{name}"), True)


def has_rows(df: DataFrame) -> bool:
    return len(df.take(1)) > 0


def small(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """A written table of a few narrow columns, marked for broadcast if it has at most so many rows; else it is joined by a shuffle."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def fresh(df: DataFrame, name: str) -> str:
    """The name, with underscores before it until no column of df has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def place_of(df: DataFrame, name: str) -> int:
    """The place of a column by its name as Spark resolves it: as it is written, else in any case."""
    return df.columns.index(name) if name in df.columns else [c.lower() for c in df.columns].index(name.lower())


def columns(df: DataFrame) -> list[Column]:
    """All columns of df, whatever signs their names hold."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def whole_row(df: DataFrame) -> Column:
    """All columns of a row in one struct, where names of our own cannot meet theirs."""
    return F.struct(*columns(df))


def texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Just the id and the text, under names of our own, so that other columns cannot clash."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))
