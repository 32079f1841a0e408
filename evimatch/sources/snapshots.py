"""A dated catalogue: of every set the newest snapshot at a day, as a data source that opens only the sets asked for.

A snapshot is a folder ``day=<ISO day>/set_name=<set>/`` of Parquet files; a day may bring some sets only, and what a set's newest
snapshot lacks is gone.  Each file is a partition of its own, read batch by batch.  The driver lists names of files, days times sets at
most.  The folder has to be one that executors reach by pyarrow: a shared path, or an address whose file system pyarrow has.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from urllib.parse import unquote

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

FORMAT = "catalogue_snapshots"
#: The columns of a snapshot beside set_name, which its folder gives.
CARD = pa.schema([("id", pa.int64()), ("name", pa.string()), ("num", pa.int32()), ("den", pa.int32()), ("hp", pa.int32()), ("year", pa.int32())])
_NO_SET = "__HIVE_DEFAULT_PARTITION__"
_PUSHDOWN = "spark.sql.python.filterPushdown.enabled"


def _open(path: str) -> tuple[fs.FileSystem, str]:
    if path.startswith("/"):
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(re.sub("^file:/(?!/)", "file:///", re.sub("^s3a:", "s3:", path)))


class SnapshotReader(DataSourceReader):
    def __init__(self, path: str, as_of: str) -> None:
        self.path, self.as_of = path, as_of
        self.sets: set | None = None  # the sets asked for; None for all

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Takes over what names sets outright; Spark applies the rest."""
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == ("set_name",):
                asked = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.sets = (asked if self.sets is None else self.sets & asked) - {None}
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        files, root = _open(self.path)
        inside = lambda at: sorted(files.get_file_info(fs.FileSelector(at, allow_not_found=True)), key=lambda x: x.base_name)
        newest: dict[str, str] = {}
        for day in inside(root):
            if day.base_name.startswith("day=") and day.base_name[4:] <= self.as_of:
                newest |= {x.base_name[9:]: x.path for x in inside(day.path) if x.base_name.startswith("set_name=")}
        found = []
        for escaped, at in newest.items():
            name = None if escaped == _NO_SET else unquote(escaped)
            if self.sets is None or name in self.sets:
                found += [InputPartition((name, x.path)) for x in inside(at) if x.base_name.endswith(".parquet")]
        return found

    def read(self, partition: InputPartition | None) -> Iterator[pa.RecordBatch]:
        if partition is None or partition.value is None:  # no snapshot at that day
            return
        name, at = partition.value
        files, _ = _open(self.path)
        with files.open_input_file(at) as f:
            for batch in pq.ParquetFile(f).iter_batches(batch_size=10_000):
                columns = [batch.column(c.name).cast(c.type) if c.name in batch.schema.names else pa.nulls(batch.num_rows, c.type) for c in CARD]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([name] * batch.num_rows, pa.string())], names=[*CARD.names, "set_name"])


class CatalogueSnapshots(DataSource):
    """Options: path, as_of (an ISO day; the last one without it)."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "id long, name string, num int, den int, hp int, year int, set_name string"

    def reader(self, schema) -> SnapshotReader:
        return SnapshotReader(self.options["path"], self.options.get("as_of", "9999-12-31"))


def write_snapshot(cards: DataFrame, path: str, day: str) -> None:
    """Cards with set_name as the snapshot of a day; a day that is written again is replaced whole."""
    cards.select(*[F.col(c.name) for c in CARD], "set_name").write.mode("overwrite").partitionBy("set_name").parquet(f"{path}/day={day}")


def cards_as_of(spark: SparkSession, path: str, as_of: str | None = None) -> DataFrame:
    """The catalogue as it was on a day, for ``search`` and all else that takes cards.  No snapshot by then: no rows.

    Turns filter pushdown to Python sources on for the session.
    """
    spark.conf.set(_PUSHDOWN, "true")
    spark.dataSource.register(CatalogueSnapshots)
    read = spark.read.format(FORMAT)
    return (read.option("as_of", as_of) if as_of else read).load(path)
