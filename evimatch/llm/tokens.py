"""Token-ID output: Arrow stream files of fixed-size-list batches, with masks, and their reader.

Texts are dealt into ranges of the order column, sorted within, encoded, laid end to end and cut into sequences of equal length.
A file holds batches of two columns, ``ids`` (fixed-size list of unsigned 16- or 32-bit ids) and ``mask`` (fixed-size list of
0/1, 0 on the padding behind the last id).  Every batch but the last has the same number of sequences and, being plain values, the
same number of bytes.  A stream has no footer, but with one stride for all batches sequence i is found by division: SequenceFile
reads it from a memory-mapped file without a copy.  Beside the files an index table tells where each text lies.

A task writes a file under a name of its own and reports the name with its rows; the index, written by Spark, is what counts.  A
task that is repeated after a lost executor writes another file and the first is not referred to.  Files and index lie in the folder
asked for; without one in the shared folder, until the session ends.
"""

from __future__ import annotations

import json
import os
import re
import uuid
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
from pyspark import TaskContext
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evimatch.llm.tables import Scratch, partitions
from evimatch.llm.wordids import Learnt, Lines, Words, flat

SEQUENCE, BATCH = 1024, 256
END_ID = 1


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    """Path of a public tokenizer file on the executors."""
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=1)
def _loaded(path: str):
    """The tokenizer, which a Python worker keeps for its next tasks, and whether the short way holds for it."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks already use every core
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    normalizer, split = (json.loads(x.__getstate__()) if x else {} for x in (tokenizer.normalizer, tokenizer.pre_tokenizer))
    first = split.get("pretokenizers", [split])[0]
    return tokenizer, normalizer == _NORMALIZER and first.get("pattern", {}).get("Regex") == _PATTERN


class Encoder:
    """Encodes whole texts by their distinct words, remembering what the tokenizer gave.

    No token or rule of this kind of tokenizer (white space dropped, parts split by a pattern, BPE inside a part) reaches over
    ASCII white space, so a text's ids are its words' ids in order.  The pattern parts letters from marks behind them too, so most words
    are two runs in lower case, which go to the library's BPE model when they are new; other words, such as those with digits or
    apostrophes, go through the whole tokenizer.  Tests compare both ways with encoding whole texts.
    """

    def __init__(self, path: str, kind: str) -> None:
        self.tokenizer, self.short = _loaded(path)
        self.words = Words((kind,), self._word_ids, self._run_ids(Lines(self.tokenizer)) if self.short else None, lower=True)

    def _word_ids(self, words: list[str]) -> Learnt:
        return [flat([e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)])], None

    @staticmethod
    def _run_ids(lines: Lines) -> Callable[[list[str]], Learnt]:
        return lambda runs: ([lines.ids(runs)], None)

    def encode(self, texts: list[bytes] | pa.Array) -> list[bytes]:
        """Each text's ids as little-endian bytes, without the end id; a null text has none."""
        held = pa.array([x.decode() for x in texts], pa.string()) if isinstance(texts, list) else texts.cast(pa.string())
        words = pc.ascii_split_whitespace(held.fill_null(""))
        ((ids, at),), _ = self.words.ids(words.flatten())
        at = at[np.asarray(words.offsets)].tolist()
        return [ids[lo:hi].tobytes() for lo, hi in pairwise(at)]


@lru_cache(maxsize=1)
def _encoder(path: str, kind: str) -> Encoder:
    """A Python worker keeps it, with what it remembers, for its next tasks."""
    return Encoder(path, kind)


#: The parts of the public tokenizer file for which the short way holds; with others every word goes the long way.
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
_PATTERN = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"


def _open(path: str, write: bool):
    path = re.sub("^s3[an]://", "s3://", path)  # one store under Spark's name and Arrow's
    if "://" in path or path.startswith("file:"):
        fs, at = pyarrow.fs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))
    else:
        fs, at = pyarrow.fs.LocalFileSystem(), path
    if write:
        fs.create_dir(at.rsplit("/", 1)[0], recursive=True)
        return fs.open_output_stream(at)
    return pa.memory_map(at) if isinstance(fs, pyarrow.fs.LocalFileSystem) else fs.open_input_file(at)


class _Writer:
    def __init__(self, path: str, kind: str, sequence: int, batch: int) -> None:
        self.kind, self.sequence, self.batch = np.dtype(kind), sequence, batch
        self.schema = pa.schema([("ids", pa.list_(pa.from_numpy_dtype(self.kind), sequence)), ("mask", pa.list_(pa.bool_(), sequence))])
        self.file = _open(path, True)
        self.stream = pa.ipc.new_stream(self.file, self.schema)
        self.left, self.held = [], 0

    def add(self, ids: bytes) -> None:
        self.left.append(ids)
        self.held += len(ids) // self.kind.itemsize
        if self.held >= 4 * self.sequence * self.batch:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        ids = np.frombuffer(b"".join(self.left), dtype=self.kind)
        step = self.sequence * self.batch
        for lo in range(0, len(ids) if last else len(ids) - len(ids) % step, step):
            own = ids[lo : lo + step]
            pad = -len(own) % self.sequence
            mask = np.ones(len(own) + pad, dtype=bool)
            mask[len(own) :] = False
            own = np.concatenate((own, np.zeros(pad, dtype=self.kind))) if pad else own
            self.stream.write_batch(pa.RecordBatch.from_arrays([pa.FixedSizeListArray.from_arrays(pa.array(own), self.sequence), pa.FixedSizeListArray.from_arrays(pa.array(mask), self.sequence)], schema=self.schema))
        rest = ids[len(ids) - len(ids) % step :]
        self.left, self.held = [rest.tobytes()], len(rest)

    def close(self) -> None:
        self._flush(True)
        self.stream.close()
        self.file.close()


def _write(folder: str, path: str, kind: str, end_id: int, sequence: int, batch: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, writer, at = None, None, 0
        part = TaskContext.get().partitionId()
        name = f"{folder}/part-{part:06d}-{uuid.uuid4().hex[:12]}.arrows"
        end = np.array([end_id], dtype=kind).tobytes()
        for b in batches:
            if not b.num_rows:
                continue
            if writer is None:
                encoder, writer = _encoder(path, kind), _Writer(name, kind, sequence, batch)
            first, n = [], []
            for ids in encoder.encode(b.column(1)):
                writer.add(ids + end)
                first.append(at)
                n.append(len(ids) // len(end) + 1)
                at += n[-1]
            rows = b.num_rows
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(np.full(rows, part, dtype=np.int64)), pa.array([name] * rows, pa.string()), pa.array(first, pa.int64()), pa.array(n, pa.int64())], names=["doc_id", "part", "file", "at", "n_tokens"]
            )
        if writer is not None:
            writer.close()

    return run


class SequenceFile:
    """Random access to the sequences of one file: ids and masks are views of the mapped file, nothing is copied or read ahead."""

    def __init__(self, path: str) -> None:
        self.map = _open(path, False)
        self.schema = pa.ipc.read_schema(self.map)
        self.first = self.map.tell()
        message = pa.ipc.read_message(self.map) if self.map.size() > self.first + 8 else None
        whole = pa.ipc.read_record_batch(message, self.schema) if message is not None else None
        self.batch, self.stride = (len(whole), self.map.tell() - self.first) if whole is not None else (1, 1)

    def sequence(self, i: int) -> tuple[np.ndarray, pa.BooleanArray]:
        """ids and mask of sequence i, from 0; IndexError beyond the last."""
        block, row = divmod(i, self.batch)
        at = self.first + block * self.stride
        if i < 0 or at + 8 >= self.map.size():  # the last eight bytes end the stream
            raise IndexError(i)
        self.map.seek(at)
        found = pa.ipc.read_record_batch(pa.ipc.read_message(self.map), self.schema)
        if row >= len(found):
            raise IndexError(i)
        ids, mask = (c.flatten() for c in found.slice(row, 1).columns)
        return ids.to_numpy(zero_copy_only=True), mask


def write_tokens(
    docs: DataFrame, *, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, end_id: int = END_ID, vocabulary_size: int = 49_408, sequence: int = SEQUENCE, batch: int = BATCH, order: list[Column] | None = None
) -> DataFrame:
    """Write the files; returns their index: doc_id, part, file, at (first id within the part), n_tokens (with the end id).

    Texts are laid in ascending order of id (null ids first, equal ids in the order of their texts), or in the order of the given
    columns of docs.  Files and index go to the folders files and index in ``path``, which must be new, and stay there.  A null or
    empty text is the end id alone.  Repeated rows are written each.  An empty table writes no file.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "tokens")
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *[c.alias(f"o{i}") for i, c in enumerate(order or [])])
    by = [f"o{i}" for i in range(len(order))] if order else ["doc_id", "text"]
    own = own.repartitionByRange(partitions(spark), *by[: len(order) if order else 1]).sortWithinPartitions(*by).select("doc_id", "text")
    kind = "uint16" if vocabulary_size <= 1 << 16 else "uint32"
    index = own.mapInArrow(_write(f"{path or scratch.path}/files", tokenizer or vocabulary(), kind, end_id, sequence, batch), "doc_id long, part long, file string, at long, n_tokens long")
    if path is None:
        return scratch.table(index, "index")
    index.write.parquet(f"{path}/index")
    return spark.read.schema(index.schema).parquet(f"{path}/index")


def as_stored(docs: DataFrame) -> list[Column]:
    """The order in which Spark wrote the rows of a table, for rows read straight from its files; for others the order they lie in."""
    try:
        return [docs["_metadata.file_path"], docs["_metadata.row_index"]]
    except AnalysisException:
        return [F.monotonically_increasing_id()]


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per text: the crc of its ids, read from its file; only the batches that hold the text are touched."""
    name, stream, held, base = None, None, np.empty(0, dtype=np.uint16), 0
    for b in batches:
        crc = []
        for file, at, n in zip(*(b.column(c).to_pylist() for c in ("file", "at", "n_tokens")), strict=True):
            if file != name or at < base:
                name, base = file, 0
                stream = pa.ipc.open_stream(_open(file, False))
                held = np.empty(0, dtype=np.uint16)
            while base + len(held) < at + n:
                ids, mask = stream.read_next_batch().columns
                ids, width = ids.flatten().to_numpy(), ids.type.list_size
                last = mask.slice(len(mask) - 1, 1).flatten().to_numpy(zero_copy_only=False)
                ids = ids[: len(ids) - int(width - last.sum())]
                if base + len(held) <= at:
                    base += len(held)
                    held = ids
                else:
                    skip = max(0, at - base)
                    held, base = np.concatenate((held[skip:], ids)), base + skip
            own = held[at - base : at - base + n]
            if len(own) != n:
                raise ValueError(f"{file} ends before its index says")
            crc.append(zlib.crc32(own.astype("<u4").tobytes()))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(3), b.column(4), pa.array(crc, pa.int64())], names=["doc_id", "part", "at", "n_tokens", "ids_crc32"])


def read_tokens(index: DataFrame) -> DataFrame:
    """Read the files back: doc_id, start (ids of all texts before it), n_tokens, ids_crc32.

    What lies before each part is summed from the index, one row a part.
    """
    index = index.repartition(partitions(index.sparkSession), "file").sortWithinPartitions("file", "at")
    read = index.mapInArrow(_read, "doc_id long, part long, at long, n_tokens long, ids_crc32 long")
    parts = index.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))  # one row a part: as few as tasks
    return read.join(before, "part").select("doc_id", (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")
