"""Benchmark decontamination: windows of normalised benchmark words, broadcast as a hash set, scanned over every text.

The set is cut into blocks of at most BLOCK_WINDOWS windows, so what is broadcast never exceeds a fixed size however large the
benchmark is; each block costs one more scan of the texts.  A hash hit counts only if the words themselves are equal.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evimatch.llm import wordgrams as wg
from evimatch.llm.tables import Scratch, place_of, texts

#: Benchmark windows broadcast at once: about 120 bytes each with their words and item ids.
BLOCK_WINDOWS = 200_000
WINDOW = 10


def _windows_of_items(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words in wg.pieces(batch.column(1), wg.ALNUM, lower=True):
                h, counts = words.hashes(), words.counts
                item, k, key, text = [], [], [], []
                for d in range(words.n_texts):
                    n = min(size, int(counts[d]))
                    if not n:
                        continue
                    lo, hi = int(words.first[d]), int(words.first[d + 1])
                    c = wg.multipliers(n, n)
                    for at in range(lo, hi - n + 1):
                        item.append(batch.column(0)[words.row + d].as_py())
                        k.append(n)
                        key.append(int(wg.mix(np.array([(h[at : at + n] * c).sum(dtype=np.uint64)], dtype=np.uint64)).view(np.int64)[0]))
                        text.append(words.joined(at, at + n))
                yield pa.RecordBatch.from_arrays([pa.array(item, pa.string()), pa.array(k, pa.int32()), pa.array(key, pa.int64()), pa.array(text, pa.binary())], names=["item", "k", "h", "words"])

    return run


class _Block:
    """Windows of one block, by their number of words: sorted hashes, the words, and the items they belong to."""

    def __init__(self, rows: list) -> None:
        by_size: dict[int, list] = {}
        for r in rows:
            by_size.setdefault(r.k, []).append((np.int64(r.h).view(np.uint64), bytes(r.words), sorted(r.items)))
        self.tables = {}
        for k, own in by_size.items():
            own.sort(key=lambda x: (x[0], x[1]))
            self.tables[k] = (np.array([x[0] for x in own], dtype=np.uint64), [x[1] for x in own], [x[2] for x in own])


def _hits(words: wg.Words, block: _Block) -> tuple[np.ndarray, list[set[str]]]:
    """Which words are inside an occurrence of a window, and the items found in each text."""
    h = words.hashes()
    edge = np.zeros(len(h) + 1, dtype=np.int64)
    items: list[set[str]] = [set() for _ in range(words.n_texts)]
    for k, (keys, phrases, owners) in block.tables.items():
        grams, at = words.windows(h, k, k)
        lo = np.searchsorted(keys, grams)
        found = np.flatnonzero(keys[np.minimum(lo, len(keys) - 1)] == grams)
        for i in found:
            first = int(at[i])
            said = words.joined(first, first + k)
            j = int(lo[i])
            while j < len(keys) and keys[j] == grams[i]:  # windows with one hash and other words are told apart here
                if phrases[j] == said:
                    edge[first] += 1
                    edge[first + k] -= 1
                    items[int(np.searchsorted(words.first, first, "right")) - 1].update(owners[j])
                j += 1
    return np.cumsum(edge[:-1]) > 0, items


_FOUND = "n_words long, hits array<int>, items array<string>"


def _scan(block_of, again: bool, more: bool):
    """doc_id, text and, if again, what earlier blocks found -> doc_id, the text if more blocks follow, and what is found so far."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = block_of.value
        for batch in batches:
            for words in wg.pieces(batch.column(1), wg.ALNUM, lower=True):
                hit, items = _hits(words, block)
                hit_at = [np.flatnonzero(hit[lo:hi]).astype(np.int32) for lo, hi in zip(words.first[:-1], words.first[1:], strict=True)]
                own = batch.slice(words.row, words.n_texts)
                if again:
                    hit_at = [np.union1d(x, np.array(y, dtype=np.int32)) if y else x for x, y in zip(hit_at, own.column(3).to_pylist(), strict=True)]
                    items = [x.union(y) for x, y in zip(items, own.column(4).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        *own.columns[: 2 if more else 1],
                        pa.array(words.counts.astype(np.int64)),
                        pa.array(hit_at, pa.list_(pa.int32())),
                        pa.array([sorted(x) for x in items], pa.list_(pa.string())),
                    ],
                    names=["doc_id", *(["text"] if more else []), "n_words", "hits", "items"],
                )

    return run


def _blocks(scratch: Scratch, benchmark: DataFrame, item_col: str, item_text_col: str, window: int, block_windows: int) -> tuple[int, DataFrame]:
    """How many blocks of about ``block_windows`` there are, and the benchmark's distinct windows with their block."""
    bench = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(item_text_col).cast("string").alias("text"))
    windows = bench.mapInArrow(_windows_of_items(window), "item string, k int, h long, words binary")
    distinct = scratch.table(windows.groupBy("k", "h", "words").agg(F.collect_set("item").alias("items")), "windows")
    n_blocks = max(1, -(-distinct.count() // block_windows))
    return n_blocks, distinct.withColumn("block", F.pmod("h", F.lit(n_blocks)))


def _pass_by_pass(docs: DataFrame, scratch: Scratch, n: int, windows: DataFrame, step) -> DataFrame:
    """step(rows, block, i) for each block; between two the rows are written, so that one block at a time is held and broadcast."""
    for i in range(n):
        block = docs.sparkSession.sparkContext.broadcast(_Block(windows.where(F.col("block") == i).collect()))
        docs = step(docs, block, i)
        if i + 1 < n:
            docs = scratch.table(docs, f"after-{i}")
            block.destroy()
            scratch.drop(f"after-{i - 1}")
    return docs


def contamination(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """Per row of docs: doc_id, n_words, hits (positions of hit words), items (ids of items with occurring windows).

    Words are runs of ASCII letters (lower-cased), digits and non-ASCII characters.  A window is ``window`` consecutive words of
    an item; an item of fewer words, but not none, is one window.  A null or empty text has no words and so no hits.  Repeated
    items count once; an item with a null id still hits words but names no item.  An empty benchmark hits nothing.  Rows go from
    block to block as they are, with what was found so far, so null and repeated ids stay rows of their own.
    """
    scratch = Scratch(docs.sparkSession, "decontaminate")
    n, windows = _blocks(scratch, benchmark, item_col, item_text_col, window, block_windows)

    def step(found: DataFrame, block, i: int) -> DataFrame:
        more = i + 1 < n
        return found.mapInArrow(_scan(block, i > 0, more), f"doc_id long, {'text string, ' if more else ''}{_FOUND}")

    return _pass_by_pass(texts(docs, id_col, text_col), scratch, n, windows, step)


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns from what contamination() returns."""
    n_hit = F.size("hits").cast("long")
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def _clean_rows(block_of, at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = block_of.value
        for batch in batches:
            keep = np.ones(batch.num_rows, dtype=bool)
            for words in wg.pieces(batch.column(at), wg.ALNUM, lower=True):
                hit, _ = _hits(words, block)
                sums = np.concatenate(([0], np.cumsum(hit)))
                keep[words.row : words.row + words.n_texts] = sums[words.first[1:]] == sums[words.first[:-1]]
            yield batch.filter(pa.array(keep))

    return run


def clean(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """The rows of docs, all columns as they were, that hold no benchmark window; one pass for each block, no join.

    Null and empty texts hold none and stay; an empty benchmark leaves all rows.
    """
    scratch = Scratch(docs.sparkSession, "decontaminate")
    n, windows = _blocks(scratch, benchmark, item_col, item_text_col, window, block_windows)
    at = place_of(docs, text_col)
    return _pass_by_pass(docs, scratch, n, windows, lambda rows, block, i: rows.mapInArrow(_clean_rows(block, at), docs.schema))
