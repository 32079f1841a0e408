"""Substring dedup with repeated-phrase automata.

1. Anchors.  Every window of ``size`` words is represented by the smallest hash of its 5-word phrases.  Equal windows have equal
   anchors, and neighbouring windows mostly share one, so a text of n words has about n/5 runs of windows.  Anchors that occur
   in one text only cannot hold a recurring window and are dropped after a pre-aggregated count.
2. Segments.  The words under a run of windows whose anchor recurs.  Equal segments are told apart once, by a 128-bit key, with
   the smallest and largest doc_id that have them, so a passage in a third of all texts is one segment.
3. Automata.  Segments are dealt into shards by anchor, so every occurrence of a window in any text lies in a segment of one
   shard.  Each shard counts hashes of windows, compiles a window of each hash that two texts have into an Aho-Corasick automaton
   (pyahocorasick) and streams all its segments through it.  What the automaton finds says where a window stands, which texts
   hold it and which is the first; hashes only propose.  A proposed window that it does not find (another one with its hash was
   compiled) goes into a next automaton.  A shard's segments and bytes are bounded; the number of shards grows with the data.
4. Removal.  Each text gets the windows whose first holder is another, smaller doc_id, and drops the words they cover.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evimatch.llm import wordgrams as wg
from evimatch.llm.tables import Scratch, has_rows, texts

SIZE, PHRASE = 13, 5
#: Windows in one run: a text that says one phrase over and over is cut into runs of equal words, which are one segment.
MOST_WINDOWS = 64
#: Segments and bytes of text in one shard on average.
SHARD_SEGMENTS, SHARD_BYTES = 4_000, 8_000_000


def _runs(words: wg.Words, size: int, phrase: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of neighbouring windows with one anchor: (anchor, first word, number of windows, hash of the words under the run)."""
    h = words.hashes()
    _, at = words.windows(h, size)
    if not len(at):
        z = np.empty(0, dtype=np.int64)
        return z.astype(np.uint64), z, z, z.astype(np.uint64)
    n = len(h) - phrase + 1
    c = wg.multipliers(phrase, 21)
    p = h[:n] * c[0]
    for j in range(1, phrase):
        p += h[j : n + j] * c[j]
    p = wg.mix(p)
    least, width, want = p, 1, size - phrase + 1
    while width < want:  # sliding minimum over the window's phrases, doubling the width
        step = min(width, want - width)
        least = np.minimum(least[:-step], least[step:])
        width += step
    least = least[at]
    new = np.ones(len(at), dtype=bool)
    new[1:] = (least[1:] != least[:-1]) | (at[1:] != at[:-1] + 1)
    begun = np.flatnonzero(new)
    new |= (np.arange(len(at)) - np.repeat(begun, np.diff(np.append(begun, len(at))))) % MOST_WINDOWS == 0
    lo = np.flatnonzero(new)
    count = np.diff(np.append(lo, len(at)))
    first = at[lo]
    up, down = wg._POWERS.upto(len(h) + 1)
    total = np.zeros(len(h) + 1, dtype=np.uint64)
    np.cumsum((h ^ np.uint64(0xC2B2AE3D27D4EB4F)) * up[: len(h)], out=total[1:])
    under = wg.mix((total[first + count - 1 + size] - total[first]) * down[first] + count.astype(np.uint64))
    return least[lo], first, count, under


def _anchor_counts(size: int, phrase: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words in wg.pieces(batch.column(1)):
                anchor, first, _, _ = _runs(words, size, phrase)
                text = np.searchsorted(words.first, first, "right") - 1
                _, keep = np.unique(wg.mix(anchor + text.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_index=True)
                a, n = np.unique(anchor[keep], return_counts=True)  # once for each text, then summed over this piece
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(n.astype(np.int64))], names=["anchor", "n"])

    return run


def _run_rows(size: int, phrase: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for words in wg.pieces(batch.column(1)):
                anchor, first, count, under = _runs(words, size, phrase)
                text = np.searchsorted(words.first, first, "right") - 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array(anchor.view(np.int64)), pa.array(under.view(np.int64)), pa.array(ids[words.row + text].astype(np.int64)), pa.array((first - words.first[text]).astype(np.int64)), pa.array(count.astype(np.int64))],
                    names=["anchor", "under", "doc_id", "first", "windows"],
                )

    return run


def _segment_texts(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            asked = batch.column(2)
            for words in wg.pieces(batch.column(1)):
                out: list[tuple] = []
                for d in range(words.n_texts):
                    base, end = int(words.first[d]), int(words.first[d + 1])
                    for s in asked[words.row + d].as_py():
                        lo = base + s["first"]
                        if lo + s["windows"] + size - 1 <= end:
                            out.append((s["anchor"], s["under"], s["lo"], s["hi"], words.joined(lo, lo + s["windows"] + size - 1)))
                yield pa.RecordBatch.from_arrays([*(pa.array([x[i] for x in out], pa.int64()) for i in range(4)), pa.array([x[4] for x in out], pa.binary())], names=["anchor", "under", "lo", "hi", "words"])

    return run


class _Alphabet(dict):
    """A character for each word, so that a window is a string of as many characters as it has words."""

    def __missing__(self, word: bytes) -> str:
        n = len(self)
        c = self[word] = chr(n if n < 0xD800 else n + 0x800)  # surrogates are not characters
        return c


def _locate(size: int):
    def run(table: pa.Table) -> pa.Table:
        lo, hi = (table.column(c).to_numpy() for c in ("lo", "hi"))
        letters = _Alphabet()
        lines = ["".join(map(letters.__getitem__, w.split(b" "))) for w in table.column("words").to_pylist()]
        length = np.array([len(x) for x in lines], dtype=np.int64)
        line_at, window_at = (np.concatenate([[0], np.cumsum(x)]) for x in (length, length - size + 1))
        line = np.repeat(np.arange(len(lines)), length - size + 1)
        at = np.arange(window_at[-1]) - window_at[line]  # each window's place in its line
        codes = wg.mix(np.frombuffer("".join(lines).encode("utf-32-le"), dtype=np.uint32).astype(np.uint64))
        c = wg.multipliers(size, 22)
        h = np.zeros(len(at), dtype=np.uint64)
        for j in range(size):
            h += codes[line_at[line] + at + j] * c[j]
        least, most, which = _holders(np.unique(h, return_inverse=True)[1], lo[line], hi[line])
        recurs = (least < most)[which]

        phrase = np.full(len(at), -1, dtype=np.int64)  # the phrase that an automaton has found at each window
        n_phrases = 0
        while (left := np.flatnonzero(recurs & (phrase < 0))).size:  # again only for phrases that share their hash with another
            automaton = ahocorasick.Automaton()
            for w in left[np.unique(h[left], return_index=True)[1]].tolist():
                automaton.add_word(lines[line[w]][at[w] : at[w] + size], n_phrases)
                n_phrases += 1
            automaton.make_automaton()
            places, found = [], []
            for x, start in zip(lines, (window_at[:-1] - size + 1).tolist(), strict=True):
                for end, p in automaton.iter(x):
                    places.append(start + end)
                    found.append(p)
            phrase[places] = found

        seen = np.flatnonzero(phrase >= 0)
        least, most, which = _holders(phrase[seen], lo[line[seen]], hi[line[seen]], n_phrases)
        seen, holder = seen[(least < most)[which]], least[which][(least < most)[which]]  # the very words are in two texts at least
        held, holders = np.zeros(len(at), dtype=bool), np.zeros(len(at), dtype=np.int64)
        held[seen], holders[seen] = True, holder
        lists = pa.LargeListArray.from_arrays(pa.array(window_at), pa.array(holders, mask=~held)).cast(pa.list_(pa.int64()))
        hit = pa.array(np.bincount(line[seen], minlength=len(lines)) > 0)
        return pa.table({"anchor": table.column("anchor"), "under": table.column("under"), "holders": lists}).filter(hit)

    return run


def _holders(which: np.ndarray, lo: np.ndarray, hi: np.ndarray, n: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The smallest and largest doc_id of each phrase, and ``which`` again."""
    n = int(which.max(initial=-1)) + 1 if n is None else n
    ends = np.iinfo(np.int64)
    least, most = np.full(n, ends.max), np.full(n, ends.min)
    np.minimum.at(least, which, lo)
    np.maximum.at(most, which, hi)
    return least, most, which


_HELD = "anchor long, under long, holders array<long>"


def _held_by_window(said: DataFrame, scratch: Scratch, size: int, shard_segments: int) -> DataFrame:
    """The same answer for anchors with more segments than a shard takes: their windows are dealt out by their own words."""
    split = said.withColumn("w", F.split(F.col("words").cast("string"), " "))
    each = F.expr(f"transform(sequence(0, size(w) - {size}), i -> array_join(slice(w, i + 1, {size}), ' '))")
    windows = scratch.table(split.select("anchor", "under", "lo", "hi", F.posexplode(each).alias("i", "words")), "hot-windows")
    distinct = scratch.table(windows.groupBy("words").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).where("lo < hi"), "hot-distinct")
    shards = max(1, -(-distinct.count() // shard_segments))
    keyed = distinct.select(F.xxhash64("words").alias("anchor"), F.crc32(F.col("words").cast("binary")).alias("under"), "lo", "hi", F.col("words").cast("binary").alias("words"))
    found = keyed.withColumn("shard", F.pmod("anchor", F.lit(shards))).groupBy("shard").applyInArrow(_locate(size), _HELD)
    found = found.select(F.col("anchor").alias("h1"), F.col("under").alias("h2"), F.col("holders")[0].alias("holder"))
    back = windows.withColumn("h1", F.xxhash64("words")).withColumn("h2", F.crc32(F.col("words").cast("binary"))).join(found, ["h1", "h2"], "left")
    grouped = back.groupBy("anchor", "under").agg(F.array_sort(F.collect_list(F.struct("i", "holder"))).alias("x"))
    return scratch.table(grouped.select("anchor", "under", F.expr("transform(x, y -> y.holder)").alias("holders")).where("exists(holders, h -> h is not null)"), "hot-held")


def _kept_words(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = batch.column(2)
            for words in wg.pieces(batch.column(1)):
                n = words.counts.astype(np.int64)
                removed, sums, left = np.zeros(len(n), dtype=np.int64), [], []
                for d in range(words.n_texts):
                    lo, hi = int(words.first[d]), int(words.first[d + 1])
                    at = spans[words.row + d]
                    keep = np.ones(hi - lo, dtype=bool)
                    if at.is_valid:
                        starts = np.concatenate([x.values.to_numpy() for x in at.values]) if len(at.values) else np.empty(0, dtype=np.int32)
                        edge = np.zeros(hi - lo + size + 1, dtype=np.int64)
                        starts = starts[starts + size <= hi - lo]
                        np.add.at(edge, starts, 1)
                        np.add.at(edge, starts + size, -1)
                        keep = np.cumsum(edge)[: hi - lo] == 0
                    removed[d] = (~keep).sum()
                    own = np.flatnonzero(keep) + lo
                    text = b" ".join(words.data[s:e].tobytes() for s, e in zip(words.starts[own].tolist(), words.ends[own].tolist(), strict=True))
                    sums.append(hashlib.sha256(text).hexdigest())
                    left.append(text)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(words.row, words.n_texts), pa.array(n), pa.array(removed), pa.array(sums, pa.string()), pa.array(left, pa.binary()).cast(pa.string())],
                    names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"],
                )

    return run


def repeated_passages(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, phrase: int = PHRASE, shard_segments: int = SHARD_SEGMENTS) -> DataFrame:
    """Per row: doc_id, n_words, n_removed, kept_sha256, kept_text (kept words joined by one space).

    A window is ``size`` consecutive words of one text.  A word goes if a window that covers it also starts in a text with a
    smaller doc_id; windows are judged on the input.  Words are kept as they are (case, punctuation).

    A null or empty text has no words.  A row with a null id is compared with nothing and keeps all its words.  Repeated rows
    (one id, one text) are one text and get the same result; were texts of one id to differ, spans found in any are removed from
    each as far as they fit.  Recurrence inside one text alone removes nothing.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "passages")
    own = texts(docs, id_col, text_col)
    named = own.where("doc_id is not null")
    counts = named.mapInArrow(_anchor_counts(size, phrase), "anchor long, n long")
    recurring = scratch.table(counts.groupBy("anchor").agg(F.sum("n").alias("n")).where("n > 1").select("anchor"), "recurring")
    runs = named.mapInArrow(_run_rows(size, phrase), "anchor long, under long, doc_id long, first long, windows long")
    runs = scratch.table(runs.join(recurring, "anchor", "left_semi"), "runs")
    segments = runs.groupBy("anchor", "under").agg(F.min(F.struct("doc_id", "first", "windows")).alias("src"), F.max("doc_id").alias("hi"))
    asked = segments.groupBy(F.col("src.doc_id").alias("doc_id")).agg(F.collect_list(F.struct("anchor", "under", "src.first", "src.windows", F.col("src.doc_id").alias("lo"), "hi")).alias("asked"))
    said = scratch.table(named.join(asked, "doc_id").mapInArrow(_segment_texts(size), "anchor long, under long, lo long, hi long, words binary"), "segments")
    out = own.withColumn("spans", F.lit(None).cast("array<array<int>>"))
    n, size_of = said.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("words")), F.lit(0))).first()
    if n:
        shards = max(1, -(-n // shard_segments), -(-size_of // SHARD_BYTES))
        hot = scratch.table(said.groupBy("anchor").count().where(F.col("count") > shard_segments).select("anchor"), "hot")
        crowded = has_rows(hot)
        placed = (said.join(hot, "anchor", "left_anti") if crowded else said).withColumn("shard", F.pmod(F.xxhash64("anchor"), F.lit(shards)))
        held = scratch.table(placed.groupBy("shard").applyInArrow(_locate(size), _HELD), "held")
        if crowded:
            held = held.union(_held_by_window(said.join(hot, "anchor", "left_semi"), scratch, size, shard_segments))
        if has_rows(held):
            gone = "filter(transform(holders, (x, i) -> if(x < doc_id, cast(first + i as int), null)), x -> x is not null)"
            spans = runs.join(held, ["anchor", "under"]).select("doc_id", F.expr(gone).alias("at")).where("size(at) > 0")
            spans = spans.groupBy("doc_id").agg(F.collect_list("at").alias("spans"))
            out = own.join(spans, "doc_id", "left").select("doc_id", "text", "spans")
    return out.mapInArrow(_kept_words(size), "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string")
