"""Quality rules: plain text statistics and a logistic regression on hashed word and character n-grams.

The model is trained on labelled rows (at most TRAIN_ROWS of them and TRAIN_BYTES of text, chosen by a hash of their id, so the choice
does not depend on how rows lie in files), its scores are turned into probabilities on rows kept out of training, and every text is scored in
Arrow batches against a fixed threshold.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evimatch.llm import wordgrams as wg
from evimatch.llm.tables import place_of, texts

#: The bounds on what training reads: labelled rows, and bytes of all their texts together.  Scoring has no such bound.
TRAIN_ROWS, TRAIN_BYTES = 2_500, 64_000_000
DIM = 1 << 18
#: Least calibrated probability of good quality for a text to stay.
KEEP_AT = 0.5
#: Word n-grams of 1 and 2 words; character n-grams of 2, 3 and 4 bytes inside and across words.
WORD_SIZES, CHAR_SIZES = (1, 2), (2, 3, 4)
_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True


def _features(words: wg.Words) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each kind of n-gram: (bucket of each n-gram, text of each n-gram)."""
    h, text = words.hashes(), words.text_of_words()
    for j, k in enumerate(WORD_SIZES):
        g, at = words.windows(h, k, 40 + k)
        yield (g >> np.uint64(46)).astype(np.int32), text[at]
    data = words.data.astype(np.uint32)
    of_byte = np.repeat(np.arange(words.n_texts), np.diff(words.offsets))
    for k in CHAR_SIZES:
        n = len(data) - k + 1
        if n <= 0:
            continue
        g = data[:n].copy()
        for j in range(1, k):
            g = g * np.uint32(257) + data[j : n + j]
        g = (g * np.uint32(2654435761) + np.uint32(k * 40503)) * np.uint32(0x9E3779B1)
        at = np.flatnonzero(of_byte[:n] == of_byte[k - 1 :])
        yield (g[at] >> np.uint32(14)).astype(np.int32), of_byte[at]


def _score(words: wg.Words, weights: np.ndarray, bias: float) -> np.ndarray:
    """Sum over kinds of the mean weight of the text's n-grams, plus the bias."""
    out = np.full(words.n_texts, bias)
    for kind, (bucket, text) in enumerate(_features(words)):
        total = np.bincount(text, weights=weights[kind][bucket], minlength=words.n_texts)
        out += total / np.maximum(1, np.bincount(text, minlength=words.n_texts))
    return out


@dataclass
class Model:
    """Weights by kind of n-gram, and the calibration: probability = 1 / (1 + exp(-(slope * score + shift)))."""

    weights: np.ndarray
    bias: float
    slope: float = 1.0
    shift: float = 0.0

    def probability(self, score: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * score + self.shift, -40, 40)))


class _Grams:
    """Each training row's n-grams as (bucket, count) by kind, four bytes each, in a file: the driver holds those of one row at a time."""

    def __init__(self) -> None:
        self.file, self.end = tempfile.TemporaryFile(), 0
        self.at: list[tuple[int, list[int]]] = []  # of each row: where it begins, and the n-grams of each kind

    def __len__(self) -> int:
        return len(self.at)

    def add(self, text: str) -> None:
        begin, sizes = self.end, []
        for words in wg.pieces(pa.array([text], pa.string())):
            for bucket, _ in _features(words):
                for x in np.unique(bucket, return_counts=True):
                    self.end += self.file.write(x.astype(np.uint32).tobytes())
                sizes.append((self.end - begin) // 8 - sum(sizes))
        self.at.append((begin, sizes))

    def shares(self, i: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """Row i's n-grams as (bucket, share of its kind) by kind."""
        begin, sizes = self.at[i]
        self.file.seek(begin)
        own = np.frombuffer(self.file.read(8 * sum(sizes)), dtype=np.uint32)
        out, lo = [], 0
        for n in sizes:
            ids, counts = own[lo : lo + n], own[lo + n : lo + 2 * n]
            out.append((ids.astype(np.int64), counts / max(1, counts.sum())))
            lo += 2 * n
        return out


def fit(rows: _Grams, good: np.ndarray, *, epochs: int = 12, rate: float = 8.0, seed: int = 1) -> Model:
    """Logistic regression by AdaGrad on four fifths of the rows; Platt calibration on the last fifth."""
    kinds = len(WORD_SIZES) + len(CHAR_SIZES)
    w, seen = np.zeros((kinds, DIM)), np.full((kinds, DIM), 1e-2)
    bias, seen_bias = 0.0, 1e-2
    held = np.arange(len(rows)) % 5 == 4
    train = np.flatnonzero(~held)
    balance = np.where(good > 0, 0.5 / max(1e-9, good[train].mean()), 0.5 / max(1e-9, 1 - good[train].mean())) if len(train) else np.ones(len(rows))
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(train):
            own = rows.shares(i)
            s = bias + sum(w[k, ids] @ share for k, (ids, share) in enumerate(own))
            g = (1 / (1 + np.exp(-np.clip(s, -40, 40))) - good[i]) * balance[i]
            for k, (ids, share) in enumerate(own):
                step = g * share
                seen[k, ids] += step * step
                w[k, ids] -= rate * step / np.sqrt(seen[k, ids]) * 0.05
            seen_bias += g * g
            bias -= 0.05 * rate * g / np.sqrt(seen_bias) * 0.2
    model = Model(w.astype(np.float32), float(bias))
    score = np.array([bias + sum(w[k, ids] @ share for k, (ids, share) in enumerate(rows.shares(i))) for i in range(len(rows))])
    at = np.flatnonzero(held) if held.sum() >= 20 else np.arange(len(rows))
    a, b = 1.0, 0.0
    for _ in range(300):  # two parameters, convex
        p = 1 / (1 + np.exp(-np.clip(a * score[at] + b, -40, 40)))
        d = p - good[at]
        curve = p * (1 - p) + 1e-6
        hessian = np.array([[(curve * score[at] ** 2).sum() + 1e-3, (curve * score[at]).sum()], [(curve * score[at]).sum(), curve.sum() + 1e-3]])
        step = np.linalg.solve(hessian, np.array([(d * score[at]).sum() + 1e-3 * (a - 1), d.sum()]))
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-9:
            break
    model.slope, model.shift = float(max(a, 1e-3)), float(b)
    return model


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", most: int = TRAIN_ROWS, most_bytes: int = TRAIN_BYTES) -> Model | None:
    """Fit on at most ``most`` labelled rows.  None where there are not two classes to tell apart.

    The chosen rows are those with the smallest hash of their id, as far as their texts have ``most_bytes`` bytes together; no text is
    too long as such.  An id counts once, whatever rows repeat it (the least of its texts, the best of its labels).  Rows with a null id,
    text or label are left out of training (they are scored like all others).
    """
    marks = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("good")).where("doc_id is not null and good is not null")
    chosen = marks.groupBy("doc_id").agg(F.max("good").alias("good")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    own = texts(docs, id_col, text_col).where("text is not null")
    once = own.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "good").agg(F.min("text").alias("text"))  # chosen holds at most ``most`` rows
    so_far = F.sum(F.octet_length("text")).over(Window.orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, 0))
    rows, marks = _Grams(), []
    for r in once.withColumn("so_far", so_far).where(F.col("so_far") <= most_bytes).select("doc_id", "good", "text").toLocalIterator():
        rows.add(r.text)
        marks.append((r.doc_id, float(r.good > 0)))
    ids, good = np.array([i for i, _ in marks], dtype=np.int64), np.array([x for _, x in marks])
    order = np.argsort(ids)[np.random.default_rng(7).permutation(len(ids))]
    if len(set(good)) < 2:
        return None
    rows.at = [rows.at[i] for i in order]
    return fit(rows, good[order])


def _dup_lines(text: str) -> int:
    seen: set[str] = set()
    n = 0
    for line in text.split("\n"):
        if line in seen:
            n += 1
        elif line.strip(" \t\n\x0b\x0c\r"):
            seen.add(line)
    return n


def _repeat_words(words: wg.Words, h: np.ndarray) -> np.ndarray:
    """Per text: words inside 3-word windows that the text has twice or more."""
    grams, at = words.windows(h, 3, 9)
    text = words.text_of_words()
    own = wg.mix(grams + text[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(own, kind="stable")
    s = own[order]
    same = np.zeros(len(s) + 1, dtype=bool)
    same[1:-1] = s[1:] == s[:-1]
    twice = np.sort(at[order[same[1:] | same[:-1]]])
    cover = np.zeros(len(h) + 1, dtype=np.int64)
    np.add.at(cover, twice, 1)
    np.add.at(cover, twice + 3, -1)
    return np.bincount(text, weights=np.cumsum(cover[:-1]) > 0, minlength=words.n_texts).astype(np.int64)


def _rules(model_of, keep_at: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_of.value
        for batch in batches:
            for words in wg.pieces(batch.column(1)):
                h, n = words.hashes(), words.counts.astype(np.int64)
                starts_char = np.cumsum(np.concatenate(([0], (words.data & 0xC0) != 0x80)))
                per_word = starts_char[words.ends] - starts_char[words.starts]
                word_chars = np.bincount(words.text_of_words(), weights=per_word, minlength=words.n_texts).astype(np.int64)
                symbols = np.cumsum(np.concatenate(([0], _SYMBOL[words.data])))
                n_symbols = symbols[words.offsets[1:]] - symbols[words.offsets[:-1]]
                repeat = _repeat_words(words, h)
                whole = words.data.tobytes()
                lines = np.array([_dup_lines(whole[lo:hi].decode("utf-8", "replace")) for lo, hi in zip(words.offsets[:-1].tolist(), words.offsets[1:].tolist(), strict=True)], dtype=np.int64)
                failed = (n < 50) | (100 * repeat > 50 * n)
                good = model.probability(_score(words, model.weights, model.bias)) if model is not None else np.ones(len(n))
                kept = ~failed & (good >= keep_at)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(words.row, words.n_texts), *(pa.array(x) for x in (n, word_chars, n_symbols, lines, repeat, failed, kept, good))],
                    names=["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "p_good"],
                )

    return run


SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, p_good double"


def quality(docs: DataFrame, model: Model | None, *, id_col: str = "doc_id", text_col: str = "text", keep_at: float = KEEP_AT) -> DataFrame:
    """Per row: the base statistics, base_failed, the calibrated probability p_good and kept.

    base_failed: fewer than 50 words, or more than half of the words in 3-word windows that recur in the text.  kept: not
    base_failed and p_good >= keep_at.  Without a model p_good is 1.  A null text counts as empty: no words, so base_failed.
    """
    return texts(docs, id_col, text_col).mapInArrow(_rules(docs.sparkSession.sparkContext.broadcast(model), keep_at), SCHEMA)


def _passing(model_of, keep_at: float, at: int):
    rules = _rules(model_of, keep_at)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column(at)
            pair = pa.RecordBatch.from_arrays([pa.array(np.arange(batch.num_rows)), text], names=["i", "text"])
            keep = pa.concat_arrays([x.column(7) for x in rules(iter([pair]))]) if batch.num_rows else pa.array([], pa.bool_())
            yield batch.filter(keep)

    return run


def passing(docs: DataFrame, model: Model | None, *, text_col: str = "text", keep_at: float = KEEP_AT) -> DataFrame:
    """The rows of docs that quality() keeps, with all their columns, in one pass without a join."""
    return docs.mapInArrow(_passing(docs.sparkSession.sparkContext.broadcast(model), keep_at, place_of(docs, text_col)), docs.schema)
