"""Repeated passages: automata find what hashes only propose, and texts of one word over and over stay small."""

import numpy as np
import pyarrow as pa
import pytest

from evimatch.llm import passages
from evimatch.llm import wordgrams as wg


def _by_hand(rows, size):
    least, most = {}, {}
    for _, _, lo, hi, words in rows:
        w = words.split(b" ")
        for i in range(len(w) - size + 1):
            key = tuple(w[i : i + size])
            least[key], most[key] = min(least.get(key, lo), lo), max(most.get(key, hi), hi)
    out = []
    for anchor, under, _, _, words in rows:
        w = words.split(b" ")
        keys = [tuple(w[i : i + size]) for i in range(len(w) - size + 1)]
        held = [least[k] if least[k] < most[k] else None for k in keys]
        if any(h is not None for h in held):
            out.append({"anchor": anchor, "under": under, "holders": held})
    return out


@pytest.mark.parametrize("same_hash", [False, True])
def test_automata_decide_where_hashes_agree(monkeypatch, same_hash):
    if same_hash:  # every window has one hash: only the automata can tell them apart
        monkeypatch.setattr(wg, "multipliers", lambda n, seed: np.zeros(n, dtype=np.uint64))
    rng = np.random.default_rng(3)
    rows = []
    for i in range(60):
        lo = int(rng.integers(-5, 40))
        words = b" ".join(b"w%d" % x for x in rng.integers(0, 4, int(rng.integers(3, 9))))
        rows.append((i, i * 7, lo, lo + int(rng.integers(0, 2)), words))
    table = pa.table({c: pa.array([r[k] for r in rows], pa.binary() if c == "words" else pa.int64()) for k, c in enumerate(("anchor", "under", "lo", "hi", "words"))})
    assert passages._locate(3)(table).to_pylist() == _by_hand(rows, 3)


def test_without_automata_nothing_is_located(monkeypatch):
    class Blind:
        def add_word(self, *_):
            pass

        def make_automaton(self):
            pass

        def iter(self, *_):
            raise LookupError

    monkeypatch.setattr(passages.ahocorasick, "Automaton", Blind)
    table = pa.table({"anchor": [1, 2], "under": [1, 2], "lo": [1, 2], "hi": [1, 2], "words": pa.array([b"a b c", b"a b c"])})
    with pytest.raises(LookupError):
        passages._locate(3)(table)


def test_one_word_over_and_over(spark):
    lengths = [12, 13, 14, 76, 77, 78, 500, *range(2_000, 6_800, 97), 20_000]
    rows = [(i, " ".join(["again"] * n)) for i, n in enumerate(lengths)]
    words = next(wg.pieces(pa.array([t for _, t in rows]), size=10**8))
    _, _, count, _ = passages._runs(words, passages.SIZE, passages.PHRASE)
    assert count.max() == passages.MOST_WINDOWS and count.sum() == sum(max(0, n - passages.SIZE + 1) for n in lengths)
    got = {r.doc_id: r.n_removed for r in passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: n if i > 1 else 0 for i, n in enumerate(lengths)}
