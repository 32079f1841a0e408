"""Token ids of many words at once: what the tokenizers are asked for, and awkward words against whole texts."""

import random
import sys

import numpy as np
import pytest

from evimatch.llm import alignment, tokens, wordids

LETTERS = "abcxyzABCÀÉÖØÞßàéöøþÿ"


class _Counted:
    """A tokenizer that counts the strings it is given."""

    def __init__(self, of):
        self.of, self.n = of, 0

    def encode(self, strings, **more):
        self.n += len(strings) if isinstance(strings, list) else 1
        return self.of.encode(strings, **more)


@pytest.fixture
def both():
    return alignment.Tokenizers(alignment.vocabulary("byte_bpe_50k.json"), alignment.vocabulary("piece_bpe_32k.model"))


def _same(t, text, found):
    a, b = t.a.encode(" " + text, add_special_tokens=False).ids, t.b.encode(text)
    same = b"".join(t.a_bytes[i] for i in a) == b"".join(t.b_bytes[i] for i in b) == (" " + text).encode()
    assert [np.frombuffer(x, "<u2").tolist() for x in found] == ([a, b] if same else [[], []]), text


def test_alignment_asks_for_each_run_once(both):
    """Words with other marks behind them, and words of earlier batches, are not encoded again."""
    rng = random.Random(1)
    words = ["".join(rng.choice(LETTERS) for _ in range(rng.randrange(4, 10))) for _ in range(500)]
    texts = [" ".join(w + m for w in words) for m in ("", ".", ",", "!?", ":%%", ";")]
    both.b = _Counted(both.b)
    first = list(both.encode(texts[:3]))
    found = first + list(both.encode(texts[3:]))
    assert both.b.n < 600, both.b.n
    both.b = both.b.of
    for text, ids in zip(texts, found, strict=True):
        _same(both, text, ids)


def test_alignment_forgets_between_batches(both, monkeypatch):
    """Places in what is remembered hold for a batch, however much it learns; blocks of few words give the same ids."""
    for name, n in (("MOST", 20), ("LEARN", 7), ("LAID", 5)):
        monkeypatch.setattr(wordids, name, n)
    rng = random.Random(2)
    signs = LETTERS + "'.,-09 \n\t_<|>" + "日µª́"
    texts = ["".join(rng.choice(signs) for _ in range(rng.randrange(1, 60))) for _ in range(600)]
    for lo in range(0, 600, 50):
        for text, ids in zip(texts[lo : lo + 50], both.encode(texts[lo : lo + 50]), strict=True):
            _same(both, text, ids)
    assert list(both.encode(["", "a", ""]))[::2] == [(b"", b"")] * 2 and list(both.encode([])) == []


def test_token_files_take_distinct_words_together():
    """No Python function runs for each distinct word: that took most of a task's CPU seconds."""
    e, rng, calls = tokens.Encoder(tokens.vocabulary(), "uint16"), random.Random(3), 0
    words = ["".join(rng.choice(LETTERS) for _ in range(rng.randrange(4, 10))) + rng.choice(("", ",", ".", "%%%")) for _ in range(4000)]

    def count(frame, event, arg):
        nonlocal calls
        calls += event == "call"

    sys.setprofile(count)
    try:
        found = e.encode([" ".join(words).encode()])
    finally:
        sys.setprofile(None)
    assert np.frombuffer(found[0], "uint16").tolist() == e.tokenizer.encode(" ".join(words), add_special_tokens=False).ids
    assert calls < 1000, calls


def test_token_encoder_forgets_between_batches(monkeypatch):
    for name, n in (("MOST", 20), ("LEARN", 7), ("LAID", 5)):
        monkeypatch.setattr(wordids, name, n)
    e, rng = tokens.Encoder(tokens.vocabulary(), "uint16"), random.Random(4)
    signs = LETTERS + "'.,-09 \n\t_<|>\x0b\x1c\x85" + "日µª́"
    for _ in range(12):
        texts = ["".join(rng.choice(signs) for _ in range(rng.randrange(60))) for _ in range(50)]
        for text, ids in zip(texts, e.encode([x.encode() for x in texts]), strict=True):
            assert np.frombuffer(ids, "uint16").tolist() == e.tokenizer.encode(text, add_special_tokens=False).ids, text
    assert e.encode([]) == []
