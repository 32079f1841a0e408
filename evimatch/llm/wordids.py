"""Token ids of many words at once: each distinct word is looked up once a batch, and what is remembered lies in flat arrays.

Most distinct words are letters with common marks behind them, and only few distinct runs of letters or marks make them up.  A
tokenizer that never joins a letter and a mark gives a word the ids of its runs in order; all other words go to it as they are.
"""

from __future__ import annotations

import codecs
from collections.abc import Callable
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Letters of ASCII and Latin-1, which no normalisation changes but for case, and visible ASCII marks but the apostrophe.
LETTERS = "".join(chr(i) for i in range(0x41, 0x100) if chr(i).isalpha() and chr(i) not in "ªµº")
MARKS = "".join(chr(i) for i in range(0x21, 0x7F) if not chr(i).isalnum() and chr(i) != "'")
_PLAIN = "^[A-Za-zÀ-ÖØ-öø-ÿ]+[!-&(-/:-@\\[-`{-~]*$"
#: Strings, and bytes of them, that are remembered; strings learnt at once; entries laid end to end at once.
MOST, MOST_BYTES, LEARN, LAID = 400_000, 32 << 20, 20_000, 1 << 18

#: For each kind of id the ids of all strings, end to end, and how many each string has; then which strings have to be looked at again.
Learnt = tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray | None]


def laid(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The values of the entries ``which`` end to end, and where each begins, with the end of the last."""
    ends = np.zeros(len(which) + 1, dtype=np.int64)
    np.cumsum(sizes[which], out=ends[1:])
    out = np.empty(ends[-1], dtype=values.dtype)
    for lo in range(0, len(which), LAID):
        own, at = which[lo : lo + LAID], ends[lo : lo + LAID + 1]
        shift = np.repeat(starts[own] - at[:-1], np.diff(at))
        out[at[0] : at[-1]] = values[shift + np.arange(at[0], at[-1])]
    return out, ends


class Known:
    """Ids of distinct strings; those it lacks are learnt, many at once.  ``none``: strings that have no ids."""

    def __init__(self, learn: Callable[[list[str]], Learnt], kinds: tuple[str, ...], none: tuple[str, ...] = ()) -> None:
        self.learn, self.kinds, self.none = learn, kinds, none
        self.forget()

    def forget(self) -> None:
        n = len(self.none)
        self.strings, self.odd = pa.array(self.none, pa.string()), np.zeros(n, dtype=bool)
        self.sides = [(np.empty(0, dtype=k), np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)) for k in self.kinds]

    def trim(self) -> None:
        """Start anew when too much is held; places found before no longer hold."""
        if len(self.strings) > MOST or self.strings.nbytes > MOST_BYTES:
            self.forget()

    def find(self, strings: pa.Array) -> np.ndarray:
        """The place of each string in ``sides``."""
        own = strings.dictionary_encode()
        at = pc.index_in(own.dictionary, value_set=self.strings).fill_null(-1).to_numpy().astype(np.int64)
        lack = np.flatnonzero(at < 0)
        if len(lack):
            new = own.dictionary.take(pa.array(lack))
            at[lack] = np.arange(len(self.strings), len(self.strings) + len(lack))
            self._add(new)
        return at[own.indices.to_numpy()]

    def _add(self, new: pa.Array) -> None:
        more, odd = [[] for _ in self.kinds], [self.odd]
        for lo in range(0, len(new), LEARN):
            some = new.slice(lo, LEARN).to_pylist()
            sides, wrong = self.learn(some)
            for m, side in zip(more, sides, strict=True):
                m.append(side)
            odd.append(np.zeros(len(some), dtype=bool) if wrong is None else wrong)
        self.strings, self.odd = pa.concat_arrays([self.strings, new]), np.concatenate(odd)
        for i, (values, _, sizes) in enumerate(self.sides):
            sizes = np.concatenate([sizes, *(n for _, n in more[i])])
            self.sides[i] = np.concatenate([values, *(v.astype(values.dtype) for v, _ in more[i])]), np.cumsum(sizes) - sizes, sizes


class Words:
    """Ids of words, in one or more kinds; ``lower`` where the tokenizer takes letters in lower case."""

    def __init__(self, kinds: tuple[str, ...], whole: Callable[[list[str]], Learnt], runs: Callable[[list[str]], Learnt] | None, lower: bool = False) -> None:
        self.wholes, self.runs, self.lower = Known(whole, kinds), Known(runs, kinds, ("",)) if runs else None, lower

    def ids(self, words: pa.Array) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
        """For each kind the ids of all words, end to end, and where each word's begin, with the end of the last; then the odd words."""
        own = words.dictionary_encode()
        distinct, at = own.dictionary, own.indices.to_numpy()
        plain = pc.match_substring_regex(distinct, _PLAIN).to_numpy(zero_copy_only=False) if self.runs else np.zeros(len(distinct), dtype=bool)
        self.wholes.trim()
        other = self.wholes.find(distinct.filter(pa.array(~plain)))
        odd = np.zeros(len(distinct), dtype=bool)
        odd[~plain] = self.wholes.odd[other]
        if self.runs:
            self.runs.trim()
            short = distinct.filter(pa.array(plain))
            letters, marks = pc.utf8_rtrim(short, MARKS), pc.utf8_ltrim(short, LETTERS)
            runs = self.runs.find(pa.concat_arrays([pc.utf8_lower(letters) if self.lower else letters, marks])).reshape(2, -1)
            odd[plain] = self.runs.odd[runs].any(axis=0)
        out, order = [], np.argsort(np.concatenate((np.flatnonzero(~plain), np.flatnonzero(plain))))
        for i, side in enumerate(self.wholes.sides):
            values, begin = laid(*side, other)
            if self.runs:
                more, starts = laid(*self.runs.sides[i], runs.T.ravel())
                values, begin = np.concatenate((values, more)), np.concatenate((begin[:-1], starts[::2] + len(values)))
            out.append(laid(values, begin[:-1][order], np.diff(begin)[order], at))
        return out, odd[at]


class Lines:
    """A byte-level BPE model alone, for strings without line ends that its tokenizer would not part any further."""

    def __init__(self, tokenizer) -> None:
        from tokenizers import Tokenizer, pre_tokenizers

        self.model = Tokenizer(tokenizer.model)
        self.model.pre_tokenizer = pre_tokenizers.CharDelimiterSplit("\n")
        end = tokenizer.model.end_of_word_suffix or ""
        self.lengths = np.array([len((tokenizer.id_to_token(i) or "").removesuffix(end)) for i in range(tokenizer.get_vocab_size())], dtype=np.int64)

    def ids(self, strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the strings, end to end, and how many each has: token lengths, in bytes, add up to the strings'."""
        spelled = "\n".join(strings).encode()
        lines = codecs.charmap_decode(spelled, "strict", _CHARS)[0].split("\n")
        found = self.model.encode_batch_fast(["\n".join(lines[lo : lo + 500]) for lo in range(0, len(lines), 500)], add_special_tokens=False)
        ids = np.concatenate([np.array(e.ids, dtype=np.int64) for e in found])
        ends, last = np.cumsum(self.lengths[ids]), np.cumsum(np.fromiter(map(len, lines), dtype=np.int64, count=len(lines)))
        if ends[-1] != last[-1]:
            raise ValueError("the model has no token for some byte")
        return ids, np.diff(np.searchsorted(ends, last, side="right"), prepend=0)


def flat(ids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Ids end to end, and how many each string has."""
    sizes = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids))
    return np.fromiter(chain.from_iterable(ids), dtype=np.int64, count=int(sizes.sum())), sizes


def byte_chars() -> dict[str, int]:
    """The characters that stand for bytes in byte-level entries: printable ones for themselves, the others from 256 on in order."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


#: The character of each byte, but a line end stays one.
_CHARS = "".join(sorted(byte_chars(), key=byte_chars().get)).replace("Ċ", "\n")
