"""Cross-tokenizer alignment: where the tokens of two tokenizers end together, and which of them overlap.

Each text is encoded by both, a space before it (the second adds its own).  Token ends are bits of a packed bitset over the bytes of
a block of texts.  AND of the two bitsets gives the shared cuts, which part the tokens into groups; popcounts before a word rank a bit,
so a cut becomes a range of tokens of either side; OR gives every byte interval that one token of each covers, and so the links.

Encoded texts are written once.  Pairs of ids are counted by documents: within a task on distinct pairs, then summed by Spark.  The
counts come back to the texts in blocks of at most PAIRS pairs, one broadcast at a time, and each block gives its part of the sums.

Texts that are null or empty, or whose tokens' bytes do not add up to a space and the text, have no tokens.  Special tokens in a text
are plain text.  Ids are not looked at: repeated rows and rows with null ids count each as a document.  An empty table gives no row.
A text's tokens are worked on in blocks that end at shared cuts, so a very long text needs memory for its ids, not for all its links.
Other columns may have any name.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from array import array
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evimatch.llm.tables import Scratch
from evimatch.llm.tokens import vocabulary
from evimatch.llm.wordids import LETTERS, MARKS, Learnt, Lines, Words, byte_chars, flat

#: Pairs of a broadcast block; pairs a task counts before it hands them on; tokens of one side in a block of bits.
PAIRS, HELD, TOKENS = 2_000_000, 500_000, 1 << 18
#: Texts that do not part at each space: white space of any kind before one, or one at the front.
_UNEVEN = "(^|[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]) "
#: Fixed value: the pre-tokenizer for which letters and marks may go straight to the model.
_BYTE_LEVEL = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}


class Tokenizers:
    """Both vocabularies: each id's bytes, and texts to ids.

    A space behind a character that is no white space begins a new part for both: the first's pattern never matches across it, and no
    piece of the second holds its space sign anywhere but at the front (looked up in the vocabulary; else texts are one part).  So a
    text's ids are its parts' ids in order.  The first's pattern parts letters from marks behind them too, and no piece of the second
    holds both (looked up as well), so a plain part has the ids of its two runs.  Runs and other parts are remembered.  Tests compare
    with encoding whole texts.
    """

    def __init__(self, a_path: str, b_path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks already use every core
        import sentencepiece
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(a_path), sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        byte = byte_chars()
        self.a_bytes = [bytes(byte[c] for c in self.a.id_to_token(i) or "") for i in range(self.a.get_vocab_size())]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.parted = not any("▁" in p.lstrip("▁") for p in pieces)
        self.end = self.b.encode("a ")[len(self.b.encode("a")) :]  # what a space at the end becomes
        # two bytes an id do where the vocabulary allows
        self.kinds = tuple("H" if len(x) <= 1 << 16 else "I" for x in (self.a_bytes, self.b_bytes))
        told = json.loads(self.a.to_str())
        said = [p for i, p in enumerate(pieces) if not (self.b.is_control(i) or self.b.is_unknown(i) or self.b.is_byte(i))]
        alone = all(set(p).isdisjoint(LETTERS) or set(p).isdisjoint(MARKS) for p in said)
        self.plain = self.parted and alone and told["normalizer"] is None and told["pre_tokenizer"] == _BYTE_LEVEL and all(t["special"] for t in told["added_tokens"])
        self.lines = Lines(self.a) if self.plain else None
        self.words = Words(tuple({"H": "<u2", "I": "<u4"}[k] for k in self.kinds), self._part_ids, self._run_ids if self.plain else None)

    _CUT, _RUN = re.compile(r"(?<=\S)(?= )"), re.compile(r"\s ")

    def parts(self, text: str) -> list[str]:
        """Parts without the space that each begins with."""
        if not self.parted:
            return [text]
        if text.startswith(" ") or self._RUN.search(text):
            return [x[1:] for x in self._CUT.split(" " + text)]
        return text.split(" ")

    def _odd(self, strings: list[str], sides: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray | None:
        """Strings whose bytes the ids of either side do not spell; nothing if there is none."""
        said, spelled = [x.encode() for x in strings], [(spell, ids.tolist(), n.tolist()) for spell, (ids, n) in zip((self.a_bytes, self.b_bytes), sides, strict=True)]
        whole = b"".join(said)
        if all(b"".join(map(spell.__getitem__, ids)) == whole for spell, ids, _ in spelled):
            return None
        odd = np.zeros(len(said), dtype=bool)
        for spell, ids, sizes in spelled:
            at = iter(ids)
            odd |= np.array([b"".join([spell[t] for t in islice(at, n)]) != x for x, n in zip(said, sizes, strict=True)], dtype=bool)
        return odd

    def _part_ids(self, parts: list[str]) -> Learnt:
        """Parts by the whole tokenizers, each with the space before it."""
        said = [" " + x for x in parts]
        a_ids = [e.ids for e in self.a.encode_batch_fast(said, add_special_tokens=False)]
        b_ids = [b if x else self.end for x, b in zip(parts, self.b.encode(parts, num_threads=1), strict=True)]
        sides = [flat(a_ids), flat(b_ids)]
        return sides, self._odd(said, sides)

    def _run_ids(self, runs: list[str]) -> Learnt:
        """Letters with the space before them, marks without one: the second would add it, so for it they go behind a letter."""
        said = [" " + x if x[0] in LETTERS else x for x in runs]
        front = len(self.b.encode("a"))
        b_ids = self.b.encode([x[1:] if x[0] == " " else "a" + x for x in said], num_threads=1)
        sides = [self.lines.ids(said), flat([ids if x[0] == " " else ids[front:] for x, ids in zip(said, b_ids, strict=True)])]
        return sides, self._odd(said, sides)

    def _a_ids(self, parts: list[str]) -> list[list[int]]:
        """The first's ids of parts, as texts get them."""
        ((ids, at), _), _ = self.words.ids(pa.array(parts, pa.string()))
        return [x.tolist() for x in np.split(ids, at[1:-1])]

    def encode(self, texts: list[str] | pa.Array) -> Iterator[tuple[bytes, bytes]]:
        """Both id sequences as integers of kinds; two empty ones where bytes do not add up."""
        held = pa.array(texts, pa.string()) if isinstance(texts, list) else texts.cast(pa.string())
        there = pc.fill_null(pc.binary_length(held), 0).to_numpy() > 0
        uneven = pc.match_substring_regex(held, _UNEVEN).fill_null(False).to_numpy(zero_copy_only=False) if self.parted else np.ones(len(held), dtype=bool)
        found = [(b"", b"")] * len(held)
        for rows, split in ((np.flatnonzero(there & ~uneven), lambda x: pc.split_pattern(x, " ")), (np.flatnonzero(there & uneven), self._split)):
            own = held.take(pa.array(rows))
            parts = split(own)
            sides, odd = self.words.ids(parts.flatten())
            of = np.asarray(parts.offsets)
            odd = np.diff(np.concatenate(([0], np.cumsum(odd)))[of]) > 0
            (a, a_at), (b, b_at) = [(ids, at[of].tolist()) for ids, at in sides]
            for i, r in enumerate(rows.tolist()):
                ids = a[a_at[i] : a_at[i + 1]].tobytes(), b[b_at[i] : b_at[i + 1]].tobytes()
                if not odd[i] or self._adds_up(own[i].as_py(), *ids):
                    found[r] = ids
        yield from found

    def _split(self, texts: pa.Array) -> pa.Array:
        return pa.array([self.parts(x) for x in texts.to_pylist()], pa.list_(pa.string()))

    def _adds_up(self, text: str, a: bytes, b: bytes) -> bool:
        spelled = [b"".join(map(side.__getitem__, array(kind, ids))) for side, kind, ids in zip((self.a_bytes, self.b_bytes), self.kinds, (a, b), strict=True)]
        return spelled[0] == spelled[1] == (" " + text).encode()

    def lengths(self) -> tuple[np.ndarray, np.ndarray]:
        return tuple(np.array([len(x) for x in xs], dtype=np.int64) for xs in (self.a_bytes, self.b_bytes))


_HELD: dict[tuple[str, str], Tokenizers] = {}


def _tokenizers(a_path: str, b_path: str) -> Tokenizers:
    """One for each worker: the vocabularies take a second to read."""
    if (a_path, b_path) not in _HELD:
        _HELD[a_path, b_path] = Tokenizers(a_path, b_path)
    return _HELD[a_path, b_path]


def encode(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", a: str | None = None, b: str | None = None) -> DataFrame:
    """row (unique), doc_id, a, b: the ids of both tokenizers, two bytes each, or four where a vocabulary has more than 65,536."""
    a, b = a or vocabulary("byte_bpe_50k.json"), b or vocabulary("piece_bpe_32k.model")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = list(_tokenizers(a, b).encode(batch.column(2)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array([f[i] for f in found], pa.binary()) for i in (0, 1))], names=["row", "doc_id", "a", "b"])

    own = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return own.mapInArrow(run, "row long, doc_id long, a binary, b binary")


class Bits:
    """A packed bitset with ranks: bit i is bit i % 64 of word i // 64."""

    def __init__(self, words: np.ndarray) -> None:
        self.words = words
        self.before = np.concatenate(([0], np.cumsum(np.bitwise_count(words), dtype=np.int64)))

    @classmethod
    def at(cls, places: np.ndarray, size: int) -> Bits:
        flags = np.zeros(-(-size // 64) * 64, dtype=bool)
        flags[places] = True
        return cls(np.packbits(flags, bitorder="little").view("<u8"))

    def rank(self, places: np.ndarray) -> np.ndarray:
        """How many bits are set before each place."""
        low = (np.uint64(1) << (places & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[places >> 6] + np.bitwise_count(self.words[places >> 6] & low)

    def select(self) -> np.ndarray:
        """The places of all set bits."""
        return np.flatnonzero(np.unpackbits(self.words.view(np.uint8), bitorder="little"))


class Block:
    """Tokens of both sides over the same bytes: the group ends and links in it."""

    def __init__(self, a: np.ndarray, b: np.ndarray, a_length: np.ndarray, b_length: np.ndarray) -> None:
        a_end, b_end = np.cumsum(a_length[a]), np.cumsum(b_length[b])
        self.a, self.b = Bits.at(a_end - 1, a_end[-1]), Bits.at(b_end - 1, b_end[-1])

    def groups(self) -> tuple[np.ndarray, np.ndarray]:
        """For each group the tokens of a and of b up to its end."""
        cuts = Bits(self.a.words & self.b.words).select()
        return self.a.rank(cuts) + 1, self.b.rank(cuts) + 1

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        """The token of a and of b of each link: one link for each interval between ends of either side."""
        ends = Bits(self.a.words | self.b.words).select()
        return self.a.rank(ends), self.b.rank(ends)


def _blocks(a: np.ndarray, b: np.ndarray, a_length: np.ndarray, b_length: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """Ranges of a and of b of some TOKENS tokens, each ending at a shared cut."""
    i = j = 0
    most = TOKENS
    while i < len(a):
        if len(a) - i <= most and len(b) - j <= most:
            yield i, len(a), j, len(b)
            return
        a_end, b_end = np.cumsum(a_length[a[i : i + most]]), np.cumsum(b_length[b[j : j + most]])
        shared = np.intersect1d(a_end, b_end, assume_unique=True)
        if not len(shared):
            most *= 2
            continue
        m, n = int(np.searchsorted(a_end, shared[-1])) + 1, int(np.searchsorted(b_end, shared[-1])) + 1
        yield i, i + m, j, j + n
        i, j, most = i + m, j + n, TOKENS


class _Batch:
    """The tokens of the texts of a batch, laid end to end."""

    def __init__(self, batch: pa.RecordBatch, lengths: tuple[np.ndarray, np.ndarray]) -> None:
        self.lengths, found = lengths, []
        for side, length in zip("ab", lengths, strict=True):
            held, kind = batch.column(side).to_pylist(), np.dtype("<u2" if len(length) <= 1 << 16 else "<u4")
            found.append((np.frombuffer(b"".join(held), dtype=kind), np.array([len(x) // kind.itemsize for x in held], dtype=np.int64)))
        (self.a, self.n_a), (self.b, self.n_b) = found
        self.row = np.repeat(np.arange(batch.num_rows, dtype=np.int32), self.n_a)  # of each token of a
        self.n_b_ids = len(lengths[1])

    def blocks(self) -> Iterator[tuple[Block, np.ndarray, np.ndarray, np.ndarray]]:
        """Each block with its ids of a and b and the rows of a's tokens."""
        for i, m, j, n in _blocks(self.a, self.b, *self.lengths):
            a, b = self.a[i:m].astype(np.int64), self.b[j:n].astype(np.int64)
            yield Block(a, b, *self.lengths), a, b, self.row[i:m]


def _sum_of(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    found, where = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.zeros(len(found), dtype=np.int64)
    np.add.at(total, where, np.concatenate(counts))
    return found, total


def pair_counts(encoded: DataFrame, *, a: str | None = None, b: str | None = None) -> DataFrame:
    """a_id, b_id, n: in how many rows the pair is linked."""
    a, b = a or vocabulary("byte_bpe_50k.json"), b or vocabulary("piece_bpe_32k.model")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths = _tokenizers(a, b).lengths()
        width = len(lengths[0]) * len(lengths[1])
        keys, counts, held = [], [], 0

        def out() -> pa.RecordBatch:
            pairs, n = _sum_of(keys, counts)
            return pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(n)], names=["pair", "n"])

        for batch in batches:
            texts = _Batch(batch, lengths)
            own = np.empty(0, dtype=np.int64)  # distinct pairs of each row
            for block, a_ids, b_ids, row in texts.blocks():
                x, y = block.links()
                new = np.unique(row[x].astype(np.int64) * width + a_ids[x] * texts.n_b_ids + b_ids[y])
                own = np.union1d(own, new) if len(own) else new
            if len(own):
                pairs, n = np.unique(own % width, return_counts=True)
                keys.append(pairs)
                counts.append(n)
                held += len(pairs)
            if held > HELD:
                yield out()
                keys, counts, held = [], [], 0
        if held:
            yield out()

    found = encoded.select("a", "b").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    n_b = F.lit(len(_tokenizers(a, b).b_bytes))
    return found.select(F.expr("pair").alias("pair"), F.floor(F.col("pair") / n_b).cast("int").alias("a_id"), (F.col("pair") % n_b).cast("int").alias("b_id"), "n")


def groups(encoded: DataFrame, *, a: str | None = None, b: str | None = None) -> DataFrame:
    """row, doc_id, a_ids, b_ids, a_ends, b_ends: both sequences and, for each group, how many tokens of each lie up to its end."""
    a, b = a or vocabulary("byte_bpe_50k.json"), b or vocabulary("piece_bpe_32k.model")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, held = _Batch(batch, _tokenizers(a, b).lengths()), ([], [])
            at = [0, 0]
            for block, a_ids, b_ids, _ in texts.blocks():
                for side, ends in enumerate(block.groups()):
                    held[side].append(ends + at[side])
                at = [at[0] + len(a_ids), at[1] + len(b_ids)]
            ends = [np.concatenate([np.empty(0, np.int64), *h]) for h in held]
            starts = [np.concatenate(([0], np.cumsum(n))) for n in (texts.n_a, texts.n_b)]
            cut = np.searchsorted(ends[0], starts[0], side="right")  # groups end with their texts
            of = np.repeat(np.arange(batch.num_rows), np.diff(cut))
            lists = [pa.ListArray.from_arrays(pa.array(s, pa.int32()), pa.array(x, pa.int32())) for s, x in ((starts[0], texts.a), (starts[1], texts.b), (cut, ends[0] - starts[0][of]), (cut, ends[1] - starts[1][of]))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *lists], names=["row", "doc_id", "a_ids", "b_ids", "a_ends", "b_ends"])

    return encoded.mapInArrow(run, "row long, doc_id long, a_ids array<int>, b_ids array<int>, a_ends array<int>, b_ends array<int>")


class _Spelled:
    """Groups as text: every id's decimal digits with the sign behind it, so that a block is one gather."""

    def __init__(self, n_a: int, n_b: int) -> None:
        self.base = 2 * n_a
        self.words = pa.array([f"{i}{s}" for n, signs in ((n_a, ",|"), (n_b, ",;")) for i in range(n) for s in signs], pa.large_string())

    def spell(self, a: np.ndarray, b: np.ndarray, ends: tuple[np.ndarray, np.ndarray]) -> tuple[bytes, np.ndarray]:
        """The text, a ``;`` behind each group, and each group's end in it."""
        out = np.empty(len(a) + len(b), dtype=np.int64)
        n_a, n_b = (np.diff(e, prepend=0) for e in ends)
        before = np.repeat(ends[1] - n_b, n_a), np.repeat(ends[0], n_b)
        for ids, side, base in ((a, 0, 0), (b, 1, self.base)):
            last = np.zeros(len(ids), dtype=np.int64)
            last[ends[side] - 1] = 1
            out[np.arange(len(ids)) + before[side]] = base + 2 * ids + last
        taken = self.words.take(pa.array(out))
        offsets = np.frombuffer(taken.buffers()[1], dtype=np.int64, count=len(out) + 1)
        return taken.buffers()[2].to_pybytes()[: offsets[-1]], offsets[ends[0] + ends[1]]


def _by_row(row: np.ndarray, values: np.ndarray, rows: int) -> np.ndarray:
    """Sums by row, exact; row ascends."""
    out = np.zeros(rows, dtype=np.int64)
    if len(row):
        first = np.concatenate(([0], np.flatnonzero(np.diff(row)) + 1))
        out[row[first]] = np.add.reduceat(values, first)
    return out


_SUMS = "row long, n_best long, count_sum long"
_FACTS = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"


def _digest(a: str, b: str, counts, first: bool):
    """Sums over links whose pair is in the block of counts; with ``first`` what does not depend on counts too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths, (pairs, n, best) = _tokenizers(a, b).lengths(), counts.value
        spelled = _Spelled(len(lengths[0]), len(lengths[1])) if first else None
        for batch in batches:
            texts, rows = _Batch(batch, lengths), batch.num_rows
            n_groups, n_links, n_best, count_sum = (np.zeros(rows, dtype=np.int64) for _ in range(4))
            said, left = [None] * rows, [b""] * rows
            for block, a_ids, b_ids, row in texts.blocks():
                x, y = block.links()
                own, where = np.unique(a_ids[x] * texts.n_b_ids + b_ids[y], return_inverse=True)
                at = np.searchsorted(pairs, own)
                at[at == len(pairs)] = 0
                here = pairs[at] == own if len(pairs) else np.zeros(len(own), dtype=bool)
                count_sum += _by_row(row[x], np.where(here, n[at], 0)[where] if len(pairs) else np.zeros(len(x), np.int64), rows)
                n_best += _by_row(row[x], (here & best[at])[where].astype(np.int64) if len(pairs) else np.zeros(len(x), np.int64), rows)
                if first:
                    n_links += np.bincount(row[x], minlength=rows)
                    ends = block.groups()
                    of = row[ends[0] - 1]
                    n_groups += np.bincount(of, minlength=rows)
                    text, stops = spelled.spell(a_ids, b_ids, ends)
                    last = np.flatnonzero(np.diff(of, append=-1))
                    start = 0
                    for g in last:
                        r, stop = int(of[g]), int(stops[g])
                        said[r] = said[r] or hashlib.sha256()
                        said[r].update(left[r] + text[start : stop - 1])
                        left[r], start = b";", stop
            columns = {"row": batch.column("row"), "n_best": pa.array(n_best), "count_sum": pa.array(count_sum)}
            if first:
                columns |= {"doc_id": batch.column("doc_id"), "n_a": pa.array(texts.n_a), "n_b": pa.array(texts.n_b), "n_groups": pa.array(n_groups), "n_links": pa.array(n_links), "groups_sha256": pa.array([h.hexdigest() if h else "" for h in said])}
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return run


def digest(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", a: str | None = None, b: str | None = None, block: int = PAIRS) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of each row.

    n_best counts the links whose pair is in as many documents as any pair of the same id of ``a``; count_sum adds up the links' counts.
    """
    spark = docs.sparkSession
    a, b = a or vocabulary("byte_bpe_50k.json"), b or vocabulary("piece_bpe_32k.model")
    scratch = Scratch(spark, "alignment")
    encoded = scratch.table(encode(docs, id_col=id_col, text_col=text_col, a=a, b=b), "encoded")
    pairs = scratch.table(pair_counts(encoded, a=a, b=b).select("pair", "a_id", "n"), "pairs")
    most = pairs.groupBy("a_id").agg(F.max("n").alias("most"))  # a row an id
    total = pairs.count()
    ranked = pairs.join(F.broadcast(most), "a_id").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))
    ranked = ranked.repartition(max(1, -(-total // block)))
    dealt = scratch.table(ranked.select("*", F.floor(F.monotonically_increasing_id() % (1 << 33) / block).alias("part"), F.spark_partition_id().alias("deal")), "dealt")
    wanted = [(r.deal, r.part) for r in dealt.select("deal", "part").distinct().sort("deal", "part").toLocalIterator()] or [(0, 0)]
    facts, sums = None, []
    for i, (deal, part) in enumerate(wanted):
        rows = dealt.where((F.col("deal") == deal) & (F.col("part") == part)).select("pair", "n", "best").toArrow().sort_by("pair")
        held = spark.sparkContext.broadcast(tuple(rows[c].to_numpy() for c in ("pair", "n", "best")))
        found = encoded.mapInArrow(_digest(a, b, held, i == 0), _SUMS + (", " + _FACTS if i == 0 else ""))
        found = scratch.table(found, f"found-{i}")
        held.destroy()
        facts = facts or found
        sums.append(found.select("row", "n_best", "count_sum"))
    if len(sums) > 1:
        more = sums[0]
        for s in sums[1:]:
            more = more.unionByName(s)
        facts = facts.drop("n_best", "count_sum").join(more.groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum")), "row")
    return facts.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
