"""Alignment, top-k and divergence on awkward rows, against plain versions."""

import collections
import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from evimatch.llm import alignment, divergence, topk

NAMES = ("row", "pair", "g", "h", "n", "p", "q", "term", "shard", "place", "id", "x", "a", "b", "Text")
AWKWARD = [" ", "  ", "\n", "\t ", " \n", "a", "B", "don't", "'s", "é", "日本", "ｆｕｌｌ", "<|endoftext|>", "<s>", "</s>", "▁", "<0x41>", "\x00", "\x1c ", " ", "　 ", "ﬁ", "😀", "1234", "...", "_", "ab", "é", "\x85 "]


def _strings(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(AWKWARD) for _ in range(rng.randrange(1, 14))) for _ in range(n)]


@pytest.fixture(scope="module")
def both():
    return alignment.Tokenizers(alignment.vocabulary("byte_bpe_50k.json"), alignment.vocabulary("piece_bpe_32k.model"))


def _plain(t, text):
    """ids of both from whole texts, or two empty lists."""
    if not text:
        return [], []
    a, b = t.a.encode(" " + text, add_special_tokens=False).ids, t.b.encode(text)
    same = b"".join(t.a_bytes[i] for i in a) == b"".join(t.b_bytes[i] for i in b) == (" " + text).encode()
    return (a, b) if same else ([], [])


def test_parts_give_the_ids_of_whole_texts(both):
    texts = _strings(6000, 3)
    found = [tuple(list(np.frombuffer(x, "<u2")) for x in f) for f in both.encode(texts)]
    assert found == [_plain(both, x) for x in texts]
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefgtionXYZ'.,;:!?-é") for _ in range(rng.randrange(1, 12))) for _ in range(20_000)] + ["Hello,", "it's.", "I'll", "endoftext"]
    for w, a in zip(words, both._a_ids(words), strict=True):
        assert a == both.a.encode(" " + w, add_special_tokens=False).ids, w
    assert both.plain and both.parted
    assert any(not f[0] for f in found) and sum(bool(f[0]) for f in found) > 1000


def _aligned(t, texts):
    said, links = [], []
    for text in texts:
        a, b = _plain(t, text)
        ends = [np.cumsum([len(side[i]) for i in ids]).tolist() if ids else [] for ids, side in ((a, t.a_bytes), (b, t.b_bytes))]
        group, out, x, y = [[], []], [], 0, 0
        own = []
        while x < len(a):
            own.append((a[x], b[y]))
            p, q = ends[0][x], ends[1][y]
            if p <= q:
                group[0].append(a[x])
                x += 1
            if q <= p:
                group[1].append(b[y])
                y += 1
            if p == q:
                out.append(",".join(map(str, group[0])) + "|" + ",".join(map(str, group[1])))
                group = [[], []]
        links.append(own)
        said.append((len(a), len(b), len(out), len(own), hashlib.sha256(";".join(out).encode()).hexdigest() if out else ""))
    count = collections.Counter(p for own in links for p in set(own))
    best = collections.defaultdict(int)
    for (i, _), n in count.items():
        best[i] = max(best[i], n)
    return [(*s[:4], sum(count[p] == best[p[0]] for p in own), sum(count[p] for p in own), s[4]) for s, own in zip(said, links, strict=True)]


@pytest.mark.parametrize("block, tokens", [(4_000_000, 1 << 20), (50, 7)])
def test_alignment(spark, both, monkeypatch, block, tokens):
    monkeypatch.setattr(alignment, "TOKENS", tokens)  # blocks inside a text; workers are forked from a fresh import, so call it here too
    long = " ".join(f"v{i % 977}" for i in range(60_000))
    texts = [None, "", long, "the same text", "the same text", *_strings(150, 8)]
    rows = [(None if i == 4 else i // 2, x) for i, x in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("clash") for c in NAMES if c != "Text"}).repartition(3)
    got = [tuple(r) for r in alignment.digest(docs, block=block).collect()]
    want = [(i, *w) for (i, _), w in zip(rows, _aligned(both, texts), strict=True)]
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    assert alignment.digest(docs.limit(0)).count() == 0


def test_blocks_end_at_shared_cuts(both, monkeypatch):
    monkeypatch.setattr(alignment, "TOKENS", 5)
    text = "an unbelievably incomprehensible sentence, xyzzyxqj of words " * 20
    a, b = (np.array(x) for x in _plain(both, text))
    lengths = both.lengths()
    whole = alignment.Block(a, b, *lengths)
    ends, links, at = [[], []], 0, [0, 0]
    for i, m, j, n in alignment._blocks(a, b, *lengths):
        part = alignment.Block(a[i:m], b[j:n], *lengths)
        for side, e in enumerate(part.groups()):
            ends[side] += (e + at[side]).tolist()
        links += len(part.links()[0])
        at = [m, n]
    assert ends == [e.tolist() for e in whole.groups()] and links == len(whole.links()[0]) and at == [len(a), len(b)]


def test_groups_give_token_ranges(spark, both):
    docs = spark.createDataFrame([(1, "some incomprehensibly long words"), (2, ""), (3, "word")], "doc_id long, text string")
    for r in alignment.groups(alignment.encode(docs)).collect():
        assert len(r.a_ends) == len(r.b_ends) and (not r.a_ends or (r.a_ends[-1], r.b_ends[-1]) == (len(r.a_ids), len(r.b_ids)))
        at = (0, 0)
        for m, n in zip(r.a_ends, r.b_ends, strict=True):
            assert b"".join(both.a_bytes[i] for i in r.a_ids[at[0] : m]) == b"".join(both.b_bytes[i] for i in r.b_ids[at[1] : n])
            at = (m, n)


def _brute(rows, k):
    vectors = [(j, i, [int(np.floor(256 * float(c))) for c in x]) for j, (i, x) in enumerate(rows) if x is not None and all(c is not None and np.isfinite(c) for c in x)]
    out = []
    for j, i, q in vectors:
        if i is not None and i % 50 == 0:
            scored = sorted((-max(-(2**63) + 1, min(2**63 - 1, sum(a * b for a, b in zip(q, x, strict=False)))), v is None, v or 0) for m, v, x in vectors if m != j)
            out += [(i, rank, None if none else v, -s) for rank, (s, none, v) in enumerate(scored[:k], 1)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("shard, block", [(8192, 8192), (1024, 3)])
def test_top_k(spark, shard, block):
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.normal(0, 0.2, 24)]) for i in range(3000)]
    rows += [(i, [0.5, *[0.0] * 23]) for i in range(3000, 3300)]  # ties: a group of copies
    rows += [(0, rows[7][1]), (50, rows[50][1]), (None, rows[100][1]), (None, rows[100][1]), (3350, None), (3400, [1.0, None]), (3450, [float("nan")] * 24), (3500, [float("inf"), 1.0]), (3550, []), (3600, [2.0]), (3650, [*rows[1][1], 3.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({c: F.lit("clash") for c in NAMES}).repartition(5)
    got = topk.top_k(table, shard=shard, block=block).collect()
    assert sorted(map(tuple, got), key=repr) == _brute(rows, 5)
    assert topk.top_k(table.limit(0)).count() == 0 and topk.top_k(table, F.lit(False)).count() == 0


def test_top_k_of_few_and_of_huge_numbers(spark):
    rows = [(0, [1e18, -1e300]), (50, [3e9, 2e9]), (100, [-3e9, 1.0])]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    clipped = [(i, [max(-(2.0**62), min(2.0**62, 256 * c)) / 256 for c in x]) for i, x in rows]
    assert sorted(map(tuple, got), key=repr) == _brute(clipped, 5) and len(got) == 6


def test_what_is_dropped_cannot_win():
    rng = np.random.default_rng(9)
    x = (rng.exponential(30, (500, 16)) * rng.choice([-1, 0, 0, 1], (500, 16))).astype(np.int64)
    import pyarrow as pa

    shard = topk._Shard(topk._shard([pa.array(range(500))], [pa.array([False] * 500)], [x]).to_pylist()[0])
    for q in x[:60]:
        score = x @ q
        least = int(np.sort(score)[-5])
        at, found = shard.candidates(q, least)
        assert set(np.flatnonzero(score >= least)) <= set(at) and (score[at] == found).all()
        assert least <= 0 or len(at) == (score >= least).sum()


def _audit(rows, min_docs, top):
    docs = [((lang or ""), (source or ""), __import__("re").findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate({i: i + 32 for i in range(65, 91)}))) for text, lang, source in rows]
    out = []
    for lang in {d[0] for d in docs}:
        held = collections.Counter(t for d in docs if d[0] == lang for t in set(d[2]))
        kept = sorted(t for t, n in held.items() if n >= min_docs)
        counts = {s: collections.Counter(t for d in docs if d[:2] == (lang, s) for t in d[2]) for s in {d[1] for d in docs if d[0] == lang}}
        rate = lambda c: {t: 1 + (10**9 * (c[t] + 5)) // (sum(c[u] for u in kept) + 5 * len(kept)) for t in kept}
        p, q = {s: rate(c) for s, c in counts.items()}, rate(sum(counts.values(), collections.Counter()))
        for s in counts:
            pairs = sorted((-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode()) for o in counts if o != s)
            terms = sorted((q[t] - p[s][t], t.encode()) for t in kept if counts[s][t] and p[s][t] > q[t])[:top]
            out += [(lang, s, part, i.decode(), -v, r) for part, found in (("pair", pairs), ("term", terms)) for r, (v, i) in enumerate(found, 1)]
    return sorted(out)


def test_divergence(spark):
    rng = random.Random(2)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60)] + ["Ünï", "日本", "THE", "the", "😀x"]
    rows = [(" ".join(rng.choice(words[: 10 + 9 * (i % 7)]) for _ in range(rng.randrange(30))), ["en", "de", None][i % 3], [f"s{i % 7}", None, ""][i % 11 % 3]) for i in range(400)]
    rows += [(None, "en", "s1"), ("", "xx", "only"), ("one two", "xx", "other"), ("... 12", "yy", "alone"), *rows[:3]]
    rows += [(" ".join(["hot"] * 100_000 + ["the"] * 50_000), "en", "s0")]
    docs = spark.createDataFrame(rows, "text string, lang string, source string").withColumns({c: F.lit("clash") for c in NAMES if c != "Text"}).repartition(3)
    got = divergence.divergence(docs, min_docs=8, top_terms=6).collect()
    assert sorted(map(tuple, got)) == _audit(rows, 8, 6)
    assert divergence.divergence(docs.limit(0)).count() == 0
