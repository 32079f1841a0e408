"""Words at one place, rows and lines, against a plain version; and a very long document."""

import random
import re

from pyspark.sql import functions as F

from evimatch.functions import text as t
from evimatch.operators import layout

SCHEMA = "doc_id long, word_id long, text string, conf double, x0 double, y0 double, x1 double, y1 double"


def _middle(w):
    return (w["y0"] + w["y1"]) / 2


def _tall(w):
    return w["y1"] - w["y0"]


def _share(a, b):
    across = min(a["x1"], b["x1"]) - max(a["x0"], b["x0"])
    return across >= min(a["x1"] - a["x0"], b["x1"] - b["x0"]) * 0.6 and abs(_middle(a) - _middle(b)) < max(_tall(a), _tall(b)) * 0.6


def _bare(s):
    s = re.sub(r"[^A-Za-z0-9À-ÿ.!?]+$", "", re.sub(r"^[^A-Za-z0-9À-ÿ#©]+", "", (s or "").strip()))
    return s if re.search(r"(^|[^.!?])\.$", s) else re.sub(r"[.!?]+$", "", s)


def plain_lines(words):
    out = []
    for doc in sorted({w["doc_id"] for w in words}):
        own = [w | {"text": _bare(w["text"])} for w in words if w["doc_id"] == doc]
        own = [w for w in own if None not in w.values() and re.search("[A-Za-z0-9]", w["text"]) and w["x1"] > w["x0"] and w["y1"] > w["y0"]]
        rank = {w["word_id"]: (-w["conf"] * len(w["text"]) ** 0.5, w["word_id"]) for w in own}
        stay = []
        for w in sorted(own, key=lambda w: rank[w["word_id"]]):
            if not any(_share(k, w) for k in stay):
                stay.append(w)
        rows = []
        for w in sorted(stay, key=lambda w: (_middle(w), rank[w["word_id"]])):
            fits = [r for r in rows if abs(_middle(w) - sum(map(_middle, r)) / len(r)) < min(_tall(w), min(map(_tall, r))) * 0.5]
            if fits:
                fits[0].append(w)
            else:
                rows.append([w])
        lines = []
        for r in rows:
            r = sorted(r, key=lambda w: (w["x0"], _middle(w), rank[w["word_id"]]))
            cuts = [0, *(i for i in range(1, len(r)) if r[i]["x0"] - r[i - 1]["x1"] > min(_tall(r[i]), _tall(r[i - 1])) * 2.2), len(r)]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                p = r[lo:hi]
                letters = sum(len(w["text"]) for w in p)
                sure = sum(w["conf"] * len(w["text"]) for w in p) / letters
                box = [f(w[c] for w in p) for f, c in ((min, "x0"), (min, "y0"), (max, "x1"), (max, "y1"))]
                lines.append((" ".join(w["text"] for w in p), round(sure, 9), min(w["conf"] for w in p), sorted(map(_tall, p))[(len(p) - 1) // 2], *box))
        out += [(doc, *x) for x in lines]
    return sorted(out)


def _some(docs, n, seed, close):
    rng = random.Random(seed)
    shapes = ["Jordan", "ELLIS,", "«a»", "Mr.", "what?!", "#12", "...", "", None, "x", "©1998", "12/99", "Ünï"]
    rows = []
    for d in range(docs):
        for i in range(n):
            x, y, h = rng.randrange(400) * 1.0, rng.randrange(close) * 1.0, float(rng.choice([8, 10, 12, 30]))
            rows.append((d, i, rng.choice(shapes), rng.randrange(1, 20) / 20, x, y, x + rng.choice([0, 5, 30, 60]), y + h))
    return rows + [(0, n, "none", 0.9, None, None, None, None)]


def _as_rows(frame):
    return sorted((r.doc_id, r.text, round(r.confidence, 9), r.weakest, r.height, r.x0, r.y0, r.x1, r.y1) for r in frame.collect())


def test_lines_and_pairs_like_a_plain_version(spark):
    for close in (60, 900):
        rows = _some(6, 90, close, close)
        frame = spark.createDataFrame(rows, SCHEMA).repartition(4)
        words = [dict(zip([c.split()[0] for c in SCHEMA.split(", ")], r, strict=True)) for r in rows]
        lines = layout.words_to_lines(frame)
        assert _as_rows(lines) == plain_lines(words)
        numbered = lines.groupBy("doc_id").agg(F.min("line_id").alias("lo"), F.max("line_id").alias("hi"), F.count("*").alias("n")).collect()
        assert all(r.lo == 0 and r.hi == r.n - 1 for r in numbered)
        boxed = [w for w in words if w["x0"] is not None and w["x1"] > w["x0"]]
        want = sorted((a["doc_id"], a["word_id"], b["word_id"]) for a in boxed for b in boxed if a["doc_id"] == b["doc_id"] and a["word_id"] < b["word_id"] and _share(a, b))
        assert sorted(map(tuple, layout.same_place(frame, "doc_id").collect())) == want
    assert layout.words_to_lines(frame.limit(0)).count() == 0


def test_a_very_long_document(spark):
    """100,000 words, read twice, in lines so close that the page is one band."""
    i = F.col("id") % 100_000
    words = spark.range(200_000).select(
        F.lit(1).cast("long").alias("doc_id"), F.col("id").alias("word_id"), F.concat(F.lit("w"), i).alias("text"), F.when(F.col("id") < 100_000, 0.9).otherwise(0.5).alias("conf"),
        (i % 50 * 60.0).alias("x0"), (F.floor(i / 50) * 11.0).alias("y0"), (i % 50 * 60.0 + 50).alias("x1"), (F.floor(i / 50) * 11.0 + 10).alias("y1"),
    )
    got = layout.words_to_lines(words).agg(F.count("*").alias("n"), F.min("weakest").alias("sure"), F.min(F.size(F.split("text", " "))).alias("least"), F.max("line_id").alias("last")).first()
    assert tuple(got) == (2000 * 50, 0.9, 1, 99_999) or tuple(got) == (2000, 0.9, 50, 1999)


def test_clean_word(spark):
    said = ["(Ellis)", "Jr.", "No!", "a..", ".", "#53", "© 1999", None, "'n'", "Ä!?"]
    got = spark.createDataFrame([(s,) for s in said], "s string").select(t.clean_word(F.col("s")).alias("w")).collect()
    assert [r.w for r in got] == [_bare(s) for s in said]
