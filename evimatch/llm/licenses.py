"""License scans: MinHash bands over overlapping windows of words retrieve templates, exact shingle containment verifies.

DataFrame operations only.  A template of T words is looked for with windows of T + hop - 1 words that start every hop words, so any
T consecutive words lie whole in one window.  hop is a quarter of the template's shingles (at least one word), which bounds the
Jaccard similarity of a window that holds at least 80 % of the template from below by 0.8 * s / (1.05 * s + hop - 1) for s shingles,
0.55 or more; with BANDS bands of one minhash each such a window is retrieved with probability 1 - (1 - 0.55)**BANDS, above
0.9999 for 12 bands (1 for short templates, where hop is 1 and an exact mention is the whole window).

Templates that differ in a few words (a version) pass for one another by containment alone.  So where another template holds that much of
one, a window also has to hold one of its deciding shingles, which no such other has.

Windows are formed around a few anchor words only.  This loses nothing: anchors are chosen so that, in every template, fewer than 80 %
of the shingles are without one, hence every window that passes the containment test has an anchor in it.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evimatch.llm.license_texts import TEMPLATES
from evimatch.llm.tables import texts

SHINGLE, BANDS, PERCENT = 5, 12, 80


def words_of(text: str) -> list[str]:
    """ASCII letters (lower-cased), digits, '.', '+' and '-' inside words; all else separates.  The same rule as in Spark below."""
    return [w for w in (x.strip(".-+") for x in re.split(r"[^a-z0-9.+-]+", text.translate({i: i + 32 for i in range(65, 91)}))) if w]


def _shingles(words: list[str]) -> list[str]:
    return [" ".join(words[i : i + SHINGLE]) for i in range(max(1, len(words) - SHINGLE + 1))]


def anchors(templates: dict[str, str]) -> list[str]:
    """Words such that in each template fewer than PERCENT of the distinct shingles hold none of them; greedy, most common first."""
    sets = [{tuple(s.split(" ")) for s in _shingles(words_of(t))} for t in templates.values()]
    open_sets, chosen = [s for s in sets if s], []
    while open_sets:
        counts: dict[str, int] = {}
        for s in open_sets:
            for w in {w for g in s for w in g}:
                counts[w] = counts.get(w, 0) + (100 * sum(w not in g for g in s) < PERCENT * len(s))
        best = max(sorted(set(counts) - set(chosen)), key=lambda w: (len(w) > 5, counts[w], len(w)))  # long words are rare in other texts
        chosen.append(best)
        open_sets = [s for s in open_sets if 100 * sum(not any(w in g for w in chosen) for g in s) >= PERCENT * len(s)]
    return chosen


def deciding(templates: dict[str, str]) -> dict[str, list[str]]:
    """The shingles of each template that none of those has which hold PERCENT of it; all are the same where there is no such other."""
    sets = {name: set(_shingles(words_of(text))) for name, text in templates.items() if words_of(text)}
    out = {}
    for name, own in sets.items():
        kin = [other for n, other in sets.items() if n != name and 100 * len(own & other) >= PERCENT * len(own)]
        out[name] = sorted(own.difference(*kin)) if kin else []
    return out


def template_table(spark: SparkSession, templates: dict[str, str]) -> DataFrame:
    """template_id, n_words, hop, grams (distinct shingles), deciding (those asked for too); one small row a template."""
    rows, own = [], deciding(templates)
    for name, text in templates.items():
        w = words_of(text)
        grams = sorted(set(_shingles(w)))
        if w:
            rows.append((name, len(w), max(1, (len(w) - SHINGLE + 1) // 4), grams, own[name]))
    return spark.createDataFrame(rows, "template_id string, n_words int, hop int, grams array<string>, deciding array<string>")


_BANDS = "transform(sequence(1, {bands}), b -> array_min(transform(h, x -> xxhash64(x, b))))"
#: Words of a text: its ASCII letters in lower case.  Cut out of the text as it is, so that no other letter turns into an ASCII one.
_WORDS = r"filter(transform(split(text, '[^A-Za-z0-9.+-]+'), x -> lower(regexp_replace(x, '^[.+-]+|[.+-]+$', ''))), x -> x <> '')"
#: Starts of the windows (every hop words, the last one reaching the end of the text) that hold one of the anchor words at ``spots``.
_STARTS = """array_distinct(flatten(transform(spots, p -> transform(
    sequence(greatest(0, p - span + hop) div hop, least(p div hop, (greatest(0, size(w) - span) + hop - 1) div hop)), i -> i * hop))))"""


def scan(docs: DataFrame, templates: dict[str, str] | None = None, *, id_col: str = "doc_id", text_col: str = "text", bands: int = BANDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, template_id, n_windows (windows that hold the template), first_word (where the first of them starts, from 0).

    A template matches a window that has at least ``percent`` % of its distinct five-word shingles (the whole, if it has fewer words) and,
    where another template is that close to it, one of its deciding ones.
    Only matches are returned; null and empty texts have none, nor has an empty table.  Rows that repeat a doc_id are scanned each and
    reported as one, a window's place counting once; so are rows without a doc_id, under a null.  Other columns are ignored.

    A text is read and cut into words once.  Windows are formed around its anchor words only, for all window shapes side by side.
    """
    spark = docs.sparkSession
    templates = TEMPLATES if templates is None else templates
    table = template_table(spark, templates)  # a constant of the code: a few rows
    wanted_words = anchors(templates)
    own = texts(docs, id_col, text_col)
    if not wanted_words:
        return own.limit(0).select("doc_id", F.lit("").alias("template_id"), F.lit(0).cast("long").alias("n_windows"), F.lit(0).cast("long").alias("first_word"))
    said = own.where(F.col("text").rlike("(?i)" + "|".join(map(re.escape, wanted_words))))
    marked = F.array(*[F.lit(x) for x in wanted_words])
    words = said.select("doc_id", F.expr(_WORDS).alias("w"))
    spotted = words.withColumn("spots", F.filter(F.transform("w", lambda x, i: F.when(F.array_contains(marked, x), i)), lambda i: i.isNotNull())).where("size(spots) > 0")
    shapes = sorted({(len(w), max(1, (len(w) - SHINGLE + 1) // 4)) for w in map(words_of, templates.values()) if w})
    shape = F.array(*[F.struct(F.lit(n).alias("n"), F.lit(hop).alias("hop"), F.lit(n + hop - 1).alias("span"), F.lit(min(SHINGLE, n)).alias("k")) for n, hop in shapes])
    shaped = spotted.select("doc_id", "w", "spots", F.explode(shape).alias("s")).select("doc_id", "w", "spots", "s.*").where("size(w) >= k")
    windows = shaped.select("doc_id", "n", "k", F.explode(F.expr(f"transform({_STARTS}, s -> named_struct('at', s, 'w', slice(w, s + 1, span)))")).alias("x"))
    grams = windows.where("size(x.w) >= k").select("doc_id", "n", "x.at", F.expr("transform(sequence(0, size(x.w) - k), i -> array_join(slice(x.w, i + 1, k), ' '))").alias("g"))
    keys = grams.withColumn("h", F.expr("transform(g, x -> xxhash64(x))")).select("doc_id", "n", "at", "g", F.posexplode(F.expr(_BANDS.format(bands=bands))).alias("band", "key"))
    known = table.withColumn("h", F.expr("transform(grams, x -> xxhash64(x))")).select("template_id", F.col("n_words").alias("n"), "grams", "deciding", F.posexplode(F.expr(_BANDS.format(bands=bands))).alias("band", "key"))
    candidates = keys.join(F.broadcast(known), ["n", "band", "key"])  # templates x bands rows
    exact = candidates.where(f"100 * size(array_intersect(g, grams)) >= {percent} * size(grams)").where("size(deciding) = 0 or arrays_overlap(g, deciding)")
    return exact.groupBy("doc_id", "template_id").agg(F.countDistinct("at").alias("n_windows"), F.min("at").cast("long").alias("first_word"))
