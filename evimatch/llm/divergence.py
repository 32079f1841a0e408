"""Source divergence audit: how differently the sources of a language use its vocabulary.

Plain relational: regexp matches are exploded and counted, groups (lang, source) meet the language's kept terms so that zeros are
dense, smoothed rates of two sources meet on language and term, and windows rank.  The rows that meet are kept terms times pairs of
sources of one language, summed before they are shuffled; nothing depends on how many documents a source has.

All arithmetic is of integers: rates are ``1 + floor(SCALE * (count + PRIOR) / (N + PRIOR * V))`` in decimals of 38 digits, so counts
may exceed what a long times SCALE holds.

Nulls in text, lang and source are empty strings.  Repeated rows and rows with null ids count each, ids are not looked at.  An empty
table gives no row; a group without terms has its pairs; a language without kept terms has its pairs with value 0 and no terms.  A
long text is one array of its terms within one row.  Ties are ranked by the item's UTF-8 bytes.  Other columns may have any name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evimatch.llm.tables import Scratch, small

#: Terms are runs of ASCII letters and of anything beyond ASCII.
TERM = r"[A-Za-z\x80-\x{10FFFF}]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MIN_DOCS, PRIOR, SCALE, TOP_TERMS = 30, 5, 1_000_000_000, 50


def term_counts(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """g, term, n (occurrences), docs (rows that hold it), of every group's rows; groups has lang, source and g.

    A row gives its terms and, after them, its distinct terms, so that one explode and one aggregation, summed within tasks before the
    shuffle, count both.  The explode is an outer one: for an inner one the planner would find all terms a second time to drop rows
    without any.
    """
    said = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    found = said.join(groups, ["lang", "source"]).select("g", F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit(TERM), F.lit(0)).alias("terms"))
    each = found.select("g", F.size("terms").alias("all"), F.concat("terms", F.array_distinct("terms")).alias("terms")).select("g", "all", F.posexplode_outer("terms").alias("place", "term"))
    again = F.when(F.col("place") < F.col("all"), 0).otherwise(1)
    return each.groupBy("g", "term").agg(F.sum(1 - again).cast("long").alias("n"), F.sum(again).cast("long").alias("docs")).where(F.col("term").isNotNull())


def _rates(dense: DataFrame, key: str, prior: int, scale: int) -> DataFrame:
    """dense with p, from totals of a row a group."""
    total = dense.groupBy(key).agg(F.sum("n").alias("total"), F.count("*").alias("kept"))
    wide = lambda c: c.cast("decimal(20,0)")
    p = F.call_function("div", F.lit(scale).cast("decimal(10,0)") * wide(F.col("n") + prior), wide(F.col("total") + prior * F.col("kept")))
    return dense.join(total, key).withColumn("p", 1 + p).drop("total", "kept")


def divergence(docs: DataFrame, *, min_docs: int = MIN_DOCS, prior: int = PRIOR, scale: int = SCALE, top_terms: int = TOP_TERMS) -> DataFrame:
    """lang, source, part, item, value, rank.

    Part ``pair``: every other source of the language, with the sum of absolute differences of rates.  Part ``term``: the kept terms
    that the source uses at a higher rate than its language does, only to rank top_terms.
    """
    scratch = Scratch(docs.sparkSession, "divergence")
    groups = docs.groupBy(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source"))).agg(F.count("*").alias("docs"))
    groups = scratch.table(groups.select("lang", "source", F.monotonically_increasing_id().alias("g")), "groups")
    known = small(groups)
    counts = scratch.table(term_counts(docs, known), "counts")
    kept = counts.join(known, "g").groupBy("lang", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")).where(F.col("docs") >= min_docs)
    kept = scratch.table(kept.select("lang", "term", "n"), "kept")
    dense = kept.select("lang", "term").join(known, "lang").select("lang", "g", "term").join(counts.select("g", "term", "n"), ["g", "term"], "left").fillna(0, ["n"])
    p = scratch.table(_rates(dense, "g", prior, scale), "rates")
    q = _rates(kept, "lang", prior, scale).select("lang", "term", F.col("p").alias("q"))

    other = p.select("lang", "term", F.col("g").alias("h"), F.col("p").alias("q"))
    apart = p.select("lang", "term", "g", "p").join(other, ["lang", "term"]).where(F.col("g") < F.col("h")).groupBy("g", "h").agg(F.sum(F.abs(F.col("p") - F.col("q"))).alias("value"))
    apart = apart.unionByName(apart.select(F.col("h").alias("g"), F.col("g").alias("h"), "value"))
    pairs = groups.join(groups.select("lang", F.col("source").alias("item"), F.col("g").alias("h")), "lang").where(F.col("g") != F.col("h"))
    pairs = pairs.join(apart, ["g", "h"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).alias("value"))
    more = p.join(q, ["lang", "term"]).where((F.col("n") > 0) & (F.col("p") > F.col("q"))).join(known.drop("lang"), "g")
    more = more.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    return pairs.withColumn("rank", rank).unionByName(more.withColumn("rank", rank).where(F.col("rank") <= top_terms))
