"""Operators on card records: duplicates, counts, search, selection, and the two cascades of the store."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evimatch.functions import text as t


def identity_key(*parts: Column) -> Column:
    """Folded set|number|name|variant|language; null where all are blank."""
    folded = [t.fold(p) for p in parts]
    blank = folded[0] == ""
    for f in folded[1:]:
        blank = blank & (f == "")
    return F.when(~blank, F.concat_ws("|", *folded))


def duplicates(cards: DataFrame, key: Column) -> DataFrame:
    """key, n of groups of two or more."""
    return cards.select(key.alias("key")).where("key is not null").groupBy("key").agg(F.count("*").alias("n")).where("n > 1")


def merge_quantity(cards: DataFrame, key: str, id_col: str, confidence: str, quantity: str) -> DataFrame:
    """Per group: the surest card (smallest id on a tie), the summed quantity (0 and null count 1) and how many go."""
    surest = F.max_by(id_col, F.struct(F.col(confidence), -F.col(id_col)))
    amount = F.sum(F.coalesce(F.nullif(F.col(quantity), F.lit(0)), F.lit(1)).cast("bigint"))
    return cards.groupBy(key).agg(surest.alias("keep"), amount.alias("quantity"), (F.count("*") - 1).alias("removed"))


def status(cards: DataFrame) -> DataFrame:
    """all, review, ready and failed counts in one pass."""
    failed, review = F.col("state") == "FAILED", F.col("state") == "NEEDS_REVIEW"
    return cards.agg(F.count("*").alias("n_all"), F.count_if(review).alias("n_review"), F.count_if(~review & ~failed).alias("n_ready"), F.count_if(failed).alias("n_failed"))


def search_page(cards: DataFrame, needle: str, fields: list[str], sort: str, id_col: str, size: int = 100, descending: bool = False, as_text: bool = True) -> DataFrame:
    """Rows with the needle in any field, sorted as text (null as '') or by value, with the id to break ties; one page."""
    q = needle.lower()
    hit = F.lit(False)
    for f in fields:
        hit = hit | F.coalesce(F.lower(F.col(f).cast("string")).contains(q), F.lit(False))
    key = F.coalesce(F.col(sort).cast("string"), F.lit("")) if as_text else F.col(sort)
    return cards.where(hit).orderBy(key.desc() if descending else key.asc(), id_col).limit(size)


def range_ids(shown: DataFrame, order: str, id_col: str, start: int, end: int) -> DataFrame:
    """Ids between two in display order, both ways; only the end if the start is not shown, none if the end is not.

    The two places are found by aggregation, so no single task numbers all rows.
    """
    at = shown.agg(F.min(F.when(F.col(id_col) == start, F.col(order))).alias("a"), F.min(F.when(F.col(id_col) == end, F.col(order))).alias("b"))
    low, high = F.least(F.coalesce("a", "b"), F.col("b")), F.greatest(F.coalesce("a", "b"), F.col("b"))
    return shown.join(F.broadcast(at)).where(F.col("b").isNotNull() & F.col(order).between(low, high)).select(id_col)  # one row


def orphans(blobs: DataFrame, cards: DataFrame, now: str, hours: int = 24) -> DataFrame:
    """Blobs of cards that are gone, older than a day or without a time."""
    owner = F.split(F.col("blob_id"), ":")[0]
    old = F.col("at").isNull() | (F.col("at") < F.to_timestamp(F.lit(now)) - F.expr(f"interval {hours} hours"))
    ids = cards.select(F.col("card_id").cast("string").alias("owner"))
    return blobs.withColumn("owner", owner).join(ids, "owner", "left_anti").where(old)


def without(table: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    return table.join(gone.select(key), key, "left_anti")
