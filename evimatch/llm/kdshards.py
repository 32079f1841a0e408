"""Sharding by a k-d tree: split at distributed weighted medians along the widest metadata dimension.

Every node of the tree looks for the point of its widest dimension below which its left shards' share of the bytes lies.  The
point is found by summing bytes in equal bins and looking closer inside the one bin that holds it, for all nodes of a level at
once; rows with one value are told apart by doc_id in the same way.  The nodes are a table like the rows: their bins are summed,
chosen and joined back by Spark, so a tree may have any number of leaves and nothing of it comes to the driver.

Rows with equal texts are one point of the space, that of their smallest doc_id, so no cut parts them.  Groups so large that a cut
could not pass beside them evenly are given a shard each before the tree grows, the largest first and each to the shard that has the
least so far; the tree then fills every shard up to its share.  Only a group larger than a whole shard is cut, like rows of their own.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evimatch.llm.tables import BROADCAST_ROWS, Scratch, has_rows, partitions, small

BINS = 1024
DIMS = ("d_size", "d_source", "d_lang", "d_id")
#: A group of equal texts with more than one part in so many of a shard's bytes is given a shard: shards * LARGE_PART groups at most.
LARGE_PART = 200
#: Groups of more rows than this, and than one in HOT_GROUPS of all rows, are met by a broadcast: HOT_GROUPS groups at most.
HOT_ROWS, HOT_GROUPS = 10_000, 100_000
_TEXT = ["h", "text_crc32", "size"]


def _narrowed(rows: DataFrame, state: DataFrame, few, scratch: Scratch, name: str) -> DataFrame:
    """rows (node, v, size); state (node, lo, hi, below, want) -> node, at, below.

    at is the smallest value of the node with ``want`` bytes at or below it, below the bytes strictly below at.  Each round cuts
    lo..hi into BINS bins and goes on with the values met in one of them.
    """
    step = F.expr(f"greatest(1L, cast(ceil((cast(hi as decimal(20,0)) - cast(lo as decimal(20,0)) + 1) / {BINS}) as bigint))")
    i, on = 0, True
    while on:
        met = rows.join(few(state.where("lo < hi").withColumn("step", step)), "node").where("v between lo and hi")
        bins = met.groupBy("node", F.expr("v div step").alias("bin")).agg(F.sum("size").alias("b"), F.min("v").alias("bin_lo"), F.max("v").alias("bin_hi"), F.first("below").alias("below"), F.first("want").alias("want"))
        so_far = Window.partitionBy("node").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
        upto = F.col("below") + F.sum("b").over(so_far)
        sums = bins.withColumn("upto", upto)
        found, enough = F.struct("bin_lo", "bin_hi", (F.col("upto") - F.col("b")).alias("before")), F.col("upto") >= F.col("want")
        chosen = sums.groupBy("node").agg(F.coalesce(F.min_by(F.when(enough, found), F.when(enough, F.col("bin"))), F.max_by(found, F.col("bin"))).alias("x"))
        after = state.join(chosen, "node", "left").select("node", F.coalesce("x.bin_lo", "lo").alias("lo"), F.coalesce("x.bin_hi", "hi").alias("hi"), F.coalesce("x.before", "below").alias("below"), "want")
        i += 1
        state = scratch.table(after, f"{name}-{i}")
        scratch.drop(f"{name}-{i - 1}")
        on = has_rows(state.where("lo < hi"))
    return state.select("node", F.col("lo").alias("at"), "below")


def _housed(groups: DataFrame, shards: int, shard_bytes: int, scratch: Scratch) -> tuple[DataFrame, list[int]]:
    """The large groups with their shard (home), and what every shard has of them.

    They come to the driver as four numbers each; as each has more than 1/LARGE_PART of a shard's bytes, there are at most
    shards * LARGE_PART of them.
    """
    large = groups.where((F.col("bytes") * LARGE_PART > shard_bytes) & (F.col("bytes") <= shard_bytes)).select(*_TEXT, "bytes")
    held, homes = [(0, s) for s in range(shards)], []
    for r in large.orderBy(F.desc("bytes"), *_TEXT).toLocalIterator():
        has, home = heapq.heappop(held)
        homes.append((r.h, r.text_crc32, r.size, home))
        heapq.heappush(held, (has + r.bytes, home))
    table = groups.sparkSession.createDataFrame(homes, "h long, text_crc32 long, size long, home int")
    return scratch.table(table, "homes"), [has for has, _ in sorted(held, key=lambda x: x[1])]


def _together(plain: DataFrame, groups: DataFrame, homes: DataFrame, most_bytes: int, n_rows: int) -> DataFrame:
    """plain, with the place of its smallest doc_id for each row of a group of equal texts of at most ``most_bytes``, and home."""
    whole = F.col("bytes") <= most_bytes
    is_hot = F.col("n") > max(HOT_ROWS, n_rows // HOT_GROUPS)
    hot = groups.where(is_hot).select(*_TEXT, F.when(whole, F.col("least")).alias("least"), F.lit(True).alias("hot"))
    cold = groups.where(~is_hot & whole).select(*_TEXT, "least")
    met = plain.join(F.broadcast(homes), _TEXT, "left").join(F.broadcast(hot), _TEXT, "left")
    apart = F.col("hot") | F.col("home").isNotNull()
    rest = met.where(~F.coalesce(apart, F.lit(False))).drop("least", "hot").join(small(cold), _TEXT, "left")
    both = met.where(apart).drop("hot").unionByName(rest)
    return both.withColumns({d: F.coalesce(f"least.{d}", d) for d in ("d_id", "d_source", "d_lang")}).drop("least", "h")


def kd_shards(docs: DataFrame, shards: int = 8, *, target_bytes: int | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang") -> DataFrame:
    """Per row: doc_id, size (UTF-8 bytes of the text, null as none, plus 1), text_crc32, law, shard, slot, grown_shard (null).

    The tree has ``shards`` leaves, or as many as it takes for a leaf of target_bytes.  Dimensions: size, source, lang (by their
    crc32) and doc_id, each measured against its whole range.  The law is ``bytes``: at each cut the two sides are off by one text or
    by one group of 1/LARGE_PART of a shard at most, unless large groups alone fill a shard beyond its share.  Rows with equal texts
    (null and empty are equal) are in one shard, unless they have more bytes than a shard; such a group is cut.  slot numbers a shard's rows from 0 without gaps, in no order that matters.

    Null ids, sources and languages count as the smallest value (their rows stay).  Rows that agree in the dimension and in
    doc_id cannot be told apart and stay together.  Other columns are ignored.  An empty table gives an empty result.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "kdshards")
    text = F.col(text_col).cast("string")
    code = lambda c: F.coalesce(F.crc32(F.col(c).cast("string").cast("binary")), F.lit(-1)).cast("long")
    size = (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")
    plain = docs.select(
        F.lit(0).cast("long").alias("node"),
        F.col(id_col).cast("long").alias("doc_id"),
        size.alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
        F.xxhash64(F.coalesce(text, F.lit(""))).alias("h"),
        size.alias("d_size"),
        code(source_col).alias("d_source"),
        code(lang_col).alias("d_lang"),
        F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("d_id"),
    )
    ranges = [f(d).alias(f"{side}_{d}") for d in DIMS for side, f in (("lo", F.min), ("hi", F.max))]
    width = lambda d: f"(cast(hi_{d} as double) - cast(lo_{d} as double))"
    plain = scratch.table(plain, "plain")
    sums = plain.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"), F.count("*").alias("n")).first()
    if target_bytes:
        shards = max(1, -(-sums.bytes // target_bytes))
    shard_bytes = -(-sums.bytes // shards)
    groups = plain.groupBy(*_TEXT).agg(F.count("*").alias("n"), F.min(F.struct("d_id", "d_source", "d_lang")).alias("least")).where("n > 1")
    groups = scratch.table(groups.withColumn("bytes", F.col("n") * F.col("size")), "groups")
    homes, has = _housed(groups, shards, shard_bytes, scratch)
    every = scratch.table(_together(plain, groups, homes, shard_bytes // LARGE_PART, sums.n), "together")
    scratch.drop("plain", "groups")
    room = [0.0]  # of the shards before each
    for h in has:
        room.append(room[-1] + max(0.0, sums.bytes / shards - h))
    housed = every.where("home is not null").select("doc_id", "size", "text_crc32", F.col("home").alias("shard"))
    placed = every.where("home is null").drop("home")
    whole = scratch.table(placed.agg(*ranges), "whole")  # one row
    placed = placed.withColumns({"first": F.lit(0), "shards": F.lit(shards)})
    ahead = F.broadcast(whole.crossJoin(spark.createDataFrame([(room,)], "room array<double>")).select("room", *[F.expr(f"greatest(1D, {width(d)})").alias(f"whole_{d}") for d in DIMS]))
    before = lambda shard: f"element_at(room, cast({shard} + 1 as int))"
    part = f"coalesce(try_divide({before('first + shards div 2')} - {before('first')}, {before('first + shards')} - {before('first')}), (shards div 2) / shards)"
    share = {d: f"{width(d)} / whole_{d}" for d in DIMS}
    widest = F.expr("case " + " ".join(f"when {share[d]} >= greatest({', '.join(share.values())}) then {k}" for k, d in enumerate(DIMS)) + " end")
    of_dim = lambda side="": F.expr("case dim " + " ".join(f"when {k} then {side}{d}" for k, d in enumerate(DIMS)) + " end")
    nodes, i = 1, 0
    while nodes < 2 * shards:
        few = F.broadcast if nodes <= BROADCAST_ROWS else (lambda x: x)  # a level has as many nodes at most
        stats = placed.where("shards > 1").groupBy("node", "first", "shards").agg(F.sum("size").alias("bytes"), *ranges).where(" or ".join(f"lo_{d} < hi_{d}" for d in DIMS))
        split = stats.crossJoin(ahead).withColumn("dim", widest)  # one row
        split = scratch.table(split.select("node", "dim", of_dim("lo_").alias("lo"), of_dim("hi_").alias("hi"), F.lit(0.0).alias("below"), F.expr(f"bytes * {part}").alias("want")), f"split-{i}")
        if not has_rows(split):  # what is left cannot be told apart
            break
        rows = placed.join(few(split.select("node", "dim")), "node").select("node", of_dim().alias("v"), "d_id", "size")
        cut = _narrowed(rows.select("node", "v", "size"), split.drop("dim"), few, scratch, f"value-{i}")
        ties = rows.join(few(cut.select("node", "at")), "node").where("v = at").select("node", F.col("d_id").alias("v"), "size")
        start = ties.groupBy("node").agg(F.min("v").alias("lo"), F.max("v").alias("hi")).join(cut.select("node", "below"), "node").join(split.select("node", "want"), "node")
        tie = _narrowed(ties, scratch.table(start, f"start-{i}"), few, scratch, f"tie-{i}")
        cuts = split.select("node", "dim").join(cut.select("node", "at"), "node").join(tie.select("node", F.col("at").alias("tie")), "node")
        moved = placed.join(few(cuts), "node", "left").withColumn("right", F.coalesce((of_dim() > F.col("at")) | ((of_dim() == F.col("at")) & (F.col("d_id") > F.col("tie"))), F.lit(False)))
        low = F.expr("shards div 2").cast("int")
        first = F.when(F.col("right"), F.col("first") + low).otherwise(F.col("first"))
        left_over = F.when(F.col("at").isNull(), 1).when(F.col("right"), F.col("shards") - low).otherwise(low)
        i, nodes = i + 1, 2 * nodes
        placed = scratch.table(moved.select((F.col("node") * 2 + F.col("right").cast("int")).alias("node"), first.alias("first"), left_over.alias("shards"), "doc_id", "size", "text_crc32", *DIMS), f"placed-{i}")
        scratch.drop(f"placed-{i - 1}", f"split-{i - 1}", f"start-{i - 1}")
    return _slots(placed.select("doc_id", "size", "text_crc32", F.col("first").alias("shard")).unionByName(housed), scratch)


def _slots(placed: DataFrame, scratch: Scratch) -> DataFrame:
    """Number the rows of each shard without one task per shard: by blocks, whose counts are summed."""
    blocks = partitions(placed.sparkSession)
    dealt = scratch.table(placed.withColumn("block", F.pmod(F.xxhash64("doc_id", "text_crc32", "size"), F.lit(blocks))), "placed")
    counts = dealt.groupBy("shard", "block").agg(F.count("*").alias("n"))
    before = counts.select("shard", "block", (F.sum("n").over(Window.partitionBy("shard").orderBy("block")) - F.col("n")).alias("before"))
    numbered = dealt.withColumn("k", F.row_number().over(Window.partitionBy("shard", "block").orderBy("doc_id", "text_crc32")))
    return numbered.join(before, ["shard", "block"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("before") + F.col("k") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
