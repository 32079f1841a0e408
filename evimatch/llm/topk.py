"""Exact top-k by inner product with MaxScore over postings of quantised vectors.

A component x becomes the integer ``floor(SCALE * x)``.  Each dimension is two terms, one for each sign; a shard of at most SHARD
vectors holds for every term the vectors with that sign there, the largest magnitude among them, and the integers themselves for
probing.  A query scores a term of its own sign upwards and the other downwards, so the upward terms' largest magnitudes bound what is
left to gain.  Terms are put in order of their bounds.  Those at the end that together stay below the score to beat are not essential:
a vector met in no essential posting cannot enter.  Essential postings are traversed; then vectors that can still reach the score to
beat are probed, some dimensions at a time, and dropped as soon as they cannot.  The score to beat is the k-th best that the task has
seen so far, over all its shards, so what is dropped is never among the k best.  Tasks give k rows a query, and a window merges them.

Queries are a stated set.  They are packed into blocks of at most QUERIES, and one block at a time meets the shards, as the broadcast.

Vectors that are null, or hold a null or non-finite component, take no part.  Vectors of different lengths are compared as if the
shorter had zeros.  Every row is a vector of its own whatever its id: repeated rows meet each other, each repeated query row has its
own results, only a row itself is left out.  Ties go to the smaller id, null ids last.  Integers beyond
62 bits and scores beyond a long are held at these ends.  An empty table, or one without queries, gives no row.  Other columns may
have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evimatch.llm.tables import Scratch, partitions

#: Vectors of a shard, queries of a broadcast block, bytes of integers in either.
SHARD, QUERIES, BYTES = 8192, 8192, 16 << 20
SCALE, K = 256, 5
#: Dimensions probed before vectors that can no longer win are dropped.
STEP = 8
_FAR, _MOST = 1 << 62, (1 << 63) - 1


def _integers(column: pa.Array, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows take part, and their integers, padded with zeros to the longest."""
    lists = column.cast(pa.list_(pa.float64()))
    flat = lists.flatten()
    values = flat.to_numpy(zero_copy_only=False)
    length = np.asarray(lists.value_lengths().fill_null(0), dtype=np.int64)
    row = np.repeat(np.arange(len(lists)), length)
    fine = np.asarray(lists.is_valid()).copy()
    fine[row[~np.isfinite(values)]] = False  # a null component is NaN here
    out = np.zeros((len(lists), int(length.max(initial=0))), dtype=np.int64)
    place = np.arange(len(values)) - np.repeat(np.cumsum(length) - length, length)
    keep = fine[row]
    out[row[keep], place[keep]] = np.clip(np.floor(np.clip(values[keep], -1e300, 1e300) * scale), -_FAR, _FAR).astype(np.int64)
    return fine, out[fine]


def _pad(x: np.ndarray, dims: int) -> np.ndarray:
    return x if x.shape[1] >= dims else np.pad(x, ((0, 0), (0, dims - x.shape[1])))


def _shards(scale: int, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, asks, values, held, size = [], [], [], 0, 0
        for b in batches:
            for lo in range(0, b.num_rows, 1024):
                part = b.slice(lo, 1024)
                fine, x = _integers(part.column(1), scale)
                if len(x):
                    keep = pa.array(fine)
                    ids.append(part.column(0).filter(keep))
                    asks.append(part.column(2).filter(keep).fill_null(False))
                    values.append(x)
                    held, size = held + len(x), size + x.nbytes
                if held + 1024 > most or size > BYTES:
                    yield _shard(ids, asks, values)
                    ids, asks, values, held, size = [], [], [], 0, 0
        if held:
            yield _shard(ids, asks, values)

    return run


def _shard(ids: list[pa.Array], asks: list[pa.Array], values: list[np.ndarray]) -> pa.RecordBatch:
    dims = max(x.shape[1] for x in values)
    x = np.concatenate([_pad(v, dims) for v in values])
    lists = [np.flatnonzero(s * x[:, d] > 0).astype(np.int32) for d in range(dims) for s in (1, -1)]
    tops = np.array([np.abs(x[p, t // 2]).max(initial=0) for t, p in enumerate(lists)], dtype=np.int64)
    ends = np.cumsum([len(p) for p in lists], dtype=np.int64)
    kind = np.int32 if np.abs(x).max(initial=0) < 1 << 31 else np.int64
    row = [np.array([len(x)], dtype=np.int64), x.astype(kind), tops, ends, np.concatenate([np.empty(0, np.int32), *lists])]
    return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays([0, len(x)], pa.concat_arrays(y)) for y in (ids, asks)] + [pa.array([a.tobytes()], pa.binary()) for a in row[1:]], names=["ids", "asks", "ints", "tops", "ends", "postings"])


_INDEX = "ids array<long>, asks array<boolean>, ints binary, tops binary, ends binary, postings binary"


def index(vectors: DataFrame, asks: Column, *, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE, shard: int = SHARD) -> DataFrame:
    """A row for each shard: ids, which of them ask, integers row by row, and each term's largest magnitude, end and postings."""
    own = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("x"), asks.alias("asks"))
    return own.repartition(partitions(vectors.sparkSession)).mapInArrow(_shards(scale, max(1024, shard)), _INDEX)


def _unpack(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """ids (null: the largest long), which are null, integers."""
    ids = row["ids"]
    none = np.array([i is None for i in ids], dtype=bool)
    x = np.frombuffer(row["ints"], dtype=np.int32 if len(row["ints"]) * 2 == len(ids) * len(row["tops"]) // 2 else np.int64)
    return np.array([_MOST if i is None else i for i in ids], dtype=np.int64), none, x.reshape(len(ids), -1)


def _asking(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for row in b.to_pylist():
            _, _, x = _unpack(row)
            at = np.flatnonzero(np.array(row["asks"], dtype=bool))
            asked = [pa.array(np.full(len(at), row["shard"])), pa.array(at), pa.array([row["ids"][i] for i in at], pa.int64()), pa.array([x[i].astype(np.int64).tobytes() for i in at], pa.binary())]
            yield pa.RecordBatch.from_arrays(asked, names=["shard", "place", "query_id", "x"])


class _Best:
    """The k best of one query in a task."""

    def __init__(self, q: np.ndarray, k: int) -> None:
        self.q, self.k = q, k
        self.score, self.id, self.none = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)

    def least(self) -> int | None:
        """The score to beat or equal, if there are k already."""
        return int(self.score[-1]) if len(self.score) == self.k else None

    def take(self, score: np.ndarray, ids: np.ndarray, none: np.ndarray) -> None:
        score = np.concatenate((self.score, score))
        ids, none = np.concatenate((self.id, ids)), np.concatenate((self.none, none))
        first = np.lexsort((ids, none, -score))[: self.k]
        self.score, self.id, self.none = score[first], ids[first], none[first]


class _Shard:
    def __init__(self, row: dict) -> None:
        self.ids, self.none, x = _unpack(row)
        self.tops = np.frombuffer(row["tops"], dtype=np.int64)
        ends = np.frombuffer(row["ends"], dtype=np.int64)
        self.lists = np.split(np.frombuffer(row["postings"], dtype=np.int32), ends[:-1]) if len(ends) else []
        self.x = x.astype(np.int64)
        self.columns = np.ascontiguousarray(self.x.T)
        self.most = int(np.abs(x).max(initial=0))

    def candidates(self, q: np.ndarray, least: int | None) -> tuple[np.ndarray, np.ndarray]:
        """Places that can be among the best, with their scores; all others score below ``least``."""
        dims = min(len(q), self.x.shape[1])
        q = q[:dims]
        if int(np.abs(q).max(initial=0)) * self.most * max(1, dims) >= _FAR:  # beyond 64 bits: Python's own integers
            score = self.x[:, :dims].astype(object) @ q.astype(object) if dims else np.zeros(len(self.x), dtype=object)
            return np.arange(len(self.x)), np.array([min(max(s, -_MOST), _MOST) for s in score], dtype=np.int64)
        if least is None or least <= 0:  # vectors in no posting of the query's signs may win: everything is essential
            return np.arange(len(self.x)), self.x[:, :dims] @ q
        up = 2 * np.arange(dims) + (q < 0)
        bound = np.abs(q) * self.tops[up]
        order = np.argsort(-bound, kind="stable")
        order = order[bound[order] > 0]
        left = bound[order][::-1].cumsum()[::-1]  # what a dimension and those after it can add at most
        essential = int(np.searchsorted(-left, -least, side="right"))  # what is left behind them is below the score to beat
        gained = np.zeros(len(self.x), dtype=np.int64)
        for d in order[:essential]:
            met = self.lists[up[d]]
            gained[met] += q[d] * self.columns[d][met]
        rest = int(left[essential]) if essential < len(order) else 0
        at = np.flatnonzero(gained + rest >= least)
        score = gained[at]
        against = np.flatnonzero(q)  # the other sign's terms of every dimension only take away: probed where not yet counted
        for lo in range(0, len(against), STEP):
            if not len(at):
                break
            d = against[lo : lo + STEP]
            part = self.x[np.ix_(at, d)] * q[d]
            score = score + np.minimum(part, 0).sum(axis=1)
            keep = score + rest >= least
            at, score = at[keep], score[keep]
        for lo in range(essential, len(order), STEP):
            if not len(at):
                break
            d = order[lo : lo + STEP]
            score = score + np.maximum(self.x[np.ix_(at, d)] * q[d], 0).sum(axis=1)
            rest = int(left[lo + STEP]) if lo + STEP < len(order) else 0
            keep = score + rest >= least
            at, score = at[keep], score[keep]
        return at, score


def _search(block, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = block.value
        best = [_Best(np.frombuffer(x, dtype=np.int64), k) for x in asked["x"]]
        for b in batches:
            for row in b.to_pylist():
                shard = _Shard(row)
                for own, place, mine in zip(asked["shard"], asked["place"], best, strict=True):
                    at, score = shard.candidates(mine.q, mine.least())
                    if own == row["shard"]:
                        other = at != place
                        at, score = at[other], score[other]
                    if len(at) > 4 * k:  # no more than the k best scores and their ties need sorting
                        high = score >= np.partition(score, len(score) - k)[-k]
                        at, score = at[high], score[high]
                    mine.take(score, shard.ids[at], shard.none[at])
        n = [len(m.score) for m in best]
        if sum(n):
            of = [np.repeat(asked[c], n) for c in ("shard", "place")]
            none = np.concatenate([m.none for m in best])
            yield pa.RecordBatch.from_arrays([pa.array(a) for a in of] + [pa.array(np.repeat(np.arange(len(best)), n)).cast(pa.int64()), pa.array(np.concatenate([m.id for m in best]), pa.int64(), mask=none), pa.array(np.concatenate([m.score for m in best]))], names=["shard", "place", "asked", "vec_id", "score"])

    return run


def top_k(vectors: DataFrame, asks: Column | None = None, *, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE, shard: int = SHARD, block: int = QUERIES) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: of each row that asks, the k best of all other rows.

    ``asks`` is a condition on the rows; without it, those ask whose id is divisible by 50.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "topk")
    shards = scratch.table(index(vectors, F.col(id_col) % 50 == 0 if asks is None else asks, id_col=id_col, vector_col=vector_col, scale=scale, shard=shard), "shards")
    shards = scratch.table(shards.withColumn("shard", F.monotonically_increasing_id()), "index")
    scratch.drop("shards")
    asking = scratch.table(shards.select("shard", "ids", "asks", "ints", "tops").mapInArrow(_asking, "shard long, place long, query_id long, x binary"), "asking")
    n, widest = asking.agg(F.count("*"), F.max(F.length("x"))).first()
    block = max(1, min(block, BYTES // max(1, widest or 1)))
    dealt = scratch.table(asking.repartition(max(1, -(-n // block))).select("*", (F.floor(F.monotonically_increasing_id() % (1 << 33) / block)).alias("part"), F.spark_partition_id().alias("deal")), "dealt")
    found = None
    for r in dealt.select("deal", "part").distinct().sort("deal", "part").toLocalIterator():
        mine = dealt.where((F.col("deal") == r.deal) & (F.col("part") == r.part))
        rows = mine.select("shard", "place", "x").toArrow()
        held = spark.sparkContext.broadcast({"shard": rows["shard"].to_numpy(), "place": rows["place"].to_numpy(), "x": rows["x"].to_pylist()})
        one = scratch.table(shards.mapInArrow(_search(held, k), "shard long, place long, asked long, vec_id long, score long"), f"found-{r.deal}-{r.part}")
        held.destroy()
        one = one.drop("asked")
        found = one if found is None else found.unionByName(one)
    if found is None:
        return asking.select("query_id", F.lit(0).alias("rank"), F.col("place").alias("vec_id"), F.col("place").alias("score")).limit(0)
    rank = F.row_number().over(Window.partitionBy("shard", "place").orderBy(F.desc("score"), F.asc_nulls_last("vec_id")))
    ranked = found.withColumn("rank", rank).where(F.col("rank") <= k)
    return ranked.join(asking.select("shard", "place", "query_id"), ["shard", "place"]).select("query_id", "rank", "vec_id", "score")
