"""Mixing sources to target weights by Poisson replication.

Each text is taken k times, k drawn from a Poisson distribution whose mean is its source's target repetition rate: the target
share of the bytes over the share the source has.  The draw inverts the distribution at a uniform number made from a seed and the
text's id, so it is the same on every run and for every layout.  Large rates are inverted too, from log probabilities.  A copy's key is
a uniform number made from seed, id and copy number; partition k of n takes the keys from k/n to (k+1)/n and is sorted by them, so
the rows lie in one global random order.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evimatch.llm.tables import Scratch, columns, partitions, whole_row

#: Sources whose rates are sent to every task; with more, the rates are joined by a shuffle (which splits hot sources).
BROADCAST_SOURCES = 10_000
#: Steps of all sources that are sent to every task.
BROADCAST_STEPS = 4_000_000
#: Up to this rate exp(-rate) is a number above 0.
SUMMED_RATE = 700
#: Copies that a text's list of copies holds at once, where rates are large.
COPY_BLOCK = 10_000
_BITS = 48


def uniform(seed: int, *columns: str):
    """A number in [0, 1) with 48 bits from the md5 of the seed and some columns."""
    text = F.concat_ws(":", F.lit(str(seed)), *[F.col(c).cast("string") for c in columns])
    return F.conv(F.substring(F.md5(text), 1, _BITS // 4), 16, 10).cast("long").cast("double") / float(1 << _BITS)


def rates(docs: DataFrame, weights: dict[str, float] | None = None, *, default: float = 0.0, epochs: float = 1.0, text_col: str = "text", source_col: str = "source") -> DataFrame:
    """source, bytes, rate: how often a source's texts are repeated on average.  Counted over all rows, in Spark.

    weights are relative; a source that is not named has the default.  Without weights all sources weigh the same.  The output
    has about epochs times the input's bytes.  A null source is a source of its own, named ''.
    """
    source = F.coalesce(F.col(source_col).cast("string"), F.lit(""))
    sums = docs.groupBy(source.alias("source")).agg(F.sum(F.coalesce(F.octet_length(F.col(text_col).cast("string")), F.lit(0)).cast("long")).alias("bytes"))
    sums = sums.where("bytes > 0")
    if weights is None:
        weighed = sums.withColumn("w", F.lit(1.0))
    else:
        table = docs.sparkSession.createDataFrame([(k, float(v)) for k, v in weights.items()] or [("", 0.0)], "source string, w double")
        weighed = sums.join(table, "source", "left").withColumn("w", F.coalesce("w", F.lit(float(default))))
    whole = weighed.agg(F.sum("bytes").alias("b"), F.sum("w").alias("w"))
    return weighed.crossJoin(whole.select(F.col("b").alias("all_bytes"), F.col("w").alias("all_w"))).select(  # one row
        "source", "bytes", F.expr(f"coalesce({float(epochs)!r}D * all_bytes * (w / nullif(all_w, 0)) / bytes, 0D)").alias("rate")
    )


def poisson_steps(rate: str = "rate") -> str:
    """SQL for the cumulative Poisson probabilities P(X <= 0), P(X <= 1), ... as far as they matter."""
    top = f"cast(ceil({rate} + 12 * sqrt({rate}) + 20) as int)"
    add = f"(s, k) -> named_struct('p', s.p * {rate} / k, 'c', s.c + s.p * {rate} / k, 'all', array_append(s.all, s.c + s.p * {rate} / k))"
    start = f"named_struct('p', exp(-{rate}), 'c', exp(-{rate}), 'all', array(exp(-{rate})))"
    return f"aggregate(sequence(1, {top}), {start}, {add}, s -> s.all)"


def _inverted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """source, bytes, rate -> the same with low and steps: P(low <= X <= low), P(low <= X <= low + 1), ..., 12 deviations to each side.

    What is left out has a probability below 1e-30, far less than one step of the uniform number.
    """
    for batch in batches:
        low, steps = [], []
        for rate in batch.column(2).to_pylist():
            lo, hi = (int(rate + side * (12 * math.sqrt(rate) + 20)) for side in (-1, 1))
            first = lo * math.log(rate / lo) - (rate - lo) - math.log(2 * math.pi * lo) / 2 - 1 / (12 * lo) + 1 / (360 * lo**3)
            logs = first + np.concatenate(([0.0], np.cumsum(np.log(rate / np.arange(lo + 1, hi + 1)))))
            low.append(lo)
            steps.append(np.cumsum(np.exp(logs)))
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(low, pa.int64()), pa.array(steps, pa.list_(pa.float64()))], names=["source", "bytes", "rate", "low", "steps"])


def mix(
    docs: DataFrame, weights: dict[str, float] | None = None, *, default: float = 0.0, seed: int = 17, epochs: float = 1.0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", copy_col: str = "copy_no", key_col: str = "mix_key", shuffle: bool = True
) -> DataFrame:
    """All columns of docs, each row as often as drawn, with copy_col (from 1) and key_col, the place in the global order.

    A column of docs that has one of these two names gives way to it; other names can be asked for.
    Rows with a null or empty text, or of a source without weight, have rate 0 and go.  A null id draws like any other value; rows
    that share an id draw alike, so repeated rows come as often as each other.  A rate may be of any size, a text of any length; an
    empty table gives none.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "mixing")
    rated = scratch.table(rates(docs, weights, default=default, epochs=epochs, text_col=text_col, source_col=source_col), "rated")
    table = rated.where(f"rate <= {SUMMED_RATE}").withColumn("low", F.lit(0).cast("long")).withColumn("steps", F.expr(poisson_steps()))
    top = rated.agg(F.max("rate").alias("top")).first().top
    large = top is not None and top > SUMMED_RATE
    if large:
        table = table.unionByName(rated.where(f"rate > {SUMMED_RATE}").mapInArrow(_inverted, "source string, bytes long, rate double, low long, steps array<double>"))
    table = scratch.table(table, "rates")
    size = table.agg(F.count("*").alias("n"), F.sum(F.size("steps")).alias("steps")).first()
    few = size.n <= BROADCAST_SOURCES and (size.steps or 0) <= BROADCAST_STEPS
    drawn_by = table.select("source", "low", "steps")
    own = docs.select(*[col for c, col in zip(docs.columns, columns(docs), strict=True) if c.lower() not in (copy_col.lower(), key_col.lower())])
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    keyed = docs.where(F.octet_length(F.col(text_col).cast("string")) > 0).select(whole_row(own).alias("row"), text(source_col).alias("source"), text(id_col).alias("id"))
    drawn = keyed.join(F.broadcast(drawn_by) if few else drawn_by, "source")
    times = drawn.withColumn("u", uniform(seed, "id")).withColumn("k", F.expr("low + size(filter(steps, c -> c <= u))")).where("k > 0")
    if large:  # no list holds all copies of a text
        times = times.drop("steps").withColumn("first", F.explode(F.expr(f"sequence(1L, k, {COPY_BLOCK}L)")))
        copies = times.withColumn("copy", F.explode(F.expr(f"sequence(first, least(k, first + {COPY_BLOCK - 1}L))")))
    else:
        copies = times.withColumn("copy", F.explode(F.expr("sequence(1L, k)")))
    out = copies.select("row.*", F.col("copy").alias(copy_col), uniform(seed + 1, "id", "copy").alias(key_col))
    if shuffle:
        n = partitions(spark)
        out = out.repartitionById(n, F.floor(F.col(key_col) * n).cast("int")).sortWithinPartitions(key_col)
    return out
