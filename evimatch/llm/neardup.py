"""MinHash near-duplicate detection with tensored banding.

One table key joins a short band from a collection A with a short band from a collection B.  With m bands in each
collection there are m*m tables, yet only 2*m bands of minhashes are computed: about the square root of what independent
tables would take.  Because every key starts with its A band, texts whose A band is unique are dropped before any key of
that band is formed, so most texts never reach the m*m tables.

How the work stays whole and small:

* Texts with equal shingle sets form one class (128-bit fingerprint of the full set, pre-aggregated), so a group of exact
  copies of any size is one node.  Nodes get numbers of their own; which row stands for a class or a component is the smallest
  (doc_id, hash of the text), null ids last, so null and repeated ids are rows like any other.
* Within a table bucket each node is checked against the smallest node only: links grow with the bucket, not with its square.
* Nodes that failed such a check may still be linked to another member.  They are compared by an exact prefix filter (shared
  rare shingle within the first places, size and place bounds) against all nodes of buckets, in other components only.
* Every link is confirmed on full shingle sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evimatch.llm import wordgrams as wg
from evimatch.llm.components import components
from evimatch.llm.tables import Scratch, columns, fresh, has_rows, small, texts

#: m bands of r minhashes in each of the two collections.  At a similarity of s a pair is found with probability
#: (1 - (1 - s**r)**m)**2; 0.9999 at s = 0.8.
BANDS, ROWS = 14, 3
_SET_SEED, _SHORT_SEED = 11, 100


def _shingle_sets(words: wg.Words, size: int) -> list[np.ndarray]:
    """Per text the sorted distinct hashes of its shingles; the whole sequence is one shingle if there are fewer words."""
    h = words.hashes()
    grams, at = words.windows(h, size, _SET_SEED)
    cut = np.searchsorted(at, words.first)
    counts = words.counts
    out = []
    for d in range(words.n_texts):
        if counts[d] == 0:
            out.append(grams[:0])
        elif counts[d] < size:
            s = h[words.first[d] : words.first[d + 1]]
            c = wg.multipliers(len(s), _SHORT_SEED + len(s))
            out.append(wg.mix(np.array([(s * c).sum(dtype=np.uint64)], dtype=np.uint64)))
        else:
            out.append(np.unique(grams[cut[d] : cut[d + 1]]))
    return out


def _minima(sets: list[np.ndarray], multiplier: np.ndarray) -> np.ndarray:
    """Smallest value of each hash function over each non-empty set."""
    flat = np.concatenate(sets)
    at = np.cumsum([0, *(len(s) for s in sets[:-1])])
    out = np.empty((len(sets), len(multiplier)), dtype=np.uint64)
    for j, m in enumerate(multiplier):
        x = flat * m
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        out[:, j] = np.minimum.reduceat(x, at)
    return out


def _bands(minima: np.ndarray, rows: int) -> np.ndarray:
    n, k = minima.shape
    c = wg.multipliers(rows, 5)
    return wg.mix((minima.reshape(n, k // rows, rows) * c).sum(axis=2, dtype=np.uint64))


def _signatures(size: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        multiplier = wg.multipliers(2 * bands * rows, 3)
        for batch in batches:
            for words in wg.pieces(batch.column(2), wg.NOT_SPACE, lower=True):
                sets = _shingle_sets(words, size)
                n = np.array([len(s) for s in sets], dtype=np.int64)
                full = np.flatnonzero(n)
                f1, f2 = np.zeros(len(n), dtype=np.uint64), np.zeros(len(n), dtype=np.uint64)
                keys = np.zeros((len(n), 2 * bands), dtype=np.uint64)
                if len(full):
                    own = [sets[i] for i in full]
                    f1[full] = [wg.mix(s * np.uint64(0x9FB21C651E98DF25)).sum(dtype=np.uint64) for s in own]
                    f2[full] = [wg.mix(s ^ np.uint64(0xA0761D6478BD642F)).sum(dtype=np.uint64) for s in own]
                    keys[full] = _bands(_minima(own, multiplier), rows)
                lists = [pa.FixedSizeListArray.from_arrays(pa.array(np.ascontiguousarray(x).view(np.int64).ravel()), bands).cast(pa.list_(pa.int64())) for x in (keys[:, :bands], keys[:, bands:])]
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(i).slice(words.row, words.n_texts) for i in (0, 1)), pa.array(n), pa.array(f1.view(np.int64)), pa.array(f2.view(np.int64)), *lists],
                    names=["doc_id", "t", "n", "f1", "f2", "a", "b"],
                )

    return run


def _sets_of(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words in wg.pieces(batch.column(1), wg.NOT_SPACE, lower=True):
                sets = _shingle_sets(words, size)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(words.row, words.n_texts), pa.array([s.tobytes() for s in sets], pa.binary())], names=["node", "grams"]
                )

    return run


def _confirmed(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, dtype=bool)
            for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                x, y = (np.frombuffer(s.as_buffer(), dtype=np.uint64) for s in (x, y))
                both = np.sort(np.concatenate((x, y)))
                same = int((both[1:] == both[:-1]).sum())
                keep[i] = 100 * same >= percent * (len(x) + len(y) - same)
            out = batch.select([0, 1]).filter(pa.array(keep))
            yield out

    return run


def _exploded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, batch.num_rows, 256):
            part = batch.slice(lo, 256)
            grams = [np.frombuffer(x.as_buffer(), dtype=np.int64) for x in part.column(1)]
            n = np.array([len(x) for x in grams])
            node = np.repeat(part.column(0).to_numpy(), n)
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(np.repeat(n, n)), pa.array(np.concatenate(grams))], names=["node", "size", "gram"])


def _star_candidates(nodes: DataFrame, scratch: Scratch, percent: int) -> DataFrame:
    """nodes (node, n, a, b) -> (u, v, members): v is the smallest node of a bucket that holds u.

    members is the size of the largest such bucket, or -1 where the sizes of the two sets rule out a link.
    """
    first = nodes.select("node", "n", F.posexplode("a").alias("i", "ka"), "b")
    slim = first.select("i", "ka")
    shared = slim.groupBy("i", "ka").agg(F.count("*").alias("c")).where("c > 1").select("i", "ka")
    rows = first.join(shared, ["i", "ka"], "left_semi")
    keys = scratch.table(rows.select("node", "n", F.xxhash64("i", "ka").alias("ka"), F.posexplode("b").alias("j", "kb")), "keys")
    buckets = keys.groupBy("ka", "j", "kb").agg(F.min(F.struct("node", "n")).alias("least"), F.count("*").alias("members")).where("members > 1")
    near = f"100 * least(n, least.n) >= {percent} * greatest(n, least.n)"
    pairs = keys.join(buckets, ["ka", "j", "kb"]).where("node <> least.node").where(f"members > 2 or {near}")
    members = F.when(F.expr(near), F.col("members")).otherwise(-1)
    return pairs.groupBy(F.col("node").alias("u"), F.col("least.node").alias("v")).agg(F.max(members).alias("members"))


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    left = pairs.join(sets.select(F.col("node").alias("u"), F.col("grams").alias("gu")), "u")
    both = left.join(sets.select(F.col("node").alias("v"), F.col("grams").alias("gv")), "v").select("u", "v", "gu", "gv")
    return both.mapInArrow(_confirmed(percent), "u long, v long")


def _prefix_candidates(unresolved: DataFrame, sets: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """Pairs of an unresolved node and any node of another component that can reach the threshold: exact, by rare shingles first."""
    grams = sets.mapInArrow(_exploded, "node long, size long, gram long")
    counts = grams.groupBy("gram").agg(F.count("*").alias("c")).where("c > 1")
    common = grams.join(counts, "gram")
    order = Window.partitionBy("node").orderBy("c", "gram")
    whole = Window.partitionBy("node")
    ranked = common.withColumn("k", F.row_number().over(order)).withColumn("all", F.count("*").over(whole))
    # shingles that no other set has come first, so they take the first places
    prefix = ranked.withColumn("at", F.col("size") - F.col("all") + F.col("k")).where(f"at <= size - ({percent} * size + 99) div 100 + 1").select("node", "size", "gram", "at")
    prefix = prefix.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    prefix = prefix.join(unresolved.withColumn("open", F.lit(True)), "node", "left").withColumn("open", F.coalesce("open", F.lit(False)))
    x, y = prefix.where("open").alias("x"), prefix.alias("y")  # each pair from one side only
    hit = x.join(
        y,
        F.expr(
            f"x.gram = y.gram and x.label <> y.label and (not y.open or x.node < y.node) and 100 * least(x.size, y.size) >= {percent} * greatest(x.size, y.size)"
            f" and {100 + percent} * (1 + least(x.size - x.at, y.size - y.at)) >= {percent} * (x.size + y.size)"
        ),
    )
    return hit.select(F.greatest("x.node", "y.node").alias("u"), F.least("x.node", "y.node").alias("v")).distinct()


_MARKS = "doc_id long, t long, n long, f1 long, f2 long, a array<long>, b array<long>"


def _keyed(own: DataFrame) -> DataFrame:
    return own.select("doc_id", F.xxhash64("text").alias("t"), "text")


def _grouped(own: DataFrame, scratch: Scratch, size: int, percent: int, bands: int, rows: int) -> tuple[DataFrame, DataFrame]:
    """own (doc_id, text) -> marks, one row a text (doc_id, t, n, f1, f2), and groups, one row a class (f1, f2, n_exact, rep).

    t is a hash of the text.  rep (none, doc_id, t) is the row that stands for the class's whole component; none tells that it has
    no doc_id.  Texts without shingles have no class.
    """
    marks = scratch.table(_keyed(own).mapInArrow(_signatures(size, bands, rows), _MARKS), "signatures")
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "t")
    full = marks.where("n > 0").groupBy("f1", "f2").agg(F.min(F.struct(first.alias("first"), "n", "a", "b")).alias("x"), F.count("*").alias("n_exact"))
    # numbers are given as the table is written, and stay
    classes = scratch.table(full.select(F.monotonically_increasing_id().alias("node"), "f1", "f2", "n_exact", "x.*"), "classes")
    labels = _linked(own, classes, scratch, percent, size)
    groups = classes.select("node", "f1", "f2", "n_exact", "first")
    if labels is None:
        groups = groups.withColumn("rep", F.col("first"))
    else:
        reps = groups.join(labels, "node").groupBy("label").agg(F.min("first").alias("rep"))
        groups = groups.join(labels.join(reps, "label").select("node", "rep"), "node", "left").withColumn("rep", F.coalesce("rep", "first"))
    groups = scratch.table(groups.select("f1", "f2", "n_exact", "rep"), "groups")
    scratch.drop("classes", "sets", "links", "links2", "pairs", "pairs2", "unresolved")
    return marks.select("doc_id", "t", "n", "f1", "f2"), groups


def _linked(own: DataFrame, classes: DataFrame, scratch: Scratch, percent: int, size: int) -> DataFrame | None:
    """node, label of the classes that links hold together; None where there are no candidates."""
    pairs = scratch.table(_star_candidates(classes.select("node", "n", "a", "b"), scratch, percent), "pairs")
    scratch.drop("keys")
    if not has_rows(pairs):
        return None
    wanted = pairs.select(F.col("u").alias("node")).union(pairs.select(F.col("v").alias("node"))).distinct()
    asked = scratch.table(classes.join(wanted, "node", "left_semi").select("node", F.col("first.doc_id").alias("d"), F.col("first.t").alias("h")), "asked")
    met = _keyed(own).join(small(asked), F.expr("t = h and doc_id <=> d"))  # of all texts only those that are compared are shuffled
    chosen = met.groupBy("node").agg(F.min("text").alias("text"))
    sets = scratch.table(chosen.mapInArrow(_sets_of(size), "node long, grams binary"), "sets")
    scratch.drop("asked")
    links = scratch.table(_confirm(pairs.where("members > 0").select("u", "v"), sets, percent), "links")
    labelled = components(links, scratch, "first")
    failed = pairs.where("members > 2 or members < 0").join(links, ["u", "v"], "left_anti")
    at = labelled.select("node", "label")
    apart = (
        failed.join(at.withColumnsRenamed({"node": "u", "label": "lu"}), "u", "left")
        .join(at.withColumnsRenamed({"node": "v", "label": "lv"}), "v", "left")
        .where("coalesce(lu, u) <> coalesce(lv, v)")
        .select(F.col("u").alias("node"))
        .distinct()
    )
    unresolved = scratch.table(apart, "unresolved")
    if has_rows(unresolved):
        crowded = pairs.where("members > 2 or members < 0")
        members = crowded.select(F.col("u").alias("node")).union(crowded.select(F.col("v").alias("node"))).distinct()
        more = scratch.table(_prefix_candidates(unresolved, sets.join(members, "node", "left_semi"), labelled, percent), "pairs2")
        if has_rows(more):
            links2 = scratch.table(_confirm(more, sets, percent), "links2")
            labelled = components(links.union(links2), scratch, "second")
    return labelled


def near_duplicates(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size: int = 4, percent: int = 80, bands: int = BANDS, rows: int = ROWS
) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (smallest doc_id that links reach), kept (doc_id = component_id), n_exact.

    Texts are lower-cased (A-Z) and cut at white space; a set holds the distinct ``size``-word shingles, or the whole sequence
    where there are fewer words.  Texts are linked if 100 * intersection >= percent * union.  n_exact counts the rows with an
    equal set.

    A null or empty text has no shingles, is linked with nothing and keeps its own id.  A row with a null id takes no part in
    linking: its component_id is null and it is kept.  Rows that repeat an id are linked each by its own text, and all that carry
    the smallest id of their component are kept.  Other columns are ignored; an empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession, "neardup")
    own = texts(docs, id_col, text_col)
    marks, groups = _grouped(own.where("doc_id is not null"), scratch, size, percent, bands, rows)
    by_set = groups.select("f1", "f2", F.col("rep.doc_id").alias("component_id"), "n_exact")
    out = marks.join(by_set, ["f1", "f2"], "left").select("doc_id", "n", F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce("n_exact", F.lit(1)).cast("long").alias("n_exact"))
    nameless = own.where("doc_id is null").select("text")
    nameless = nameless.mapInArrow(_counted(size), "n long").select(F.lit(None).cast("long").alias("doc_id"), "n", F.lit(None).cast("long").alias("component_id"), F.lit(1).cast("long").alias("n_exact"))
    return out.unionByName(nameless).select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"), "n_exact")


def _counted(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words in wg.pieces(batch.column(0), wg.NOT_SPACE, lower=True):
                yield pa.RecordBatch.from_arrays([pa.array([len(s) for s in _shingle_sets(words, size)], pa.int64())], names=["n"])

    return run


def one_of_each(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS
) -> DataFrame:
    """The rows of docs, all columns as they were, without near duplicates: exactly one row of each group stays.

    It is the one with the smallest id, null ids last; of rows that share id and text, one.  Rows with a null or empty text belong to
    no group and all stay.  An empty table stays empty.

    Rows are told apart by id and a hash of the text, so no copy of docs is written; what goes is taken out by an anti-join whose
    other side has no texts.
    """
    scratch = Scratch(docs.sparkSession, "one-of-each")
    d, t, i, u, row = (fresh(docs, name) for name in ("own_id", "own_hash", "out_id", "out_hash", "own_row"))
    marks, groups = _grouped(texts(docs, id_col, text_col), scratch, size, percent, bands, rows)
    placed = marks.where("n > 0").join(groups, ["f1", "f2"]).select("doc_id", "t", F.expr("doc_id <=> rep.doc_id and t = rep.t").alias("stays"))
    fate = placed.groupBy("doc_id", "t").agg(F.max("stays").alias("stays"), F.count("*").alias("n"))
    out_of = scratch.table(fate.where("not stays or n > 1").select(F.col("doc_id").alias(i), F.col("t").alias(u), "stays"), "out")
    scratch.drop("signatures", "groups")
    own = docs.withColumns({d: F.col(id_col).cast("long"), t: F.xxhash64(F.col(text_col).cast("string"))})
    same = F.col(d).eqNullSafe(F.col(i)) & (F.col(t) == F.col(u))
    left = own.join(small(out_of.select(i, u)), same, "left_anti").select(*columns(docs))
    again = out_of.where("stays").select(i, u)
    if not has_rows(again):
        return left
    rows_of = own.join(small(again), same, "left_semi").groupBy(d, t).agg(F.min_by(F.struct(*columns(docs)), F.xxhash64(*columns(docs))).alias(row))
    return left.union(rows_of.select(f"{row}.*"))
