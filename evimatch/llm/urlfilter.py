"""URL filters with dated lists: entries become validity intervals, captures are judged by the entries of their own time.

DataFrame operations only.  A list is a log of changes (kind, pattern, action, at).  Changes of one pattern are ordered by time and
each holds until the next; a capture at time t is matched as of t.  A URL is turned into the keys an entry could name - its host,
every domain above it, its host with every leading part of its path as deep as the list goes - and meets the list by equality on the key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def intervals(entries: DataFrame) -> DataFrame:
    """kind, pattern, since, until (null: still holds): when a pattern was on the list.

    action is 'add' or 'remove'.  Repeated adds change nothing; at one time a remove wins over an add.  Rows with a null field are
    left out.  kind is 'host', 'domain' or 'prefix'; patterns are compared in lower case, prefixes without a trailing slash.
    """
    pattern = F.when(F.col("kind") == "prefix", F.regexp_replace(F.lower("pattern"), "/+$", "")).otherwise(F.lower("pattern"))
    whole = entries.select("kind", pattern.alias("pattern"), "action", F.col("at").cast("timestamp").alias("at")).dropna()
    state = whole.groupBy("kind", "pattern", "at").agg(F.min(F.col("action") == "add").alias("on"))
    order = Window.partitionBy("kind", "pattern").orderBy("at")
    turns = state.withColumn("was", F.lag("on", 1, False).over(order)).where("on <> was")
    return turns.withColumn("until", F.lead("at").over(order)).where("on").select("kind", "pattern", F.col("at").alias("since"), "until")


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))


def path_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1))


def deepest(held: DataFrame) -> DataFrame:
    """One row, deepest: path parts that any prefix entry names at most."""
    parts = F.length("pattern") - F.length(F.translate("pattern", "/", ""))
    return held.agg(F.coalesce(F.max(F.when(F.col("kind") == "prefix", parts)), F.lit(0)).alias("deepest"))


def keys_of(host: Column, path: Column, deepest: Column) -> Column:
    """All (kind, pattern) pairs that an entry matching this URL can have; no prefix entry has more than deepest path parts."""
    kinds = "struct<kind:string,pattern:string>"
    labels = F.split(host, r"\.")
    parts = F.filter(F.split(path, "/"), lambda x: x != "")
    n = F.size(labels)
    domains = F.transform(F.sequence(F.lit(1), n), lambda i: F.struct(F.lit("domain").alias("kind"), F.array_join(F.slice(labels, i, n), ".").alias("pattern")))
    depth = F.least(F.size(parts), deepest)
    prefixes = F.transform(F.sequence(F.lit(0), depth), lambda i: F.struct(F.lit("prefix").alias("kind"), F.concat_ws("/", host, F.when(i > 0, F.array_join(F.slice(parts, F.lit(1), i), "/"))).alias("pattern")))
    own = F.array(F.struct(F.lit("host").alias("kind"), host.alias("pattern")))
    return F.when(host != "", F.concat(own, domains, prefixes)).otherwise(F.array().cast(f"array<{kinds}>"))


def judge(captures: DataFrame, entries: DataFrame, *, id_col: str = "page_id", url_col: str = "url", at_col: str = "fetched_at") -> DataFrame:
    """Per capture: id, host, n_entries (entries active for it when it was fetched), matched (the strictest, as kind:pattern), blocked.

    A null or malformed URL has host '' and is matched by nothing; so is a capture without a time.  Rows are kept as they are,
    repeated ones too; an empty list blocks nothing.  Captures are reduced to their distinct (host, path, time) before they meet
    the list, so a page fetched again and again costs one lookup.
    """
    url = F.coalesce(F.col(url_col).cast("string"), F.lit(""))
    own = captures.select(F.col(id_col).alias("id"), host_of(url).alias("host"), path_of(url).alias("path"), F.col(at_col).cast("timestamp").alias("at"))
    lookup = own.where("host <> ''").select("host", "path", "at").distinct()
    listed = intervals(entries)
    deep = lookup.crossJoin(F.broadcast(deepest(listed)))  # one row
    keyed = deep.select("host", "path", "at", F.explode(keys_of(F.col("host"), F.col("path"), F.col("deepest"))).alias("key")).select("host", "path", "at", "key.kind", "key.pattern")
    held = listed.withColumnsRenamed({"kind": "k", "pattern": "p"})
    active = keyed.join(held, F.expr("kind = k and pattern = p and at >= since and (until is null or at < until)"))
    found = active.groupBy("host", "path", "at").agg(F.count("*").alias("n_entries"), F.min(F.concat_ws(":", "kind", "pattern")).alias("matched"))
    meet = own.join(found, ["host", "path", "at"], "left")
    n = F.coalesce("n_entries", F.lit(0)).cast("long")
    return meet.select(F.col("id").alias(id_col), "host", n.alias("n_entries"), F.coalesce("matched", F.lit("")).alias("matched"), (n > 0).alias("blocked"))
