"""Named queries: each is a Spark function and, where SQL can say the same, the SQL to hold it against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from evimatch.functions import vocabulary as v
from evimatch.plans.views import expand, view

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register f(get) under its name, where get('captures') gives a table or view."""

    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(lambda name: view(spark, sf_dir, name))
        if sql is not None:
            ORACLES[f.__name__] = expand(sql).strip()
        return f

    return add


def fold_sql(x: str) -> str:
    return f"lower(trim(regexp_replace(translate(translate(coalesce({x}, ''), '{v.ACCENTED}', '{v.PLAIN}'), '`´', ''''''), '\\s+', ' ', 'g')))"


def similarity_sql(s: str, t: str) -> str:
    """Of two folded texts."""
    return (
        f"case when {s} = '' or {t} = '' then 0.0::double when {s} = {t} then 1.0::double when abs(length({s}) - length({t})) * 2 > greatest(length({s}), length({t})) then 0.0::double"
        f" else 1.0::double - levenshtein({s}, {t})::double / greatest(length({s}), length({t}))::double end"
    )


def number_sql(a: str, b: str) -> str:
    p = r"'^([A-Za-z]*)0*(\d+)([a-z]?)(?:\s*/\s*([A-Za-z]*)0*(\d+))?$'"
    part = lambda x, i: f"regexp_extract(trim(coalesce({x}, '')), {p}, {i})"
    num = lambda x, i: f"cast(nullif({part(x, i)}, '') as bigint)"
    return (
        f"case when {num(a, 2)} is null or {num(b, 2)} is null then case when {fold_sql(a)} = {fold_sql(b)} then 1.0::double else 0.0::double end"
        f" when {num(a, 2)} = {num(b, 2)} and lower({part(a, 1)}) = lower({part(b, 1)}) then case when coalesce({num(a, 5)}, 0) = 0 or coalesce({num(b, 5)}, 0) = 0 then 0.85::double when {num(a, 5)} = {num(b, 5)} then 1.0::double else 0.6::double end else 0.0::double end"
    )
