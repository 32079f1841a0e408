"""Cards, captures and the rest, derived from the star schema by SQL that Spark and DuckDB read alike."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evimatch.functions import vocabulary as v


def _one_of(words: list[str]) -> str:
    """A word of a list by the capture's number."""
    return f"split_part('{'|'.join(words)}', '|', cast(cid % {len(words)} + 1 as int))"


_BACK = ["concat(upper(maker), ' CHROME')", "concat('© ', cast(year as string), ' ', maker)", "concat('# ', cast(num as string))", "concat('Official ', league, ' Product, ', cast(num as string), '/', cast(den as string))", "concat(product, ' ', upper(finish))", "concat(maker, ' ', cast(year + 1 as string), ' No. ', cast(den as string), 'b')"]

VIEWS = {
    "ref_cards": """select cast(p_partkey as bigint) as id, p_name as name, p_brand as set_name, p_type as series, cast(1950 + p_size as int) as year,
        cast(10 * (1 + p_partkey % 34) as int) as hp, cast(row_number() over (partition by p_brand order by p_partkey) as int) as num,
        cast(count(*) over (partition by p_brand) as int) as den, p_partkey % 3 = 0 as has_variants, case when p_size % 7 = 0 then 'de' else 'en' end as language from {part}""",
    "ref_sets": "select set_name, cast(max(den) as int) as total, cast(min(year) as int) as released from {ref_cards} group by set_name",
    "captures": """select o.o_orderkey as cid, r.id as true_id, case when o.o_orderkey % 3 = 0 then replace(r.name, 'e', 'c') else r.name end as name, r.name as true_name,
        r.num as num, cast(case when o.o_orderstatus = 'P' then r.den + 1 else r.den end as int) as den, cast(case when o.o_orderpriority = '5-LOW' then r.year + 3 else r.year end as int) as year,
        case when o.o_orderkey % 11 = 0 then null else r.hp end as hp, case when o.o_orderkey % 4 = 0 then null else 'en' end as language, o.o_orderpriority as priority,
        cast(case when o.o_orderkey % 10 = 0 then 'PSA' when o.o_orderkey % 10 = 1 then 'beckett grading services' when o.o_orderkey % 10 = 2 then 'nobody' else null end as string) as grader
        from {orders} o join {ref_cards} r on r.id = o.o_custkey""",
    "ocr_text": """select cid, concat(case when cid % 2 = 0 then 'Basic' else 'Evolves from Someone' end, chr(10), name, case when cid % 7 = 0 then '' else concat(' HP ', cast(coalesce(hp, 55) as string)) end, chr(10),
        replace(cast(num as string), '0', 'O'), case when cid % 3 = 0 then '|' else '/' end, cast(den as string), chr(10), '© ', cast(year as string), ' Wizards Inc.', chr(10),
        case when cid % 5 = 0 then 'Reverse Holo Rare' when cid % 5 = 1 then '1st Edition' when cid % 5 = 2 then 'Prizm niveau 2' else 'Entwicklungsstufe 1' end) as text from {captures}""",
    "strip_text": "select cid, case when cid % 5 = 0 then '' else text end as text, cast(0.8 as double) as top_conf, case when cid % 8 = 3 then cast(0.4 as double) else cast(0.8 as double) end as bottom_conf from {ocr_text}",
    "cards": """select c_custkey as card_id, c_name as name, concat('Brand#', cast(c_nationkey as string)) as set_name, cast(c_custkey % 40 as string) as number, c_mktsegment as variant,
        case when c_custkey % 5 = 0 then 'NEEDS_REVIEW' when c_custkey % 17 = 0 then 'FAILED' else 'IDENTIFIED' end as state, cast(c_custkey % 101 as int) as confidence, cast(c_custkey % 4 as int) as quantity, c_acctbal as price from {customer}""",
    "photos": """select page_id as pos, case when page_id % 9 = 0 then concat('scan_', cast(page_id as string), '.jpg') else concat('Card-', cast((page_id - page_id % 2) / 2 % 40 as int), case when page_id % 2 = 0 then '_Front' else '-back' end, case when page_id % 5 = 0 then '.JPG' else '.png' end) end as name from {pages}""",
    "words": """select l_orderkey as doc_id, row_number() over (partition by l_orderkey order by l_partkey, l_suppkey, l_linenumber, l_extendedprice, l_quantity, l_discount, l_tax) as word_id, concat('W', cast(l_partkey % 97 as string)) as text, l_partkey as part_id,
        cast(l_linenumber % 3 as int) as row_id, cast(l_partkey % 900 as double) as x0, cast(l_partkey % 900 + 20 + l_suppkey % 60 as double) as x1, cast(8 + l_suppkey % 9 as double) as h, cast(l_suppkey % 8 as double) / 8.0 as conf from {lineitem}""",
    "job_log": """select user_id as job_id, event_id, ts, event_type = 'error' as failed, cast(floor(value * 10) as bigint) as ms,
        case when event_type = 'signup' then 'QUEUED' when event_type = 'view' then 'RUNNING' when event_type = 'error' then 'FAILED' else 'DONE' end as state from {events}""",
    "moves": """select user_id as card_id, event_id, ts, case when event_type = 'signup' then 'UPLOADED' when event_type = 'view' then 'PROCESSING' when event_type = 'click' then 'NEEDS_REVIEW' when event_type = 'purchase' then 'VERIFIED' else 'FAILED' end as state from {events}""",
    "general": """select cid, case when cid % 4 = 0 then null else name end as name, case when cid % 3 = 0 then null else concat(cast(num as string), '/', cast(den as string)) end as number,
        case when cid % 6 = 1 then cast(0.3 as double) else cast(0.8 as double) end as number_conf, case when cid % 2 = 0 then null else 'Base' end as set_name, case when cid % 7 = 0 then null else cast(year as string) end as year,
        case when cid % 5 = 0 then null when cid % 5 = 1 then 'Chrome' else 'Holo' end as variant, cast(cid % 10 as double) / cast(10 as double) as g_conf, case when cid % 4 < 2 then true_name end as g_name,
        case when cid % 3 = 1 then 'Topps' end as g_manufacturer, case when cid % 3 = 2 then 'Prizm' end as g_product, case when cid % 7 < 2 then '1999' end as g_year, case when cid % 6 < 2 then cast(num as string) end as g_number,
        case when cid % 12 = 0 then 'lone number' end as g_rule, case when cid % 8 = 0 then 'NBA' when cid % 8 = 1 then 'WWE' end as g_league, case when cid % 9 = 1 then concat(cast(num as string), '/', cast(den as string)) end as g_serial,
        case when cid % 10 = 0 then 'refractor' end as g_finish from {captures}""",
    "back_lines": f"""with c as (select *, {_one_of(v.MANUFACTURERS)} as maker, {_one_of(v.PRODUCTS)} as product, {_one_of(list(v.LEAGUES))} as league, {_one_of(v.FINISHES)} as finish from {{captures}}) """
    + " union all ".join(f"select cid, {i} as line_id, {said} as text, cast(3 + (cid + 3 * {i}) % 7 as double) / cast(10 as double) as confidence from c" for i, said in enumerate(_BACK)),
    "sided_names": """with c as (select cid as card_id, cid, name, true_name, cast(3 + cid % 7 as double) / cast(10 as double) as sure from {captures})
        select card_id, 'front' as side, 0 as pos, name as text, sure as confidence, sure / cast(2 as double) as score from c
        union all select card_id, 'front', 1, case when cid % 5 = 0 then upper(true_name) else concat(split_part(true_name, ' ', 2), ' other') end, cast(0.65 as double), cast(0.4 as double) from c where cid % 4 < 2
        union all select card_id, 'back', 0, case when cid % 3 = 1 then 'nobody here' else true_name end, cast(0.7 as double), cast(0.3 as double) from c where cid % 11 > 0
        union all select card_id, 'back', 1, case when cid % 2 = 0 then concat(true_name, ' Jr.') else split_part(true_name, ' ', 1) end, cast(0.6 as double), cast(0.2 as double) from c where cid % 4 > 0""",
    "corrected": """select c_custkey as card_id, case when c_custkey % 4 = 0 then 'Mine' end as mine, c_name as name, case when c_custkey % 6 = 0 then 'name,variant' when c_custkey % 6 = 1 then 'year' else '' end as flags,
        case when c_custkey % 5 = 0 then 'NEEDS_REVIEW' when c_custkey % 17 = 0 then 'FAILED' else 'IDENTIFIED' end as state, case when c_custkey % 3 = 0 then upper(c_name) end as c_name_known, cast(c_custkey % 101 as double) / cast(100 as double) as sure from {customer}""",
}
#: Tables whose rows are worked on one by one.  One that Spark would read in fewer splits than there are cores (as in tests) is dealt out
#: to all of them first; it has at most a split's bytes for each core.  Events are left out: all that reads them deals them by a key.
FACTS = {"orders", "lineitem", "documents", "embeddings"}
BASE = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A base table or a derived view."""
    if name in BASE:
        table = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        cores = spark.sparkContext.defaultParallelism
        return table.repartition(cores) if name in FACTS and table.rdd.getNumPartitions() < cores else table
    sql = VIEWS[name]
    return spark.sql(sql, **{n: view(spark, sf_dir, n) for n in set(re.findall(r"\{(\w+)\}", sql))})


def back_lines(captures: DataFrame) -> DataFrame:
    """The view of that name from one reading of the captures; as a union of its lines it reads and joins them once for each line."""
    words = {"maker": v.MANUFACTURERS, "product": v.PRODUCTS, "league": list(v.LEAGUES), "finish": v.FINISHES}
    c = captures.selectExpr("cid", "num", "den", "year", *[f"{_one_of(x)} as {name}" for name, x in words.items()])
    lines = c.selectExpr("cid", f"posexplode(array({', '.join(_BACK)})) as (line_id, text)")
    return lines.selectExpr("cid", "line_id", "text", "cast(3 + (cid + 3 * line_id) % 7 as double) / cast(10 as double) as confidence")


def words(lineitem: DataFrame) -> DataFrame:
    """The view of that name, its key named before words are numbered: what then works by document needs no further shuffle."""
    named = lineitem.selectExpr("l_orderkey as doc_id", "l_partkey as part_id", "l_suppkey", "l_linenumber", "l_extendedprice", "l_quantity", "l_discount", "l_tax")
    order = Window.partitionBy("doc_id").orderBy("part_id", "l_suppkey", "l_linenumber", "l_extendedprice", "l_quantity", "l_discount", "l_tax")
    return named.withColumn("word_id", F.row_number().over(order)).selectExpr(
        "doc_id", "word_id", "concat('W', cast(part_id % 97 as string)) as text", "part_id", "cast(l_linenumber % 3 as int) as row_id",
        "cast(part_id % 900 as double) as x0", "cast(part_id % 900 + 20 + l_suppkey % 60 as double) as x1", "cast(8 + l_suppkey % 9 as double) as h", "cast(l_suppkey % 8 as double) / 8.0 as conf",
    )


def expand(sql: str) -> str:
    """SQL with {view} references written out, for another engine."""
    known = "|".join([*BASE, *VIEWS])
    return re.sub(rf"\{{({known})\}}", lambda m: m[1] if m[1] in BASE else f"({expand(VIEWS[m[1]])})", sql)
