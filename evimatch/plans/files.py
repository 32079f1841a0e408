"""Queries on files: rows of CSV texts of any number of files, and the templates they hold."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from evimatch.functions import vocabulary as v
from evimatch.plans.records import _SQL_EBAY, _filled
from evimatch.plans.registry import query
from evimatch.session import shared_folder
from evimatch.sources import csvio, snapshots

#: A customer's orders as a file: above them a header and, in two files of three, a line or two of other things.  Cells hold quotes, line
#: ends, other delimiters and carriage returns; a third of the rows has a cell less.
_SECOND = "case o_orderkey % 5 when 0 then concat('say \"', o_orderpriority, '\"') when 1 then concat('two', chr(10), 'lines, ', o_orderstatus, chr(10)) when 2 then '' when 3 then concat('a;b', chr(9), o_orderpriority) else concat('\"', o_orderstatus, '\",') end"
_THIRD = "case when o_orderkey % 3 = 0 then null when o_orderkey % 7 = 0 then concat('x', chr(13), 'y') else concat(' ', o_orderstatus) end"
_MARK = "case when o_custkey % 2 = 0 then ';' else chr(9) end"


def _texts(get):
    """file, text."""
    quoted = lambda x: F.concat(F.lit('"'), F.replace(x, F.lit('"'), F.lit('""')), F.lit('"'))
    sql = lambda x: F.expr(x.replace("chr(", "char("))
    o = get("orders").select("o_custkey", "o_orderkey", sql(_SECOND).alias("b"), sql(_THIRD).alias("c"), sql(_MARK).alias("mark"))
    line = F.concat(F.col("o_orderkey").cast("string"), F.col("mark"), quoted(F.col("b")), F.coalesce(F.concat(F.col("mark"), quoted(F.col("c"))), F.lit("")), F.when(F.col("o_orderkey") % 2 == 0, F.lit("\r")).otherwise(F.lit("")))
    own = o.withColumn("line", line).groupBy("o_custkey", "mark").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", "line"))).alias("rows"))
    head = F.concat_ws("\n", F.when(F.col("o_custkey") % 3 > 0, F.concat(F.lit('﻿#INFO'), F.col("mark"), F.lit("Version"))), F.when(F.col("o_custkey") % 3 > 1, F.lit('"one\nnote"')), F.concat(F.lit("Id"), F.col("mark"), F.lit("*Text"), F.col("mark"), F.lit('"The ""Rest"""')))
    return own.select(F.col("o_custkey").cast("string").alias("file"), F.concat(F.concat_ws("\n", head, F.array_join(F.transform("rows", lambda x: x["line"]), "\n"))).alias("text"))


def _rows(get):
    """The texts' lines in blocks of five, so that quoted line ends go over blocks as they do over the splits of large files."""
    lines = _texts(get).select("file", F.posexplode(F.split("text", "\n", -1)).alias("at", "line"))
    return csvio.read_rows(lines.select("file", F.floor(F.col("at") / 5).alias("block"), "at", "line"))


_EXPECTED = f"""o as (select *, o_custkey % 3 as above, row_number() over (partition by o_custkey order by o_orderkey) as k, {_SECOND} as b, {_THIRD} as c from orders),
f as (select distinct o_custkey, above, {_MARK} as mark from o)"""


@query(f"""with {_EXPECTED}
select cast(o_custkey as varchar) as file, k + above as row, {_MARK} as delimiter, case when c is null then 2 else 3 end as n, cast(o_orderkey as varchar) as c1, b as c2, c as c3 from o
union all select cast(o_custkey as varchar), above, mark, 3, 'Id', '*Text', 'The "Rest"' from f union all select cast(o_custkey as varchar), 0, mark, 2, '#INFO', 'Version', null from f where above > 0
union all select cast(o_custkey as varchar), 1, mark, 1, 'one' || chr(10) || 'note', null, null from f where above > 1""")
def csv_rows(get):
    cell = lambda i: F.try_element_at("cells", F.lit(i)).alias(f"c{i}")
    return _rows(get).select("file", "row", "delimiter", F.size("cells").alias("n"), cell(1), cell(2), cell(3))


@query(f"""with {_EXPECTED} select cast(f.o_custkey as varchar) as file, mark as delimiter, f.above as header_row, 'Id|*Text|The "Rest"' as headers, '*Text' as required,
  case f.above when 0 then '' when 1 then '#INFO,Version' else '#INFO,Version|one' || chr(10) || 'note' end as preamble, count(*) as n_samples from f join o using (o_custkey) group by all""")
def csv_templates(get):
    found = csvio.templates(_rows(get))
    joined = F.array_join(F.transform("preamble", lambda r: F.array_join(r, ",")), "|")
    return found.select("file", "delimiter", "header_row", F.array_join("headers", "|").alias("headers"), F.array_join("required", "|").alias("required"), joined.alias("preamble"), "n_samples")


_FILLED = f"""{_SQL_EBAY}, filled as (select id, kind, c_name, c_acctbal from k join customer on c_custkey = id),
x as (select id, unnest(list_concat(['issue:{v.STARTER_HEADERS[0]}'], case when kind is null then ['issue:Category ID'] else [] end, case when c_name is null or c_name = '' then ['warning:Title'] else [] end, ['warning:Condition ID'], case when c_acctbal < 0 then ['warning:Start price'] else [] end)) as p from filled)"""


@query(f"{_FILLED} select split_part(p, ':', 1) as kind, substr(p, strpos(p, ':') + 1) as header, count(*) as n from x group by all union all select 'total', null, count(*) from filled union all select 'affected', null, count(*) from filled")
def template_summary(get):
    return csvio.summary(*_filled(get))


@query(f"{_FILLED} select id, split_part(p, ':', 1) as kind, substr(p, strpos(p, ':') + 1) as header from x")
def template_issues(get):
    return csvio.issues(*_filled(get), "id")


#: Ten parts are a template; headers are names of fields in several spellings, descriptors, and words that no field has.
_HEADER = """case p_partkey % 13 when 0 then '*C:Player' when 1 then 'cardName' when 2 then 'CD:Grade - (ID: 27502)' when 3 then 'Kategorie (ID: 3)' when 4 then 'Start_price' when 5 then 'CD:27502' when 6 then 'PREIS' when 7 then p_brand when 8 then 'Year' when 9 then 'L:Jahr' when 10 then 'grade' when 11 then 'Quantity' else p_name end"""
_ALIASES = ", ".join(f"('{f}', '{a}', {i})" for i, (f, names) in enumerate(v.HEADER_ALIASES.items()) for a in names)


@query(f"""with h as (select cast(p_partkey // 10 as bigint) as template, p_partkey as i, {_HEADER} as h from part),
n as (select *, regexp_replace(lower(trim(regexp_replace(regexp_replace(regexp_replace(replace(h, '*', ''), '^(?i:C|L):', ''), '\\s*\\([^)]*\\)\\s*', ' ', 'g'), '([a-z0-9])([A-Z])', '\\1 \\2', 'g'))), '[\\s_-]+', ' ', 'g') as n, h in ('CD:Grade - (ID: 27502)', 'CD:27502') as d from h),
al(field, alias, k) as (values {_ALIASES}),
d as (select template, min_by(h, i) as h from n where d group by template),
f as (select template, field, min_by(h, i) as h from (select n.template, al.field, n.h, n.i from n join al on al.alias = n.n left join d on d.template = n.template and d.h = n.h where d.h is null) group by all),
m as (select template, field, h from f union all select template, 'gradeId', h from d),
t as (select distinct template from n)
select t.template, coalesce((select string_agg(field || '=' || h, '|' order by field) from m where m.template = t.template), '') as mapping,
  (select count(*) from (select distinct field from al) a where a.field not in (select field from m where m.template = t.template)) as n_unmapped,
  coalesce((select string_agg(n.h, '|' order by n.i) from n where n.template = t.template and n.h not in (select h from m where m.template = t.template)), '') as unknown from t""")
def header_mapping(get):
    told = get("part").select(F.floor(F.col("p_partkey") / 10).alias("template"), F.col("p_partkey").alias("i"), F.expr(_HEADER).alias("header"))
    found = csvio.mappings(told)
    pairs = F.array_sort(F.transform(F.map_entries("mapping"), lambda x: F.concat(x["key"], F.lit("="), x["value"])))
    return found.select("template", F.array_join(pairs, "|").alias("mapping"), F.size("unmapped").cast("bigint").alias("n_unmapped"), F.array_join("unknown", "|").alias("unknown"))


#: Two snapshots of the catalogue before the day asked for and one after it; the second brings some sets only, with cards renamed and missing.
_RENEWED, _AS_OF = "set_name < 'Brand#3'", "2024-02-15"


@query(f"""select id, case when {_RENEWED} then name || ' II' else name end as name, set_name, num, den, hp, case when {_RENEWED} then year + 1 else year end as year
from {{ref_cards}} where not ({_RENEWED} and id % 2 = 1)""")
def catalogue_as_of(get):
    cards = get("ref_cards").select("id", "name", "set_name", "num", "den", "hp", "year")
    spark = cards.sparkSession
    path = f"{shared_folder(spark)}/catalogue-{uuid.uuid4()}"
    renewed = cards.where(_RENEWED).where("id % 2 = 0").withColumns({"name": F.concat("name", F.lit(" II")), "year": F.col("year") + 1})
    for day, what in (("2024-01-01", cards), ("2024-02-01", renewed), ("2024-03-01", cards.withColumn("name", F.lit("later")))):
        snapshots.write_snapshot(what, path, day)
    return snapshots.cards_as_of(spark, path, _AS_OF)
