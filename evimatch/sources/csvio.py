"""Template files in and spreadsheet-safe CSV out."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evimatch.functions import market
from evimatch.functions import text as t
from evimatch.functions import vocabulary as v

MISSING = "Needs review"


@dataclass
class Template:
    """A marketplace's file layout; a few dozen headers, so it lives on the driver and shapes the plan."""

    headers: list[str]
    delimiter: str = ","
    preamble: list[list[str]] = field(default_factory=list)
    sample_rows: list[list[str]] = field(default_factory=list)
    required: list[str] = field(default_factory=list)
    recommended: list[str] = field(default_factory=list)


def scan(spark: SparkSession, path: str) -> DataFrame:
    """The physical lines of CSV files: file, block (where the split begins that the line was read in), at (grows within a split), line."""
    lines = spark.read.option("lineSep", "\n").text(path)
    return lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), F.col("value").alias("line"))


def records(lines: DataFrame) -> DataFrame:
    """file, row (from 0), text: the records of physical lines (file, block, at, line); a line end inside quotes ends no record.

    Whether a line ends its record depends on how many quotes stand before it in its file, and its row on how many records ended there.
    Both are counted by block: a block gives its quotes and its record ends for either parity, a window over the blocks of a file
    carries them on, and lines take up what their block was given.  So a file of any size is read by as many tasks as it has splits.
    Only lines of records that go over several are brought together.  A quote that is never closed makes one record of what follows it.
    """
    order = Window.partitionBy("file", "block").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    quotes = F.length("line") - F.length(F.replace("line", F.lit('"'), F.lit("")))
    told = lines.withColumn("own", quotes.cast("long")).withColumn("quotes", F.sum("own").over(order))
    ends = lambda odd: F.sum((F.col("quotes") % 2 == odd).cast("long"))
    told = told.withColumns({"ends0": ends(0).over(order), "ends1": ends(1).over(order)})
    blocks = told.groupBy("file", "block").agg(F.sum("own").alias("all"), ends(0).alias("end0"), ends(1).alias("end1"))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("odd", F.coalesce(F.sum("all").over(earlier), F.lit(0)) % 2)
    blocks = blocks.withColumn("start", F.coalesce(F.sum(F.when(F.col("odd") == 0, F.col("end0")).otherwise(F.col("end1"))).over(earlier), F.lit(0)))
    placed = told.join(blocks.select("file", "block", "odd", "start"), ["file", "block"])
    ended = (F.col("odd") + F.col("quotes")) % 2 == 0
    begun = (F.col("odd") + F.col("quotes") - F.col("own")) % 2 == 0
    row = F.col("start") + F.when(F.col("odd") == 0, F.col("ends0")).otherwise(F.col("ends1")) - ended.cast("long")
    placed = placed.select("file", "block", "at", "line", row.alias("row"), (begun & ended).alias("whole"))
    pieces = placed.where("not whole").groupBy("file", "row").agg(F.array_sort(F.collect_list(F.struct("block", "at", "line"))).alias("p"))
    joined = pieces.select("file", "row", F.array_join(F.transform("p", lambda x: x["line"]), "\n").alias("text"))
    every = placed.where("whole").select("file", "row", F.col("line").alias("text")).unionByName(joined)
    return every.withColumn("text", F.when(F.col("row") == 0, F.regexp_replace("text", "^\ufeff", "")).otherwise(F.col("text")))


def cells(record: Column, delimiter: Column) -> Column:
    """The cells of a record: quotes are taken off, doubled ones inside quotes are one, delimiters inside quotes stay, \\r outside goes.

    Cut at its quotes a record is by turns outside and inside of them; an empty piece outside, between two quotes, is a doubled one.
    """
    sign = F.concat(F.lit("\\Q"), delimiter, F.lit("\\E"))
    split = lambda x: F.split(F.replace(x, F.lit("\r"), F.lit("")), sign, -1)
    none = F.expr("named_struct('done', cast(array() as array<string>), 'open', '')")

    def walk(pieces: Column) -> Column:
        def step(a: Column, p: Column) -> Column:
            more = lambda x: F.struct(a["done"].alias("done"), F.concat(a["open"], x).alias("open"))
            doubled = (p["i"] > 0) & (p["i"] < F.size(pieces) - 1) & (p["s"] == "")

            def outside(parts: Column) -> Column:
                first = F.array(F.concat(a["open"], parts[0]))
                return F.when(F.size(parts) == 1, more(parts[0])).otherwise(F.struct(F.concat(a["done"], first, F.slice(parts, 2, F.size(parts) - 2)).alias("done"), F.element_at(parts, -1).alias("open")))

            return F.when(p["i"] % 2 == 1, more(p["s"])).when(doubled, more(F.lit('"'))).otherwise(t.let(split(p["s"]), outside))

        found = F.aggregate(F.transform(pieces, lambda s, i: F.struct(i.alias("i"), s.alias("s"))), none, step)
        return t.let(found, lambda f: F.array_append(f["done"], f["open"]))

    return F.when(record.contains('"'), t.let(F.split(record, '"', -1), walk)).otherwise(split(record))


def read_rows(lines: DataFrame, delimiter: str | None = None) -> DataFrame:
    """file, row, delimiter, cells of physical lines as scan() gives them; rows may have any number of cells.

    Without a delimiter each file's is told from its first physical line.  A blank line is a row of one empty cell, as is one in quotes.
    """
    found = records(lines)
    if delimiter is None:
        first = lines.groupBy("file").agg(F.min_by("line", F.struct("block", "at")).alias("line"))
        found = found.join(first.select("file", market.delimiter(F.regexp_replace("line", "^\ufeff", "")).alias("delimiter")), "file")
    else:
        found = found.withColumn("delimiter", F.lit(delimiter))
    return found.select("file", "row", "delimiter", cells(F.col("text"), F.col("delimiter")).alias("cells"))


#: Rows among which a header is looked for.
HEADER_ROWS = 20


def templates(rows: DataFrame) -> DataFrame:
    """file, delimiter, header_row, headers, required, preamble (rows), n_samples of the rows of any number of template files.

    The header is, of the first 20 rows with two cells or more, the one with the most distinct cells (first on a tie; a bonus if all
    differ).  Rows above it are the preamble, rows below it with any cell that is not blank are samples; blank header cells are dropped.
    Files without such a row give none.
    """
    bare = F.filter(F.transform("cells", lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")), lambda c: c != "")
    told = rows.withColumn("bare", bare)
    distinct = F.size(F.array_distinct("bare"))
    points = distinct + (distinct == F.size("bare")).cast("int")
    early = told.where((F.col("row") < HEADER_ROWS) & (F.size("bare") >= 2))
    heads = early.groupBy("file").agg(F.max_by(F.struct("row", "bare"), F.struct(points.alias("p"), (-F.col("row")).alias("r"))).alias("h"))
    both = told.join(heads.select("file", F.col("h.row").alias("header_row"), F.col("h.bare").alias("headers")), "file")
    above = F.when(F.col("row") < F.col("header_row"), F.struct("row", "cells"))
    whole = both.groupBy("file", "delimiter", "header_row", "headers").agg(F.array_sort(F.collect_list(above)).alias("above"), F.count_if((F.col("row") > F.col("header_row")) & (F.size("bare") > 0)).alias("n_samples"))
    needed = F.filter("headers", market.required_header)
    return whole.select("file", "delimiter", "header_row", "headers", needed.alias("required"), F.transform("above", lambda x: x["cells"]).alias("preamble"), "n_samples")


def parse_template(spark: SparkSession, text: str) -> Template:
    """The one template of a text; its rows are read as those of any file are."""
    lines = spark.createDataFrame([("", 0, i, x) for i, x in enumerate(text.removesuffix("\n").split("\n"))], "file string, block long, at long, line string")
    rows = read_rows(lines)
    head = templates(rows).first()
    if head is None:
        raise ValueError("no header row found in this template")
    samples = rows.where((F.col("row") > head.header_row) & F.exists("cells", lambda c: F.trim(c) != "")).orderBy("row").collect()  # a template's few
    return Template(head.headers, head.delimiter, head.preamble, [r.cells for r in samples], head.required)


def starter() -> Template:
    heads = v.STARTER_HEADERS
    return Template(list(heads), ",", [["#INFO Version=0.0.2 Template= eBay-draft-listings-template_DE"]], [], heads[:2], ["Title", "Condition ID", "Start price", "Quantity"])


def mappings(headers: DataFrame) -> DataFrame:
    """template, mapping (field -> header), unmapped (fields), unknown (headers) of headers (template, i, header) of any number of templates.

    Headers that name a descriptor come first, then the fields in the order of their aliases; a field takes the first header of its names
    that no other field has.  A template's headers, a few dozen, are folded in the aggregation that brings them together.
    """
    told = headers.select("template", "i", F.col("header").alias("h"), market.normalize_header(F.col("header")).alias("n"), market.descriptor_field(F.col("header")).alias("d"))
    whole = told.groupBy("template").agg(F.array_sort(F.collect_list(F.struct("i", "h", "n", "d"))).alias("all"))
    taken = F.expr("cast(array() as array<struct<field:string,i:int,h:string>>)")
    entry = lambda field, x: F.struct(field.alias("field"), x["i"].cast("int").alias("i"), x["h"].alias("h"))
    has = lambda a, what, x: F.exists(a, lambda y: y[what] == x)
    first = F.aggregate("all", taken, lambda a, x: F.when(x["d"].isNull() | has(a, "field", x["d"]), a).otherwise(F.array_append(a, entry(x["d"], x))))
    fields = F.array(*[F.struct(F.lit(f).alias("field"), F.array(*map(F.lit, names)).alias("names")) for f, names in v.HEADER_ALIASES.items()])

    def give(a: Column, f: Column) -> Column:
        free = F.filter("all", lambda x: F.array_contains(f["names"], x["n"]) & ~F.exists(a, lambda y: y["h"] == x["h"]))
        return t.let(F.try_element_at(free, F.lit(1)), lambda x: F.when(x.isNull(), a).otherwise(F.array_append(a, entry(f["field"], x))))

    done = whole.withColumn("taken", F.aggregate(fields, first, give))
    last = F.filter("taken", lambda x, i: ~F.exists(F.slice("taken", i + 2, F.size("taken")), lambda y: y["field"] == x["field"]))  # a later header replaces a descriptor's
    mapping = F.map_from_entries(F.transform(last, lambda x: F.struct(x["field"], x["h"])))
    unmapped = F.array_except(F.array(*map(F.lit, v.HEADER_ALIASES)), F.map_keys(mapping))
    unknown = F.transform(F.filter("all", lambda x: ~has(F.col("taken"), "h", x["h"])), lambda x: x["h"])
    return done.select("template", mapping.alias("mapping"), unmapped.alias("unmapped"), unknown.alias("unknown"))


def suggest_mapping(spark: SparkSession, headers: list[str]) -> dict[str, str]:
    """field -> header of one template."""
    return mappings(spark.createDataFrame([(0, i, h) for i, h in enumerate(headers)], "template int, i int, header string")).first().mapping


def template_rows(cards: DataFrame, template: Template, mapping: dict[str, str], values: dict[str, Column], keep: list[str]) -> DataFrame:
    """keep columns and one column h<i> a header; unknown headers are empty, required ones without a value say so."""
    inverse = {h: f for f, h in mapping.items()}
    out = []
    for i, h in enumerate(template.headers):
        f = inverse.get(h)
        value = F.coalesce(values[f].cast("string"), F.lit("")) if f in values else F.lit("")
        if f is not None and h in template.required:
            value = F.when(value == "", MISSING).otherwise(value)
        out.append(value.alias(f"h{i}"))
    return cards.select(*keep, *out)


def _blank(template: Template, wanted: list[str]) -> Column:
    """The headers of ``wanted`` that a row has no value for."""
    at = {h: f"h{i}" for i, h in enumerate(template.headers)}
    return F.filter(F.array(*[F.when(F.coalesce(F.col(at[h]), F.lit("")).isin("", MISSING), h) for h in wanted]), lambda x: x.isNotNull()) if wanted else F.array().cast("array<string>")


def issues(rows: DataFrame, template: Template, key: str) -> DataFrame:
    """key, kind ('issue' or 'warning'), header: a row of its own for each value that a required or recommended header lacks."""
    of = lambda kind, wanted: F.transform(_blank(template, wanted), lambda h: F.struct(F.lit(kind).alias("kind"), h.alias("header")))
    return rows.select(key, F.explode(F.concat(of("issue", template.required), of("warning", template.recommended))).alias("x")).select(key, "x.*")


def summary(rows: DataFrame, template: Template) -> DataFrame:
    """kind, header, n: rows in all (total), without any issue (complete) and with one (affected), and for each header its issues and warnings.

    One pass: each row gives what it counts for, and counts are summed before they are shuffled.
    """
    one = lambda kind, header: F.struct(F.lit(kind).alias("kind"), header.alias("header"))
    none = F.lit(None).cast("string")
    told = rows.select(_blank(template, template.required).alias("bad"), _blank(template, template.recommended).alias("poor"))
    state = F.when(F.size("bad") == 0, one("complete", none)).otherwise(one("affected", none))
    counted = F.concat(F.array(one("total", none), state), F.transform("bad", lambda h: one("issue", h)), F.transform("poor", lambda h: one("warning", h)))
    return told.select(F.explode(counted).alias("x")).groupBy("x.kind", "x.header").agg(F.count("*").alias("n"))


def validate(rows: DataFrame, template: Template) -> DataFrame:
    """header, n of rows without a value a required header needs."""
    return summary(rows, template).where("kind = 'issue'").select("header", "n")


def csv_line(columns: list[Column], delimiter: str = ",", text: frozenset[int] = frozenset()) -> Column:
    return F.concat_ws(delimiter, *[market.csv_field(c, delimiter, i in text) for i, c in enumerate(columns)])


def write_csv(lines: DataFrame, header: str, order: list[str], path: str, preamble: tuple[str, ...] = (), bom: bool = True, by: str | None = None) -> None:
    """lines (order..., line) as CRLF text, range-partitioned by the order so that files concatenate in order.

    Every file but the first of the order has rows only; the head (byte order mark, preamble, header) is the first row of all.
    With ``by``, one folder for each of its values, each with a head of its own.
    """
    head = lines.sparkSession.createDataFrame([(("﻿" if bom else "") + "\r\n".join([*preamble, header]),)], "line string")
    first = [F.lit(0).alias("__k")]
    rows = lines.select(*( [by] if by else []), F.lit(1).alias("__k"), *order, "line")
    if by:
        heads = lines.select(by).distinct().crossJoin(F.broadcast(head)).select(by, *first, *[F.lit(None).cast(lines.schema[o].dataType).alias(o) for o in order], "line")  # one head row
        rows.unionByName(heads).repartitionByRange(by, "__k", *order).sortWithinPartitions(by, "__k", *order).select(by, "line").write.mode("overwrite").partitionBy(by).option("lineSep", "\r\n").text(path)
    else:
        heads = head.select(*first, *[F.lit(None).cast(lines.schema[o].dataType).alias(o) for o in order], "line")
        rows.unionByName(heads).repartitionByRange("__k", *order).sortWithinPartitions("__k", *order).select("line").write.mode("overwrite").option("lineSep", "\r\n").text(path)
