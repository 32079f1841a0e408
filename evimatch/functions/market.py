"""What a marketplace file needs: ids, prices, titles, headers and safe CSV fields."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from evimatch.functions import vocabulary as v

DEFAULT_TITLE = "{year} {manufacturer} {set} {name} #{number} {variant} {language}"


def _plain(c: Column) -> Column:
    bare = F.lower(F.translate(F.coalesce(c.cast("string"), F.lit("")), v.ACCENTED, v.PLAIN))
    return F.trim(F.regexp_replace(F.regexp_replace(bare, "[^a-z0-9. ]+", " "), r"\s+", " "))


def _plain_text(s: str) -> str:
    return re.sub(r"\s+", " ", re.sub("[^a-z0-9. ]+", " ", s.lower())).strip()


def _lookup(key: Column, table: dict) -> Column:
    pairs = [x for k, val in table.items() for x in (F.lit(k), F.lit(val))]
    return F.try_element_at(F.create_map(*pairs), key)


def _blank(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit("")) == ""


def card_type(chosen: Column, game: Column, sport: Column) -> Column:
    said = F.trim(F.coalesce(chosen, F.lit("")))
    return F.when(said.isin(*v.CATEGORIES), said).when(~_blank(game), "ccg").when(~_blank(sport), "sports")


def category_id(kind: Column) -> Column:
    return _lookup(kind, v.CATEGORIES)


def condition_id(text: Column) -> Column:
    return _lookup(_plain(text), v.CONDITIONS)


def grader_id(text: Column) -> Column:
    table: dict[str, int] = {}
    for code, name, short in v.GRADERS:
        for key in (name, short):
            if key:
                table.setdefault(_plain_text(key), code)
    return _lookup(_plain(text), table)


def grade_id(text: Column) -> Column:
    """A label, else the last number in the text without trailing zeroes."""
    t = _plain(text)
    words = _lookup(t, {_plain_text(k): code for k, code in v.GRADES.items()})
    last = F.try_element_at(F.regexp_extract_all(t, F.lit(r"(\d+(?:\.\d+)?)"), F.lit(1)), F.lit(-1))
    number = F.regexp_replace(F.regexp_replace(F.regexp_replace(last, r"^0+(?=\d)", ""), r"(\.\d*?)0+$", "$1"), r"\.$", "")
    return F.when(t == "", None).otherwise(F.coalesce(words, _lookup(number, v.GRADES)))


def is_graded(said: Column, grader: Column, grade: Column, condition: Column) -> Column:
    text = F.coalesce(said.cast("string"), F.lit(""))
    return (
        F.when(text.rlike("(?i)^(yes|y|true|ja|graded|bewertet)$"), True)
        .when(text.rlike("(?i)^(no|n|false|nein|ungraded|unbewertet)$"), False)
        .when(~_blank(grader) | ~_blank(grade), True)
        .when(~_blank(condition), False)
    )


def problems(kind: Column, graded: Column, condition: Column, grader: Column, grade: Column) -> Column:
    """What is missing before a card can be listed, in words."""
    told = lambda c, word: F.when(_blank(c), word).otherwise(f"{word} (not one eBay lists{' for cards' if word == 'condition' else ''})")
    found = F.array(
        F.when(kind.isNull(), "card type"),
        F.when(graded & grader_id(grader).isNull(), told(grader, "grader")),
        F.when(graded & grade_id(grade).isNull(), told(grade, "grade")),
        F.when(~graded & condition_id(condition).isNull(), told(condition, "condition")),
        F.when(graded.isNull(), "graded or not"),
    )
    return F.filter(found, lambda x: x.isNotNull())


def price(text: Column, mark: str = ".") -> Column:
    """A plain amount with two digits after the mark, else null: a price is never guessed."""
    s = F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), r"(?i)\s|€|eur", "")
    whole, cents = F.regexp_extract(s, r"^(\d+)", 1), F.regexp_extract(s, r"[.,](\d{1,2})$", 1)
    return F.when(~s.rlike(r"^\d+([.,]\d{1,2})?$"), None).when(cents == "", whole).otherwise(F.concat(whole, F.lit(mark), F.rpad(cents, 2, "0")))


def amount(number: Column) -> Column:
    """A number as price() takes it: plain digits, two of them after the point, so neither an exponent nor the sign of -0.0 is in the way."""
    return F.when(number >= 0, number.try_cast("decimal(38,2)").cast("string"))


def title(template: str, values: dict[str, Column], limit: int = 80) -> Column:
    """Fill a title template; a token without a value goes with what is glued to it; cut at a word, if one is near."""
    parts: list[Column] = []
    for piece in re.split(r"(\s+)", template):
        m = re.fullmatch(r"(\S*)\{(\w+)\}(\S*)", piece)
        if m is None:
            parts.append(F.lit(piece))
        else:
            value = values.get(m[2], F.lit(None)).cast("string")
            parts.append(F.when(_blank(value), "").otherwise(F.concat(F.lit(m[1]), value, F.lit(m[3]))))
    full = F.concat(*parts)
    full = F.trim(F.regexp_replace(F.regexp_replace(full, r"\s{2,}", " "), r"\s+([,.;:])", "$1"))
    cut = F.substring(full, 1, limit)
    space = F.length(cut) - F.instr(F.reverse(cut), " ")
    has = F.instr(cut, " ") > 0
    return F.when(F.length(full) <= limit, full).otherwise(F.trim(F.when(has & (space > limit * 0.6), cut.substr(F.lit(1), space)).otherwise(cut)))


def unknown_tokens(template: str) -> list[str]:
    known = "year manufacturer brand set series name number variant finish edition language condition grade game".split()
    return [t for t in re.findall(r"\{(\w+)\}", template) if t not in known]


def csv_field(value: Column, delimiter: str = ",", force_text: bool = False) -> Column:
    """One CSV field: formulas defused by an apostrophe, values a spreadsheet would change quoted."""
    s = value.cast("string")
    s = F.when(s.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), s)).otherwise(s)
    coercible = s.rlike(r"^(\d+\s*/\s*\d+|\d+-\d+|0\d+|\d{12,})$")
    outer = s.rlike(r"^\s|\s$")
    quote = F.lit(force_text) | coercible | s.contains(delimiter) | s.contains('"') | s.contains("\n") | s.contains("\r") | outer
    doubled = F.replace(s, F.lit('"'), F.lit('""'))
    return F.when(value.isNull(), "").when(quote, F.concat(F.lit('"'), doubled, F.lit('"'))).otherwise(doubled)


def normalize_header(h: Column) -> Column:
    s = F.replace(h, F.lit("*"), F.lit(""))
    s = F.regexp_replace(s, "(?i)^(C|L):", "")
    s = F.regexp_replace(s, r"\s*\([^)]*\)\s*", " ")
    s = F.regexp_replace(s, "([a-z0-9])([A-Z])", "$1 $2")
    return F.regexp_replace(F.lower(F.trim(s)), r"[\s_-]+", " ")


def required_header(h: Column) -> Column:
    s = F.lower(F.trim(h))
    return h.contains("*") | s.startswith("required") | s.startswith("pflicht")


def descriptor_field(h: Column) -> Column:
    """The field that a CD:/CDA: header names, by its id or else its words."""
    t = F.trim(F.coalesce(h, F.lit("")))
    code = F.coalesce(F.nullif(F.regexp_extract(t, r"(?i)\(ID:\s*(\d+)\)", 1), F.lit("")), F.regexp_extract(t, r"(?i)^CDA?:\s*(\d+)\s*$", 1))
    words = _plain(F.regexp_replace(F.regexp_replace(t, "(?i)^CDA?:", ""), r"(?i)\(ID:[^)]*\)", ""))
    return F.when(t.rlike("(?i)^CDA?:"), F.coalesce(_lookup(code, v.DESCRIPTORS), _lookup(words, v.DESCRIPTOR_WORDS)))


def single_line(c: Column) -> Column:
    return F.regexp_replace(F.coalesce(c, F.lit("")), r"\r\n|\r|\n", "<br>")


def slug(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def count_outside_quotes(line: Column, mark: str) -> Column:
    """How often a mark stands outside quotes; an unclosed quote reaches to the end."""
    bare = F.regexp_replace(F.regexp_replace(line, '"[^"]*"', ""), '"[^"]*$', "")
    return (F.length(bare) - F.length(F.replace(bare, F.lit(mark), F.lit("")))).cast("int")


def delimiter(text: Column) -> Column:
    """The mark most common in the first line outside quotes: semicolon, comma, tab in that order; comma if none."""
    line = F.element_at(F.split(F.regexp_replace(F.coalesce(text, F.lit("")), "^﻿", ""), r"\r?\n", 2), 1)
    s, c, t = (count_outside_quotes(line, x) for x in (";", ",", "\t"))
    return F.when((s > 0) & (s >= c) & (s >= t), ";").when((c > 0) & (c >= t), ",").when(t > 0, "\t").otherwise(",")
