"""Queries on whole readings, corrections, exports and the smaller record operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from evimatch.functions import market, values
from evimatch.functions import text as t
from evimatch.functions import vocabulary as v
from evimatch.operators import assembly, images, jobs, matching, merging, review
from evimatch.plans import matching as plans
from evimatch.plans.records import _EBAY, _GRAY, _csv_sql, _ebay, _gray
from evimatch.plans.registry import ORACLES, fold_sql, number_sql, query, similarity_sql
from evimatch.plans.views import expand
from evimatch.session import settled

_SIGNALS = f"""select a.cid, a.name, b.number, c.latest as year, d.hp, nullif(split_part(e.terms, ',', 1), '') as variant, f.language
from ({ORACLES["pick_name"]}) a join ({ORACLES["card_numbers"]}) b using (cid) join ({ORACLES["years_copyright"]}) c using (cid) join ({ORACLES["hp"]}) d using (cid) join ({ORACLES["variant_terms"]}) e using (cid) join ({ORACLES["language_guess"]}) f using (cid)"""


def _signals(get):
    c = F.col("text")
    return get("ocr_text").select("cid", t.pick_name(c).alias("name"), t.pick_number(c).alias("number"), t.latest_year(c).alias("year"), t.hp(c).alias("hp"), F.try_element_at(t.variant_terms(c), F.lit(1)).alias("variant"), t.language(c).alias("language"))


@query(_SIGNALS)
def signals_all(get):
    return _signals(get)


_SPLIT = r"'^([A-Za-z]*)0*(\d+)([a-z]?)\s*/\s*([A-Za-z]*)0*(\d+)$'"


def _read_sql(source: str) -> str:
    """sig: what the texts of a view say; r: the best card of each, with margin and flags."""
    strips, texts = expand(f"{{{source}}}"), expand("{ocr_text}")
    of = lambda name: ORACLES[name].replace(texts, strips)
    den = "try_cast(regexp_replace(x[2], '\\D', '', 'g') as int)"
    pairs = f"list_zip(regexp_extract_all({plans._FIXED}, {plans._NUM}, 1), regexp_extract_all({plans._FIXED}, {plans._NUM}, 2))"
    fuzzy = f"case when h = '' or n = '' then 0.0::double when contains(h, n) then 1.0::double when length(n) < 4 then 0.0::double else coalesce(list_max(list_concat({plans._WIN})), 0.0::double) end"
    about = r"(?i)\b(?:evolves?\s+(?:from|de|aus)|put\s+.+\s+on\s+the|entwickelt|[eé]volue)\b"
    same = lambda x, y: f"case when {x} is not null then case when {x} = {y} then 1.0::double else 0.0::double end end"
    return f"""tot as (select list(distinct total) as known from {{ref_sets}}),
num0 as (select cid, array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '' and not regexp_matches(x, '{about}')), chr(10)) as said, list_filter({pairs}, lambda x: not coalesce({den} < 5, false)) as ns from {{{source}}}),
num1 as (select cid, said, coalesce(list_filter(ns, lambda x: list_contains(known, {den}))[1], ns[1]) as x from num0, tot),
sig0 as (select a.cid, a.name, b.said, b.x[1] || '/' || b.x[2] as number, c.latest as year, d.hp, nullif(split_part(e.terms, ',', 1), '') as variant, f.language
  from ({of("pick_name")}) a join num1 b using (cid) join ({of("years_copyright")}) c using (cid) join ({of("hp")}) d using (cid) join ({of("variant_terms")}) e using (cid) join ({of("language_guess")}) f using (cid)),
sig as (select *, cast(nullif(regexp_extract(number, {_SPLIT}, 2), '') as bigint) as num, cast(nullif(regexp_extract(number, {_SPLIT}, 5), '') as bigint) as den from sig0),
{plans._ROUTE1.replace("{captures}", "sig")},
near as (select one.cid, {similarity_sql(fold_sql("q.name"), fold_sql("c.name"))} as s, {fold_sql("q.said")} as h, {fold_sql("c.name")} as n from one join sig q on q.cid = one.cid join {{ref_cards}} c on c.id = one.id where coalesce(abs(q.year - c.year) <= 1, true)),
sat as (select distinct cid from near where s >= 0.8 or {fuzzy} >= 0.85),
rest as (select * from sig where cid not in (select cid from sat)), {plans._tiers("rest")},
cand as (select distinct cid, id from (select cid, id from one union all select cid, id from two)),
pp as (select q.*, c.id, c.num || '/' || c.den as c_number, c.year as c_year, c.hp as c_hp, c.language as c_language, c.has_variants, {fold_sql("q.said")} as h, {fold_sql("c.name")} as n, {fold_sql("q.name")} as qf from cand join sig q using (cid) join {{ref_cards}} c on c.id = cand.id),
p as (select cid, id, variant, has_variants, case when number is not null then {number_sql("number", "c_number")} end as a_number, case when coalesce(name, '') <> '' then greatest({similarity_sql("qf", "n")}, {fuzzy}) end as a_name,
  {same("year", "c_year")} as a_year, {same("hp", "c_hp")} as a_hp, {same("language", "c_language")} as a_language from pp),
s as (select *, 0.0::double + coalesce(a_number * 3.0::double, 0.0::double) + coalesce(a_name * 2.0::double, 0.0::double) + coalesce(a_year * 1.0::double, 0.0::double) + coalesce(a_hp * 0.8::double, 0.0::double) + coalesce(a_language * 0.5::double, 0.0::double) as total,
  0.0::double + {" + ".join(f"case when a_{f} is null then 0.0::double else {v.WEIGHTS[f]}::double end" for f in ("number", "name", "year", "hp", "language"))} as evidence from p),
d as (select *, floor(case when evidence = 0 then 0.0::double else total / evidence end * least(1.0::double, 0.4::double + evidence / {sum(v.WEIGHTS.values())}::double * 1.2::double) * 1000.0::double + 0.5::double) / 1000.0::double as confidence from s),
o as (select *, row_number() over (partition by cid order by confidence desc, id) as place, lead(confidence) over (partition by cid order by confidence desc, id) as next from d),
r as (select *, floor((confidence - coalesce(next, 0.0::double)) * 1000.0::double + 0.5::double) / 1000.0::double as margin,
  list_filter([case when a_number < 0.75 then 'number' end, case when a_name < 0.75 then 'name' end, case when a_year < 0.75 then 'year' end, case when a_language < 0.75 then 'language' end, case when variant is null and has_variants then 'variant' end], lambda x: x is not null) as flags from o where place = 1)"""


@query(f"with {_read_sql('ocr_text')} select cid, id as best_id, confidence, margin, {plans._BAND} as band, array_to_string(flags, ',') as flags from r")
def interpret(get):
    """From the text that was read to the ranked card: signals with known totals, candidate search, score with names found in the text, rank, flags."""
    cards, sets = get("ref_cards"), get("ref_sets")
    read = settled(assembly.signals(get("ocr_text").withColumnRenamed("cid", "card_id"), sets))
    best = assembly.match(read, cards, sets).where("place = 1")
    return best.select(F.col("card_id").alias("cid"), F.col("id").alias("best_id"), "confidence", "margin", values.band(F.col("confidence"), F.col("margin")).alias("band"), F.array_join("flags", ",").alias("flags"))


def card_words(get):
    """Words of both sides of captures: a front with maker, name (its first word read twice) and print run, in two of three a back with number, name and legal line."""
    c = get("captures").select("cid", F.split(F.upper("true_name"), " ").alias("n"), "num")
    word = lambda side, text, sure, x, y, h, when: F.when(when, F.struct(F.lit(side).alias("side"), text.cast("string").alias("text"), sure.cast("double").alias("conf"), F.lit(float(x)).alias("x0"), F.lit(float(y)).alias("y0"), F.lit(x + 250.0).alias("x1"), F.lit(float(y + h)).alias("y1")))
    front, back, legal = F.col("cid") % 25 != 0, F.col("cid") % 3 != 0, F.col("cid") % 5 < 3
    sure, mis = F.lit(0.5) + F.col("cid") % 4 * 0.125, lambda x: F.when(F.col("cid") % 10 == 4, F.replace(x, F.lit("E"), F.lit("F"))).otherwise(x)
    words = [
        word("front", F.lit("(TOPPS)"), F.lit(0.875), 100, 50, 30, front & (F.col("cid") % 4 < 2)), word("front", F.col("n")[1], sure, 400, 800, 60, front), word("front", F.col("n")[0], sure, 100, 800, 60, front),
        word("front", F.substring(F.col("n")[0], 1, 2), F.lit(0.25), 110, 804, 50, front), word("front", F.lit("12/99,"), F.lit(0.875), 100, 300, 20, front & (F.col("cid") % 6 == 1)),
        word("back", F.col("num"), F.lit(0.875), 100, 100, 40, back & (F.col("cid") % 2 == 0)), word("back", mis(F.col("n")[0]), F.lit(0.75), 100, 500, 50, back), word("back", mis(F.col("n")[1]), F.lit(0.75), 400, 500, 50, back),
        word("back", F.lit("©1999"), F.lit(0.75), 100, 900, 15, back & legal), word("back", F.lit("Topps"), F.lit(0.75), 360, 900, 15, back & legal),
    ]
    return c.select(F.col("cid").alias("card_id"), F.posexplode(F.filter(F.array(*words), lambda w: w.isNotNull())).alias("word_id", "w")).select("card_id", "word_id", "w.*")


_LETTERS_NEAR = "(lx = ly or greatest(length(lx), length(ly)) >= 7 and 1.0::double - levenshtein(lx, ly)::double / greatest(length(lx), length(ly))::double >= 0.85)"


@query(f"""with {_read_sql("strip_text")},
w as (select cid, upper(true_name) as ft, case when cid % 10 = 4 then replace(upper(true_name), 'E', 'F') else upper(true_name) end as bt, cid % 25 <> 0 as has_front, cid % 3 <> 0 as has_back, 0.5::double + cid % 4 * 0.125::double as cf, 0.75::double as cb,
  cid % 25 <> 0 and cid % 4 < 2 as maker_front, cid % 3 <> 0 and cid % 5 < 3 as legal_back, case when cid % 3 <> 0 and cid % 2 = 0 then cast(num as varchar) end as lone, case when cid % 25 <> 0 and cid % 6 = 1 then '12/99' end as serial from {{captures}}),
l as (select *, regexp_replace(lower(ft), '[^a-z0-9]', '', 'g') as lx, regexp_replace(lower(bt), '[^a-z0-9]', '', 'g') as ly, 0.69::double + 0.3::double * greatest(0, least(1, (cf - 0.4) / 0.4)) as sf, 0.6::double + 0.3::double * 0.875::double as sb from w),
a as (select *, has_front and has_back and {_LETTERS_NEAR} as agreed from l),
g as (select *, case when agreed then case when cf >= cb then ft else bt end when has_front and (not has_back or sf >= sb) then ft when has_back then bt end as g_name,
  case when agreed then least(0.95::double, greatest(cf, cb) + 0.1::double) when has_front and (not has_back or sf >= sb) then cf when has_back then cb end as g_conf from a),
j as (select g.*, sig.name, sig.number, sig.year, sig.variant, sig.language, case when cid % 8 = 3 then 0.4::double else 0.8::double end as bottom, r.id as best_id, r.confidence, r.margin, r.a_name, coalesce(r.flags, []) as r_flags,
  c.name as k_name, c.num || '/' || c.den as k_number, c.set_name as k_set, cast(c.year as varchar) as k_year, c.language as k_language, coalesce(r.confidence < 0.5, true) as general from g join sig using (cid) left join r using (cid) left join {{ref_cards}} c on c.id = r.id),
m as (select *, general and number is not null and bottom < 0.5 as weak, coalesce(a_name >= 0.75 and name <> k_name, false) as respelt, general and name is null and number is null and g_name is null and not maker_front and not legal_back and lone is null and serial is null as mute from j),
f as (select *, case when general then coalesce(g_name, name) else coalesce(name, case when has_back then bt end) end as name1, case when general then case when g_name is not null then g_conf * 0.85::double when name is not null then 0.8::double * 0.9::double end else case when name is not null then 0.8::double * 0.9::double when has_back then cb * 0.85::double end end as name1_conf,
  case when (number is null or weak) and lone is not null then lone when weak then null else number end as number1, (number is null or weak) and lone is not null as guessed,
  case when general then coalesce(case when legal_back then '1999' end, cast(year as varchar)) else coalesce(cast(year as varchar), case when legal_back then '1999' end) end as year1 from m),
h as (select *, case when general and number1 = serial then null else number1 end as number2 from f),
e as (select *, list_distinct(list_concat(case when general then list_filter([case when name1 is null then 'name' end, 'set', case when number2 is null then 'number' end, case when year1 is null then 'year' end, case when guessed then 'number' end, case when g_name is null or g_conf < 0.6 then 'name' end], lambda x: x is not null)
  when guessed then ['number'] else [] end, r_flags)) as flags from h)
select cid, case when respelt then k_name else coalesce(name1, k_name) end as name, case when respelt or name1 is null and k_name is not null then 'db_match' when name1 is not null then 'ocr' end as name_source,
  floor(coalesce(case when respelt then confidence when name1 is not null then name1_conf else confidence end, 0) * 1000000 + 0.5) as name_conf, coalesce(number2, k_number) as number,
  case when number2 is null then case when k_number is not null then 'db_match' end when guessed then 'inferred' else 'ocr' end as number_source, k_set as set_name, coalesce(year1, k_year) as year,
  case when general and maker_front or legal_back then 'Topps' end as manufacturer, case when general and lower(variant) in ('chrome', 'prizm') then null else variant end as variant, coalesce(language, k_language) as language, case when general then serial end as serial,
  best_id, coalesce(confidence, 0) as confidence, coalesce(margin, 0) as margin, array_to_string(list_sort(case when mute then ['name', 'number'] else flags end), ',') as flags, case when mute then 'We could not read any text on this card.' end as error,
  case when not mute and len(flags) = 0 and confidence >= 0.9 and margin >= 0.1 then 'IDENTIFIED' else 'NEEDS_REVIEW' end as state from e""")
def card_records(get):
    """One record a card from strip text, the words of both sides and the catalogue."""
    strips = get("strip_text").withColumnRenamed("cid", "card_id")
    done = assembly.records(strips, card_words(get), get("ref_cards"), get("ref_sets"))
    value = lambda f: F.col(f"{f}.value")
    source = lambda f: F.when(value(f).isNotNull(), F.col(f"{f}.source"))
    sure = F.floor(F.coalesce("name.confidence", F.lit(0.0)) * 1000000 + 0.5).cast("double")
    return done.select(
        F.col("card_id").alias("cid"), value("name").alias("name"), source("name").alias("name_source"), sure.alias("name_conf"), value("number").alias("number"), source("number").alias("number_source"), value("set").alias("set_name"), value("year").alias("year"),
        value("manufacturer").alias("manufacturer"), value("variant").alias("variant"), value("language").alias("language"), value("serial").alias("serial"), "best_id", "confidence", "margin", F.array_join(F.array_sort("flags"), ",").alias("flags"), "error", "state",
    )


def _whole_cards(get, fill_only: bool):
    g = get("general")
    blank = F.lit(None).cast("struct<value:string,source:string,confidence:double,evidence:string>")
    field = lambda c, conf: F.when(F.col(c).isNotNull(), values.extracted(F.col(c), "ocr", conf, F.col(c))).otherwise(blank)
    own = {"name": field("name", F.lit(0.8)), "number": field("number", F.col("number_conf")), "set": field("set_name", F.lit(0.8)), "year": field("year", F.lit(0.8)), "variant": field("variant", F.lit(0.8))}
    none = {f: blank.alias(f) for f in ("manufacturer", "league", "sport", "serial")}
    said = lambda k: F.when(F.col(f"g_{k}").isNotNull(), F.struct(F.col(f"g_{k}").alias("value"), F.col("g_conf").alias("confidence"), F.col(f"g_{k}").alias("raw"), F.lit(None).cast("string").alias("side"), F.col("g_rule").alias("rule"))).alias(f"g_{k}")
    cards = g.select("cid", *[c.alias(f) for f, c in own.items()], *none.values(), F.array().cast("array<string>").alias("flags"), *[said(k) for k in merging.KINDS])
    out = merging.apply_general(cards, fill_only)
    return out.select("cid", "name.value", F.col("number.value").alias("number"), F.col("number.source").alias("number_source"), F.coalesce("number.confidence", F.lit(0.0)).alias("number_conf"), F.col("set.value").alias("set_name"), F.col("manufacturer.value").alias("manufacturer"), F.col("year.value").alias("year"), F.col("variant.value").alias("variant"), F.col("sport.value").alias("sport"), F.array_join("flags", ",").alias("flags")).withColumnRenamed("value", "name")


@query("""with g as (select *, number is not null and number_conf < 0.5 as weak from {general}),
w as (select *, g_number is not null and (number is null or weak) as wanted from g),
n as (select *, case when wanted then g_number when weak then null else number end as n1, case when wanted and g_rule is not null then 'inferred' when wanted then 'ocr' when weak then null when number is not null then 'ocr' end as s1,
  case when wanted and g_rule is not null then least(0.6::double, g_conf * 0.7::double) when wanted then g_conf * 0.8::double when weak or number is null then 0.0::double else number_conf end as c1,
  coalesce(g_name, name) as name2, coalesce(set_name, g_product) as set2, coalesce(g_year, year) as year2 from w),
e as (select *, coalesce(g_serial is not null and n1 = g_serial, false) as run from n)
select cid, name2 as name, case when not run then n1 end as number, case when not run then s1 end as number_source, case when run then 0.0::double else c1 end as number_conf, set2 as set_name, g_manufacturer as manufacturer, year2 as year,
  case when g_finish is not null then g_finish when lower(variant) in ('chrome', 'prizm') then null else variant end as variant, case when g_league = 'NBA' then 'Basketball' end as sport,
  array_to_string(list_filter([case when name2 is null then 'name' end, case when set2 is null then 'set' end, case when run or n1 is null then 'number' end, case when year2 is null then 'year' end,
    case when wanted and g_rule is not null and not run and n1 is not null then 'number' end, case when name2 is not null and not coalesce(g_name is not null and g_conf >= 0.6, false) then 'name' end], lambda x: x is not null), ',') as flags from e""")
def apply_general(get):
    return _whole_cards(get, False)


@query("""select cid, coalesce(name, g_name) as name, coalesce(number, g_number) as number, case when number is not null then 'ocr' when g_number is null then null when g_rule is not null then 'inferred' else 'ocr' end as number_source,
  case when number is not null then number_conf when g_number is null then 0.0::double when g_rule is not null then least(0.6::double, g_conf * 0.7::double) else g_conf * 0.8::double end as number_conf, coalesce(set_name, g_product) as set_name, g_manufacturer as manufacturer,
  coalesce(year, g_year) as year, coalesce(variant, g_finish) as variant, case when g_league = 'NBA' then 'Basketball' end as sport, case when number is null and g_number is not null and g_rule is not null then 'number' else '' end as flags from {general}""")
def fill_from_back(get):
    return _whole_cards(get, True)


def _corrected(get):
    c = get("corrected").withColumn("flags", F.filter(F.split("flags", ","), lambda x: x != ""))
    return c.withColumn("name", values.extracted(F.col("name"), "ocr", F.lit(0.8), F.col("name")))


_FLAG_LIST = "list_filter(string_split(flags, ','), lambda x: x <> '')"


@query(f"select card_id, coalesce(mine, name) as name, case when mine is null then 'ocr' else 'user' end as source, case when mine is null then 0.8::double else 1.0::double end as confidence, array_to_string(case when mine is null then {_FLAG_LIST} else list_filter({_FLAG_LIST}, lambda x: x <> 'name') end, ',') as flags from {{corrected}}")
def correct_fields(get):
    done = review.correct(_corrected(get), "name", F.col("mine"), F.col("mine").isNotNull())
    return done.select("card_id", F.col("name.value").alias("name"), "name.source", "name.confidence", F.array_join("flags", ",").alias("flags"))


@query(f"select card_id, coalesce(c_name_known, name) as name, case when c_name_known is null then 'ocr' else 'user' end as source, sure as confidence, array_to_string(list_filter({_FLAG_LIST}, lambda x: x = 'variant'), ',') as flags from {{corrected}}")
def apply_candidate(get):
    c = _corrected(get).withColumnsRenamed({"c_name_known": "c_name", "sure": "c_confidence"})
    done = review.apply_candidate(c, ("name",))
    return done.select("card_id", F.col("name.value").alias("name"), "name.source", "confidence", F.array_join("flags", ",").alias("flags"))


@query("select card_id, case when sure >= 0.75 and c_name_known is not null and c_name_known <> name then c_name_known else name end as name, case when sure >= 0.75 and c_name_known is not null and c_name_known <> name then card_id || ' (read as “' || name || '”)' else name end as evidence from {corrected}")
def name_override(get):
    c = _corrected(get).withColumn("name", review.override_name(F.col("name"), F.col("c_name_known"), F.col("sure"), F.col("sure"), F.col("card_id")))
    return c.select("card_id", F.col("name.value").alias("name"), F.col("name.evidence").alias("evidence"))


_CARD = _EBAY.replace("chosen,", "card_type,", 1).replace(" from customer", ", case when c_custkey % 2 = 0 then '12,5' when c_custkey % 9 = 0 then 'free' end as price, case when c_custkey % 8 = 0 then '3' end as quantity from customer")


@query(f"""with e as ({_CARD}), k as (select *, case when graded = 'Ja' then true when graded = 'nein' then false when coalesce(grader, '') <> '' or coalesce(grade, '') <> '' then true when coalesce(condition, '') <> '' then false end as g from e)
select id, case when card_type = 'sports' then 261328 else 183454 end as category, case when g then case grader when 'psa' then 275010 end end as grader_id, case when g then case grade when 'Gem Mint 9.50' then 275021 when 'authentic' then 2750219 end end as grade_id,
  case when g is null or not g then case when condition is null then 400011 when condition = 'Sehr gut' then 400012 when condition = 'near mint' then 400010 end end as card_condition, case when price = '12,5' then '12.50' when price = 'free' then null else '1' end as price, coalesce(quantity, '1') as quantity from k""")
def card_value(get):
    c = get("customer").selectExpr(*[x.strip() for x in _CARD[len("select ") : _CARD.index(" from customer")].replace("'12,5'", "'12;5'").split(", ")]).withColumn("price", F.replace("price", F.lit(";"), F.lit(",")))
    done = review.card_values(c, {"card_type": "ccg", "condition": "Excellent", "price": "1"})
    return done.select("id", "category", "grader_id", "grade_id", "card_condition", "price", "quantity")


@query("select card_id from {corrected} where state = 'NEEDS_REVIEW' or flags <> ''")
def review_list(get):
    return review.to_review(_corrected(get)).select("card_id")


@query("select card_id from {corrected} where state not in ('NEEDS_REVIEW', 'FAILED')")
def state_ready(get):
    return review.in_state(_corrected(get), "ready").select("card_id")


@query("select distinct o_custkey as card_id from orders where o_custkey in (select card_id from {cards} where state = 'FAILED')")
def prune_selection(get):
    return review.prune(get("orders").select(F.col("o_custkey").alias("card_id")), get("cards").where("state = 'FAILED'"), "card_id")


@query("select row_number() over (order by o_orderdate, o_orderkey) as place, o_orderkey as card_id from orders order by o_orderdate, o_orderkey limit 100")
def created_order(get):
    first = get("orders").orderBy("o_orderdate", "o_orderkey").limit(100).select("o_orderdate", F.col("o_orderkey").alias("card_id"))
    rows = first.groupBy().agg(F.array_sort(F.collect_list(F.struct("o_orderdate", "card_id"))).alias("x"))  # one page
    return rows.select(F.posexplode("x").alias("place", "c")).select((F.col("place") + 1).cast("bigint").alias("place"), "c.card_id")


@query("select key, n from (select concat_ws('|', set_name, number) as key, count(*) as n from {cards} group by 1) where n > 1 order by n desc, key limit 20")
def dup_first_twenty(get):
    groups = get("cards").groupBy(F.concat_ws("|", "set_name", "number").alias("key")).agg(F.count("*").alias("n")).where("n > 1")
    return groups.orderBy(F.desc("n"), "key").limit(20)


_FIELDS = {"name": "name", "number": "number", "set": "set_name", "year": "'1999'", "variant": "variant"}
_LINE = "concat_ws(',', " + ", ".join([_csv_sql("name"), *["''" if f not in _FIELDS else (f"'\"' || replace(({_FIELDS[f]}), '\"', '\"\"') || '\"'" if f == "number" else _csv_sql(_FIELDS[f])) for f in v.FIELDS_OF_CARD], _csv_sql("variant"), "''", _csv_sql("cast(quantity as varchar)"), "'\"\"'", "''", _csv_sql("cast(confidence as varchar)"), _csv_sql("state")]) + ")"


@query(f"select card_id, {_LINE} as line from {{cards}}")
def export_generic(get):
    fields = {f: F.expr(e) for f, e in _FIELDS.items()} | {"quantity": F.col("quantity")}
    return get("cards").select("card_id", review.generic_line(F.col("name"), fields, F.col("confidence"), F.col("state")).alias("line"))


@query("select card_id, coalesce(name, '') || chr(9) || coalesce(set_name, '') || chr(9) || coalesce(number, '') || chr(9) || coalesce(variant, '') || chr(9) || case when card_id % 3 = 0 then '' else '1999' end as line from {cards}")
def export_tabs(get):
    year = F.expr("case when card_id % 3 = 0 then null else '1999' end")
    return get("cards").select("card_id", review.tab_line([F.col(c) for c in ("name", "set_name", "number", "variant")] + [year]).alias("line"))


@query("select card_id, '{\"card_id\":' || card_id || ',\"name\":\"' || name || '\",\"state\":\"' || state || '\"}' as record from {cards}")
def export_json(get):
    return get("cards").select("card_id", F.to_json(F.struct("card_id", "name", "state")).alias("record"))


@query(f"""with q as (select cid, true_id, name, true_name, den, case when cid % 9 = 4 then num + 1 else num end as num from {{captures}})
select q.cid, {similarity_sql(fold_sql('q.name'), fold_sql('q.true_name'))} >= 0.85 as name_ok, case when q.num = c.num and q.den = c.den then 'right' else 'wrong' end as number_ok from q join {{ref_cards}} c on c.id = q.true_id""")
def truth_join(get):
    truth = get("ref_cards").select(F.col("id").alias("true_id"), F.col("num").alias("t_num"), F.col("den").alias("t_den"))
    both = get("captures").withColumn("num", F.expr("case when cid % 9 = 4 then num + 1 else num end")).join(truth, "true_id")
    same = (F.col("num") == F.col("t_num")) & (F.col("den") == F.col("t_den"))
    return both.select("cid", (t.similarity(F.col("name"), F.col("true_name")) >= 0.85).alias("name_ok"), F.when(same, "right").otherwise("wrong").alias("number_ok"))


#: Pictures of one tone in four: some are the same picture, others only hash alike in what the hash looks at.
_TONED = f"select vec_id, case when vec_id % 3 = 0 then list_transform(g, lambda x: (vec_id // 3 % 40)::double) else g end as g from (select vec_id, {_GRAY} as g from embeddings)"
_HASH = "lower(printf('%x', list_reduce(list_prepend(2166136261::bigint, list_transform(list_filter(list_zip(g, range(0, len(g))), lambda z: z[2] % 16 = 0), lambda z: cast(z[1] as bigint))), lambda h, b: (xor(h, b) * 16777619) % 4294967296)))"


@query(f"select hash, count(*) as n from (select {_HASH} as hash from ({_TONED})) group by hash having count(*) >= 2")
def dup_image_groups(get):
    tone = F.floor(F.col("vec_id") / 3) % 40
    toned = _gray(get).withColumn("gray", F.when(F.col("vec_id") % 3 == 0, F.transform("gray", lambda x: tone.cast("double"))).otherwise(F.col("gray")))
    return toned.select(images.fnv_hash(F.col("gray")).alias("hash")).groupBy("hash").agg(F.count("*").alias("n")).where("n >= 2")


_PIXELS = f"c as (select vec_id, unnest(g) as v, unnest(range(0, len(g))) as i from (select vec_id, {_GRAY} as g from embeddings)), p as (select vec_id, v, i // 8 as y, i % 8 as x from c)"


@query(f"""with {_PIXELS}, b as (select a.vec_id, a.y, a.x, any_value(a.v) as v, sum(b.v) / count(*) as m from p a join p b on b.vec_id = a.vec_id and abs(b.y - a.y) <= 2 and abs(b.x - a.x) <= 2 group by a.vec_id, a.y, a.x)
select vec_id, sum(floor(m * 1000)) as blurred, sum(floor(least(255::double, 255::double * v / greatest(1::double, m)))) as flat from b group by vec_id""")
def gray_blur_square(get):
    """Pictures of 8 by 8."""
    total = lambda x, f: F.aggregate(x, F.lit(0.0), lambda t, y: t + F.floor(f(y)).cast("double"))
    g = _gray(get).select("vec_id", images.box_blur(F.col("gray"), F.lit(8), 2).alias("m"), images.flatten_illumination(F.col("gray"), F.lit(8), 2).alias("f"))
    return g.select("vec_id", total("m", lambda y: y * 1000).alias("blurred"), total("f", lambda y: y).alias("flat"))


_METRICS = f"""{_PIXELS}, e as (select a.vec_id, u.v + d.v + l.v + r.v - 4 * a.v as e from p a join p u on u.vec_id = a.vec_id and u.y = a.y - 1 and u.x = a.x join p d on d.vec_id = a.vec_id and d.y = a.y + 1 and d.x = a.x
  join p l on l.vec_id = a.vec_id and l.y = a.y and l.x = a.x - 1 join p r on r.vec_id = a.vec_id and r.y = a.y and r.x = a.x + 1),
s as (select vec_id, (sum(e * e) * count(*) - sum(e) * sum(e)) / (count(*) * count(*)) as sharp from e group by vec_id),
q as (select vec_id, sum(v) / count(*) as mean, cast(count(*) filter (where v > 160) as double) / count(*) as blown from p group by vec_id)"""


@query(f"""with {_METRICS} select vec_id, floor(sharp / 16 * 1000 + 0.5) / 1000 as sharpness, array_to_string(list_filter([case when 300 + vec_id % 200 < 400 then 'small' end, case when mean - 70 < 60 then 'dark' end, case when blown > 0.04 and blown < 0.5 then 'glare' end, case when sharp / 16 < 60 then 'blurry' end], lambda x: x is not null), ',') as issues
from s join q using (vec_id)""")
def gray_issues(get):
    """What is wrong with pictures of 8 by 8, their light and contrast turned down so that each issue is met."""
    sharp = images.laplacian_variance(F.col("gray"), F.lit(8)) / 16
    mean = F.aggregate("gray", F.lit(0.0), lambda a, x: a + x) / F.size("gray")
    g = _gray(get).select("vec_id", sharp.alias("sharp"), mean.alias("mean"), (F.size(F.filter("gray", lambda x: x > 160)) / F.size("gray")).alias("blown"))
    told = images.issues(F.col("vec_id") % 200 + 300, F.col("mean") - 70, F.col("blown"), F.col("sharp"))
    return g.select("vec_id", values.round3(F.col("sharp")).alias("sharpness"), F.array_join(told, ",").alias("issues"))


_ACCEPTED = f"{plans._BAND} = 'HIGH' and len({plans._FLAGS}) = 0"


@query(f"""with {plans._SCORED}, k as (select cid, max(case when id = true_id then 1 else 0 end) as offered from r group by cid), y as (select *, {_ACCEPTED} as accepted from r where place = 1),
x as (select q.priority as condition, q.cid % 3 as layout, {similarity_sql(fold_sql("q.name"), fold_sql("q.true_name"))} >= 0.85 as name_ok, q.den = c.den as number_ok, y.id = y.true_id as is_right, k.offered = 1 as offered, y.accepted, cast(q.cid * 37 % 1000 as bigint) as ms
  from y join k using (cid) join {{captures}} q on q.cid = y.cid join {{ref_cards}} c on c.id = q.true_id)
select condition, layout, count(*) as n, {", ".join(f"cast(floor(100.0 * count(*) filter (where {a}) / count(*) + 0.5) as bigint) as {b}" for a, b in (("name_ok", "name_pct"), ("number_ok", "number_pct"), ("is_right", "right_pct"), ("offered", "offered_pct")))},
  count(*) filter (where accepted) as accepted, count(*) filter (where accepted and not is_right) as wrong, list_sort(list(ms))[count(*) // 2 + 1] as median_ms from x group by rollup (condition, layout)""")
def accuracy_grid(get):
    """How often readings are right, by condition and layout, by condition and over all."""
    ranked = plans._ranked(get)
    offered = ranked.groupBy("cid").agg(F.max((F.col("id") == F.col("true_id")).cast("int")).alias("offered"))
    truth = get("ref_cards").select(F.col("id").alias("true_id"), F.col("den").alias("true_den"))
    q = get("captures").join(truth, "true_id").select("cid", F.col("priority").alias("condition"), (F.col("cid") % 3).alias("layout"), (t.similarity(F.col("name"), F.col("true_name")) >= 0.85).alias("name_ok"), (F.col("den") == F.col("true_den")).alias("number_ok"), (F.col("cid") * 37 % 1000).alias("ms"))
    best = ranked.where("place = 1").select("cid", (F.col("id") == F.col("true_id")).alias("is_right"), values.auto_acceptable(F.col("confidence"), F.col("margin"), matching.flags(plans._FIELDS)).alias("accepted"))
    return matching.accuracy(q.join(best, "cid").join(offered.select("cid", (F.col("offered") == 1).alias("offered")), "cid"), ["condition", "layout"])


@query(f"with {plans._SCORED} select cast(floor(confidence * 10) as bigint) as bin, count(*) as n, count(*) filter (where id = true_id) as n_right from r where place = 1 group by 1")
def calibration(get):
    return plans._ranked(get).where("place = 1").groupBy(F.floor(F.col("confidence") * 10).alias("bin")).agg(F.count("*").alias("n"), F.count_if(F.col("id") == F.col("true_id")).alias("n_right"))


@query("select doc_id, word_id, place from (select doc_id, word_id, row_number() over (partition by doc_id order by h desc, word_id) as place from {words}) where place <= 4")
def texts_largest(get):
    w = get("words").select("doc_id", F.col("word_id").alias("line_id"), "h")
    return merging.keep_texts(w, "doc_id", 4, "h").select("doc_id", F.col("line_id").alias("word_id"), F.col("place").cast("bigint").alias("place"))


def _framings(get):
    frame = F.element_at(F.array(F.lit("located"), F.lit("whole-frame"), F.lit("turned-around")), F.col("row_id") + 1)
    sign = F.col("x1").cast("int") % 3 == 0
    return get("words").select("doc_id", F.col("word_id").alias("ordinal"), frame.alias("framing"), (F.col("conf") * 1.2).alias("confidence"), (F.col("x0") / 900).alias("margin"), sign.alias("has_signal"))


def _best_sql(which: str) -> str:
    """r: framings; b: each document's best of those that ``which`` names, up to the first best that is HIGH."""
    return f"""r as (select doc_id, word_id as ordinal, row_id, conf * 1.2::double as c, x0 / 900::double as m, cast(x1 as int) % 3 = 0 as s from {{words}}),
o as (select * from r where {which}),
lead as (select a.*, not exists (select 1 from o b where b.doc_id = a.doc_id and b.ordinal < a.ordinal and (b.c > a.c or (b.c = a.c and b.s >= a.s))) as leads from o a),
stop as (select doc_id, min(ordinal) as stop from lead where leads and c >= 0.9 and m >= 0.1 group by doc_id),
b as (select * from (select o.*, row_number() over (partition by o.doc_id order by c desc, s desc, ordinal) as k from o left join stop using (doc_id) where stop is null or ordinal <= stop) where k = 1)"""


@query(f"with {_best_sql('true')} select doc_id, ordinal, c as confidence from b")
def best_framing(get):
    return merging.best_framing(_framings(get), "doc_id").select("doc_id", "ordinal", "confidence")


@query(f"""with {_best_sql("row_id <> 2")},
t as (select * from (select *, row_number() over (partition by doc_id order by c desc, ordinal) as k from r where row_id = 2 and doc_id in (select doc_id from r where row_id = 0)) where k = 1),
w as (select b.doc_id, coalesce(t.c > b.c and not b.s and not (b.c >= 0.9 and b.m >= 0.1), false) as turned, b.ordinal as bo, b.c as bc, b.row_id as br, t.ordinal as t_o, t.c as tc from b left join t using (doc_id))
select doc_id, case when turned then 'turned-around' when br = 0 then 'located' else 'whole-frame' end as framing, case when turned then t_o else bo end as ordinal, case when turned then tc else bc end as confidence from w""")
def second_opinion(get):
    return merging.second_opinion(_framings(get), "doc_id").select("doc_id", "framing", "ordinal", "confidence")


def _place_sql(i: int) -> str:
    return "case region " + " ".join(f"when '{name}' then {box[i]}::double" for name, box in v.REGIONS.items()) + " end"


@query(f"""select *, floor((sx + 30 / (240::double / sh)) * 1000 + 0.5) / 1000 as card_x, floor((sy + 6 / (240::double / sh)) * 1000 + 0.5) / 1000 as card_y from (
select id, region, sx, sy, cast(least(width - sx, floor({_place_sql(2)} * width + 0.5)) as int) as sw, cast(least(height - sy, floor({_place_sql(3)} * height + 0.5)) as int) as sh from (
select *, cast(floor({_place_sql(0)} * width + 0.5) as int) as sx, cast(floor({_place_sql(1)} * height + 0.5) as int) as sy from (
select p_partkey as id, cast(200 + p_size * 7 as int) as width, cast(280 + p_size * 9 as int) as height, case p_partkey % 3 when 0 then 'top' when 1 then 'bottomLeft' else 'bottomRight' end as region from part)))""")
def region_rects(get):
    name = F.element_at(F.array(F.lit("top"), F.lit("bottomLeft"), F.lit("bottomRight")), (F.col("p_partkey") % 3 + 1).cast("int"))
    size = get("part").select(F.col("p_partkey").alias("id"), name.alias("region"), (F.col("p_size") * 7 + 200).cast("int").alias("width"), (F.col("p_size") * 9 + 280).cast("int").alias("height"))
    cut = size.withColumn("r", images.region_rect(F.col("region"), F.col("width"), F.col("height")))
    at = images.to_card(F.col("r"), F.lit(42), F.lit(18))
    return cut.select("id", "region", "r.*", values.round3(at["x"]).alias("card_x"), values.round3(at["y"]).alias("card_y"))


@query(f"select vec_id, list_sum(list_transform(f, lambda x: floor(x))) as total, floor(list_min(f)) as least from (select vec_id, list_transform(range(1, len(g) + 1), lambda i: least(255::double, 255::double * g[i] / greatest(list_sum(g[greatest(1, i - 4):i + 4]) / len(g[greatest(1, i - 4):i + 4]), 1::double))) as f from (select vec_id, {_GRAY} as g from embeddings))")
def gray_flatten(get):
    flat = _gray(get).select("vec_id", images.flatten_line(F.col("gray"), 4).alias("f"))
    return flat.select("vec_id", F.aggregate("f", F.lit(0.0), lambda a, x: a + F.floor(x).cast("double")).alias("total"), F.floor(F.array_min("f")).cast("double").alias("least"))


@query("select job_id, cast(max(run) as bigint) as attempts, max(run) <= 3 as retryable from (select job_id, island, sum(case when failed then 1 else 0 end) as run from (select *, sum(case when failed then 0 else 1 end) over (partition by job_id order by event_id) as island from {job_log}) group by job_id, island) group by job_id")
def job_attempts(get):
    runs = jobs.failure_runs(get("job_log"), "job_id", ["event_id"], "failed")
    return runs.groupBy("job_id").agg(F.max("run").cast("bigint").alias("attempts"), (F.max("run") <= 3).alias("retryable"))


_ACTION = "case event_type when 'signup' then 'added' when 'view' then 'started' when 'purchase' then 'done' when 'error' then 'failed' else 'retry' end"
_SAID = "case event_id % 10 when 0 then 'pause' when 5 then 'cancel' when 7 then 'retry failed' else case when event_id % 3 = 0 then 'run' else 'resume' end end"


def _job_events(get):
    """Events as a log: a tenth of the clicks speak to the queue, ten of them, and every 50th event is told twice."""
    e = get("events").select((F.col("user_id") % 10).alias("queue"), F.col("user_id").alias("job_id"), "ts", "event_id", "event_type", (F.col("event_id") % 3 != 0).alias("retryable"))
    control = (F.col("event_type") == "click") & (F.col("event_id") % 20 < 10)
    log = e.where(~control).withColumn("action", F.expr(_ACTION)).drop("event_type")
    return log.unionByName(log.where("event_id % 50 = 0")), e.where(control).withColumn("action", F.expr(_SAID))


@query(f"""with recursive e as (select user_id % 10 as queue, user_id as job_id, ts, event_id, event_type = 'click' and event_id % 20 < 10 as control, {_ACTION} as action, {_SAID} as said, event_id % 3 <> 0 as retryable from events),
j as (select distinct queue, job_id from e where not control),
l as (select job_id, ts, event_id, action, retryable from e where not control union all select j.job_id, e.ts, e.event_id, e.said, null from j join e on e.queue = j.queue and e.control),
n as (select *, row_number() over (partition by job_id order by ts, event_id) as k from l),
f as (select job_id, 0::bigint as k, null::varchar as state, 0 as attempts, false as paused, false as cancelled, 0 as passed from j
  union all select f.job_id, n.k,
    case when action = 'added' and state is null then 'QUEUED' when action = 'started' and state = 'QUEUED' and not paused and not cancelled then 'RUNNING' when action = 'done' and state = 'RUNNING' then 'SUCCEEDED'
      when action = 'failed' and state = 'RUNNING' then case when attempts < 3 and retryable and not cancelled then 'QUEUED' else 'FAILED' end when action = 'retry' and state in ('FAILED', 'CANCELLED') then 'QUEUED'
      when action = 'retry failed' and state = 'FAILED' then 'QUEUED' when action = 'cancel' and state = 'QUEUED' then 'CANCELLED' else state end,
    case when action = 'started' and state = 'QUEUED' and not paused and not cancelled then attempts + 1 when action = 'retry' and state in ('FAILED', 'CANCELLED') or action = 'retry failed' and state = 'FAILED' then 0 else attempts end,
    case action when 'pause' then true when 'run' then false when 'resume' then false else paused end, case action when 'cancel' then true when 'run' then false else cancelled end,
    passed + case when action = 'added' and state is null or action = 'started' and state = 'QUEUED' and not paused and not cancelled or action in ('done', 'failed') and state = 'RUNNING' or action = 'retry' and state in ('FAILED', 'CANCELLED')
      or action in ('pause', 'resume', 'cancel', 'retry failed', 'run') then 0 else 1 end
    from f join n on n.job_id = f.job_id and n.k = f.k + 1)
select job_id, state, attempts, paused, cancelled, passed from (select *, row_number() over (partition by job_id order by k desc) as r from f) where r = 1""")
def job_states(get):
    return jobs.reduce_queues(*_job_events(get))


@query("select event_id, least(8000.0::double, 400.0::double * pow(2.0::double, event_id % 9)) / 2 as least_ms, least(8000.0::double, 400.0::double * pow(2.0::double, event_id % 9)) as most_ms from events")
def job_backoff(get):
    low, high = jobs.backoff_bounds(F.col("event_id") % 9 + 1)
    return get("events").select("event_id", low.alias("least_ms"), high.alias("most_ms"))


@query("select pos, name from {photos} where lower(name) not like '%.png'")
def file_gate(get):
    kind = F.when(F.lower("name").endswith(".png"), "application/octet-stream").otherwise("IMAGE/jpeg")
    return get("photos").where(review.is_image(kind, F.col("name"))).select("pos", "name")


@query(f"select doc_id, md5(replace({fold_sql('text')}, 'ß', 'ss')) as folded from documents")
def fold_de_text(get):
    return get("documents").select("doc_id", F.md5(t.fold_de(F.col("text")).cast("binary")).alias("folded"))


@query("select id, regexp_replace(regexp_replace(lower(name || ' & ' || series), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') as slug, replace(replace(replace(name || chr(13) || chr(10) || series || chr(10) || name, chr(13) || chr(10), '<br>'), chr(13), '<br>'), chr(10), '<br>') as line from {ref_cards}")
def export_names(get):
    return get("ref_cards").select("id", market.slug(F.concat("name", F.lit(" & "), "series")).alias("slug"), market.single_line(F.concat("name", F.lit("\r\n"), "series", F.lit("\n"), "name")).alias("line"))


@query(f"select vec_id, list_sum(list_transform(g, lambda x: case when x > 128 then 1 else 0 end)) as light, floor(list_sum(list_transform(g, lambda x: x * 0.299::double + x * 0.587::double + (255.0::double - x) * 0.114::double)) * 1000 + 0.5) / 1000 as brightness from (select vec_id, {_GRAY} as g from embeddings)")
def gray_binary(get):
    b = _gray(get).select("vec_id", "gray", images.binarize(F.col("gray"), F.lit(128)).alias("b"))
    luma = F.aggregate(F.transform("gray", lambda x: images.luma(x, x, 255.0 - x)), F.lit(0.0), lambda a, x: a + x)
    return b.select("vec_id", F.aggregate(F.transform("b", lambda x: (x / 255).cast("bigint")), F.lit(0).cast("bigint"), lambda a, x: a + x).alias("light"), values.round3(luma).alias("brightness"))


@query("select id, case h when 0 then 'cardConditionId' when 1 then 'graderId' when 2 then 'gradeId' when 3 then 'certificationNumber' end as field from (select p_partkey as id, p_size % 5 as h from part)")
def descriptor_fields(get):
    head = F.expr("case p_size % 5 when 0 then 'CD:Card Condition - (ID: 40001)' when 1 then 'CD:27501' when 2 then 'cd:Grade' when 3 then 'CDA:Certification Number - (ID: 27503)' else 'Grade' end")
    return get("part").select(F.col("p_partkey").alias("id"), market.descriptor_field(head).alias("field"))
