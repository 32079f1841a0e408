"""Queries on matching, candidate search and text signals."""

from __future__ import annotations

from pyspark.sql import functions as F

from evimatch.functions import text as t
from evimatch.functions import values
from evimatch.functions import vocabulary as v
from evimatch.operators import catalog, matching
from evimatch.plans.registry import fold_sql, number_sql, query, similarity_sql

_FIELDS = ("number", "name", "year", "hp", "language", "variant")


def _pairs(get):
    """Captures with the catalogue cards of their number (an equality, so rows are dealt by it)."""
    q = get("captures").select("cid", "true_id", "num", F.concat(F.col("num").cast("string"), F.lit("/"), F.col("den").cast("string")).alias("q_number"), F.col("name").alias("q_name"), F.col("year").alias("q_year"), F.col("hp").alias("q_hp"), F.col("language").alias("q_language"), F.lit(None).cast("string").alias("q_variant"))
    c = get("ref_cards").select("id", "num", F.concat(F.col("num").cast("string"), F.lit("/"), F.col("den").cast("string")).alias("c_number"), F.col("name").alias("c_name"), F.col("year").alias("c_year"), F.col("hp").alias("c_hp"), F.col("language").alias("c_language"), F.lit(None).cast("string").alias("c_variant"), F.col("has_variants").alias("c_has_variants"))
    # dealt by capture, so that ranking finds each capture's pairs in one place
    return matching.prepare(q, "q_").repartition("cid").join(matching.prepare(c, "c_"), "num")


def _ranked(get):
    scored = matching.score(_pairs(get), _FIELDS)
    narrow = scored.select("cid", "true_id", "id", "q_variant", "c_has_variants", "confidence", *[f"a_{f}" for f in _FIELDS])  # texts stay behind
    return matching.rank(narrow, "cid", "id")


_SCORED = f"""
p as (select q.cid, q.true_id, c.id, c.has_variants, {number_sql("q.num || '/' || q.den", "c.num || '/' || c.den")} as a_number, {similarity_sql("q.f", "c.f")} as a_name,
  case when q.year = c.year then 1.0::double else 0.0::double end as a_year, case when q.hp is null then null when q.hp = c.hp then 1.0::double else 0.0::double end as a_hp,
  case when q.language is null then null when q.language = c.language then 1.0::double else 0.0::double end as a_language
  from (select *, {fold_sql("name")} as f from {{captures}}) q join (select *, {fold_sql("name")} as f from {{ref_cards}}) c on q.num = c.num),
s as (select *, 0.0::double + a_number * 3.0::double + a_name * 2.0::double + a_year * 1.0::double + coalesce(a_hp * 0.8::double, 0.0::double) + coalesce(a_language * 0.5::double, 0.0::double) as total,
  0.0::double + 3.0::double + 2.0::double + 1.0::double + case when a_hp is null then 0.0::double else 0.8::double end + case when a_language is null then 0.0::double else 0.5::double end as evidence from p),
d as (select *, floor(total / evidence * least(1.0::double, 0.4::double + evidence / {sum(v.WEIGHTS.values())}::double * 1.2::double) * 1000.0::double + 0.5::double) / 1000.0::double as confidence from s),
o as (select *, row_number() over (partition by cid order by confidence desc, id) as place from d),
r as (select *, floor((confidence - coalesce(lead(confidence) over (partition by cid order by place), 0.0::double)) * 1000.0::double + 0.5::double) / 1000.0::double as margin from o where place <= 5)"""
_BAND = "case when confidence >= 0.9 and margin >= 0.1 then 'HIGH' when confidence >= 0.7 then 'MEDIUM' else 'LOW' end"
_FLAGS = "list_filter([case when a_number < 0.75 then 'number' end, case when a_name < 0.75 then 'name' end, case when a_year < 0.75 then 'year' end, case when a_language < 0.75 then 'language' end, case when has_variants then 'variant' end], lambda x: x is not null)"


@query(f"with {_SCORED} select cid, id as best_id, confidence, margin from r where place = 1")
def match_rank(get):
    return _ranked(get).where("place = 1").select("cid", F.col("id").alias("best_id"), "confidence", "margin")


@query(f"with {_SCORED} select cid, array_to_string({_FLAGS}, ',') as flags from r where place = 1")
def match_flags(get):
    return _ranked(get).where("place = 1").select("cid", F.array_join(matching.flags(_FIELDS), ",").alias("flags"))


@query(f"with {_SCORED} select cid, {_BAND} as band, case when {_BAND} = 'HIGH' and len({_FLAGS}) = 0 then 'IDENTIFIED' else 'NEEDS_REVIEW' end as state from r where place = 1")
def match_band_state(get):
    c, m = F.col("confidence"), F.col("margin")
    return _ranked(get).where("place = 1").select("cid", values.band(c, m).alias("band"), values.state_of(c, m, matching.flags(_FIELDS)).alias("state"))


@query(f"with {_SCORED} select count(*) as n, count(*) filter (where {_BAND} = 'HIGH' and len({_FLAGS}) = 0) as accepted, count(*) filter (where {_BAND} = 'HIGH' and len({_FLAGS}) = 0 and id <> true_id) as wrong from r where place = 1")
def match_auto_accept(get):
    ok = values.auto_acceptable(F.col("confidence"), F.col("margin"), matching.flags(_FIELDS))
    return _ranked(get).where("place = 1").agg(F.count("*").alias("n"), F.count_if(ok).alias("accepted"), F.count_if(ok & (F.col("id") != F.col("true_id"))).alias("wrong"))


@query(f"with {_SCORED} select cid, place, id, confidence from r")
def match_alternatives(get):
    return _ranked(get).select("cid", F.col("place").cast("bigint").alias("place"), "id", "confidence")


_A = "case when cid % 6 = 0 then 'SV0' || num || '/' || den when cid % 6 = 1 then '00' || num when cid % 6 = 2 then 'promo' else num || '/' || den end"
_B = "case when cid % 4 = 0 then num || '/' || (den + 1) when cid % 4 = 1 then 'sv' || num || '/' || den when cid % 4 = 2 then 'Promo' else '0' || num || ' / ' || den end"


@query(f"select cid, a, b, {number_sql('a', 'b')} as agreement from (select cid, {_A} as a, {_B} as b from {{captures}})")
def match_number_agreement(get):
    rows = get("captures").select("cid", F.expr(_A).alias("a"), F.expr(_B).alias("b"))
    return rows.select("cid", "a", "b", t.compare_numbers(F.col("a"), F.col("b")).alias("agreement"))


def _catalog(get):
    return get("captures"), get("ref_cards"), get("ref_sets")


_ROUTE1 = """few as (select *, row_number() over (partition by total order by set_name) as k from {ref_sets}),
one as (select q.cid, c.id from {captures} q join few f on f.total = q.den and f.k <= 12 join {ref_cards} c on c.set_name = f.set_name and c.num = q.num)"""
_SATISFIED = f"""sat as (select distinct one.cid from one join {{captures}} q on q.cid = one.cid join {{ref_cards}} c on c.id = one.id
where abs(q.year - c.year) <= 1 and {similarity_sql(fold_sql("q.name"), fold_sql("c.name"))} >= 0.8)"""


def _tiers(source: str) -> str:
    """The name route by plain contains, over all pairs of the two tables: whole names, then names without their last letters."""
    cut = "case when contains(c.f, q.f) then 0 when length(q.f) >= 6 and contains(c.f, left(q.f, length(q.f) - 1)) then 1 when length(q.f) >= 7 and contains(c.f, left(q.f, length(q.f) - 2)) then 2 when length(q.f) >= 8 and contains(c.f, left(q.f, length(q.f) - 3)) then 3 end"
    return f"""asked as (select *, {fold_sql("name")} as f from {source}), named as (select *, {fold_sql("name")} as f from {{ref_cards}}),
met as (select q.f as qf, c.f as cf, {cut} as cut from (select distinct f from asked where length(regexp_replace(f, '[^a-z]', '', 'g')) >= 4) q, (select distinct f from named) c),
hit as (select q.cid, c.id, {similarity_sql("c.f", "left(q.f, length(q.f) - met.cut)")} as close, case when met.cut > 0 then case when q.num is null or c.num = q.num then 4 + met.cut end
  when c.num = q.num and c.hp = q.hp then 1 when c.num = q.num then 2 when c.hp = q.hp then 3 else 4 end as tier from met join asked q on q.f = met.qf join named c on c.f = met.cf where met.cut is not null),
least as (select *, min(tier) over (partition by cid) as low from hit where tier is not null),
two as (select cid, id, tier from (select *, row_number() over (partition by cid order by close desc, id) as k from least where tier = low) where k <= 8)"""


@query(f"with {_ROUTE1} select cid, id from one")
def route_number(get):
    return catalog.number_route(*_catalog(get))


@query(f"with {_tiers('{captures}')} select cid, id, tier from two")
def route_relaxation(get):
    q, c, _ = _catalog(get)
    return catalog.name_tiers(q, c)


@query(f"with {_ROUTE1}, {_SATISFIED} select cid from sat")
def route_early_stop(get):
    q, c, s = _catalog(get)
    return catalog.satisfied(catalog.number_route(q, c, s), q, c)


@query(f"with {_ROUTE1}, {_SATISFIED}, rest as (select * from {{captures}} where cid not in (select cid from sat)), {_tiers('rest')} select cid, id, cast(min(route) as integer) as route from (select cid, id, 1 as route from one union all select cid, id, 2 as route from two) group by cid, id")
def route_union_dedupe(get):
    return catalog.search(*_catalog(get))


@query("select c.id, c.name, c.num || '/' || s.total as number, s.released as year from {ref_cards} c left join {ref_sets} s on s.set_name = c.set_name")
def set_enrichment(get):
    return get("ref_cards").join(get("ref_sets"), "set_name", "left").select("id", "name", F.concat(F.col("num").cast("string"), F.lit("/"), F.col("total").cast("string")).alias("number"), F.col("released").alias("year"))


@query("select cid, den from {captures} where den in (select total from {ref_sets})")
def known_totals_semi(get):
    return get("captures").join(get("ref_sets").select(F.col("total").alias("den")), "den", "left_semi").select("cid", "den")


@query("select set_name, id, language from (select *, max(case when language = 'de' then 1 else 0 end) over (partition by set_name) as hit from {ref_cards}) where hit = 0 or language = 'de'")
def prefer_language(get):
    return catalog.prefer_language(get("ref_cards"), "set_name", "de").select("set_name", "id", "language")


@query(f"select doc_id, md5({fold_sql('text')}) as folded, length({fold_sql('text')}) as n from documents")
def fold_text(get):
    f = t.fold(F.col("text"))
    return get("documents").select("doc_id", F.md5(f.cast("binary")).alias("folded"), F.length(f).cast("bigint").alias("n"))


@query(f"select cid, {similarity_sql(fold_sql('name'), fold_sql('true_name'))} as same, {similarity_sql(fold_sql('name'), fold_sql('set_name'))} as other from {{captures}} join (select id, set_name from {{ref_cards}}) on id = true_id")
def similarity_pairs(get):
    rows = get("captures").join(get("ref_cards").select(F.col("id").alias("true_id"), "set_name"), "true_id")
    return rows.select("cid", t.similarity(F.col("name"), F.col("true_name")).alias("same"), t.similarity(F.col("name"), F.col("set_name")).alias("other"))


_WIN = ", ".join(f"list_transform(range(1, length(h) - length(n) - ({d}) + 2), lambda i: {similarity_sql('trim(substr(h, i, length(n) + (' + str(d) + ')))', 'n')})" for d in (-1, 0, 1))


@query(f"select cid, case when h = '' or n = '' then 0.0::double when contains(h, n) then 1.0::double when length(n) < 4 then 0.0::double else coalesce(list_max(list_concat({_WIN})), 0.0::double) end as best from (select cid, {fold_sql("'* ' || name || ' w90 HP'")} as h, {fold_sql('true_name')} as n from {{captures}})")
def contains_fuzzy(get):
    hay = F.concat(F.lit("* "), F.col("name"), F.lit(" w90 HP"))
    return get("captures").select("cid", t.contains_fuzzy(hay, F.col("true_name")).alias("best"))


_FIXED = r"translate(regexp_replace(text, '([0-9OoQDIlSsBZzGT])[|\\]([0-9OoQDIlSsBZzGT])', '\1/\2', 'g'), 'OoQDIli|SsBZzGT', '000011115582267')"
_NUM = r"'([A-Z]{0,3}\d{1,4}[a-z]?)\s*/\s*([A-Z]{0,3}\d{1,4})'"
_PICK = f"list_filter(list_zip(regexp_extract_all({_FIXED}, {_NUM}, 1), regexp_extract_all({_FIXED}, {_NUM}, 2)), lambda x: not coalesce(try_cast(regexp_replace(x[2], '\\D', '', 'g') as int) < 5, false))[1]"


@query(f"select cid, translate(text, 'OoQDIli|SsBZzGT', '000011115582267') as fixed from {{ocr_text}}")
def digit_repair(get):
    return get("ocr_text").select("cid", t.digits_only(F.col("text")).alias("fixed"))


@query(f"select cid, x[1] || '/' || x[2] as number, n from (select cid, {_PICK} as x, cast(len(regexp_extract_all({_FIXED}, {_NUM}, 1)) as bigint) as n from {{ocr_text}})")
def card_numbers(get):
    found = get("ocr_text").select("cid", t.card_numbers(F.col("text")).alias("found"))
    return found.select("cid", t.choose_number(F.col("found")).alias("number"), F.size("found").cast("bigint").alias("n"))


_YEARS = r"list_transform(regexp_extract_all(text, '(?:^|[^A-Za-z0-9_])(19[3-9]\d|20[0-4]\d)\b', 1), lambda x: cast(x as integer))"


@query(rf"select cid, list_max({_YEARS}) as latest, cast(nullif(regexp_extract(text, '(?i)(?:©|\(c\)|copyright)\s*([0-9]{{4}})?', 1), '') as integer) as printed, nullif(trim(regexp_extract(text, '(?i)(?:©|\(c\)|copyright)\s*([0-9]{{4}})?\s*([A-Za-zÀ-ÿ''.\- ]{{2,40}})?', 2)), '') as holder from {{ocr_text}}")
def years_copyright(get):
    c = F.col("text")
    return get("ocr_text").select("cid", t.latest_year(c).alias("latest"), t.copyright_year(c).alias("printed"), t.copyright_holder(c).alias("holder"))


_HP = r"coalesce(nullif(regexp_extract(text, '(?i)\b(?:HP|PS|PV|LP)\s*[:.]?\s*(\d{2,3})\b', 1), ''), nullif(regexp_extract(text, '(?i)\b(\d{2,3})\s*(?:HP|PS|PV|LP)\b', 1), ''))"


@query(f"select cid, case when h between 10 and 340 and h % 10 = 0 then h end as hp from (select cid, cast({_HP} as integer) as h from {{ocr_text}})")
def hp(get):
    return get("ocr_text").select("cid", t.hp(F.col("text")).alias("hp"))


_VARIANTS = "[" + ", ".join("case when " + " or ".join(f"contains(f, '{a}')" for a in aliases) + f" then '{name}' end" for name, aliases in v.VARIANTS) + "]"


@query(f"select cid, array_to_string(case when list_contains(x, 'reverse holo') then list_filter(x, lambda y: y <> 'holo') else x end, ',') as terms from (select cid, list_filter({_VARIANTS}, lambda y: y is not null) as x from (select cid, {fold_sql('text')} as f from {{ocr_text}}))")
def variant_terms(get):
    return get("ocr_text").select("cid", F.array_join(t.variant_terms(F.col("text")), ",").alias("terms"))


_LANG = "case " + " ".join("when " + " or ".join(f"contains(f, '{h}')" for h in hints) + f" then '{code}'" for code, hints in v.LANGUAGE_HINTS) + " end"


@query(f"select cid, {_LANG} as language from (select cid, {fold_sql('text')} as f from {{ocr_text}})")
def language_guess(get):
    return get("ocr_text").select("cid", t.language(F.col("text")).alias("language"))


_W = r"regexp_matches(t, '^[A-Za-zÀ-ÿ][A-Za-zÀ-ÿ''’.\-]*$') and not regexp_matches(t, '(?i)^(?:basic|stage|stufe|grundphase|phase|niveau|pok[eé]mon|trainer|dresseur|hp|ps|pv|lp)$') and (length(t) >= 4 or regexp_matches(t, '(?i)^(?:ex|gx|v|vmax|vstar|vunion|break|prime|star)$') or regexp_matches(t, '(?i)^(?:mr|dr|jr)\.?$') or regexp_matches(t, '(?i)^(?:mew|muk|ho-oh)$'))"


@query(rf"""with l as (select cid, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '')[1:8] as l from {{ocr_text}}),
x as (select cid, unnest(l) as line, unnest(range(0, len(l))) as i from l),
k as (select cid, i, list_filter(list_transform(regexp_split_to_array(line, '\s+'), lambda t: regexp_replace(regexp_replace(t, '^[^A-Za-zÀ-ÿ0-9]+', ''), '[^A-Za-zÀ-ÿ0-9.''’]+$', '')), lambda t: {_W}) as w from x where not regexp_matches(line, '(?i)\b(?:evolves?\s+(?:from|de|aus)|entwickelt|[eé]volue)\b')),
s as (select cid, i, array_to_string(w, ' ') as name, 10.0::double - i * 2.5::double + least(length(regexp_replace(array_to_string(w, ' '), '[^A-Za-zÀ-ÿ]', '', 'g')), 12) * 0.3::double as score from k where len(list_filter(w, lambda t: not regexp_matches(t, '(?i)^(?:ex|gx|v|vmax|vstar|vunion|break|prime|star)$') and not regexp_matches(t, '(?i)^(?:mr|dr|jr)\.?$'))) > 0)
select c.cid, b.name from {{captures}} c left join (select cid, name from (select *, row_number() over (partition by cid order by score desc, i) as k from s) where k = 1) b using (cid)""")
def pick_name(get):
    return get("ocr_text").select("cid", t.pick_name(F.col("text")).alias("name"))


_LETTERS = lambda x: f"lower(regexp_replace({x}, '[^A-Za-zÀ-ÿ0-9]', '', 'g'))"


@query(f"select cid, case when least(length(x), length(y)) < 4 then false when x = y then true when least(length(x), length(y)) >= 5 and (contains(x, y) or contains(y, x)) then true else greatest(length(x), length(y)) >= 7 and 1.0::double - levenshtein(x, y)::double / greatest(length(x), length(y))::double >= 0.85 end as same from (select cid, {_LETTERS('name')} as x, {_LETTERS('true_name')} as y from {{captures}})")
def same_name(get):
    return get("captures").select("cid", t.same_name(F.col("name"), F.col("true_name")).alias("same"))


_TOK = r"regexp_split_to_array(t, '\s+')"


@query(rf"""select part_id, case when t = '' or len({_TOK}) > 4 or length(regexp_replace(t, '[^A-Za-zÀ-ÿ]', '', 'g')) < 4 or length(regexp_replace(t, '[^A-Za-zÀ-ÿ]', '', 'g')) * 10 < length(regexp_replace(t, '[\s''’.\-]', '', 'g')) * 9
 or len(list_filter({_TOK}, lambda x: not regexp_matches(x, '^[A-Za-zÀ-ÿ][A-Za-zÀ-ÿ''’.\-]*$'))) > 0 or len(list_filter({_TOK}, lambda x: length(regexp_replace(x, '[^A-Za-zÀ-ÿ]', '', 'g')) >= 3)) = 0 then 0.0::double
 else least(1.0::double, (case when t = upper(t) or len(list_filter({_TOK}, lambda x: not regexp_matches(x, '^[A-ZÀ-Þ]'))) = 0 then 0.7::double else 0.3::double end) + case when len({_TOK}) >= 2 then 0.3::double else 0.0::double end) end as likeness
from (select p_partkey as part_id, case when p_partkey % 5 = 0 then upper(p_name) when p_partkey % 5 = 1 then p_name || ' 7x' when p_partkey % 5 = 2 then left(p_name, 3) else p_name end as t from part)""")
def name_likeness(get):
    line = F.expr("case when p_partkey % 5 = 0 then upper(p_name) when p_partkey % 5 = 1 then p_name || ' 7x' when p_partkey % 5 = 2 then left(p_name, 3) else p_name end")
    return get("part").select(F.col("p_partkey").alias("part_id"), t.name_likeness(line).alias("likeness"))
