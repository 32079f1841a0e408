"""Queries on records: duplicates, selection, pairing, market files, layout, jobs and grey arrays."""

from __future__ import annotations

from pyspark.sql import functions as F

from evimatch.functions import market, values
from evimatch.functions import vocabulary as v
from evimatch.operators import images, jobs, layout, merging, records, review
from evimatch.plans.registry import fold_sql, query
from evimatch.plans.views import back_lines, words
from evimatch.sources import csvio

_KEY = "concat_ws('|', " + ", ".join(fold_sql(c) for c in ("set_name", "number", "name2", "variant")) + ")"
_CARDS = "(select *, case when card_id % 3 = 0 then name else 'Müller' end as name2 from {cards})"


def _cards(get):
    return get("cards").withColumn("name2", F.expr("case when card_id % 3 = 0 then name else 'Müller' end"))


def _key():
    return records.identity_key(*[F.col(c) for c in ("set_name", "number", "name2", "variant")])


@query(f"select {_KEY} as key, count(*) as n from {_CARDS} group by 1 having count(*) > 1")
def dup_groups(get):
    return records.duplicates(_cards(get), _key())


@query(f"select {_KEY} as key, max_by(card_id, confidence * 1000000 - card_id) as keep, cast(sum(case when quantity = 0 then 1 else quantity end) as bigint) as quantity, count(*) - 1 as removed from {_CARDS} group by 1")
def dup_merge_quantity(get):
    return records.merge_quantity(_cards(get).withColumn("key", _key()), "key", "card_id", "confidence", "quantity")


@query(f"select card_id from (select card_id, count(*) over (partition by {_KEY}) as n from {_CARDS}) where n > 1")
def dup_semi_view(get):
    keyed = _cards(get).withColumn("key", _key())
    return keyed.join(records.duplicates(keyed, F.col("key")).select("key"), "key", "left_semi").select("card_id")


_GRAY = "list_transform(embedding, lambda x: floor(least(greatest((x::double + 1.0::double) * 127.5::double, 0.0::double), 255.0::double)))"


def _gray(get):
    g = F.transform("embedding", lambda x: F.floor(F.least(F.greatest((x.cast("double") + 1.0) * 127.5, F.lit(0.0)), F.lit(255.0))).cast("double"))
    return get("embeddings").select("vec_id", g.alias("gray"))


@query(f"select vec_id, lower(printf('%x', list_reduce(list_prepend(2166136261::bigint, list_transform(list_filter(list_zip(g, range(0, len(g))), lambda z: z[2] % 16 = 0), lambda z: cast(z[1] as bigint))), lambda h, b: (xor(h, b) * 16777619) % 4294967296))) as hash from (select vec_id, {_GRAY} as g from embeddings)")
def dup_image_hash(get):
    return _gray(get).select("vec_id", images.fnv_hash(F.col("gray")).alias("hash"))


@query("select count(*) as n_all, count(*) filter (where state = 'NEEDS_REVIEW') as n_review, count(*) filter (where state not in ('NEEDS_REVIEW', 'FAILED')) as n_ready, count(*) filter (where state = 'FAILED') as n_failed from {cards}")
def cards_counts(get):
    return records.status(get("cards"))


@query("select card_id, name, set_name from {cards} where contains(lower(name), '17') or contains(lower(set_name), '17') or contains(lower(variant), '17') order by coalesce(set_name, ''), card_id limit 100")
def cards_search_sort_page(get):
    return records.search_page(get("cards"), "17", ["name", "set_name", "variant"], "set_name", "card_id").select("card_id", "name", "set_name")


_HAS = lambda q: "(" + " or ".join(f"contains(lower({c}), '{q}')" for c in ("name", "set_name", "variant")) + ")"


@query(f"""select 'ready' as shown, card_id from (select card_id from {{cards}} where state not in ('NEEDS_REVIEW', 'FAILED') and {_HAS("brand#1")} order by coalesce(name, ''), card_id limit 100)
union all select 'review', card_id from (select card_id from {{cards}} where state = 'NEEDS_REVIEW' and {_HAS("mach")} order by coalesce(set_name, '') desc, card_id limit 100)
union all select 'duplicates', card_id from (select card_id from (select *, count(*) over (partition by {_KEY}) as n from {_CARDS}) where n > 1 and {_HAS("1")} order by confidence desc, card_id limit 100)""")
def cards_visible(get):
    asked = {"ready": ("Brand#1", {"sort": "name"}), "review": ("mach", {"sort": "set_name", "descending": True}), "duplicates": (" 1 ", {"sort": "confidence", "descending": True, "as_text": False})}
    shown = lambda which, needle, page: review.visible(_cards(get), which, needle, ["name", "set_name", "variant"], _key(), id_col="card_id", **page).select(F.lit(which).alias("shown"), "card_id")
    ready, rest, twice = (shown(which, *how) for which, how in asked.items())
    return ready.unionByName(rest).unionByName(twice)


@query("select card_id from {cards} where card_id between 20 and 120")
def selection_range(get):
    return records.range_ids(get("cards"), "card_id", "card_id", 120, 20)


@query("select count(*) as n, count(*) filter (where state = 'FAILED') as chosen, count(*) filter (where state = 'FAILED') > 0 as some_chosen, count(*) > 0 and count(*) = count(*) filter (where state = 'FAILED') as all_chosen from {cards}")
def selection_state(get):
    chosen = F.count_if(F.col("state") == "FAILED")
    return get("cards").agg(F.count("*").alias("n"), chosen.alias("chosen"), (chosen > 0).alias("some_chosen"), ((F.count("*") > 0) & (F.count("*") == chosen)).alias("all_chosen"))


@query("select owner || ':' || owner % 3 as blob_id from (select o_orderkey as owner, o_orderdate as tm from orders) where owner not in (select card_id from {cards}) and tm < timestamp '1998-01-01 00:00:00' - interval 24 hours")
def orphan_sweep(get):
    blobs = get("orders").select(F.concat(F.col("o_orderkey").cast("string"), F.lit(":"), (F.col("o_orderkey") % 3).cast("string")).alias("blob_id"), F.col("o_orderdate").alias("at"))
    return records.orphans(blobs, get("cards"), "1998-01-01 00:00:00").select("blob_id")


@query("select o_orderkey from orders where o_custkey not in (select card_id from {cards} where state = 'FAILED')")
def cascade_delete(get):
    gone = get("cards").where("state = 'FAILED'").select(F.col("card_id").alias("o_custkey"))
    return records.without(get("orders"), gone, "o_custkey").select("o_orderkey")


_BARE = r"regexp_replace(name, '(?i)\.[a-z0-9]{2,5}$', '')"


@query(rf"""with s as (select pos, name, case when regexp_matches({_BARE}, '(?i)(^|[^a-zà-ÿ])front($|[^a-zà-ÿ])') then 'front' when regexp_matches({_BARE}, '(?i)(^|[^a-zà-ÿ])back($|[^a-zà-ÿ])') then 'back' end as side, trim(regexp_replace(lower(regexp_replace({_BARE}, '(?i)(front|back)', ' ')), '[\s._-]+', ' ', 'g')) as stem from {{photos}}),
n as (select *, row_number() over (partition by side, stem order by pos) as k from s where side is not null)
select stem, max(case when side = 'front' then name end) as front, max(case when side = 'back' then name end) as back from n group by stem, k""")
def pair_by_name(get):
    return merging.pair_by_name(get("photos")).select("stem", "front", "back")


@query("select cast(floor(pos / 2) as bigint) as pair, max(case when pos % 2 = 0 then name end) as front, max(case when pos % 2 = 1 then name end) as back from {photos} group by 1")
def pair_by_order(get):
    return merging.pair_by_order(get("photos"))


@query("""with e as (select conv_id, case when turn % 3 = 0 then 'name' else 'year' end as kind, text as value, cast(length(text) % 100 as double) / 100.0::double as confidence, turn % 5 = 1 as inferred, case when role = 'user' then 'front' else 'back' end as side, turn from {conversations}),
o as (select *, row_number() over (partition by conv_id, kind order by not inferred desc, confidence desc, side = 'front' desc, value desc) as k from e)
select conv_id, kind, value, confidence, side from o where k = 1""".replace("{conversations}", "conversations"))
def evidence_merge(get):
    e = get("conversations").select("conv_id", F.expr("case when turn % 3 = 0 then 'name' else 'year' end").alias("kind"), F.col("text").alias("value"), (F.length("text") % 100 / 100.0).cast("double").alias("confidence"), (F.col("turn") % 5 == 1).alias("inferred"), "role")
    front, back = e.where("role = 'user'").drop("role"), e.where("role <> 'user'").drop("role")
    return merging.merge_evidence(front, back, ["conv_id", "kind"])


@query("""with s as (select l_partkey as item, 'R' || (l_linenumber % 4) as text, count(*) as n, max(cast(floor(l_discount * 100 + 0.5) as bigint)) as confidence from lineitem group by 1, 2),
o as (select *, row_number() over (partition by item order by n desc, confidence desc, text) as k from s) select item, text, n, confidence from o where k = 1""")
def reading_vote(get):
    rows = get("lineitem").select(F.col("l_partkey").alias("item"), F.concat(F.lit("R"), (F.col("l_linenumber") % 4).cast("string")).alias("text"), F.floor(F.col("l_discount") * 100 + 0.5).alias("confidence"))
    return merging.vote(rows, "item")


@query("""with g as (select *, case when x0 - lag(x1) over w > 2.2 * least(h, lag(h) over w) then 1 else 0 end as cut from {words} window w as (partition by doc_id, row_id order by x0, word_id)),
l as (select *, cast(sum(cut) over (partition by doc_id, row_id order by x0, word_id rows unbounded preceding) as bigint) as line from g)
select doc_id, row_id, line, string_agg(text, ' ' order by x0, word_id) as text, count(*) as n_words, min(x0) as x0, max(x1) as x1, list_sort(list(h))[(count(*) - 1) // 2 + 1] as height, sum(conf * length(text)) / sum(length(text)) as confidence from l group by doc_id, row_id, line""")
def line_gaps(get):
    return layout.gap_lines(get("words"), ["doc_id", "row_id"])


@query("""select a.doc_id, a.word_id as u, b.word_id as v from {words} a join {words} b on a.doc_id = b.doc_id and a.word_id < b.word_id
where least(a.x1, b.x1) - greatest(a.x0, b.x0) >= 0.6 * least(a.x1 - a.x0, b.x1 - b.x0) and abs(a.row_id * 10 + a.row_id * 10 + a.h - b.row_id * 10 - b.row_id * 10 - b.h) / 2 < 0.6 * greatest(a.h, b.h)""")
def spatial_overlap(get):
    w = get("words").withColumn("y0", F.col("row_id") * 10.0).withColumn("y1", F.col("row_id") * 10.0 + F.col("h"))
    return layout.same_place(w.select("doc_id", F.col("word_id").cast("bigint").alias("word_id"), "x0", "x1", "y0", "y1"), "doc_id")


_T = [("year", "cast(year as varchar)"), ("set", "set_name"), ("name", "name"), ("number", "case when num % 4 = 0 then null else num || '/' || den end"), ("variant", "case when id % 3 = 0 then series end"), ("language", "language")]
_FULL = "trim(regexp_replace(concat(" + ", ' ', ".join(f"coalesce({'chr(35) || ' if k == 'number' else ''}({e}), '')" for k, e in _T) + r"), '\s{2,}', ' ', 'g'))"
_SPACE_AT = f"(24 - strpos(reverse({'left(f, 24)'}), ' '))"


@query(f"select id, case when length(f) <= 24 then f when contains(left(f, 24), ' ') and {_SPACE_AT} > 14.4 then trim(left(f, cast({_SPACE_AT} as bigint))) else trim(left(f, 24)) end as title from (select id, {_FULL} as f from {{ref_cards}})")
def title_render(get):
    c = {"year": F.col("year"), "set": F.col("set_name"), "name": F.col("name"), "number": F.expr("case when num % 4 = 0 then null else num || '/' || den end"), "variant": F.expr("case when id % 3 = 0 then series end"), "language": F.col("language")}
    return get("ref_cards").select("id", market.title(market.DEFAULT_TITLE, c, 24).alias("title"))


_PRICE = "case when o_orderkey % 5 = 0 then cast(o_custkey as varchar) when o_orderkey % 5 = 1 then '€ ' || o_custkey || ',' || (o_orderkey % 10) when o_orderkey % 5 = 2 then o_custkey || '.' || (10 + o_orderkey % 90) || ' EUR' when o_orderkey % 5 = 3 then '-' || o_custkey else '1,000.00' end"
_S = r"regexp_replace(p, '(?i)\s|€|eur', '', 'g')"


@query(rf"select id, case when not regexp_matches({_S}, '^\d+([.,]\d{{1,2}})?$') then null when not regexp_matches({_S}, '[.,]') then {_S} else regexp_extract({_S}, '^(\d+)', 1) || ',' || rpad(regexp_extract({_S}, '[.,](\d{{1,2}})$', 1), 2, '0') end as price from (select o_orderkey as id, {_PRICE} as p from orders)")
def price_format(get):
    return get("orders").select(F.col("o_orderkey").alias("id"), market.price(F.expr(_PRICE.replace("varchar", "string")), ",").alias("price"))


_EBAY = "select c_custkey as id, case when c_custkey % 7 = 0 then 'sports' when c_custkey % 7 = 1 then '' end as chosen, case when c_custkey % 3 = 0 then 'Pokémon' end as game, case when c_custkey % 3 = 1 then 'Football' end as sport, case when c_custkey % 4 = 0 then 'Sehr gut' when c_custkey % 4 = 1 then 'near mint' when c_custkey % 4 = 2 then 'Played' end as condition, case when c_custkey % 5 = 0 then 'psa' when c_custkey % 5 = 1 then 'CGC' end as grader, case when c_custkey % 5 = 0 then 'Gem Mint 9.50' when c_custkey % 5 = 1 then 'authentic' end as grade, case when c_custkey % 11 = 0 then 'nein' when c_custkey % 11 = 1 then 'Ja' end as graded from customer"
_SQL_PROBLEMS = "array_to_string(list_filter([case when kind is null then 'card type' end, case when g and grid is null then case when coalesce(grader, '') = '' then 'grader' else 'grader (not one eBay lists)' end end, case when g and gdid is null then case when coalesce(grade, '') = '' then 'grade' else 'grade (not one eBay lists)' end end, case when not g and cond is null then case when coalesce(condition, '') = '' then 'condition' else 'condition (not one eBay lists for cards)' end end, case when g is null then 'graded or not' end], lambda x: x is not null), '; ')"
_SQL_EBAY = f"""with e as ({_EBAY}), k as (select *, case when chosen in ('ccg', 'sports', 'nonsport') then chosen when coalesce(game, '') <> '' then 'ccg' when coalesce(sport, '') <> '' then 'sports' end as kind,
 case when graded = 'Ja' then true when graded = 'nein' then false when coalesce(grader, '') <> '' or coalesce(grade, '') <> '' then true when coalesce(condition, '') <> '' then false end as g,
 case grader when 'psa' then 275010 end as grid, case grade when 'Gem Mint 9.50' then 275021 when 'authentic' then 2750219 end as gdid, case condition when 'Sehr gut' then 400012 when 'near mint' then 400010 end as cond from e)"""


def _ebay(get):
    c = get("customer").selectExpr(*[x.strip() for x in _split_top(_EBAY[len("select ") : _EBAY.index(" from customer")])])
    return c.withColumn("kind", market.card_type(F.col("chosen"), F.col("game"), F.col("sport"))).withColumn("g", market.is_graded(F.col("graded"), F.col("grader"), F.col("grade"), F.col("condition")))


def _split_top(s: str) -> list[str]:
    """Split a select list at commas outside brackets; its case expressions hold none."""
    return s.split(", ")


@query(f"{_SQL_EBAY} select id, case kind when 'ccg' then 183454 when 'sports' then 261328 when 'nonsport' then 183050 end as category, g as graded, grid as grader_id, gdid as grade_id, cond as condition_id, {_SQL_PROBLEMS} as problems from k")
def ebay_ids(get):
    c = _ebay(get)
    told = market.problems(F.col("kind"), F.col("g"), F.col("condition"), F.col("grader"), F.col("grade"))
    return c.select("id", market.category_id(F.col("kind")).alias("category"), F.col("g").alias("graded"), market.grader_id(F.col("grader")).alias("grader_id"), market.grade_id(F.col("grade")).alias("grade_id"), market.condition_id(F.col("condition")).alias("condition_id"), F.array_join(told, "; ").alias("problems"))


@query(f"{_SQL_EBAY} select problem, count(*) as n from (select unnest(string_split({_SQL_PROBLEMS}, '; ')) as problem from k) where problem <> '' group by problem")
def still_to_decide(get):
    told = market.problems(F.col("kind"), F.col("g"), F.col("condition"), F.col("grader"), F.col("grade"))
    return _ebay(get).select(F.explode(told).alias("problem")).groupBy("problem").agg(F.count("*").alias("n"))


_HEAD = "case p_size % 5 when 0 then '*C:' || upper(p_type) || ' CardName' when 1 then p_brand || ' (ID: 12)' when 2 then 'Start_price-' || p_name when 3 then 'L:customLabel' else '  Pflicht ' || p_name end"


@query(rf"select id, regexp_replace(lower(trim(regexp_replace(regexp_replace(regexp_replace(replace(h, '*', ''), '^(?i:C|L):', ''), '\s*\([^)]*\)\s*', ' ', 'g'), '([a-z0-9])([A-Z])', '\1 \2', 'g'))), '[\s_-]+', ' ', 'g') as header, contains(h, '*') or starts_with(lower(trim(h)), 'pflicht') or starts_with(lower(trim(h)), 'required') as needed from (select p_partkey as id, {_HEAD} as h from part)")
def header_normalize(get):
    h = F.expr(_HEAD)
    return get("part").select(F.col("p_partkey").alias("id"), market.normalize_header(h).alias("header"), market.required_header(h).alias("needed"))


def _filled(get):
    template = csvio.starter()
    mapping = {"category": "Category ID", "title": "Title", "price": "Start price", "quantity": "Quantity"}
    c = _ebay(get).join(get("customer").select(F.col("c_custkey").alias("id"), "c_name", "c_acctbal"), "id")
    vals = {"category": market.category_id(F.col("kind")), "title": F.col("c_name"), "price": market.price(market.amount(F.col("c_acctbal"))), "quantity": F.lit(1)}
    return csvio.template_rows(c, template, mapping, vals, ["id"]), template


@query(f"{_SQL_EBAY} select id, coalesce(case kind when 'ccg' then '183454' when 'sports' then '261328' when 'nonsport' then '183050' end, 'Needs review') as category, c_name as title, '1' as quantity, '' as unknown from k join customer on c_custkey = id")
def template_rows(get):
    rows, t = _filled(get)
    at = {h: f"h{i}" for i, h in enumerate(t.headers)}
    return rows.select("id", F.col(at["Category ID"]).alias("category"), F.col(at["Title"]).alias("title"), F.col(at["Quantity"]).alias("quantity"), F.col(at["Format"]).alias("unknown"))


@query(f"{_SQL_EBAY} select '{v.STARTER_HEADERS[0]}' as header, count(*) as n from k union all select 'Category ID', count(*) from k where kind is null")
def template_validate(get):
    rows, t = _filled(get)
    return csvio.validate(rows, t)


_FIELD = "case l_orderkey % 8 when 0 then '=1+1' when 1 then l_partkey || '/' || (l_suppkey + 100) when 2 then '00' || l_partkey when 3 then 'say \"' || l_suppkey || '\"' when 4 then 'a,b' || l_partkey when 5 then ' x' || l_partkey when 6 then '-' || l_partkey else 'plain ' || l_suppkey end"


def _csv_sql(x: str) -> str:
    s = rf"(case when regexp_matches({x}, '^[=+\-@\t\r]') then chr(39) || {x} else {x} end)"
    return rf"case when {x} is null then '' when regexp_matches({s}, '^(\d+\s*/\s*\d+|\d+-\d+|0\d+|\d{{12,}})$') or contains({s}, ',') or contains({s}, '\"') or contains({s}, chr(10)) or contains({s}, chr(13)) or regexp_matches({s}, '^\s|\s$') then '\"' || replace({s}, '\"', '\"\"') || '\"' else replace({s}, '\"', '\"\"') end".replace('\\"', '"')


@query(f"select f as value, {_csv_sql('f')} as field, count(*) as n from (select {_FIELD} as f from lineitem) group by 1, 2")
def csv_escape(get):
    return get("lineitem").select(F.expr(_FIELD).alias("value")).withColumn("field", market.csv_field(F.col("value"))).groupBy("value", "field").agg(F.count("*").alias("n"))


@query(f"select card_id, concat_ws(',', {_csv_sql('name')}, {_csv_sql('set_name')}, {_csv_sql('number')}, {_csv_sql('state')}) as line from {{cards}}")
def csv_lines(get):
    return get("cards").select("card_id", csvio.csv_line([F.col(c) for c in ("name", "set_name", "number", "state")]).alias("line"))


_HEADS = "case p_size % 4 when 0 then p_name || ';Preis;\"a,b,c,d\"' when 1 then p_name || ',Price' when 2 then p_name || chr(9) || 'x' else p_name end || chr(10) || 'a;b;c;d'"
_OUT = lambda ch: f"(length(b) - length(replace(b, {ch}, '')))"
_DELIM = f"case when {_OUT(chr(39) + ';' + chr(39))} > 0 and {_OUT(chr(39) + ';' + chr(39))} >= {_OUT(chr(39) + ',' + chr(39))} then ';' when {_OUT(chr(39) + ',' + chr(39))} > 0 then ',' when {_OUT('chr(9)')} > 0 then chr(9) else ',' end"


@query(f"select id, {_DELIM} as delimiter from (select p_partkey as id, regexp_replace(string_split({_HEADS}, chr(10))[1], '\"[^\"]*\"', '', 'g') as b from part)")
def delimiter_detect(get):
    return get("part").select(F.col("p_partkey").alias("id"), market.delimiter(F.expr(_HEADS.replace("chr(9)", "char(9)").replace("chr(10)", "char(10)"))).alias("delimiter"))


@query(f"{_SQL_EBAY} select coalesce(kind, 'no-card-type') as bucket, count(*) as n from k group by 1")
def export_split(get):
    return _ebay(get).groupBy(F.coalesce("kind", F.lit("no-card-type")).alias("bucket")).agg(F.count("*").alias("n"))


@query("select c_custkey as card_id, coalesce(case when c_custkey % 4 = 0 then 'mine' end, case when c_custkey % 3 = 0 then c_name else c_mktsegment end) as name, case when c_custkey % 3 = 0 then 'ocr' else 'db_match' end as source, case when c_custkey % 3 = 0 then 0.9::double else 0.75::double end as confidence from customer")
def provenance_fill(get):
    c = get("customer").withColumn("read", values.extracted(F.expr("case when c_custkey % 3 = 0 then c_name end"), "ocr", F.lit(0.9), F.col("c_name")))
    filled = c.withColumn("field", values.fill(F.col("read"), F.col("c_mktsegment"), F.lit(0.75), F.lit("db")))
    return filled.select(F.col("c_custkey").alias("card_id"), values.value_of(F.expr("case when c_custkey % 4 = 0 then 'mine' end"), F.col("field")).alias("name"), "field.source", "field.confidence")


@query("select state, count(*) as n from (select job_id, max_by(state, event_id) as state from {job_log} group by job_id) group by state")
def job_stats(get):
    return jobs.stats(get("job_log"), "job_id", "event_id")


@query("select event_id, cast(floor((2 * s * 7 + 3 * n) / (6 * n)) as bigint) as eta_ms from (select event_id, sum(ms) over w as s, count(*) over w as n from {job_log} window w as (partition by job_id order by event_id rows 19 preceding))")
def job_eta(get):
    return jobs.eta(get("job_log").withColumn("left", F.lit(7)), "job_id", ["event_id"], "ms", "left").select("event_id", "eta_ms")


@query("""with i as (select *, sum(case when failed then 0 else 1 end) over (partition by job_id order by event_id) as island from {job_log}),
r as (select *, sum(case when failed then 1 else 0 end) over (partition by job_id, island order by event_id) as run from i) select job_id, cast(max(run) as bigint) as longest, max(run) >= 4 as opened from r group by job_id""")
def job_breaker(get):
    return jobs.breakers(get("job_log"), "job_id", ["event_id"], "failed", 4)


@query("select job_id, case when max_by(state, event_id) = 'RUNNING' then 'QUEUED' else max_by(state, event_id) end as state from {job_log} group by job_id")
def job_restore(get):
    return jobs.restore(get("job_log"), "job_id", "event_id")


_EDGES = ", ".join(f"('{a}', '{b}')" for a, b in v.TRANSITIONS)


@query(f"select event_id, was, state from (select event_id, state, lag(state) over (partition by card_id order by event_id) as was from {{moves}}) where was is not null and (was, state) not in ({_EDGES})")
def lifecycle_valid(get):
    return jobs.illegal_moves(get("moves"), "card_id", ["event_id"]).select("event_id", "was", "state")


@query(f"select vec_id, list_sort(g)[least(len(g), cast(floor(0.95 * len(g)) as bigint) + 1)] as p95, list_sort(g)[len(g) // 2 + 1] as middle from (select vec_id, {_GRAY} as g from embeddings)")
def gray_percentile(get):
    return _gray(get).select("vec_id", images.nth(F.col("gray"), 0.95).alias("p95"), images.upper_median(F.col("gray")).alias("middle"))


@query(f"""with g as (select vec_id, unnest({_GRAY}) as x from embeddings), h as (select vec_id, cast(x as int) as t, count(*) as n from g group by all),
d as (select distinct vec_id as v from h), r as (select range as t2 from range(0, 256)),
e as (select d.v as vec_id, r.t2 as t, coalesce(h.n, 0)::double as n from d cross join r left join h on h.vec_id = d.v and h.t = r.t2),
c as (select vec_id, t, sum(n) over w as wb, sum(t * n) over w as sb, sum(n) over (partition by vec_id) as nn, sum(t * n) over (partition by vec_id) as ss from e window w as (partition by vec_id order by t)),
b as (select vec_id, t, case when wb = 0 or nn - wb = 0 then -2.0::double else wb * (nn - wb) * (sb / wb - (ss - sb) / (nn - wb)) * (sb / wb - (ss - sb) / (nn - wb)) end as between_var from c)
select vec_id, cast(t as int) as threshold from (select *, row_number() over (partition by vec_id order by between_var desc, t) as k from b) where k = 1""")
def gray_otsu(get):
    return images.otsu(_gray(get), "vec_id", "gray")


@query(f"select vec_id, lo, hi, list_sum(list_transform(g, lambda x: floor(greatest(0.0, least(255.0, (x - lo) / (hi - lo) * 255))))) as total from (select *, greatest(lo + 1, cast(list_sort(g)[greatest(1, cast(ceil(len(g) * 0.98) as bigint))] as int)) as hi from (select vec_id, g, cast(list_sort(g)[greatest(1, cast(ceil(len(g) * 0.02) as bigint))] as int) as lo from (select vec_id, {_GRAY} as g from embeddings)))")
def gray_stretch(get):
    s = images.stretch(_gray(get), "vec_id", "gray")
    return s.select("vec_id", "lo", "hi", F.aggregate("stretched", F.lit(0.0), lambda a, x: a + F.floor(x).cast("double")).alias("total"))


@query(f"select vec_id, floor(list_sum(g) / len(g) * 1000 + 0.5) / 1000 as mean, len(list_filter(g, lambda x: x > 160)) / len(g) as blown from (select vec_id, {_GRAY} as g from embeddings)")
def gray_quality(get):
    mean = F.aggregate("gray", F.lit(0.0), lambda a, x: a + x) / F.size("gray")
    return _gray(get).select("vec_id", values.round3(mean).alias("mean"), (F.size(F.filter("gray", lambda x: x > 160)) / F.size("gray")).alias("blown"))


@query("select priority, count(*) as n, cast(floor(100.0 * count(*) filter (where name = true_name) / count(*) + 0.5) as bigint) as right_pct from {captures} group by priority")
def accuracy_report(get):
    pct = F.floor(F.count_if(F.col("name") == F.col("true_name")) * 100.0 / F.count("*") + 0.5)
    return get("captures").groupBy("priority").agg(F.count("*").alias("n"), pct.alias("right_pct"))


@query()
def words_to_lines(get):
    w = words(get("lineitem"))
    return layout.words_to_lines(w.select("doc_id", "word_id", "text", "conf", "x0", "x1", (F.col("row_id") * 20.0).alias("y0"), (F.col("row_id") * 20.0 + F.col("h")).alias("y1")))


_PLAIN = rf"trim(regexp_replace(regexp_replace(lower(translate(coalesce(text, ''), '{v.ACCENTED}', '{v.PLAIN}')), '[^a-z0-9&''.\- ©#/]+', ' ', 'g'), '\s+', ' ', 'g'))"
_LATEST = r"cast(list_max(list_transform(regexp_extract_all(p, '(?:^|[^A-Za-z0-9_])(19[3-9]\d|20[0-4]\d)\b', 1), lambda x: cast(x as integer))) as varchar)"
_PART = r"nullif(regexp_extract(p, '(?:^|\s)(\d{1,4})\s*/\s*(\d{1,4})(?:\s|$)', %d), '')"


def _evidence_sql() -> str:
    """A list of what a line may say, each kind's values in the order of the vocabulary, and the surest line for each kind."""
    q = lambda x: x.replace("'", "''")
    fact = lambda kind, value, hit: f"case when {hit} then struct_pack(kind := '{kind}', value := {value}) end"
    facts = [fact("manufacturer", f"'{q(x)}'", f"brandish and regexp_matches(p, '(^|[ ©]){q(x.lower().replace('-', ' ').replace(' ', '[- ]'))}($|[ ,.])')") for x in v.MANUFACTURERS]
    facts += [fact("product", f"'{q(x)}'", f"brandish and regexp_matches(p, '(^|[ ©]){q(x.lower())}($|[ ,.])')") for x in v.PRODUCTS]
    facts += [fact("league", f"'{x}'", f"list_contains(string_split(p, ' '), '{x.lower()}')") for x in v.LEAGUES]
    facts += [fact("finish", f"'{x}'", f"regexp_matches(p, '(^|[ ]){x}($|[ ])')") for x in v.FINISHES]
    maker = " or ".join(f"contains(p, '{q(x.lower())}')" for x in v.MANUFACTURERS)
    facts.append(fact("year", _LATEST, f"(legal or {maker}) and {_LATEST} is not null"))
    number = r"upper(regexp_extract(p, '(?:^|\s)(?:#|no\.?|nr\.?)\s*(\d{1,4}[a-z]?)(?:\s|$)', 1))"
    facts.append(fact("number", number, f"not legal and {number} <> ''"))
    top, run = _PART % 1, _PART % 2
    facts.append(fact("serial", f"{top} || '/' || {run}", f"not legal and cast({top} as integer) <= cast({run} as integer) and cast({run} as integer) >= 2"))
    return f"""with b as (select *, {_PLAIN} as p from {{back_lines}} where confidence >= 0.4), c as (select *, regexp_matches(p, '©|copyright|all rights reserved|registered trademark') as legal from b),
d as (select *, legal or len(list_filter(string_split(p, ' '), lambda x: x <> '')) <= 6 as brandish from c),
e as (select cid, line_id, text, confidence, unnest(list_transform([{", ".join(facts)}], lambda x, i: struct_pack(k := i, x := x))) as u from d)
select cid, u.x.kind as kind, u.x.value as value, text as raw, confidence from e where u.x is not null qualify row_number() over (partition by cid, u.x.kind order by confidence desc, line_id, u.k) = 1"""


@query(_evidence_sql())
def evidence_read(get):
    return layout.read_evidence(back_lines(get("captures")), "cid")


@query()
def rate_limiter(get):
    e = get("events").select(F.col("user_id").alias("client"), F.col("event_id").alias("request_id"), F.unix_millis(F.col("ts").cast("timestamp")).alias("at_ms"))
    return jobs.rate_limit(e)


_LETTERS = "lower(regexp_replace(coalesce(text, ''), '[^A-Za-zÀ-ÿ0-9]', '', 'g'))"
_SAME = """case when least(length({a}), length({b})) < 4 then false when {a} = {b} then true when least(length({a}), length({b})) >= 5 and (contains({a}, {b}) or contains({b}, {a})) then true
when greatest(length({a}), length({b})) >= 7 and 1.0::double - abs(length({a}) - length({b}))::double / greatest(length({a}), length({b})) >= 0.85 then 1.0::double - levenshtein({a}, {b})::double / greatest(length({a}), length({b})) >= 0.85 else false end"""


@query(f"""with n as (select *, {_LETTERS} as l from {{sided_names}}),
m as (select f.card_id, f.pos as fp, b.pos as bp, f.text as ft, b.text as bt, f.l as fl, b.l as bl, f.confidence as fc, b.confidence as bc, f.score as fs, b.score as bs from n f join n b using (card_id) where f.side = 'front' and b.side = 'back' and {_SAME.format(a="f.l", b="b.l")}),
h as (select *, bool_or(fp = 0 and bp = 0) over w as h00, bool_or(fp = 0 and bp = 1) over w as h01, bool_or(fp = 1 and bp = 0) over w as h10 from m window w as (partition by card_id)),
t as (select * from h where case when fp = 0 and bp = 0 then true when fp = 0 then not h00 when bp = 0 then not h00 else h00 or not (h01 or h10) end),
d as (select *, fc >= bc as surer from t),
x as (select *, case when surer then length(bl) > length(fl) and contains(bl, fl) and bc >= 0.6 else length(fl) > length(bl) and contains(fl, bl) and fc >= 0.6 end as fuller from d)
select card_id, case when surer <> fuller then ft else bt end as text, least(0.95::double, greatest(fc, bc) + 0.1::double) as confidence, greatest(fs, bs) + 0.2::double as score, true as agreed, case when surer <> fuller then 'front' else 'back' end as side from x
union all select card_id, text, confidence, score, false, side from n where not exists (select 1 from t where t.card_id = n.card_id and case when n.side = 'front' then t.fp else t.bp end = n.pos)""")
def combine_names(get):
    return merging.combine_names(get("sided_names"))


def _card_lines(get):
    """Words as lines of a card: a word of their part's name, upper-cased for every other line."""
    w = get("words").join(get("part").select(F.col("p_partkey").alias("part_id"), "p_name"), "part_id")
    y0, said = F.col("row_id") * 20.0, F.split("p_name", " ")
    return w.select("doc_id", F.col("word_id").cast("int").alias("line_id"), F.when(F.col("word_id") % 2 == 0, F.upper(said[0])).otherwise(said[1]).alias("text"), F.greatest(F.col("conf"), F.lit(0.5)).alias("confidence"), F.col("conf").alias("weakest"), F.col("h").alias("height"), F.col("x0"), y0.alias("y0"), "x1", (y0 + F.col("h")).alias("y1"))


_BELOW = ("text", "h", "confidence", "weakest", "x0", "y0", "x1", "y1")


_STACKED = f"""with l as (select doc_id, cast(word_id as integer) as line_id, case when word_id % 2 = 0 then upper(split_part(p_name, ' ', 1)) else split_part(p_name, ' ', 2) end as text, greatest(conf, 0.5) as confidence, conf as weakest, h, x0, row_id * 20.0::double as y0, x1, row_id * 20.0::double + h as y1 from {{words}} w join part on p_partkey = part_id),
n as (select *, {", ".join(f"lead({c}) over (partition by doc_id order by y0, line_id) as n_{c}" for c in _BELOW)} from l),
s as (select doc_id, line_id, text || ' ' || n_text as text, least(confidence, n_confidence) as confidence, least(weakest, n_weakest) as weakest, greatest(h, n_h) as height, least(x0, n_x0) as x0, y0, greatest(x1, n_x1) as x1, n_y1 as y1 from n
where length(text) >= 4 and length(n_text) >= 4 and abs(h - n_h) < greatest(h, n_h) * 0.45 and n_y0 - y1 < greatest(h, n_h) * 0.9 and abs(x0 - n_x0) < greatest(h, n_h) * 2.5)"""


@query(f"{_STACKED} select * from s")
def names_stacked(get):
    return layout.stacked(_card_lines(get), "doc_id")


#: Colours and things: words of one case without marks, none of them vocabulary.
_LIKELY = "case when length(replace(text, ' ', '')) < 4 then 0.0 else least(1.0::double, case when text = upper(text) then 0.7::double else 0.3::double end + case when contains(text, ' ') then 0.3::double else 0.0::double end) end"
_SIGNS = {
    "size": "greatest(0.0::double, least(1.0::double, height / 5.0::double))",
    "lettering": "greatest(0.0::double, least(1.0::double, (confidence * 0.7::double + weakest * 0.3::double - 0.4::double) / 0.4::double))",
    "likeness": _LIKELY,
    "home": "case when ((y0 + y1) / 200.0::double > 0.03 and (y0 + y1) / 200.0::double < 0.2) or ((y0 + y1) / 200.0::double > 0.7 and (y0 + y1) / 200.0::double < 0.95) then 1.0::double else 0.0::double end",
    "joined": "joined",
}


@query(f"""{_STACKED}, pool as (select doc_id, line_id, text, confidence, weakest, h as height, y0, y1, 0.0::double as joined from l union all select doc_id, line_id, text, confidence, weakest, height, y0, y1, 1.0::double from s),
r as (select *, {" + ".join(f"({x}) * {layout.NAME_SIGNS[c]}::double" for c, x in _SIGNS.items())} as score from pool where {_LIKELY} > 0 and confidence >= 0.35 and height >= 1.2),
k as (select *, cast(row_number() over (partition by doc_id order by score desc, joined, line_id) as int) as place from r) select doc_id, line_id, text, score, place from k where place <= 4""")
def names_ranked(get):
    return layout.rank_names(_card_lines(get), "doc_id", 100.0).where("place <= 4").select("doc_id", "line_id", "text", "score", "place")


@query()
def letters_spaced(get):
    w = get("words")
    return layout.space_by_gaps(w.select("doc_id", "text", "x0", "x1", F.lit(30.0).alias("line_height")))
