"""DuckDB SQL for the queries that SQL can express, and the constants both sides share."""

from __future__ import annotations

from evimatch.llm.license_texts import TEMPLATES

#: A dated list for the pages query: (kind, pattern, action, at).
URL_ENTRIES = [
    ("domain", "example.net", "add", "2024-02-01 00:00:00"),
    ("domain", "example.net", "remove", "2024-03-15 00:00:00"),
    ("domain", "example.net", "add", "2024-10-01 00:00:00"),
    ("host", "ththre.example.com", "add", "2024-01-10 00:00:00"),
    ("host", "ththre.example.com", "add", "2024-01-20 00:00:00"),
    ("host", "ththre.example.com", "remove", "2024-06-01 00:00:00"),
    ("domain", "ththth.example.net", "add", "2024-05-05 00:00:00"),
    ("prefix", "therin.example.net/en", "add", "2024-04-01 00:00:00"),
    ("prefix", "thther.example.org/en/", "add", "2024-07-01 00:00:00"),
    ("prefix", "thther.example.org/en/", "remove", "2024-07-01 00:00:00"),
    ("prefix", "tionsh.example.net/fr", "add", "2024-01-01 00:00:00"),
    ("domain", "tiontion.example.com", "add", "2024-08-08 00:00:00"),
    ("domain", "org", "add", "2024-12-01 00:00:00"),
    ("prefix", "thther.example.org/en/a/b/c/d/e/f", "add", "2024-01-01 00:00:00"),
]


#: Target weights of some sources; all others weigh 1.
MIX_WEIGHTS = {"src0": 4.0, "src1": 2.0, "src2": 0.5, "src3": 0.0}


def _values(rows: list[tuple]) -> str:
    quoted = lambda v: "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)
    return ", ".join("(" + ", ".join(map(quoted, r)) + ")" for r in rows)


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP2 = rf"""
with recursive w as (select doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') as w from documents),
g as (select doc_id, list_distinct(case when len(w) >= 4 then list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as g from w),
s as (select doc_id, len(g) as n from g),
x as (select doc_id, unnest(g) as gram from g),
rare as (select gram from x group by gram having count(*) > 1),
p as (select a.doc_id as u, b.doc_id as v, count(*) as same from x a join rare using (gram) join x b using (gram) where a.doc_id <> b.doc_id group by all),
e as (select u, v from p join s a on a.doc_id = u join s b on b.doc_id = v where 100 * same >= 80 * (a.n + b.n - same)),
r as (select doc_id, doc_id as tm from s union select r.doc_id, e.v from r join e on r.tm = e.u)
select s.doc_id, cast(s.n as bigint) as n_shingles, min(r.tm) as component_id, s.doc_id = min(r.tm) as kept
from s join r using (doc_id) group by s.doc_id, s.n
"""

OP4 = rf"""
with t(kind, pattern, action, tm) as (values {_values(URL_ENTRIES)}),
e as (select kind, case when kind = 'prefix' then regexp_replace(lower(pattern), '/+$', '') else lower(pattern) end as pattern, cast(tm as timestamp) as tm, bool_and(action = 'add') as is_on from t group by all),
turn as (select * from (select *, coalesce(lag(is_on) over (partition by kind, pattern order by tm), false) as was from e) where is_on <> was),
held as (select * from (select kind, pattern, tm as since, lead(tm) over (partition by kind, pattern order by tm) as until, is_on from turn) where is_on),
c as (select page_id, lower(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)) as host,
  lower(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1)) as path,
  timestamp '2024-01-01 00:00:00' + to_days(cast((page_id * 37) % 366 as integer)) as tm from pages),
k as (select page_id, host, path, tm, list_filter(string_split(path, '/'), lambda x: x <> '') as parts from c),
f as (select k.page_id, count(*) as n, min(h.kind || ':' || h.pattern) as matched from k join held h on k.host <> '' and k.tm >= h.since and (h.until is null or k.tm < h.until)
  and (h.kind = 'host' and h.pattern = k.host or h.kind = 'domain' and (k.host = h.pattern or ends_with(k.host, '.' || h.pattern))
  or h.kind = 'prefix' and starts_with(array_to_string(list_prepend(k.host, k.parts), '/') || '/', h.pattern || '/'))
  group by k.page_id)
select k.page_id, k.host, coalesce(f.n, 0) as n_entries, coalesce(f.matched, '') as matched, coalesce(f.n, 0) > 0 as blocked from k left join f using (page_id)
"""

OP6 = f"""
with s as (select coalesce(source, '') as source, sum(coalesce(strlen(text), 0)) as bytes from documents group by all having sum(coalesce(strlen(text), 0)) > 0),
r as (select source, cast(sum(bytes) over () as double) * (w / sum(w) over ()) / cast(bytes as double) as rate from (select *, case source {" ".join(f"when '{k}' then {v}::double" for k, v in MIX_WEIGHTS.items())} else 1.0::double end as w from s)),
k as (select source, rate, unnest(range(0, cast(ceil(rate + 12 * sqrt(rate) + 20) as bigint) + 1)) as k from r where rate > 0),
p as (select source, k, exp(-rate + k * ln(rate) - lgamma(k + 1)) as p from k),
c as (select source, k, sum(p) over (partition by source order by k) as c from p),
steps as (select source, list(c order by k) as steps from c group by source),
u as (select doc_id, text, coalesce(source, '') as source, cast(('0x' || md5('17:' || doc_id)[1:12])::bigint as double) / 281474976710656.0::double as u from documents where strlen(text) > 0),
n as (select u.*, len(list_filter(steps, lambda c: c <= u)) as n from u join steps using (source)),
x as (select doc_id, text, unnest(range(1, n + 1)) as copy_no from n where n > 0)
select doc_id, copy_no, cast(('0x' || md5('18:' || doc_id || ':' || copy_no)[1:12])::bigint as double) / 281474976710656.0::double as mix_key, cast(length(text) as bigint) as text_chars from x
"""


_WORDS = lambda text: f"list_filter(list_transform(regexp_split_to_array({text}, '[^a-z0-9.+-]+'), lambda x: regexp_replace(x, '^[.+-]+|[.+-]+$', '', 'g')), lambda x: x <> '')"

OP7 = rf"""
with t(template_id, text) as (values {_values(list(TEMPLATES.items()))}),
tw as (select template_id, {_WORDS(_LOWER)} as w from t),
ts as (select template_id, len(w) as n, greatest(1, (len(w) - 4) // 4) as hop, least(5, len(w)) as k, list_distinct(list_transform(range(1, len(w) - least(5, len(w)) + 2), lambda i: array_to_string(w[i:i + least(5, len(w)) - 1], ' '))) as grams from tw),
kin as (select a.template_id, flatten(list(b.grams)) as others from ts a join ts b on a.template_id <> b.template_id and 100 * len(list_intersect(a.grams, b.grams)) >= 80 * len(a.grams) group by all),
tt as (select ts.*, n + hop - 1 - k + 1 as span, case when others is null then [] else list_filter(grams, lambda x: not list_contains(others, x)) end as own from ts left join kin using (template_id)),
w as (select doc_id, {_WORDS(_LOWER)} as w from documents),
g as (select doc_id, k, list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' ')) as g from w, (select distinct k from tt) where len(w) >= k),
hit as (select g.doc_id, tt.template_id, tt.hop, tt.span, tt.grams, tt.own, g.g from g join tt using (k) where 100 * len(list_intersect(g.g, tt.grams)) >= 80 * len(tt.grams)),
s as (select doc_id, template_id, grams, own, span, g, unnest(generate_series(0, cast(floor((greatest(0, len(g) - span) + hop - 1) / hop) as bigint) * hop, hop)) as tm from hit),
ok as (select doc_id, template_id, tm from s where 100 * len(list_intersect(g[tm + 1:tm + span], grams)) >= 80 * len(grams) and (len(own) = 0 or list_has_any(g[tm + 1:tm + span], own)))
select doc_id, template_id, count(distinct tm) as n_windows, min(tm) as first_word from ok group by all
"""

OP8 = r"""
with w as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
x as (select doc_id, unnest(range(1, len(w) - 11)) as i, w from w where len(w) >= 13),
k as (select doc_id, i, array_to_string(w[i:i + 12], ' ') as k from x),
f as (select doc_id, i, min(doc_id) over (partition by k) as lo from k),
gone as (select doc_id, list_distinct(flatten(list(range(i, i + 13)))) as gone from f where lo < doc_id group by doc_id)
select w.doc_id, cast(len(w.w) as bigint) as n_words, cast(coalesce(len(g.gone), 0) as bigint) as n_removed,
  sha256(coalesce(array_to_string(case when g.gone is null then w.w else list_transform(list_sort(list_filter(range(1, len(w.w) + 1), lambda i: not list_contains(g.gone, i))), lambda i: w.w[i]) end, ' '), '')) as kept_sha256
from w left join gone g using (doc_id)
"""

OP10 = rf"""
with d as (select doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
b as (select item_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
bw as (select distinct item_id, least(10, len(w)) as k, unnest(list_transform(range(1, len(w) - least(10, len(w)) + 2), lambda i: array_to_string(w[i:i + least(10, len(w)) - 1], ' '))) as t from b where len(w) > 0),
dx as (select doc_id, k, unnest(range(1, len(w) - k + 2)) as i, w from d, (select distinct k from bw) where len(w) >= k),
h as (select doc_id, i, dx.k, item_id from (select doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') as t from dx) dx join bw on bw.k = dx.k and bw.t = dx.t),
c as (select doc_id, len(list_distinct(flatten(list(range(i, i + k))))) as n_hit, count(distinct item_id) as n_items, sha256(array_to_string(list_sort(list_distinct(list(cast(item_id as varchar)))), ',')) as s from h group by doc_id)
select d.doc_id, cast(len(d.w) as bigint) as n_words, cast(coalesce(c.n_hit, 0) as bigint) as n_hit, coalesce(c.n_items, 0) as n_items, coalesce(c.s, sha256('')) as items_sha256, coalesce(c.n_hit, 0) > 0 as contaminated
from d left join c using (doc_id)
"""

OP12 = """
with v as (select vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as x from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select a.vec_id as query_id, b.vec_id as vec_id, list_sum(list_transform(range(1, len(a.x) + 1), lambda i: a.x[i] * b.x[i])) as score from v a join v b on a.vec_id <> b.vec_id where a.vec_id % 50 = 0)
select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank, vec_id, cast(score as bigint) as score from s
qualify row_number() over (partition by query_id order by score desc, vec_id) <= 5
"""

OP13 = rf"""
with d as (select row_number() over () as r, coalesce(lang, '') as lang, coalesce(source, '') as source, regexp_extract_all({_LOWER}, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') as w from documents),
x as (select r, lang, source, unnest(w) as term from d),
c as (select lang, source, term, count(*) as n from x group by all),
k as (select lang, term from x group by all having count(distinct r) >= 30),
g as (select distinct lang, source from d),
s as (select g.lang, g.source, k.term, coalesce(c.n, 0) as n from g join k on k.lang = g.lang left join c on c.lang = g.lang and c.source = g.source and c.term = k.term),
p as (select lang, source, term, n, 1 + (1000000000::hugeint * (n + 5)) // (sum(n) over (partition by lang, source) + 5 * count(*) over (partition by lang, source)) as p from s),
q as (select lang, term, 1 + (1000000000::hugeint * (n + 5)) // (sum(n) over (partition by lang) + 5 * count(*) over (partition by lang)) as q from (select lang, term, sum(n) as n from s group by all)),
a as (select x.lang, x.source, y.source as item, sum(abs(x.p - y.p)) as value from p x join p y on y.lang = x.lang and y.term = x.term and y.source <> x.source group by all),
r as (select x.lang, x.source, 'pair' as part, y.source as item, coalesce(a.value, 0) as value from g x join g y on y.lang = x.lang and y.source <> x.source left join a on a.lang = x.lang and a.source = x.source and a.item = y.source
  union all select p.lang, p.source, 'term', p.term, p.p - q.q from p join q on q.lang = p.lang and q.term = p.term where p.n > 0 and p.p > q.q)
select lang, source, part, item, cast(value as bigint) as value, cast(row_number() over (partition by lang, source, part order by value desc, item) as integer) as rank from r
qualify part = 'pair' or row_number() over (partition by lang, source, part order by value desc, item) <= 50
"""

ORACLES = {"op2_near_duplicates": OP2, "op4_url_lists": OP4, "op6_mixing": OP6, "op7_license_scan": OP7, "op8_repeated_passages": OP8, "op10_contamination": OP10, "op12_top_k": OP12, "op13_divergence": OP13}
