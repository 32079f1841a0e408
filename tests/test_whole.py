"""Queries over all their rows, against SQL without any row or text limit."""

import os
import random

import duckdb
import pytest

from evimatch.operators import catalog, jobs, merging
from evimatch.plans import catalogue
from evimatch.plans.matching import _ROUTE1, _SATISFIED
from evimatch.plans.registry import fold_sql, similarity_sql
from evimatch.plans.views import BASE, expand

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in BASE:
        if os.path.exists(f"{SF}/{t}.parquet"):
            c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def _same(spark, duck, name, sql):
    got, want = catalogue.QUERIES[name](spark, SF), duck.execute(expand(sql))
    columns = [d[0] for d in want.description]
    assert sorted(map(repr, (tuple(r) for r in got.select(*columns).collect()))) == sorted(map(repr, want.fetchall()))


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_prefer_language_judges_all_cards(spark, duck):
    _same(spark, duck, "prefer_language", "select set_name, id, language from (select *, max(case when language = 'de' then 1 else 0 end) over (partition by set_name) as hit from {ref_cards}) where hit = 0 or language = 'de'")


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_set_enrichment_takes_all_sets(spark, duck):
    _same(spark, duck, "set_enrichment", "select c.id, c.name, c.num || '/' || s.total as number, s.released as year from {ref_cards} c left join {ref_sets} s using (set_name)")


def test_name_search_finds_names_inside_names_and_cut_names(spark):
    cards = spark.createDataFrame([(1, "cold plate", 4, 60), (2, "plate", 9, 60), (3, "Dialga", 7, 90), (4, "dialga ex", 8, 90), (5, "late", 1, 10)], "id long, name string, num int, hp int")
    asked = spark.createDataFrame([(1, "old plate", 4, 60), (2, "Dialgawes", 7, None), (3, "Dialgawes", 5, None), (4, "Dialgaxy", None, None), (5, "plate", 3, 60), (6, "Dialga exqqqq", None, None)], "cid long, name string, num int, hp int")
    got = {(r.cid, r.id, r.tier) for r in catalog.name_tiers(asked, cards).collect()}
    assert got == {(1, 1, 1), (2, 3, 7), (4, 3, 6), (4, 4, 6), (5, 1, 3), (5, 2, 3)}


_SEARCH = f"""p as (select q.cid, q.num as q_num, q.hp as q_hp, q.f as q, c.f as c, c.id, c.num, c.hp from (select *, {fold_sql("name")} as f from captures_) q join (select *, {fold_sql("name")} as f from {{ref_cards}}) c on contains(c.f, left(q.f, 4)) where length(regexp_replace(q.f, '[^a-z]', '', 'g')) >= 4),
k as (select *, case when contains(c, q) then 0 when length(q) >= 6 and contains(c, left(q, length(q) - 1)) then 1 when length(q) >= 7 and contains(c, left(q, length(q) - 2)) then 2 when length(q) >= 8 and contains(c, left(q, length(q) - 3)) then 3 end as cut from p),
hit as (select *, case when cut > 0 then case when q_num is null or num = q_num then 4 + cut end when cut = 0 then case when num = q_num and hp = q_hp then 1 when num = q_num then 2 when hp = q_hp then 3 else 4 end end as tier, left(q, length(q) - cut) as t from k),
least as (select cid, id, tier, {similarity_sql("c", "t")} as close, min(tier) over (partition by cid) as low from hit where tier is not null),
two as (select cid, id, tier from (select *, row_number() over (partition by cid order by close desc, id) as k from least where tier = low) where k <= 8)"""


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_route_relaxation_over_whole_names(spark, duck):
    _same(spark, duck, "route_relaxation", f"with captures_ as (select * from {{captures}}), {_SEARCH} select cid, id, tier from two")


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_route_union_over_whole_names(spark, duck):
    one = f"with {_ROUTE1}, {_SATISFIED}, captures_ as (select * from {{captures}} where cid not in (select cid from sat)), {_SEARCH}"
    _same(spark, duck, "route_union_dedupe", f"{one} select cid, id, cast(min(route) as integer) as route from (select cid, id, 1 as route from one union all select cid, id, 2 as route from two) group by cid, id")


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_evidence_merge_gives_whole_texts(spark, duck):
    e = "select conv_id, case when turn % 3 = 0 then 'name' else 'year' end as kind, text as value, cast(length(text) % 100 as double) / 100.0::double as confidence, turn % 5 = 1 as inferred, case when role = 'user' then 'front' else 'back' end as side from conversations"
    o = f"select *, row_number() over (partition by conv_id, kind order by not inferred desc, confidence desc, side = 'front' desc, value desc) as k from ({e})"
    _same(spark, duck, "evidence_merge", f"select conv_id, kind, value, confidence, side from ({o}) where k = 1")


def test_combine_names_compares_whole_texts(spark, tmp_path):
    start = "The same long beginning of "
    turns = [(1, 0, "user", start + "one story about rivers"), (1, 1, "assistant", start + "another tale, with quite different words"), (2, 0, "user", start + "a third story"), (2, 1, "assistant", start + "a third  story!")]
    spark.createDataFrame(turns, "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {(r.card_id, r.text, r.agreed) for r in catalogue.QUERIES["combine_names"](spark, str(tmp_path)).collect()}
    assert {(i, agreed) for i, _, agreed in got} == {(1, False), (2, True)} and {x for i, x, _ in got if i == 1} == {turns[0][3], turns[1][3]}


def test_names_of_both_sides_are_joined_one_to_one(spark):
    rng = random.Random(6)
    people = ["JORDAN ELLIS", "JORDANELLIS", "JORDAN ELLI", "ELLIS", "BRAY WYATT", "BRAY WATT", "ZARA HOLLIS", "ABC", "HOLLIS"]
    rows = [(card, side, pos, rng.choice(people), rng.randrange(100) / 100, rng.randrange(100) / 100) for card in range(60) for side in ("front", "back") for pos in range(rng.randrange(5))]

    def letters(s):
        return "".join(c for c in s if c.isalnum()).lower()

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            above, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                above, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, above + (x != y))
        return row[-1]

    def same(a, b):
        x, y = sorted((letters(a), letters(b)), key=len)
        return len(x) >= 4 and (x == y or len(x) >= 5 and x in y or len(y) >= 7 and 1 - edits(x, y) / len(y) >= 0.85)

    want = []
    for card in range(60):
        free = [r for r in rows if r[:2] == (card, "back")]
        for a in (r for r in rows if r[:2] == (card, "front")):
            b = next((b for b in free if same(a[3], b[3])), None)
            if b is None:
                want.append((card, a[3], a[4], a[5], False, "front"))
                continue
            free.remove(b)
            best, other = (a, b) if a[4] >= b[4] else (b, a)
            if len(letters(other[3])) > len(letters(best[3])) and letters(best[3]) in letters(other[3]) and other[4] >= 0.6:
                best = other
            want.append((card, best[3], min(0.95, max(a[4], b[4]) + 0.1), max(a[5], b[5]) + 0.2, True, best[1]))
        want += [(card, b[3], b[4], b[5], False, "back") for b in free]
    frame = merging.combine_names(spark.createDataFrame(rows, "card_id long, side string, pos int, text string, confidence double, score double"))
    plain = lambda r: (r[0], r[1], round(r[2], 9), round(r[3], 9), r[4], r[5])
    assert sorted(map(plain, frame.collect())) == sorted(map(plain, want))
    assert "InPandas" not in frame._jdf.queryExecution().toString()


def test_rate_limit_by_blocks_equals_the_bucket(spark):
    rng, rows = random.Random(8), []
    for client in (1, 2, 3, None):
        at = 0
        for k in range(400):
            at += rng.choice([0, 0, 1, 50, 300, 400, 1500, 90_000 if k % 50 == 0 else 10])
            rows.append((client, 1000 - k, at))
    rows += [(3, 5000 + k, 10_000_000) for k in range(300)] + [(4, 1, None), (4, 2, 7)]
    want = {(4, 1): None, (4, 2): 0.0}
    for client in (1, 2, 3, None):
        tokens, last, free = 12.0, None, 0.0
        for at, i in sorted((r[2], r[1]) for r in rows if r[0] == client):
            now = max(float(at), free)
            tokens = tokens if last is None else min(12.0, tokens + (now - last) * 3 / 1000)
            wait = 0.0 if tokens >= 1 else (1 - tokens) / 3 * 1000
            tokens, last = tokens + wait * 3 / 1000 - 1, now + wait
            free = last
            want[client, i] = free - at
    frame = jobs.rate_limit(spark.createDataFrame(rows, "client long, request_id long, at_ms long"))
    got = {(r.client, r.request_id): r.wait_ms for r in frame.collect()}
    assert got.keys() == want.keys() and len(got) == len(rows)
    assert all(want[k] is None and got[k] is None or abs(got[k] - want[k]) < 1e-6 for k in want) and max(w or 0 for w in want.values()) > 60_000
    plan = frame._jdf.queryExecution().toString()
    assert "InPandas" not in plan


def test_second_opinion(spark):
    rows = [
        ("outdone", 0, "located", 0.95, 0.05, False), ("outdone", 1, "whole-frame", 0.92, 0.2, True),
        ("ended", 0, "located", 0.91, 0.2, False), ("ended", 1, "whole-frame", 0.99, 0.2, True),
        ("turned", 0, "located", 0.2, 0.0, False), ("turned", 1, "whole-frame", 0.1, 0.0, False), ("turned", 2, "turned-around", 0.3, 0.0, True),
        ("as sure", 0, "located", 0.3, 0.0, False), ("as sure", 2, "turned-around", 0.3, 0.0, True),
        ("signal", 0, "located", 0.2, 0.0, True), ("signal", 2, "turned-around", 0.9, 0.5, True),
        ("nowhere", 0, "whole-frame", 0.2, 0.0, False), ("nowhere", 2, "turned-around", 0.9, 0.5, True),
    ]
    framings = spark.createDataFrame(rows, "card string, ordinal int, framing string, confidence double, margin double, has_signal boolean")
    got = {r.card: r.framing for r in merging.second_opinion(framings, "card").collect()}
    assert got == {"outdone": "located", "ended": "located", "turned": "turned-around", "as sure": "located", "signal": "located", "nowhere": "whole-frame"}
    assert merging.second_opinion(framings.limit(0), "card").count() == 0
