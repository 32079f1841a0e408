"""What the review of round 4 found."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from evimatch.operators import jobs
from evimatch.plans import catalogue


def _same_as_sql(spark, sf_dir, name, *tables):
    """Rows of a query, compared with its SQL over tables written to sf_dir."""
    c = duckdb.connect()
    c.execute("set timezone='UTC'")
    for t in tables:
        c.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet/*.parquet'")
    want = c.execute(catalogue.ORACLES[name])
    columns = [d[0] for d in want.description]
    plain = lambda r: repr([round(v, 9) if isinstance(v, float) else v for v in r])
    got = sorted(map(plain, catalogue.QUERIES[name](spark, str(sf_dir)).select(*columns).collect()))
    assert got == sorted(map(plain, want.fetchall()))
    return got


@pytest.fixture(scope="module")
def balances(spark, tmp_path_factory):
    """Customers whose balances print with a sign on zero, an exponent or many digits."""
    at = tmp_path_factory.mktemp("balances")
    rows = [(i, f"Customer#{i}", i % 25, x, "MACHINERY") for i, x in enumerate([-0.0, 0.0, 12345678.9, 1e-4, 0.125, 7.0, 711.56, -0.01, -999.5])]
    spark.createDataFrame(rows, "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string").write.parquet(f"{at}/customer.parquet")
    return at


def test_template_issues_of_any_balance(spark, balances):
    got = _same_as_sql(spark, balances, "template_issues", "customer")
    assert sum("Start price" in r for r in got) == 2


def test_template_summary_of_any_balance(spark, balances):
    got = _same_as_sql(spark, balances, "template_summary", "customer")
    assert "['warning', 'Start price', 2]" in got


def _shuffled(df) -> int:
    """Rows that a query's run wrote to shuffles."""

    def walk(node) -> int:
        kind, kids = node.getClass().getSimpleName(), node.children()
        below = [node.executedPlan()] if kind == "AdaptiveSparkPlanExec" else [node.plan()] if kind.endswith("QueryStageExec") else [kids.apply(i) for i in range(kids.size())]
        rows = node.metrics().get("shuffleRecordsWritten")
        return (rows.get().value() if rows.isDefined() else 0) + sum(map(walk, below))

    return walk(df._jdf.queryExecution().executedPlan())


def _log(seed: int, n_jobs: int, n_events: int, n_controls: int, seconds: int):
    """A log and controls of three queues, some told twice, some at one time, some without a time."""
    rng = random.Random(seed)
    when = lambda: rng.randrange(seconds) if rng.random() > 0.02 else None
    log = [(j % 3, j, 0, j, "added", None) for j in range(n_jobs)]
    for i in range(n_events):
        j = rng.randrange(n_jobs)
        log.append((j % 3, j, when(), n_jobs + i, rng.choice(["started", "started", "started", "done", "failed", "failed", "retry", "added"]), rng.choice([True, True, False, None])))
    controls = [(rng.randrange(4), when(), 10_000_000 + i, rng.choice(["pause", "resume", "resume", "cancel", "run", "run", "retry failed", "retry failed"])) for i in range(n_controls)]
    return log + log[::7], controls + controls[::5]


def _frames(spark, log, controls):
    dated = lambda df: df.withColumn("ts", F.timestamp_seconds(F.col("ts") + 1_700_000_000))
    return dated(spark.createDataFrame(log, "queue int, job_id long, ts long, event_id long, action string, retryable boolean")), dated(spark.createDataFrame(controls, "queue int, ts long, event_id long, action string"))


@pytest.mark.parametrize(("seed", "seconds"), [(1, 60), (2, 50_000), (3, 400_000)])
def test_queues_told_of_once_as_if_each_job_was(spark, seed, seconds):
    log, controls = _frames(spark, *_log(seed, 60, 900, 240, seconds))
    want = sorted(map(tuple, jobs.reduce_log(jobs.with_queue(log, controls)).collect()))
    assert len({w[1] for w in want}) > 3
    assert sorted(map(tuple, jobs.reduce_queues(log, controls).collect())) == want
    none = controls.limit(0)
    assert sorted(map(tuple, jobs.reduce_queues(log, none).collect())) == sorted(map(tuple, jobs.reduce_log(log).collect()))


def test_job_states_do_not_grow_with_jobs_times_controls(spark, tmp_path):
    """800 jobs of ten queues and 4000 controls: 320000 pairs."""
    kinds = ["signup", "view", "purchase", "error", "click"]
    rows = [(i, 1_700_000_000 + i * 37 % 90_000, i * 7919 // 5 % 800, kinds[i % 5] if i < 8000 else "click") for i in range(12000)]
    spark.createDataFrame(rows, "event_id long, ts long, user_id long, event_type string").withColumn("ts", F.timestamp_seconds("ts").cast("timestamp_ntz")).write.parquet(f"{tmp_path}/events.parquet")
    df = catalogue.QUERIES["job_states"](spark, str(tmp_path))
    assert len(df.collect()) == 800
    assert _shuffled(df) < 60_000


def test_evidence_reads_captures_once_and_every_name(spark, tmp_path):
    """Each name between the marks that may part it, against its pattern in Python; the query's own plan reads orders once."""
    import re

    from evimatch.functions import vocabulary as v
    from evimatch.operators import layout

    names = [("manufacturer", x) for x in v.MANUFACTURERS] + [("product", x) for x in v.PRODUCTS] + [("league", x) for x in v.LEAGUES] + [("finish", x) for x in v.FINISHES]
    lines = [f.format(x.replace(" ", sep), x.replace("-", sep)) for _, x in names for sep in " -" for f in ("{0}", "© {1}, ltd", "x{0} y", "Été {1}. {1}", "a b c d e f g {0}", "©{1}\t –  {1}!")]
    rows = [(i, 0, x, 0.8) for i, x in enumerate(lines)]
    got = {(r.card, r.kind): r.value for r in layout.read_evidence(spark.createDataFrame(rows, "card int, line_id int, text string, confidence double"), "card").collect()}
    ends = {"manufacturer": ("(^|[ ©])", "($|[ ,.])"), "product": ("(^|[ ©])", "($|[ ,.])"), "league": ("(^| )", "( |$)"), "finish": ("(^| )", "( |$)")}
    plain = lambda x: re.sub(r"\s+", " ", re.sub(r"[^a-z0-9&'.\- ©#/]+", " ", x.lower().replace("é", "e"))).strip()
    want = {}
    for i, x in enumerate(lines):
        p = plain(x)
        brandish = len([w for w in p.split(" ") if w]) <= 6 or "©" in p
        for kind, name in names:
            said = re.sub("[- ]", "[- ]", name.lower()) if kind == "manufacturer" else re.escape(name.lower())
            if (brandish or kind in ("league", "finish")) and re.search(ends[kind][0] + said + ends[kind][1], p):
                want.setdefault((i, kind), name)
    assert {k: x for k, x in got.items() if k[1] in ends} == want
    tables = {"orders": "1L as o_orderkey, 1L as o_custkey, 'P' as o_orderstatus, '5-LOW' as o_orderpriority", "part": "1L as p_partkey, 'big red' as p_name, 'Brand#1' as p_brand, 'ECONOMY' as p_type, 7 as p_size"}
    for name, row in tables.items():
        spark.sql(f"select {row}").write.parquet(f"{tmp_path}/{name}.parquet")
    plan = catalogue.QUERIES["evidence_read"](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [o_orderkey") == 1


def test_words_alone_are_not_dealt_again(spark):
    """Pages of words apart from one another, on one page in ten two readings of one word: only these words meet."""
    from evimatch.operators import layout

    rows = [(d, w, f"Word{w}", 0.9, 300.0 * w, 0.0, 300.0 * w + 90, 20.0) for d in range(1000) for w in range(10)]
    rows += [(d, 10, "Wrd3", 0.5, 905.0, 1.0, 985.0, 19.0) for d in range(0, 1000, 10)]
    words = spark.createDataFrame(rows, "doc_id int, word_id int, text string, conf double, x0 double, y0 double, x1 double, y1 double")
    lines = layout.words_to_lines(words)
    got = lines.collect()
    assert sorted((r.doc_id, r.text) for r in got) == sorted((d, f"Word{w}") for d in range(1000) for w in range(10))
    assert _shuffled(lines) < 4 * len(rows)
    assert _shuffled(layout.same_place(words, "doc_id")) == 0  # not run yet
    pairs = layout.same_place(words, "doc_id")
    assert len(pairs.collect()) == 100 and _shuffled(pairs) < 2 * len(rows)


def test_name_words_by_one_pattern(spark):
    """Signals fold a text once, and one pattern says what four said of a word."""
    from evimatch.functions import text as t
    from evimatch.operators import assembly

    words = [(w,) for w in "ex Gx v Vmax Mr. dr. Jr mew Muk Ho-oh basic Basic Pokémon POKÉMON hp Abc abcd Ab.d -abc É Éabc a’bc O'Neil ex. prime stars basicx niveau x1y2 ab12".split()] + [("ex\n",), ("",), ("abcd ",)]
    w = F.col("w")
    four = w.rlike(t._WORD) & ~w.rlike(t._LABEL) & ((F.length(w) >= 4) | w.rlike(t._SUFFIX) | w.rlike(t._TITLE) | w.rlike(t._SHORT))
    told = spark.createDataFrame(words, "w string").where((four != w.rlike(t._TOKEN)) | ((w.rlike(t._SUFFIX) | w.rlike(t._TITLE)) != w.rlike(t._ADDED)))
    assert told.collect() == []
    strips = spark.createDataFrame([(1, "a")], "card_id int, text string")
    plan = assembly.signals(strips, spark.createDataFrame([(9,)], "total int"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("translate(") <= 2  # of the text folded, and of digits repaired
