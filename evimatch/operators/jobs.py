"""Analysing a job log: states, time left, breakers, restarts, legal life cycles, pacing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evimatch.functions.text import let
from evimatch.functions.vocabulary import TRANSITIONS

MAX_ATTEMPTS = 3
#: What a job's log and its queue's can say.
JOB_ACTIONS, QUEUE_ACTIONS = ("added", "started", "done", "failed", "retry"), ("pause", "resume", "cancel", "retry failed", "run")
JOB = "struct<state:string,attempts:int,paused:boolean,cancelled:boolean,passed:int>"


def stats(log: DataFrame, key: str, order: str) -> DataFrame:
    """Jobs by their latest state."""
    last = log.groupBy(key).agg(F.max_by("state", order).alias("state"))
    return last.groupBy("state").agg(F.count("*").alias("n"))


def eta(done: DataFrame, key: str, order: list[str], ms: str, remaining: str, concurrency: int = 3, last: int = 20) -> DataFrame:
    """Milliseconds left: remaining times the mean of the last completions over the concurrency, rounded half up, in whole numbers."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(1 - last, 0)
    n = F.count(ms).over(w) * max(1, concurrency)
    total = F.sum(ms).over(w) * F.col(remaining)
    return done.withColumn("eta_ms", F.expr("bigint(0)") + F.floor((total * 2 + n) / (n * 2)).cast("bigint"))


def failure_runs(log: DataFrame, key: str, order: list[str], failed: str) -> DataFrame:
    """Failures in a row up to each event: the events since the last success, counted."""
    w = Window.partitionBy(key).orderBy(*order)
    island = log.withColumn("island", F.sum(F.when(F.col(failed), 0).otherwise(1)).over(w))
    run = Window.partitionBy(key, "island").orderBy(*order)
    return island.withColumn("run", F.sum(F.when(F.col(failed), 1).otherwise(0)).over(run)).drop("island")


def breakers(log: DataFrame, key: str, order: list[str], failed: str, threshold: int = 8) -> DataFrame:
    """Per key: the longest run of failures and whether the breaker opened."""
    runs = failure_runs(log, key, order, failed)
    return runs.groupBy(key).agg(F.max("run").alias("longest"), (F.max("run") >= threshold).alias("opened"))


def restore(log: DataFrame, key: str, order: str) -> DataFrame:
    """Latest state of each job after a crash: what was running is queued again."""
    last = log.groupBy(key).agg(F.max_by("state", order).alias("state"))
    return last.withColumn("state", F.when(F.col("state") == "RUNNING", "QUEUED").otherwise(F.col("state")))


def new_job() -> Column:
    """A job nothing has been said of: no state, no attempts, its queue neither paused nor cancelled, no event passed over."""
    return F.expr("named_struct('state', cast(null as string), 'attempts', 0, 'paused', false, 'cancelled', false, 'passed', 0)").cast(JOB)


def next_job(job: Column, event: Column, most: int = MAX_ATTEMPTS) -> Column:
    """A job after an event (struct with action and retryable).  An event that the job's state has no use for is passed over and counted.

    A job is added once, starts while it is queued and its queue neither paused nor cancelled, and comes back to the queue after a failure
    that may be tried again, up to ``most`` attempts and not in a cancelled queue.  Cancelling a queue ends what is queued, not what runs;
    running it anew lifts a pause and a cancellation.  A retry takes a failed or cancelled job, one of the whole queue only failed ones.
    """
    state, does = F.coalesce(job["state"], F.lit("")), event["action"]
    again = (job["attempts"] < most) & F.coalesce(event["retryable"], F.lit(True)) & ~job["cancelled"]
    moves = [
        ((does == "added") & (state == ""), F.lit("QUEUED"), F.lit(0)),
        ((does == "started") & (state == "QUEUED") & ~job["paused"] & ~job["cancelled"], F.lit("RUNNING"), job["attempts"] + 1),
        ((does == "done") & (state == "RUNNING"), F.lit("SUCCEEDED"), job["attempts"]),
        ((does == "failed") & (state == "RUNNING"), F.when(again, "QUEUED").otherwise("FAILED"), job["attempts"]),
        ((does == "retry") & state.isin("FAILED", "CANCELLED"), F.lit("QUEUED"), F.lit(0)),
        ((does == "retry failed") & (state == "FAILED"), F.lit("QUEUED"), F.lit(0)),
        ((does == "cancel") & (state == "QUEUED"), F.lit("CANCELLED"), job["attempts"]),
    ]
    to = F.when(F.lit(False), F.struct(job["state"].alias("state"), job["attempts"].alias("attempts")))
    for when, then, attempts in moves:
        to = to.when(when, F.struct(then.alias("state"), attempts.alias("attempts")))
    lifted = does.isin("run", "resume")
    return let(
        to,
        lambda x: F.struct(
            F.coalesce(x["state"], job["state"]).alias("state"),
            F.coalesce(x["attempts"], job["attempts"]).alias("attempts"),
            F.when(does == "pause", True).when(lifted, False).otherwise(job["paused"]).alias("paused"),
            F.when(does == "cancel", True).when(does == "run", False).otherwise(job["cancelled"]).alias("cancelled"),
            (job["passed"] + (x.isNull() & ~does.isin(*QUEUE_ACTIONS)).cast("int")).alias("passed"),
        ),
    )


def with_queue(log: DataFrame, controls: DataFrame) -> DataFrame:
    """A job log (queue, job_id, ts, event_id, action, retryable) with what was said to each job's queue (queue, ts, event_id, action).

    A control reaches the jobs that its queue has been told of at any time; jobs meet controls by queue.  That is jobs times controls, as a
    stream of single jobs needs them; reduce_queues() gives the same states without it.
    """
    jobs_of = log.select("queue", "job_id").distinct()
    said = jobs_of.join(controls.select("queue", "ts", "event_id", "action"), "queue")
    return log.select("queue", "job_id", "ts", "event_id", "action", "retryable").unionByName(said.withColumn("retryable", F.lit(None).cast("boolean")))


def _when() -> list[Column]:
    """What events are ordered by; those without a time come last."""
    return [F.col("ts").isNull().alias("undated"), F.col("ts"), F.col("event_id")]


def reduce_log(log: DataFrame, most: int = MAX_ATTEMPTS) -> DataFrame:
    """job_id, state, attempts, paused, cancelled, passed of a log (job_id, ts, event_id, action, retryable) in any order.

    Events count in the order of ts and event_id, a repeated event_id once.  A job's events, a handful for each attempt, are folded in
    the aggregation that brings them together.
    """
    event = F.struct(*_when(), "action", "retryable")
    whole = log.dropDuplicates(["job_id", "event_id"]).groupBy("job_id").agg(F.array_sort(F.collect_list(event)).alias("events"))
    return whole.select("job_id", F.aggregate("events", new_job(), lambda j, e: next_job(j, e, most).cast(JOB)).alias("j")).select("job_id", "j.*")


#: Seconds of a block of a queue's time in reduce_queues, and the block of events without a time.
QUEUE_BLOCK, UNDATED = 3600, 2**62
#: What a queue was told up to a moment: cancels, retries of all that failed, how many of these came before the last cancel, and its state.
_TOLD = ("cancels", "retries", "undone", "paused", "cancelled")


def _heard(log: DataFrame, controls: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The log with _TOLD as of each event, and _TOLD as of the end of each queue.

    Both are counted within blocks of a queue's time and carried from block to block, so a queue's events are never brought together.
    """
    columns = ["queue", "job_id", "ts", "event_id", "action", "retryable"]
    own = log.select(*columns, F.lit(False).alias("control"))
    said = controls.where("queue is not null").dropDuplicates(["queue", "event_id"])
    block = F.coalesce(F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / (QUEUE_BLOCK * 1_000_000)), F.lit(UNDATED))
    every = own.unionByName(said.select("queue", "ts", "event_id", "action", F.lit(True).alias("control")), allowMissingColumns=True).withColumn("block", block)

    order = Window.partitionBy("queue", "block").orderBy(F.asc_nulls_last("ts"), "event_id", "control").rowsBetween(Window.unboundedPreceding, 0)
    is_ = lambda *actions: F.col("control") & F.col("action").isin(*actions)
    placed = every.withColumns({
        "cancels": F.sum(is_("cancel").cast("long")).over(order), "retries": F.sum(is_("retry failed").cast("long")).over(order),
        "paused": F.last(F.when(is_("pause"), True).when(is_("run", "resume"), False), True).over(order), "cancelled": F.last(F.when(is_("cancel"), True).when(is_("run"), False), True).over(order),
    }).withColumn("undone", F.max(F.when(is_("cancel"), F.col("retries"))).over(order))
    at = F.struct(*_when(), "control")
    blocks = placed.groupBy("queue", "block").agg(*[F.max(c).alias(c) for c in ("cancels", "retries", "undone")], *[F.max_by(c, at).alias(c) for c in ("paused", "cancelled")])

    earlier = Window.partitionBy("queue").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    nought = {"cancels": F.lit(0), "retries": F.lit(0), "undone": F.lit(0), "paused": F.lit(False), "cancelled": F.lit(False)}
    carried = blocks.withColumn("undone", F.col("undone") + F.coalesce(F.sum("retries").over(earlier), F.lit(0)))
    so_far = {"cancels": F.sum("cancels"), "retries": F.sum("retries"), "undone": F.max("undone"), "paused": F.last("paused", True), "cancelled": F.last("cancelled", True)}
    begun = carried.select("queue", "block", *[F.coalesce(f.over(earlier), nought[c]).alias(f"b_{c}") for c, f in so_far.items()])
    latest = {c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("block"))) if c in ("paused", "cancelled") else f for c, f in so_far.items()}
    end = carried.groupBy("queue").agg(*[F.coalesce(f, nought[c]).alias(c) for c, f in latest.items()])

    both = placed.where("not control").join(begun, ["queue", "block"], "left")
    before = lambda c: F.coalesce(F.col(f"b_{c}"), nought[c])
    told = {"cancels": F.col("cancels") + before("cancels"), "retries": F.col("retries") + before("retries"), "undone": F.greatest(before("undone"), F.col("undone") + before("retries")), "paused": F.coalesce("paused", before("paused")), "cancelled": F.coalesce("cancelled", before("cancelled"))}
    return both.select(*columns, *[c.alias(k) for k, c in told.items()]), end


def reduce_queues(log: DataFrame, controls: DataFrame, most: int = MAX_ATTEMPTS) -> DataFrame:
    """reduce_log() of a log (queue, job_id, ts, event_id, action, retryable) under what was said to the queues (queue, ts, event_id, action).

    A job is of one queue.  Controls do not meet jobs: an event knows how many cancels and retries its queue had been told of before it.
    Between two events of a job a cancel ends it if it was queued; a retry takes it back if it had failed, and a cancel then ends it if it
    came after the first of these retries, that is if the last cancel has seen more retries than the job's event before.
    """
    heard, end = _heard(log, controls)
    event = F.struct(*_when(), "action", "retryable", *_TOLD)
    once = heard.repartition("queue", "job_id").dropDuplicates(["queue", "job_id", "event_id"])
    whole = once.groupBy("queue", "job_id").agg(F.array_sort(F.collect_list(event)).alias("events")).join(end.select("queue", F.struct(*_TOLD).alias("end")), "queue", "left")

    def hear(a: Column, told: Column) -> Column:
        """The job of a after what its queue was told up to told."""
        j = a["job"]
        retried = (j["state"] == "FAILED") & (told["retries"] > a["retries"])
        ended = (retried & (told["undone"] > a["retries"])) | ((j["state"] == "QUEUED") & (told["cancels"] > a["cancels"]))
        state = F.when(ended, "CANCELLED").when(retried, "QUEUED").otherwise(j["state"])
        return F.struct(state.alias("state"), F.when(retried, 0).otherwise(j["attempts"]).alias("attempts"), told["paused"].alias("paused"), told["cancelled"].alias("cancelled"), j["passed"].alias("passed")).cast(JOB)

    kind = f"struct<job:{JOB},cancels:bigint,retries:bigint>"
    start = F.struct(new_job().alias("job"), F.lit(0).alias("cancels"), F.lit(0).alias("retries")).cast(kind)
    step = lambda a, e: F.struct(let(hear(a, e), lambda j: next_job(j, e, most)).alias("job"), e["cancels"].alias("cancels"), e["retries"].alias("retries")).cast(kind)
    last = let(F.aggregate("events", start, step), lambda a: F.when(F.col("end").isNull(), a["job"]).otherwise(hear(a, F.col("end"))))
    return whole.select("job_id", last.alias("j")).select("job_id", "j.*")


def backoff_bounds(attempt: Column, base: int = 400, cap: int = 8000) -> tuple[Column, Column]:
    """Least and most milliseconds before the next attempt."""
    top = F.least(F.lit(float(cap)), F.lit(float(base)) * F.pow(F.lit(2.0), attempt - 1))
    return top / 2, top


def illegal_moves(log: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Moves between states that no edge of the life cycle allows."""
    edges = log.sparkSession.createDataFrame(TRANSITIONS, "was string, state string")  # 18 rows
    moves = log.withColumn("was", F.lag("state").over(Window.partitionBy(key).orderBy(*order))).where("was is not null")
    return moves.join(F.broadcast(edges), ["was", "state"], "left_anti")


#: Milliseconds of a block of requests in rate_limit.
PACE_BLOCK = 60_000


def rate_limit(requests: DataFrame, rate: float = 3.0, burst: int = 12) -> DataFrame:
    """requests (client, request_id, at_ms) -> wait_ms under a token bucket of each client, served in order.

    With i the place of a request from 0, the bucket is spent until V(i) = (i + 1) / rate + the largest at(j) - j / rate up to i, and
    the wait is V(i) - burst / rate - at(i), if above 0.  Counts and largest values are taken by block of time and then carried from
    block to block, so a client's requests are never brought together.  Requests without a time come last and have no wait.
    """
    at = F.col("at_ms")
    own = requests.select(F.col("client").cast("long").alias("client"), F.col("request_id").cast("long").alias("request_id"), "at_ms", F.floor(at / PACE_BLOCK).alias("block"))
    order = Window.partitionBy("client", "block").orderBy(at.asc_nulls_last(), "request_id")
    placed = own.withColumn("i", (F.row_number().over(order) - 1).cast("long"))
    # in requests times milliseconds, so whole rates give whole numbers
    placed = placed.withColumn("lead", at * F.lit(rate) - F.col("i") * 1000)
    sums = placed.groupBy("client", "block").agg(F.count("*").alias("n"), F.max("lead").alias("most"))
    before = Window.partitionBy("client").orderBy(F.col("block").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0)))
    carried = sums.withColumn("earlier", F.max(F.col("most") - F.col("start") * 1000).over(before))
    carried = carried.select(F.col("client").alias("c"), F.col("block").alias("b"), "start", "earlier")
    so_far = placed.withColumn("most", F.max("lead").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    both = so_far.join(carried, F.col("client").eqNullSafe(F.col("c")) & F.col("block").eqNullSafe(F.col("b")))
    most = F.greatest(F.col("most") - F.col("start") * 1000, F.col("earlier"))
    spent = (F.col("start") + F.col("i") + (1 - burst)) * 1000 + most - at * F.lit(rate)
    return both.select("client", "request_id", F.when(at.isNotNull(), F.greatest(F.lit(0.0), spent / rate)).alias("wait_ms"))
