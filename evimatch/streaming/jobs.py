"""Watching a job log as it grows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from evimatch.operators.jobs import MAX_ATTEMPTS, QUEUE_ACTIONS


def counts(log: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Events by state in windows of event time; late events count until the watermark has passed."""
    return log.withWatermark("ts", late).groupBy(F.window("ts", width), "state").agg(F.count("*").alias("n")).select(F.col("window.start").alias("since"), "state", "n")


def _breaker(threshold: int):
    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        run_now, opened = state.get if state.exists else (0, False)
        events = pd.concat(list(batches)).sort_values(["ts", "event_id"], kind="stable")
        for failed in events["failed"]:
            run_now = run_now + 1 if failed else 0
            opened = opened or run_now >= threshold
        state.update((run_now, opened))
        yield pd.DataFrame({"job_id": [key[0]], "run": [run_now], "opened": [opened]})

    return run


def breakers(log: DataFrame, threshold: int = 8) -> DataFrame:
    """Per job, after each batch: failures in a row and whether the breaker has opened.  State is two values a job."""
    return log.groupBy("job_id").applyInPandasWithState(_breaker(threshold), "job_id long, run int, opened boolean", "run int, opened boolean", "update", GroupStateTimeout.NoTimeout)


def _moved(job: tuple, action: str, retryable: bool | None, most: int) -> tuple:
    """operators.jobs.next_job() of one event, for state that lives between batches."""
    state, attempts, paused, cancelled, passed = job
    again = attempts < most and retryable is not False and not cancelled
    to = {
        "added": ("QUEUED", 0) if state is None else None,
        "started": ("RUNNING", attempts + 1) if state == "QUEUED" and not paused and not cancelled else None,
        "done": ("SUCCEEDED", attempts) if state == "RUNNING" else None,
        "failed": ("QUEUED" if again else "FAILED", attempts) if state == "RUNNING" else None,
        "retry": ("QUEUED", 0) if state in ("FAILED", "CANCELLED") else None,
        "retry failed": ("QUEUED", 0) if state == "FAILED" else None,
        "cancel": ("CANCELLED", attempts) if state == "QUEUED" else None,
    }.get(action)
    passed += to is None and action not in QUEUE_ACTIONS
    paused = action == "pause" or (paused and action not in ("run", "resume"))
    cancelled = action == "cancel" or (cancelled and action != "run")
    return (*(to or (state, attempts)), paused, cancelled, passed)


class JobStates(StatefulProcessor):
    """Follows each job: events wait in a list until the watermark has passed them, then move the job in the order of their times.

    State of a job: its row, the waiting events and their ids.  An id is forgotten when its event has counted, for then a repetition,
    having the same time, is behind the watermark.  A timer after each waiting event moves the job even if nothing more is said of it.
    """

    def __init__(self, most: int = MAX_ATTEMPTS) -> None:
        self.most = most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.job = handle.getValueState("job", "state string, attempts int, paused boolean, cancelled boolean, passed int")
        self.waiting = handle.getListState("waiting", "ts timestamp, event_id long, action string, retryable boolean")
        self.seen = handle.getMapState("seen", "event_id long", "at long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new, till = [], timerValues.getCurrentWatermarkInMs()
        for frame in rows:
            for ts, event_id, action, retryable in zip(frame["ts"], frame["event_id"], frame["action"], frame["retryable"], strict=True):
                at = int(ts.timestamp() * 1000)
                if at >= till and not self.seen.containsKey((int(event_id),)):
                    self.seen.updateValue((int(event_id),), (at,))
                    new.append((ts.to_pydatetime(), int(event_id), action, None if pd.isna(retryable) else bool(retryable)))
                    self.handle.registerTimer(at + 1)
        if new:
            self.waiting.appendList(new)
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        till = timerValues.getCurrentWatermarkInMs()
        due, later = [], []
        for e in self.waiting.get():
            (due if e[0].timestamp() * 1000 < till else later).append(tuple(e))
        if not due:
            return
        job = tuple(self.job.get()) if self.job.exists() else (None, 0, False, False, 0)
        for _, _, action, retryable in sorted(due, key=lambda e: e[:2]):
            job = _moved(job, action, retryable, self.most)
        for e in due:
            self.seen.removeKey((e[1],))
        self.job.update(job)
        if later:
            self.waiting.put(later)
        else:
            self.waiting.clear()
        yield pd.DataFrame([(key[0], *job)], columns=["job_id", "state", "attempts", "paused", "cancelled", "passed"])


def states(log: DataFrame, late: str = "10 minutes", most: int = MAX_ATTEMPTS) -> DataFrame:
    """The row of reduce_log() of a job each time the watermark has moved it; the last row of a job is where it stands.

    log is a stream of job_id, ts, event_id, action and retryable, what is said to a queue given to each of its jobs.
    Events later than the watermark do not count; earlier ones count in the order of their times whenever they come.
    """
    told = log.withWatermark("ts", late).groupBy("job_id")
    return told.transformWithStateInPandas(JobStates(most), "job_id long, state string, attempts int, paused boolean, cancelled boolean, passed int", "append", "eventTime")
