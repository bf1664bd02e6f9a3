"""Jobs as state: created, told their progress, asked for, deleted, and forgotten when their time is over.

Rows of job_id, ts, seq and type drive a stateful processor for each job: `created` makes it, `deleted` forgets it, and all
else is progress. What comes for a job that is unknown, was deleted, has ended or has expired does nothing. A timer set
when a job is made ends it when its time to live has passed, by event time (so a replay gives the same) or by the clock;
by the clock, another timer sends a comment whenever a job has been quiet for so long, which keeps its connection open.

live() gives the same rows for a whole log as a batch: what a stream by event time has written once its watermark has
passed all of them.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from pagewright import params as P
from pagewright.streaming.jobs import TERMINAL

# What is sent to a client whose job took too long, and what keeps its connection open.
TOO_LONG, COMMENT = "the job took too long", ": keepalive\n\n"
FRAMES = "job_id long, seq long, frame string"
#: The provider of state that timers and state variables need.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def event_frame(kind: str, page: int | None = None, message: str | None = None) -> str:
    """A server-sent event."""
    event = {"type": kind} | ({"page": page} if page is not None else {}) | ({"message": message} if message else {})
    return f"data: {json.dumps(event, separators=(',', ':'))}\n\n"


class Jobs(StatefulProcessor):
    """One job. Its state: when it was made, how many frames and pages it has had, whether it has ended, and when its next
    comment is due (0: none)."""

    def __init__(self, ttl: int = P.JOB_TTL, quiet: int = 0, by_clock: bool = False):
        self.ttl, self.quiet, self.by_clock = ttl * 1000, quiet * 1000, by_clock

    def init(self, handle) -> None:
        self.handle = handle
        self.job = handle.getValueState("job", "made long, seq long, pages long, ended boolean, due long")

    def _forget(self, made: int, due: int) -> None:
        self.handle.deleteTimer(made + self.ttl)
        if due:
            self.handle.deleteTimer(due)
        self.job.clear()

    def _later(self, due: int, now: int) -> int:
        """The next comment is due so long after now."""
        if not self.quiet or not self.by_clock:
            return 0
        if due:
            self.handle.deleteTimer(due)
        self.handle.registerTimer(now + self.quiet)
        return now + self.quiet

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentProcessingTimeInMs()
        out, job = [], self.job.get() if self.job.exists() else None
        for row in pd.concat(list(rows)).sort_values(["ts", "seq"]).itertuples(index=False):
            at = now if self.by_clock else int(pd.Timestamp(row.ts).timestamp() * 1000)
            if job is None:
                if row.type == "created":
                    self.handle.registerTimer(at + self.ttl)
                    job = (at, 0, 0, False, self._later(0, now))
                continue
            made, seq, pages, ended, due = job
            if row.type == "deleted":
                self._forget(made, due)
                job = None
            elif not ended and row.type != "created" and at <= made + self.ttl:
                pages += row.type == "page_done"
                out.append((key[0], seq, event_frame(row.type, pages if row.type == "page_done" else None)))
                ended = row.type in TERMINAL
                if ended and due:
                    self.handle.deleteTimer(due)
                job = (made, seq + 1, int(pages), ended, 0 if ended else self._later(due, now))
        if job is not None:
            self.job.update(job)
        yield pd.DataFrame(out, columns=["job_id", "seq", "frame"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        out, at = [], expiredTimerInfo.getExpiryTimeInMs()
        if self.job.exists():
            made, seq, pages, ended, due = self.job.get()
            if at >= made + self.ttl:
                if not ended:
                    out.append((key[0], seq, event_frame("error", message=TOO_LONG)))
                self._forget(made, 0 if due == at else due)
            elif at == due and not ended:
                out.append((key[0], seq, COMMENT))
                self.handle.registerTimer(at + self.quiet)
                self.job.update((made, seq + 1, pages, ended, at + self.quiet))
        yield pd.DataFrame(out, columns=["job_id", "seq", "frame"])

    def close(self) -> None:
        pass


def stream(events: DataFrame, ttl: int = P.JOB_TTL, quiet: int = P.QUIET, by_clock: bool = False) -> DataFrame:
    """job_id, seq and frame of a stream of job rows. By event time the rows need a watermark on ts."""
    return events.select("job_id", "ts", "seq", "type").groupBy("job_id").transformWithStateInPandas(Jobs(ttl, quiet, by_clock), FRAMES, "Append", "ProcessingTime" if by_clock else "EventTime")


def use_rocks(spark: SparkSession) -> None:
    """Have the session's streams keep state where state variables and timers can be."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


def live(events: DataFrame, ttl: int = P.JOB_TTL) -> DataFrame:
    """job_id, seq and frame of a whole log, when nothing more will come. Names of jobs are not used twice."""
    line = Window.partitionBy("job_id").orderBy("ts", "seq")
    rows = events.select("job_id", "ts", "seq", "type")
    earlier = line.rowsBetween(Window.unboundedPreceding, -1)
    made = F.min(F.when(F.col("type") == "created", F.col("ts"))).over(line.rowsBetween(Window.unboundedPreceding, 0))
    gone = F.coalesce(F.max(((F.col("type") == "deleted") & F.col("made").isNotNull()).cast("int")).over(earlier), F.lit(0))
    known = rows.withColumn("made", made).where("made is not null").withColumn("gone", gone)
    age = F.unix_millis("ts") - F.unix_millis("made")
    known = known.withColumn("told", ~F.col("type").isin("created", "deleted") & (F.col("gone") == 0) & (age <= ttl * 1000))
    ended = F.coalesce(F.max((F.col("told") & F.col("type").isin(*TERMINAL)).cast("int")).over(earlier), F.lit(0))
    known = known.withColumn("told", F.col("told") & (ended == 0))
    told = known.where("told")
    nth, page = F.row_number().over(line) - 1, F.count(F.when(F.col("type") == "page_done", 1)).over(line)
    shown = F.when(F.col("type") == "page_done", F.concat(F.lit(',"page":'), page.cast("string"))).otherwise("")
    frames = told.select("job_id", nth.cast("long").alias("seq"), F.concat(F.lit('data: {"type":"'), "type", F.lit('"'), shown, F.lit("}\n\n")).alias("frame"))
    close = (F.col("type") == "deleted") & (F.col("gone") == 0) & (age <= ttl * 1000)
    over = known.groupBy("job_id").agg(F.count(F.when(F.col("told"), 1)).alias("seq"), F.max(close | (F.col("told") & F.col("type").isin(*TERMINAL))).alias("over"))
    late = over.where(~F.col("over")).select("job_id", "seq", F.lit(event_frame("error", message=TOO_LONG)).alias("frame"))
    return frames.unionByName(late)
