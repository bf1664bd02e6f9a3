"""Scan jobs as a durable log of progress events.

Events are rows of job_id, ts, seq and type (loading, detected, scanning, page_done, assembling, done, error, _eof), with
page, total, pdf, elapsed and message where they apply. The batch operators below give the same rows for the whole log
as the stateful stream gives for its increments.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright import params as P
from pagewright.functions.scalars import percent

# The order that a job goes through, and what ends it.
LIFECYCLE = ("loading", "detected", "scanning", "page_done", "assembling", "done")
TERMINAL = ("done", "error", "_eof")


def until_terminal(events: DataFrame) -> DataFrame:
    """The events of each job up to the first that ends it."""
    earlier = Window.partitionBy("job_id").orderBy("ts", "seq").rowsBetween(Window.unboundedPreceding, -1)
    ended = F.coalesce(F.max(F.col("type").isin(*TERMINAL).cast("int")).over(earlier), F.lit(0))
    return events.withColumn("_ended", ended).where("_ended = 0").drop("_ended")


def progress(events: DataFrame) -> DataFrame:
    """page_done events with page (the how many-th of its job it is, whatever order pages end in) and percent."""
    done = events.where("type = 'page_done'")
    nth = F.row_number().over(Window.partitionBy("job_id").orderBy("ts", "seq"))
    total = F.count("*").over(Window.partitionBy("job_id"))
    rows = done.withColumns({"page": nth, "total": total})
    return rows.withColumn("percent", percent(F.col("page"), F.col("total")))


def states(events: DataFrame) -> DataFrame:
    """job_id, created, type, events, ended of every job, from its first event to the one that ends it."""
    rows = until_terminal(events).groupBy("job_id").agg(F.min("ts").alias("created"), F.max_by("type", F.struct("ts", "seq")).alias("type"), F.count("*").alias("events"))
    return rows.withColumn("ended", F.col("type").isin(*TERMINAL))


def without(events: DataFrame, jobs: DataFrame) -> DataFrame:
    """events but those of these jobs (a column job_id): the log with the jobs deleted."""
    return events.join(jobs.select("job_id"), "job_id", "left_anti")


def expired(events: DataFrame, now: Column, ttl: int = P.JOB_TTL) -> DataFrame:
    """job_id, created, expired of every job; its age counts from its first event."""
    jobs = events.groupBy("job_id").agg(F.min("ts").alias("created"))
    return jobs.withColumn("expired", (F.unix_timestamp(now) - F.unix_timestamp("created")) > ttl)


def as_json(event: list[str]) -> Column:
    return F.to_json(F.struct(*event))


def frame(json: Column) -> Column:
    """A server-sent event."""
    return F.concat(F.lit("data: "), json, F.lit("\n\n"))


def keepalives(events: DataFrame, quiet: int = P.QUIET) -> DataFrame:
    """job_id, ts, frame: the comment frames that keep a connection open, one for every so many seconds without an event
    of a job that has not ended."""
    line = Window.partitionBy("job_id").orderBy("ts", "seq")
    rows = until_terminal(events).withColumn("next", F.lead("ts").over(line))
    gap = F.unix_timestamp("next") - F.unix_timestamp("ts")
    times = F.when(gap > quiet, F.sequence(F.lit(1).cast("long"), F.floor((gap - 1) / quiet)))
    rows = rows.select("job_id", "ts", F.explode(times).alias("nth"))
    return rows.select("job_id", F.timestamp_seconds(F.unix_timestamp("ts") + F.col("nth") * quiet).alias("ts"), F.lit(": keepalive\n\n").alias("frame"))


def misordered(events: DataFrame) -> DataFrame:
    """Events of a job that come after a later stage of its life has begun."""
    stage = F.array_position(F.array(*map(F.lit, LIFECYCLE)), F.col("type"))
    line = Window.partitionBy("job_id").orderBy("ts", "seq").rowsBetween(Window.unboundedPreceding, -1)
    rows = events.where(F.col("type").isin(*LIFECYCLE)).withColumn("stage", stage)
    return rows.withColumn("reached", F.max("stage").over(line)).where("stage < reached")


def panels(events: DataFrame) -> DataFrame:
    """What a client shows of each job after its last event: title, pages scanned and whether it goes on."""
    rows = until_terminal(events)
    last = rows.groupBy("job_id").agg(F.max_by("type", F.struct("ts", "seq")).alias("type"), F.count(F.when(F.col("type") == "page_done", 1)).alias("pages"))
    # What is shown while a job is in each state.
    titles = {"loading": "Loading PDF pages", "detected": "Scanning", "scanning": "Scanning", "page_done": "Scanning", "assembling": "Assembling scanned PDF", "done": "Scan complete!", "error": "Scan failed", "_eof": "Scan failed"}
    pairs = F.create_map(*[F.lit(x) for pair in titles.items() for x in pair])
    return last.select("job_id", pairs[F.col("type")].alias("title"), "pages", (~F.col("type").isin(*TERMINAL)).alias("running"))


def stream_frames(events: DataFrame, ttl: int = P.JOB_TTL):
    """A stream of events as a stream of job_id, seq and frame: pages are counted as they end, nothing follows the event
    that ends a job, and a job that outlives its time to live ends with an error. State is kept per job; event time needs
    a watermark on ts."""

    def advance(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        out = []
        if state.hasTimedOut:
            seq, _, ended, _ = state.get
            if not ended:
                out.append((key[0], seq, 'data: {"type":"error","message":"the job took too long"}\n\n'))
            state.remove()
        else:
            rows = pd.concat(list(batches)).sort_values(["ts", "seq"])
            seq, pages, ended, created = state.get if state.exists else (0, 0, False, int(rows["ts"].min().timestamp() * 1000))
            for kind in rows["type"]:
                if ended:
                    break
                pages += kind == "page_done"
                shown = f',"page":{pages}' if kind == "page_done" else ""
                out.append((key[0], seq, f'data: {{"type":"{kind}"{shown}}}\n\n'))
                seq, ended = seq + 1, kind in TERMINAL
            state.update((seq, int(pages), bool(ended), created))
            state.setTimeoutTimestamp(max(created + ttl * 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["job_id", "seq", "frame"])

    return events.groupBy("job_id").applyInPandasWithState(advance, "job_id long, seq long, frame string", "seq long, pages long, ended boolean, created long", "append", "EventTimeTimeout")
