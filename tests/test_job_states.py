import datetime as dt
import time

import pandas as pd
import pytest

from pagewright.streaming import job_states as J

SCHEMA = "job_id long, ts timestamp, seq long, type string"
START = dt.datetime(2024, 1, 1)


def at(s):
    return START + dt.timedelta(seconds=s)


PARTS = [
    [(1, at(0), 0, "created"), (1, at(1), 1, "loading"), (9, at(1), 1, "loading"), (2, at(2), 0, "created"), (3, at(3), 0, "created")],
    [(1, at(12), 3, "page_done"), (1, at(10), 2, "page_done"), (3, at(11), 1, "loading"), (3, at(12), 2, "deleted"), (3, at(13), 3, "page_done"), (2, at(5), 1, "loading")],
    [(1, at(20), 4, "done"), (1, at(21), 5, "page_done"), (4, at(22), 0, "created"), (4, at(23), 1, "loading"), (4, at(23), 1, "created")],
    [(2, at(700), 2, "page_done"), (5, at(701), 0, "created"), (5, at(702), 1, "error"), (5, at(703), 2, "done")],
    [(4, at(1700), 2, "done"), (6, at(1701), 0, "created"), (1, at(1702), 9, "loading")],
    [(7, at(5000), 0, "created"), (7, at(5001), 1, "done")],
    [(8, at(9000), 0, "created"), (8, at(9001), 1, "_eof")],
]


@pytest.fixture
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    J.use_rocks(spark)
    yield spark
    spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def test_stream_equals_the_batch_after_a_restart(rocks, tmp_path):
    """Late rows, and such for unknown, deleted, ended and expired jobs; stopped after three increments and started again."""
    spark, frames = rocks, []
    for upto in (3, len(PARTS)):
        for k, rows in enumerate(PARTS[:upto]):
            if not (tmp_path / f"in/{k}").exists():
                spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
        source = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
        run = J.stream(source.withWatermark("ts", "10 seconds")).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        run.awaitTermination(300)
        frames.append(spark.read.schema(J.FRAMES).parquet(str(tmp_path / "out")).count())
    key = lambda rows: sorted((r.job_id, r.seq, r.frame) for r in rows)
    got = key(spark.read.schema(J.FRAMES).parquet(str(tmp_path / "out")).collect())
    want = key(J.live(spark.createDataFrame([r for part in PARTS for r in part], SCHEMA)).collect())
    assert got == want and 0 < frames[0] < frames[1]
    kinds = {}
    for job, _, frame in got:
        kinds.setdefault(job, []).append(frame.split('"')[3])
    assert kinds == {1: ["loading", "page_done", "page_done", "done"], 2: ["loading", "error"], 3: ["loading"], 4: ["loading", "error"], 5: ["error"], 6: ["error"], 7: ["done"], 8: ["_eof"]}
    assert '"page":2' in got[2][2]


class Clock:
    """A clock that is set by hand, with the state and timers of one job."""

    def __init__(self, processor):
        self.now, self.timers, self.value, self.processor = 0, set(), None, processor
        processor.init(self)

    def getValueState(self, name, schema):
        return self

    exists = lambda self: self.value is not None
    get = lambda self: self.value
    getCurrentProcessingTimeInMs = lambda self: self.now
    getExpiryTimeInMs = lambda self: self.fired

    def update(self, value):
        self.value = value

    def clear(self):
        self.value = None

    def registerTimer(self, at):
        self.timers.add(at)

    def deleteTimer(self, at):
        self.timers.discard(at)

    def until(self, seconds):
        """Frames by the time they were sent, in seconds."""
        out = []
        while due := sorted(t for t in self.timers if t <= seconds * 1000):
            self.now = self.fired = due[0]
            self.timers.discard(due[0])
            out += [(self.now / 1000, f) for frames in self.processor.handleExpiredTimer((1,), self, self) for f in frames["frame"]]
        self.now = seconds * 1000
        return out

    def tell(self, *kinds):
        rows = pd.DataFrame({"job_id": 1, "ts": pd.Timestamp(0), "seq": range(len(kinds)), "type": kinds})
        return [f for frames in self.processor.handleInputRows((1,), iter([rows]), self) for f in frames["frame"]]


def test_a_quiet_job_sends_a_comment_every_thirty_seconds():
    clock = Clock(J.Jobs(600, 30, by_clock=True))
    assert clock.tell("loading") == [] and not clock.timers  # unknown
    assert clock.tell("created") == [] and clock.until(29) == []
    assert clock.until(95) == [(30.0, J.COMMENT), (60.0, J.COMMENT), (90.0, J.COMMENT)]
    assert len(clock.tell("loading")) == 1 and clock.until(124) == [] and clock.until(126) == [(125.0, J.COMMENT)]
    assert len(clock.tell("page_done", "done")) == 2 and clock.until(500) == [] and clock.tell("page_done") == []
    assert clock.until(700) == [] and clock.value is None and not clock.timers  # its time is over
    clock.tell("created")
    sent = clock.until(2000)
    assert [t for t, f in sent if f == J.COMMENT] == [700.0 + 30 * k for k in range(1, 20)]
    assert sent[-1] == (1300.0, J.event_frame("error", message=J.TOO_LONG)) and not clock.timers and clock.value is None
    clock.tell("created")
    assert clock.tell("deleted", "loading") == [] and not clock.timers and clock.value is None


def test_comments_by_the_clock_in_a_stream(rocks, tmp_path):
    spark = rocks
    spark.createDataFrame([(1, at(0), 0, "created"), (1, at(0), 1, "loading"), (2, at(0), 0, "created"), (2, at(0), 1, "done")], SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in/0"))
    source = spark.readStream.schema(SCHEMA).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    run = J.stream(source, ttl=3600, quiet=2, by_clock=True).writeStream.format("memory").queryName("comments").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).start()
    until = time.time() + 90
    while time.time() < until and spark.sql("select * from comments where frame like ': keep%'").count() < 2:
        time.sleep(1)
    run.stop()
    rows = spark.sql("select * from comments order by job_id, seq").collect()
    comments = [r.job_id for r in rows if r.frame == J.COMMENT]
    assert set(comments) == {1} and len(comments) >= 2 and [r.frame.split('"')[3] for r in rows if r.frame.startswith("data")] == ["loading", "done"]
