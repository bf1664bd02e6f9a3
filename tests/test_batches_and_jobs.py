import datetime as dt

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from pagewright.operators import batches as B
from pagewright.streaming import jobs as J


def test_uploads(spark):
    rows = [(1, "a.JPG", 5, "image/jpeg"), (2, "a.JPG", 5, "image/jpeg"), (3, "a.JPG", 5, None), (4, "", 5, None), (5, "b.gif", 1, None), (6, "c.webp", 1, "")]
    df = spark.createDataFrame(rows, "seq int, name string, size int, ctype string")
    assert [r.seq for r in B.first_uploads(df, ["name", "size", "ctype"], "seq").orderBy("seq").collect()] == [1, 3, 4, 5, 6]
    assert [r.seq for r in B.accepted(df).orderBy("seq").collect()] == [1, 2, 3, 6]
    assert B.reject_pdfs(df).count() == 6
    with pytest.raises(PySparkException):
        B.reject_pdfs(spark.createDataFrame([("x.PDF",)], "name string")).collect()


def test_counts_come_with_the_rows_and_survive_retries(spark, tmp_path):
    """Equal to a group by over the input; a task that fails once and is run again counts once."""
    rows = [(k, ["a.jpg", "", None, "b.TXT", "c.png", "noend"][k % 6]) for k in range(1000)]
    df = spark.createDataFrame(rows, "seq int, name string").repartition(4)
    kept, seen = B.accepted_and_counted(df)
    flag = str(tmp_path / "failed")

    def once(batches):
        import os

        for batch in batches:
            if not os.path.exists(flag):
                open(flag, "w").close()
            yield batch

    assert kept.mapInArrow(once, kept.schema).count() == B.accepted(df).count()
    want = df.agg(F.count("*"), F.count_if(F.coalesce(F.length("name"), F.lit(0)) == 0), F.count_if((F.length("name") > 0) & ~F.lower("name").rlike("[.](jpg|png)$"))).first()
    assert seen.get == {"rows": want[0], "nameless": want[1], "unsupported": want[2]}
    pages = spark.createDataFrame([(1, bytearray(b"x"), None), (2, None, "broken"), (3, None, "x"), (4, None, None)], "page_id int, data binary, error string")
    out, seen = B.scanned_and_counted(pages)
    out.write.format("noop").mode("overwrite").save()
    assert seen.get == {"rows": 4, "scanned": 1, "failed": 2}


def test_page_limits(spark):
    one = spark.range(1)
    assert one.select(B.parsed_limit(F.lit(" 3 "))).first()[0] == 3
    assert one.select(B.parsed_limit(F.lit("many"))).first()[0] is None
    with pytest.raises(PySparkException):
        one.select(B.parsed_limit(F.lit("0"))).collect()
    pages = spark.createDataFrame([("d", k) for k in (5, 1, 3)], "doc_id string, page_no int")
    assert [r.page_no for r in B.page_limit(pages, F.lit(2)).collect()] == [1, 3]
    assert B.page_limit(pages, F.lit(None).cast("int")).count() == 3


def test_stream_of_frames(spark, tmp_path):
    """The stream counts pages, stops at the end of a job, and ends jobs that take too long."""
    start = dt.datetime(2024, 1, 1)
    at = lambda s: start + dt.timedelta(seconds=s)
    parts = [
        [(1, at(0), 1, "loading"), (2, at(1), 1, "loading"), (1, at(2), 2, "page_done")],
        [(1, at(3), 3, "page_done"), (1, at(4), 4, "done"), (1, at(5), 5, "page_done")],
        [(3, at(4000), 1, "loading")],
        [(3, at(4001), 2, "page_done")],
    ]
    schema = "job_id long, ts timestamp, seq long, type string"
    for k, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    query = J.stream_frames(stream.withWatermark("ts", "1 second")).writeStream.format("memory").queryName("frames").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination(240)
    frames = {}
    for r in spark.sql("select * from frames order by job_id, seq").collect():
        frames.setdefault(r.job_id, []).append(r.frame)
    assert [f.split('"')[3] for f in frames[1]] == ["loading", "page_done", "page_done", "done"] and '"page":2' in frames[1][2]
    assert [f.split('"')[3] for f in frames[2]] == ["loading", "error"]
    assert frames[3][0].startswith("data: {")
