import os

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from pagewright.sinks import artifacts as A
from pagewright.sinks import documents as D

SCHEMA = "name string, content binary"


def files(folder):
    return {str(p.relative_to(folder)): p.read_bytes() for p in folder.rglob("*") if p.is_file() and ".run-" not in str(p)} if folder.exists() else {}


def test_all_files_of_a_write_or_none(spark, tmp_path):
    rows = [(f"p{k}.bin", bytearray([k] * k)) for k in range(20)] + [("../up one.txt", bytearray(b"x")), ("empty", None)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    A.export(df, str(tmp_path / "out"))
    want = {f"p{k}.bin": bytes([k] * k) for k in range(20)} | {"_up_one.txt": b"x", "empty": b""}
    assert files(tmp_path / "out") == want and len(os.listdir(tmp_path / "out")) == 22
    A.export(spark.createDataFrame([("p3.bin", bytearray(b"new"))], SCHEMA), f"file:{tmp_path}/out")
    assert files(tmp_path / "out") == want | {"p3.bin": b"new"}
    # a row that fails in the last partition, after other tasks have written all of theirs
    bad = df.repartition(1).select("name", F.when(F.col("name") == "p7.bin", F.raise_error(F.lit("no content")).cast("binary")).otherwise(F.lit(b"partly")).alias("content"))
    with pytest.raises(PySparkException):
        A.export(bad.unionByName(spark.createDataFrame([("other", bytearray(b"1"))], SCHEMA)), str(tmp_path / "out"))
    assert files(tmp_path / "out") == want | {"p3.bin": b"new"}
    with pytest.raises(PySparkException):
        A.export(spark.createDataFrame([(".", None)], SCHEMA), str(tmp_path / "out"))


def test_attempts_that_are_not_committed_leave_nothing(tmp_path):
    """A task that runs twice writes two folders, of which one is committed; a name given twice has its later content."""
    writer = A.ArtifactWriter(str(tmp_path))
    first = writer.write(iter([{"name": "a", "content": b"1"}, {"name": "b", "content": b"2"}]))
    writer.write(iter([{"name": "a", "content": b"1"}]))  # killed or doubled: its message never arrives
    second = writer.write(iter([{"name": "c", "content": b"3"}, {"name": "b", "content": b"4"}]))
    assert files(tmp_path).keys().isdisjoint({"a", "b", "c"})
    writer.commit([first, second, None])
    assert files(tmp_path) == {"a": b"1", "b": b"4", "c": b"3"} and sorted(os.listdir(tmp_path)) == ["a", "b", "c"]
    other = A.ArtifactWriter(str(tmp_path))
    other.abort([other.write(iter([{"name": "d", "content": b"5"}]))])
    other.abort([])
    assert sorted(os.listdir(tmp_path)) == ["a", "b", "c"]


def test_a_stream_of_artifacts(spark, tmp_path):
    for k in range(3):
        spark.createDataFrame([(f"s{k}", bytearray([k])), ("last", bytearray([k]))], SCHEMA).coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    run = A.export_stream(stream, str(tmp_path / "out"), str(tmp_path / "state")).trigger(availableNow=True).start()
    run.awaitTermination(120)
    assert files(tmp_path / "out").keys() == {"s0", "s1", "s2", "last"} and files(tmp_path / "out")["s2"] == b"\x02"


def test_versions_have_one_order(spark, tmp_path):
    store = D.Artifacts(spark, str(tmp_path / "store"))
    store.save(spark.createDataFrame([("a", bytearray([k])) for k in range(9)], SCHEMA).coalesce(1))
    assert [bytes(r.content) for r in store.read().collect()] == [b"\x08"]
    store.save(spark.createDataFrame([("a", bytearray(b"x")), ("b", None)], SCHEMA))
    store.delete(spark.createDataFrame([("b",)], "name string"))
    assert {r["name"]: bytes(r.content) for r in store.read().collect()} == {"a": b"x"}
