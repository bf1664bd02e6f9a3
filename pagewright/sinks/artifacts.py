"""Artifacts (name, content) as files of a folder, by a data source that commits.

Tasks write into a folder of the run, each attempt into one of its own; what attempts wrote becomes visible only when
all tasks of a write (or of a stream's increment) are done: the driver then moves it to its place, one rename for each
file, and removes the folder. So a task that fails, is killed or runs twice never leaves a part of a file, and a write
that fails leaves none of its files (a task that was still running then may leave a hidden folder, which is no artifact). Files are written by Arrow's file systems: local and shared folders, HDFS and object
stores.

Defined results: names are made safe first, and one that is nothing then is an error; of one name written twice the
later row of the later partition stays; null content is an empty file; other columns are ignored.
"""

from __future__ import annotations

import os
import re
import time
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamWriter, DataSourceWriter, WriterCommitMessage

from pagewright.functions.scalars import sanitize_name

FORMAT = "artifacts"
#: Files that are moved to their places at the same time.
MOVES = 16


def located(path: str):
    """The Arrow file system of a path, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "/", path))


@dataclass
class Staged(WriterCommitMessage):
    """What one attempt wrote: its folder and the names in it, in order."""

    folder: str
    names: list[str]


class ArtifactWriter(DataSourceWriter):
    """One write into a folder."""

    def __init__(self, path: str):
        self.path, self.run = path, f".run-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator) -> Staged:
        store, root = located(self.path)
        folder, names = f"{root}/{self.run}/{uuid.uuid4().hex}", []
        store.create_dir(folder, recursive=True)
        for row in iterator:
            with store.open_output_stream(f"{folder}/{row['name']}") as out:
                out.write(row["content"] or b"")
            names.append(row["name"])
        return Staged(folder, names)

    def commit(self, messages: list) -> None:
        store, root = located(self.path)
        last = {name: f"{m.folder}/{name}" for m in messages if m is not None for name in m.names}
        with ThreadPoolExecutor(MOVES) as pool:
            list(pool.map(lambda name: store.move(last[name], f"{root}/{name}"), last))
        self._clear()

    def abort(self, messages: list) -> None:
        self._clear()

    def _clear(self) -> None:
        from pyarrow import fs

        store, root = located(self.path)
        for wait in (0.1, 0.5, 0):
            if store.get_file_info(f"{root}/{self.run}").type == fs.FileType.NotFound:
                return
            try:
                return store.delete_dir(f"{root}/{self.run}")
            except OSError:  # a task of a write that failed is still at it
                time.sleep(wait)


class ArtifactStreamWriter(DataSourceStreamWriter):
    """The increments of a stream; one that is written again after a failure writes the same names."""

    def __init__(self, path: str):
        self.inner = ArtifactWriter(path)

    def write(self, iterator: Iterator) -> Staged:
        return self.inner.write(iterator)

    def commit(self, messages: list, batchId: int) -> None:  # noqa: N803
        self.inner.commit(messages)

    def abort(self, messages: list, batchId: int) -> None:  # noqa: N803
        self.inner.abort(messages)


class ArtifactSink(DataSource):
    """`df.write.format("artifacts").save(folder)`, and the same for streams."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "name string, content binary"

    def writer(self, schema, overwrite: bool) -> ArtifactWriter:
        return ArtifactWriter(self.options["path"])

    def streamWriter(self, schema, overwrite: bool) -> ArtifactStreamWriter:  # noqa: N802
        return ArtifactStreamWriter(self.options["path"])


def absolute(folder: str) -> str:
    """The folder, as the driver sees it where it is given without a scheme."""
    return folder if re.match(r"^[A-Za-z][A-Za-z0-9+.-]*:", folder) else os.path.abspath(folder)


def safely_named(artifacts: DataFrame) -> DataFrame:
    """name and content, the names made safe."""
    return artifacts.select(F.coalesce(sanitize_name(F.col("name")), F.raise_error(F.lit("an artifact without a name"))).alias("name"), "content")


def export(artifacts: DataFrame, folder: str) -> None:
    """Write artifacts as files into a folder that all executors share: all of them, or none."""
    artifacts.sparkSession.dataSource.register(ArtifactSink)
    safely_named(artifacts).write.format(FORMAT).mode("append").save(absolute(folder))


def export_stream(artifacts: DataFrame, folder: str, checkpoint: str):
    """A stream of artifacts as files; the query that writes them, ready to be started."""
    artifacts.sparkSession.dataSource.register(ArtifactSink)
    return safely_named(artifacts).writeStream.format(FORMAT).option("checkpointLocation", checkpoint).option("path", absolute(folder)).outputMode("append")
