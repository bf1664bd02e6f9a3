"""Helpers that the corpus operators share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagewright.session import durable, passing, shared_dir

__all__ = ["ASCII_LOWER", "BROADCAST_ROWS", "durable", "each_batch", "flat_lists", "global_rank", "passing", "raw_texts", "shared_dir", "table"]

#: Most rows of a side that is broadcast; the number is counted first.
BROADCAST_ROWS = 100_000
#: ASCII capitals to small letters.
ASCII_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_texts(column: pa.Array) -> list[bytes | None]:
    """UTF-8 bytes of a string column."""
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def flat_lists(parts: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    """One list per array."""
    ends = np.cumsum([0, *map(len, parts)], dtype=np.int32)
    values = np.concatenate(parts) if parts else np.empty(0)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values.astype(kind.to_pandas_dtype(), copy=False), kind))


def each_batch(batches: Iterator[pa.RecordBatch], rows: int = 2000) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most `rows`, which bounds what a worker holds decoded."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def global_rank(df: DataFrame, *order: Column, name: str = "rank") -> DataFrame:
    """df with a rank from 0 in the given order, without bringing all rows into one task.

    Rows are dealt out by range and numbered in their partition; only one count per partition is summed up across.
    """
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    dealt = durable(dealt)
    part = F.shiftright("_at", 33)
    sizes = dealt.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    return (
        dealt.withColumn("_part", part)
        .join(F.broadcast(before), "_part")  # one row for each partition
        .withColumn(name, F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1))
        .drop("_at", "_part", "_before")
    )

