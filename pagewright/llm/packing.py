"""Best-fit decreasing packing of tokenised documents.

Tokens are counted on the executors; a document longer than a sequence is cut into full pieces after a first piece that
takes what is left over. Best-fit decreasing treats pieces of one length alike and bins of one remaining capacity alike,
so the packing is planned on the histogram of lengths, which has one row per length however many documents there are:
for each length, longest first, a segment tree over remaining capacities gives the tightest open bin in logarithmic time,
and all bins of that capacity take pieces at once. The plan is a list of runs (the pieces of one length with ranks from
.. to go to bins from .. on); pieces find their run by their rank within their length, which is counted per salted
bucket, so that no length, however common, meets in one task.

Defined results: null text counts as empty, which is one end token; empty tables give no rows; repeated rows are packed
each; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagewright.llm.common import BROADCAST_ROWS, durable, each_batch, table

LENGTH = 1024
END = 2
#: Words whose ids a worker keeps; the rest are encoded whenever they come.
CACHE = 150_000
#: Pieces in one bucket of ranks, on average.
BUCKET = 250

_encoders: dict = {}


class _WordEncoder(dict):
    """Token ids, as little-endian bytes, of a word with the space before it.

    Byte-level BPE splits a text before every space but those with white space on both sides, so a text without such is
    the concatenation of its space-separated words, and words come again and again. The file's added tokens are cut out
    of the text first, and each stands for its own id.
    """

    inside_run = re.compile(r"\s (?:\s|\Z)").search

    def __init__(self, path: str):
        super().__init__()
        import json

        import public_tokenizers
        import tiktoken

        units = {chr(c): b for b, c in _byte_units().items()}
        file = json.load(open(path, encoding="utf-8"))
        self.added = {t["content"]: np.array([t["id"]], "<u4").tobytes() for t in file["added_tokens"]}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")").split if self.added else lambda text: [text]
        ranks = {bytes(units[c] for c in token): i for token, i in file["model"]["vocab"].items() if all(c in units for c in token) and token not in self.added}
        self.encode = tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def __missing__(self, word: str) -> bytes:
        ids = array("I", self.encode(word)).tobytes()
        if len(self) < CACHE:
            self[word] = ids
        return ids

    def ids(self, text: str) -> bytes:
        if not any(token in text for token in self.added):
            return self._plain(text)
        return b"".join(self.added.get(part) or self._plain(part) for part in self.cut(text))

    def _plain(self, text: str) -> bytes:
        if self.inside_run(text):
            return np.array(self.encode(text), "<u4").tobytes()
        head, *rest = text.split(" ")
        return b"".join([np.array(self.encode(head), "<u4").tobytes(), *map(self.__getitem__, [" " + word for word in rest])])


def _byte_units() -> dict[int, int]:
    """The code point that stands for each byte in a byte-level vocabulary: printable ones for themselves, the others
    in turn from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {b: b for b in plain} | {b: 256 + i for i, b in enumerate(others)}


def encoder(path: str) -> _WordEncoder:
    """One encoder per worker process and file."""
    if path not in _encoders:
        _encoders[path] = _WordEncoder(path)
    return _encoders[path]


def token_pieces(docs: DataFrame, tokenizer: str, length: int = LENGTH, end: int = END, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and (if wanted) ids of every piece."""
    tail = np.array([end], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = encoder(tokenizer).ids
        for batch in each_batch(batches, 1000):
            docs_, pieces, starts, lengths, sums, ids = [], [], [], [], [], []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                data = (ids_of(text) if text else b"") + tail
                n = len(data) // 4
                cut = n - (n - 1) // length * length
                for k, (a, b) in enumerate(zip([0, *range(cut, n, length)], range(cut, n + 1, length), strict=True)):
                    part = data[4 * a : 4 * b]
                    docs_.append(doc)
                    pieces.append(k)
                    starts.append(a)
                    lengths.append(b - a)
                    sums.append(zlib.crc32(part))
                    if with_ids:
                        ids.append(np.frombuffer(part, "<u4").astype(np.int32))
            columns = [pa.array(docs_, pa.int64()), pa.array(pieces, pa.int32()), pa.array(starts, pa.int64()), pa.array(lengths, pa.int64()), pa.array(sums, pa.int64())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                columns.append(pa.array(ids, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


class _Tightest:
    """A segment tree over remaining capacities: which have open bins, and the least of those from a size on."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.open = [0] * (2 * self.leaves)

    def add(self, capacity: int, bins: int) -> None:
        at = self.leaves + capacity
        while at:
            self.open[at] += bins
            at //= 2

    def least(self, size: int) -> int | None:
        at = self.leaves + size
        if self.open[at]:
            return size
        while at > 1:
            if at % 2 == 0 and self.open[at + 1]:
                at += 1
                while at < self.leaves:
                    at = 2 * at + (not self.open[2 * at])
                return at - self.leaves
            at //= 2
        return None


def best_fit_runs(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Runs (length, rank from, rank to, first bin, pieces per bin, offset) of best-fit decreasing.

    The pieces of a run with ranks from + k go to bin first + k // per, at offset + k % per * length.
    """
    tree, stacks, runs, bins = _Tightest(capacity), {}, [], 0

    def push(room: int, first: int, count: int) -> None:
        if room and count:
            stacks.setdefault(room, []).append((first, count))
            tree.add(room, count)

    for size in sorted(histogram, reverse=True):
        rank, left = 0, histogram[size]
        while left:
            room = tree.least(size)
            if room is None:
                room, first, count = capacity, bins, -(-left // (capacity // size))
                bins += count
            else:
                first, count = stacks[room].pop()
                tree.add(room, -count)
            per = room // size
            full = min(count, left // per)
            for used, load in ((full, per), (1 if full < count and left > full * per else 0, left - full * per)):
                if used:
                    runs.append((size, rank, rank + used * load, first, load, capacity - room))
                    push(room - load * size, first, used)
                    rank, left, first, count = rank + used * load, left - used * load, first + used, count - used
            push(room, first, count)
    return runs


def pack(pieces: DataFrame, capacity: int = LENGTH, bucket: int = BUCKET) -> DataFrame:
    """pieces (durable rows with length, doc_id, piece) with the sequence_id and offset that each is packed at."""
    spark = pieces.sparkSession
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    runs = best_fit_runs(histogram, capacity)
    fields = ["length", "from", "to", "first", "per", "base"]
    plan = spark.createDataFrame(runs, T.StructType([T.StructField(f, T.LongType()) for f in fields]))
    buckets = F.lit([max(1, histogram.get(n, 0) // bucket) for n in range(capacity + 1)])  # a common length gets more
    salted = pieces.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.element_at(buckets, F.col("length").cast("int") + 1)))
    sizes = salted.groupBy("length", "_bucket").agg(F.count("*").alias("_n"))
    before = sizes.select("length", "_bucket", (F.sum("_n").over(Window.partitionBy("length").orderBy("_bucket")) - F.col("_n")).alias("_before"))
    within = Window.partitionBy("length", "_bucket").orderBy("doc_id", "piece", "ids_crc32")
    ranked = salted.withColumn("_rank", F.row_number().over(within) - 1).join(before, ["length", "_bucket"]).withColumn("_rank", F.col("_rank") + F.col("_before"))
    p = F.broadcast(plan.alias("p")) if len(runs) <= BROADCAST_ROWS else plan.alias("p")
    placed = ranked.alias("r").join(p, (F.col("r.length") == F.col("p.length")) & (F.col("_rank") >= F.col("p.from")) & (F.col("_rank") < F.col("p.to")))
    k = F.col("_rank") - F.col("p.from")
    return placed.select(
        *[F.col(f"r.{c}") for c in pieces.columns],
        (F.col("p.first") + F.floor(k / F.col("p.per"))).cast("long").alias("sequence_id"),
        (F.col("p.base") + k % F.col("p.per") * F.col("r.length")).alias("offset"),
    )


def op2_packing(spark, sf_dir: str) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of every piece of every document."""
    import public_tokenizers

    pieces = durable(token_pieces(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")))
    return pack(pieces)
