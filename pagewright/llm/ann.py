"""Approximate nearest neighbours by multi-index hashing.

Vectors become binary codes by a learned rotation (iterative quantisation on a bounded sample, after which every row is
coded). The rows are dealt out to shards, and the stated queries to blocks, both of bounded size, as bytes; a shard has
an index of its own: a code is split into substrings, and each substring's postings are kept by value. A query with a Hamming radius probes each substring with
all values within that substring's share of the radius; by the pigeonhole principle this retrieves every code within the
radius. Those are reranked by exact inner products, and shards hand on only their nearest, so what is merged for a query
does not grow with a shard. The radius is calibrated: true neighbours of a bounded sample of queries are found by brute
force, and the radius is the least that covers the wanted share of them. A shard that finds too few codes within the
radius widens it for that query.

Codes are not joined on their own: the radius that covers 96 % of true neighbours of nearly isotropic vectors leaves some
7 % of all rows to rerank, and fetching their vectors for each query would move far more than a block of queries beside
a shard does, which is rows * queries / 32,768 vectors in all.

Defined results: vectors that are null, zero, or hold nulls or values that are not finite take no part, nor do rows with
a null id; shorter vectors count as filled up with zeros; ties go to the smaller id; repeated rows are separate candidates, but
a query never finds its own id; a query row that is repeated has one result, and rows of one id with different vectors have one each; fewer candidates than asked for are all returned; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagewright.llm.common import durable, table

NEAREST = 20
#: Rows the rotation is learned on, and queries that the radius is calibrated on.
SAMPLE, CALIBRATION = 4000, 100
#: The share of true neighbours that the radius is to cover.
RECALL = 0.96
SUBSTRINGS = 8
#: Rows of a shard and queries of a block at most; some 70 MB of vectors of 64 components meet in a task.
SHARD, QUERIES = 65_536, 65_536
#: Rows that make a shard worth while.
LEAST = 2_048


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and vector (doubles) of the rows that take part."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where(F.col("vec_id").isNotNull() & finite & F.exists("vector", lambda x: x != 0))


def learn_rotation(x: np.ndarray, rounds: int = 40) -> np.ndarray:
    """Iterative quantisation: the rotation of the principal axes whose signs lose least. As many bits as dimensions,
    up to 64 (the leading axes)."""
    _, axes = np.linalg.eigh(x.T @ x)
    axes = axes[:, ::-1][:, :64]
    z = x @ axes
    turn = np.linalg.qr(np.random.default_rng(7).normal(size=(z.shape[1],) * 2))[0]
    for _ in range(rounds):
        u, _, vt = np.linalg.svd(np.where(z @ turn >= 0, 1.0, -1.0).T @ z)
        turn = (u @ vt).T
    return axes @ turn


def coded(x: np.ndarray, rotation: np.ndarray) -> np.ndarray:
    """64-bit codes of rows."""
    bits = np.zeros((len(x), 64), np.uint8)
    bits[:, : rotation.shape[1]] = x @ rotation >= 0
    return np.packbits(bits, axis=1, bitorder="little").view(np.uint64).ravel()


def _matrix(lists, width: int) -> np.ndarray:
    """Rows of so many components, filled up with zeros."""
    if len(lists) and all(len(x) == width for x in lists):
        return np.array(lists, np.float64)
    out = np.zeros((len(lists), width))
    for k, x in enumerate(lists):
        out[k, : len(x)] = x
    return out


def _stacked(column) -> np.ndarray:
    """The vectors of a column of bytes."""
    return np.frombuffer(b"".join(column)).reshape(len(column), -1)


def inner(q: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Inner products of one vector with rows; the same for equal rows wherever they stand."""
    return (rows * q).sum(1)


class MultiIndex:
    """The substring indexes of one shard's codes."""

    def __init__(self, codes: np.ndarray):
        self.codes, self.width = codes, 64 // SUBSTRINGS
        self.values = np.arange(1 << self.width, dtype=np.uint64)
        self.orders, self.starts = [], []
        for k in range(SUBSTRINGS):
            part = self.part(codes, k)
            self.orders.append(np.argsort(part, kind="stable"))
            self.starts.append(np.concatenate(([0], np.cumsum(np.bincount(part.astype(np.int64), minlength=1 << self.width)))))

    def part(self, codes, k: int):
        return (codes >> np.uint64(k * self.width)) & np.uint64((1 << self.width) - 1)

    def within(self, code: np.uint64, radius: int) -> np.ndarray:
        """Rows whose codes differ in at most so many bits."""
        seen = np.zeros(len(self.codes), bool)
        for k in range(SUBSTRINGS):
            share = (radius + 1 + k) // SUBSTRINGS - 1  # the shares add up to radius - substrings + 1
            if share < 0:
                continue
            probes = np.flatnonzero(np.bitwise_count(self.values ^ self.part(code, k)) <= share)
            order, starts = self.orders[k], self.starts[k]
            seen[np.concatenate([order[starts[value] : starts[value + 1]] for value in probes])] = True
        rows = np.flatnonzero(seen)
        return rows[np.bitwise_count(self.codes[rows] ^ code) <= radius]


def top(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best, ties to the smaller id."""
    if len(ids) > k:
        bar = np.partition(scores, len(scores) - k)[len(scores) - k]
        some = np.flatnonzero(scores >= bar)
    else:
        some = np.arange(len(ids))
    return some[np.lexsort((ids[some], -scores[some]))][:k]


def _search(rows: pd.DataFrame, queries: pd.DataFrame, radius: int | None, k: int) -> pd.DataFrame:
    """query_id, asked_id, vec_id, score, bits of each query's nearest in one shard; without a radius by brute force."""
    out = []
    if len(rows) and len(queries):
        rows = rows.sort_values("vec_id", kind="stable")
        ids, vectors, codes = rows["vec_id"].to_numpy(), _stacked(rows["vector"]), rows["code"].to_numpy().view(np.uint64)
        index = MultiIndex(codes)
        for query, asked, vector, code in zip(queries["query_id"], queries["asked_id"], _stacked(queries["asked"]), queries["asked_code"].to_numpy().view(np.uint64), strict=True):
            reach = 64 if radius is None else radius
            while True:
                found = index.within(code, reach) if reach < 64 else np.arange(len(ids))
                found = found[ids[found] != query]
                if len(found) >= k or reach >= 64:
                    break
                reach = min(64, reach + 4)
            best = found[top(ids[found], scores := inner(vector, vectors[found]), k)]
            scores = dict(zip(found.tolist(), scores.tolist(), strict=True))
            bits = np.bitwise_count(codes[best] ^ code)
            out += [(query, asked, ids[b], scores[b], int(n)) for b, n in zip(best.tolist(), bits, strict=True)]
    return pd.DataFrame(out, columns=["query_id", "asked_id", "vec_id", "score", "bits"])


def _nearest(index: DataFrame, queries: DataFrame, shards: int, blocks: int, radius: int | None, k: int) -> DataFrame:
    """query_id, rank, vec_id, score, bits: each block of queries meets each shard once, and shards' best are merged."""
    dealt = index.select("vec_id", "vector", "code", F.pmod(F.xxhash64("vec_id"), F.lit(shards)).alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    queries = queries.withColumn("asked_id", F.xxhash64("vec_id", "vector")).dropDuplicates(["vec_id", "asked_id"])
    asked = queries.select(F.col("vec_id").alias("query_id"), "asked_id", F.col("vector").alias("asked"), F.col("code").alias("asked_code"), F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("block"), F.explode(F.expr(f"sequence(0L, {shards - 1}L)")).alias("shard"))
    pairs = dealt.groupBy("shard", "block").cogroup(asked.groupBy("shard", "block"))
    found = pairs.applyInPandas(lambda a, b: _search(a, b, radius, k), "query_id long, asked_id long, vec_id long, score double, bits int")
    best = Window.partitionBy("query_id", "asked_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def nearest_neighbours(vectors: DataFrame, is_query, k: int = NEAREST, recall: float = RECALL) -> DataFrame:
    """query_id, rank, vec_id, score of each query's k nearest found among all rows. is_query: a condition on vec_id."""
    rows = usable(vectors)
    drawn = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).collect()
    if not drawn:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    width = rows.agg(F.max(F.size("vector"))).first()[0]
    rotation = learn_rotation(_matrix([r["vector"] for r in drawn], width))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("vector").to_pylist(), width)
            codes = coded(x, rotation) if len(x) else np.empty(0, np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array([row.tobytes() for row in x], pa.binary()), pa.array(codes.view(np.int64))], ["vec_id", "vector", "code"])

    index = durable(rows.mapInArrow(run, "vec_id long, vector binary, code long"))
    queries = index.where(is_query)
    n, asked = index.count(), queries.count()
    # as many cells as there are cores at least, so a small table is searched in parallel too
    blocks = max(1, -(-asked // QUERIES))
    shards = max(1, -(-n // SHARD), min(vectors.sparkSession.sparkContext.defaultParallelism // blocks, n // LEAST))
    tried = queries.orderBy(F.xxhash64("vec_id"), "vec_id").limit(CALIBRATION)
    bits = _nearest(index, tried, shards, 1, None, k).groupBy("bits").count().collect()
    counts = np.zeros(65)
    for r in bits:
        counts[r["bits"]] = r["count"]
    radius = int(np.searchsorted(np.cumsum(counts), recall * counts.sum())) if counts.sum() else 64
    return _nearest(index, queries, shards, blocks, radius, k).select("query_id", "rank", "vec_id", "score")


def op4_nearest(spark, sf_dir: str) -> DataFrame:
    """The 20 nearest of each vector whose id is divisible by 20."""
    return nearest_neighbours(table(spark, sf_dir, "embeddings"), "vec_id % 20 = 0")
