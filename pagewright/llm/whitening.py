"""Whitening of embeddings by shifted CholeskyQR.

Vectors become rows of integers, x = floor(64 * entry) + 1,000,000. With n rows and the sums S of each dimension, the
centred rows are (n * x - S) / n, where the numerator is exact. Distributed Gram passes orthogonalise them: a pass sums
the Gram matrix of the rows as they are after all factors so far (triangular solves, in the tasks), and its Cholesky
factor joins the product R. A Gram matrix that is close to singular gets a small multiple of the identity first, and the
passes go on until the rows are orthonormal, or, where dimensions depend on each other, until they are a projection of
orthonormal ones. Centred rows are then Q R with orthonormal Q, so the singular values of R are those of all rows, though
no Gram matrix with the square of their condition is ever relied on: they give the eigenvalues e = sigma^2 / n and the
components. Only matrices of dimension x dimension reach the driver; rows are read once for each pass.

Defined results: rows whose vector is null or holds null or non-finite entries take no part, nor do empty vectors and
those of another length than most rows have (ties: the longest), nor entries of 2^56 and more in size, whose x is no
long; the row of a null id takes part. Repeated rows are rows of their own. Directions in which the rows do not vary (to
double precision) have no component, so fewer than asked for may be returned, and none of a table whose rows are all
equal. A deviation beyond a long is null. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.llm.common import table

SCALE, OFFSET, COMPONENTS = 64, 1_000_000, 32
#: Rows that a task holds decoded.
BLOCK = 4096
#: Gram passes at most; three do for any rows of full rank.
PASSES = 8
#: How far from the identity (or a projection) a Gram matrix may be when the rows before it count as orthonormal.
ORTHONORMAL = 1e-9
#: Singular values below this share of the largest are rounding.
NOTHING = 1e-12
MOST = float(1 << 56)


def usable(vectors: DataFrame) -> tuple[DataFrame, int]:
    """vec_id and vector (doubles) of the rows that take part, and the number of their dimensions."""
    finite = F.forall("vector", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < MOST))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector")).where(finite & (F.size("vector") > 0))
    sizes = rows.groupBy(F.size("vector").alias("width")).count().orderBy(F.desc("count"), F.desc("width")).limit(1).collect()
    width = sizes[0]["width"] if sizes else 0
    return rows.where(F.size("vector") == width), width


def _blocks(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Batches with their integer rows."""
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK):
            part = batch.slice(at, BLOCK)
            entries = part.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            yield part, np.floor(SCALE * entries).astype(np.int64) + OFFSET


def _summed(rows: DataFrame, width: int, of: Callable[[np.ndarray], np.ndarray], kind: str) -> np.ndarray:
    """The sum over all blocks of what `of` makes of a block; tasks sum up their own first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for _, x in _blocks(batches, width):
            part = of(x).ravel()
            total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(total)], ["place", "value"])

    parts = rows.select("vector").mapInArrow(run, f"place int, value {kind}")
    found = parts.groupBy("place").agg(F.sum("value").alias("value")).collect()  # as many as a matrix has entries
    out = np.zeros(max((r["place"] for r in found), default=-1) + 1, np.int64 if kind == "long" else np.float64)
    for r in found:
        out[r["place"]] = r["value"]
    return out


def _centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """x - S / n, each entry rounded once."""
    exact = n * x - sums
    if n * float(np.abs(x).max(initial=0)) >= 2.0**62:
        exact = n * x.astype(object) - sums.astype(object)
    return (exact / n).astype(np.float64)


def _solved(rows: np.ndarray, factors: list[np.ndarray]) -> np.ndarray:
    """rows R1^-1 R2^-1 ..., one triangular solve for each factor."""
    for factor in factors:
        rows = np.linalg.solve(factor.T, rows.T).T
    return rows


def _factor(gram: np.ndarray, rows: int) -> np.ndarray:
    """The upper Cholesky factor of a Gram matrix, shifted as little as makes the factorisation sure."""
    d = len(gram)
    shift = 11 * d * (min(rows, BLOCK) + d + 1) * np.finfo(float).eps / 2 * np.linalg.norm(gram, 2)
    least = np.linalg.eigvalsh(gram)[0]
    if least > shift * 100:
        return np.linalg.cholesky(gram).T
    while True:
        try:
            return np.linalg.cholesky(gram + shift * np.eye(d)).T
        except np.linalg.LinAlgError:
            shift *= 10


def cholesky_qr(gram_of: Callable[[list[np.ndarray]], np.ndarray], width: int, n: int) -> np.ndarray:
    """R of the centred rows. gram_of sums the Gram matrix of the rows after the factors it is given."""
    product, factors = np.eye(width), []
    for _ in range(PASSES):
        gram = gram_of(factors)
        gram = (gram + gram.T) / 2
        size = np.linalg.norm(gram, 2)
        if size == 0:
            return np.zeros((width, width))
        if np.abs(gram @ gram - gram).max() < ORTHONORMAL:
            # orthonormal rows, or a projection of them: what is left of the identity goes into R
            values, axes = np.linalg.eigh(gram)
            return (np.sqrt(np.clip(values, 0, None))[:, None] * axes.T) @ product
        factor = _factor(gram, n)
        factors.append(factor)
        product = factor @ product
    return product


def principal(r: np.ndarray, n: int, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Eigenvalues and components (rows) of the covariance from R, largest first, and the share each explains."""
    _, sigma, axes = np.linalg.svd(r)
    values = sigma**2 / n
    keep = min(most, int((sigma > NOTHING * max(sigma[0], 1e-300)).sum()))
    return values[:keep], axes[:keep], values[:keep] / max(values.sum(), 1e-300)


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """vec_id, component (from 1), n, deviation, whitened, explained and identity_error of each row and component."""
    spark = vectors.sparkSession
    kinds = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    rows, width = usable(vectors)
    if not width:
        return spark.createDataFrame([], kinds)
    first = _summed(rows, width, lambda x: np.append(x.sum(0), len(x)), "long")
    sums, n = first[:-1], int(first[-1])

    def gram_of(factors: list[np.ndarray]) -> np.ndarray:
        def part(x: np.ndarray) -> np.ndarray:
            q = _solved(_centred(x, n, sums), factors)
            return q.T @ q

        return _summed(rows, width, part, "double").reshape(width, width)

    values, axes, explained = principal(cholesky_qr(gram_of, width, n), n, components)
    k = len(values)
    if not k:
        return spark.createDataFrame([], kinds)
    turn = axes.T / np.sqrt(values)

    def moments(x: np.ndarray) -> np.ndarray:
        white = _centred(x, n, sums) @ turn
        return np.concatenate([white.sum(0), (white.T @ white).ravel()])

    found = _summed(rows, width, moments, "double")
    mean = found[:k] / n
    error = float(np.abs(found[k:].reshape(k, k) / n - np.outer(mean, mean) - np.eye(k)).max())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, x in _blocks(batches, width):
            away = n * x - sums
            if len(x) and (n * float(np.abs(x).max()) >= 2.0**62 or width * float(np.abs(away).max()) ** 2 >= 2.0**62):
                exact = ((n * x.astype(object) - sums.astype(object)) ** 2).sum(1)
                deviation = pa.array([v if v < 1 << 63 else None for v in exact], pa.int64())
            else:
                deviation = pa.array((away**2).sum(1))
            each = np.repeat(np.arange(len(x)), k)
            white = (_centred(x, n, sums) @ turn).ravel()
            columns = [
                part.column("vec_id").take(pa.array(each)),
                pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                pa.array(np.full(len(each), n)),
                deviation.take(pa.array(each)),
                pa.array(white),
                pa.array(np.tile(explained, len(x))),
                pa.array(np.full(len(each), error)),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(run, kinds)


def op12_whitening(spark, sf_dir: str) -> DataFrame:
    """The 32 leading whitened components of every usable vector."""
    return whiten(table(spark, sf_dir, "embeddings"))
