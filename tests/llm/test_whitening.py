import math
import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from pagewright.llm import whitening as W

SCHEMA = "vec_id long, embedding array<float>"


def plain(vectors, most):
    """vec_id: deviation, and eigenvalues, components, whitened rows by a plain decomposition of the centred rows."""
    x = np.array([[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for _, v in vectors], dtype=np.int64)
    n, s = len(x), x.sum(0)
    deviation = [sum((n * int(a) - int(b)) ** 2 for a, b in zip(row, s, strict=True)) for row in x]
    y = (n * x - s) / n
    _, sigma, axes = np.linalg.svd(y, full_matrices=False)
    k = min(most, int((sigma > 1e-10 * sigma[0]).sum()))
    values = sigma**2 / n
    return deviation, values[:k] / values.sum(), y @ axes[:k].T / np.sqrt(values[:k])


def check(rows, vectors, most):
    deviation, explained, white = plain(vectors, most)
    k = len(explained)
    assert Counter(r.vec_id for r in rows) == Counter(i for i, _ in vectors for _ in range(k))
    want = {}
    for (i, _), d, w in zip(vectors, deviation, white, strict=True):
        want[i] = (d, w)
    signs = {}
    for r in rows:
        d, w = want[r.vec_id]
        assert r.n == len(vectors) and r.deviation == (d if d < 1 << 63 else None) and 1 <= r.component <= k
        assert abs(r.explained - explained[r.component - 1]) <= 1e-6 * explained[r.component - 1]
        assert r.identity_error <= 1e-9
        if abs(w[r.component - 1]) > 1e-3:
            sign = signs.setdefault(r.component, np.sign(r.whitened * w[r.component - 1]))
            assert abs(r.whitened * sign - w[r.component - 1]) < 1e-6, r


def drawn(n, d, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d)) * (0.9 ** np.arange(d)) @ np.linalg.qr(rng.normal(size=(d, d)))[0]
    return [(i, [float(np.float32(c)) for c in row]) for i, row in enumerate(x)]


def test_equals_a_plain_decomposition(spark):
    vectors = drawn(400, 12)
    check(W.whiten(spark.createDataFrame(vectors, SCHEMA).repartition(5), 7).collect(), vectors, 7)


def test_dimensions_that_depend_on_each_other(spark):
    """One dimension constant, one the copy of another, one almost so; and fewer rows than dimensions."""
    rng = random.Random(3)
    vectors = []
    for i in range(300):
        a, b = rng.gauss(0, 30), rng.gauss(0, 1)
        vectors.append((i, [a, a, a + (1 / 64 if i == 7 else 0), 0.25, b]))
    rows = W.whiten(spark.createDataFrame(vectors, SCHEMA), 5).collect()
    assert {r.component for r in rows} == {1, 2, 3}
    check(rows, vectors, 5)
    few = drawn(6, 20, 2)
    rows = W.whiten(spark.createDataFrame(few, SCHEMA), 32).collect()
    assert {r.component for r in rows} == set(range(1, 6))
    check(rows, few, 32)


def test_small_variances_beside_large_ones(spark):
    """A condition of 1e7, the square of which no double holds."""
    rng = random.Random(4)
    vectors = [(i, [rng.uniform(-1e6, 1e6) * 16, rng.uniform(-2, 2), rng.uniform(-2, 2)]) for i in range(200)]
    exact = [(i, [float(np.float32(c)) for c in v]) for i, v in vectors]
    check(W.whiten(spark.createDataFrame(exact, SCHEMA), 3).collect(), exact, 3)


def test_odd_rows(spark):
    good = drawn(60, 4)
    odd = [(100, None), (101, []), (102, [1.0, None, 0.0, 0.0]), (103, [1.0, float("nan"), 0.0, 0.0]), (104, [float("inf"), 0.0, 0.0, 0.0]), (105, [1.0, 2.0]), (106, [3e38, 0.0, 0.0, 0.0])]
    vectors = spark.createDataFrame([*good, *odd, (None, good[0][1]), good[3], good[3]], SCHEMA).withColumns({"n": F.lit("own"), "vector": F.lit(1), "component": F.lit(2)})
    rows = W.whiten(vectors, 4).collect()
    taking = [*good, (None, good[0][1]), good[3], good[3]]
    check(rows, taking, 4)
    assert W.whiten(spark.createDataFrame([], SCHEMA)).count() == 0
    assert W.whiten(spark.createDataFrame([(1, [0.5, 0.5]), (2, [0.5, 0.5])], SCHEMA)).count() == 0
    far = W.whiten(spark.createDataFrame([(i, [float(2**45 * (i % 2)), 0.0]) for i in range(4)], SCHEMA)).collect()
    assert {r.deviation for r in far} == {None} and len(far) == 4


def test_query(spark, sf):
    found = W.op12_whitening(spark, sf)
    assert found.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    vectors = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    check(found.collect(), [(i, v) for i, v in vectors if v and all(c is not None and math.isfinite(c) for c in v)], 32)
