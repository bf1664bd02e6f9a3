import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagewright.llm import ann


def plain(vectors, query, k):
    x = np.array([v for _, v in vectors])
    q = np.array(dict(vectors)[query])
    score = [(-float((row * q).sum()), i) for (i, _), row in zip(vectors, x) if i != query]
    return [i for _, i in sorted(score)[:k]]


def test_within_is_every_code_of_the_radius():
    rng = np.random.default_rng(3)
    codes = rng.integers(0, 2**63, 400, dtype=np.int64).view(np.uint64)
    codes[200:] = codes[:200] ^ np.uint64(5)
    index = ann.MultiIndex(codes)
    for radius in (0, 2, 7, 8, 20, 26, 40):
        assert index.within(codes[0], radius).tolist() == np.flatnonzero(np.bitwise_count(codes ^ codes[0]) <= radius).tolist()


@pytest.mark.parametrize("shard, block", [(ann.SHARD, ann.QUERIES), (150, 7)])
def test_recall(spark, monkeypatch, shard, block):
    """In one shard and block, and in many."""
    monkeypatch.setattr(ann, "SHARD", shard)
    monkeypatch.setattr(ann, "QUERIES", block)
    sf = "/root/testdata/sf0.01"
    rows = [(r.vec_id, [float(x) for x in r.embedding]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    found = {}
    for r in ann.op4_nearest(spark, sf).orderBy("query_id", "rank").collect():
        found.setdefault(r.query_id, []).append(r.vec_id)
        assert r.score == float((np.array(dict(rows)[r.query_id]) * np.array(dict(rows)[r.vec_id])).sum())
    queries = [i for i, _ in rows if i % 20 == 0]
    assert sorted(found) == queries and all(len(v) == 20 for v in found.values())
    hits = sum(len(set(found[q]) & set(plain(rows, q, 20))) for q in queries)
    assert hits / (20 * len(queries)) >= 0.9


def test_odd_vectors(spark):
    rng = random.Random(1)
    rows = [(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(12)]
    rows += [(20, rows[3][1]), (21, rows[3][1]), (22, rows[3][1])]
    rows += [(30, [1.0, 2.0]), (31, [9.0] * 7)]  # as if filled up with zeros
    bad = [(40, None), (60, [0.0] * 8), (80, [math.nan] + [1.0] * 7), (100, [math.inf] + [1.0] * 7), (120, [None] + [1.0] * 7), (140, []), (None, rows[0][1])]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>")
    kept = [(r.vec_id, [float(x) for x in r.embedding] + [0.0] * (8 - len(r.embedding))) for r in df.collect() if r.vec_id is not None and r.vec_id < 40]
    out = ann.nearest_neighbours(df, "vec_id % 20 = 0", k=5).orderBy("query_id", "rank").collect()
    for q in (0, 20):
        own = [r for r in out if r.query_id == q]
        assert [r.rank for r in own] == [1, 2, 3, 4, 5]
        assert [r.vec_id for r in own] == [i for _, i in sorted((-r.score, r.vec_id) for r in own)] and q not in [r.vec_id for r in own]
    assert {r.query_id for r in out} == {0, 20}
    assert [r.vec_id for r in out if r.query_id == 20][:3] == [3, 21, 22] or len(kept) > 5
    every = ann.nearest_neighbours(df, "vec_id % 20 = 0", k=50).collect()
    assert len(every) == 2 * (len(kept) - 1)
    assert all(abs(r.score - float((np.array(dict(kept)[r.query_id]) * np.array(dict(kept)[r.vec_id])).sum())) < 1e-12 for r in every)
    clashing = df.withColumns({c: F.lit(f"own {c}") for c in ("code", "vector", "shard", "block", "asked", "query_id", "bits", "rank", "score")})
    assert sorted(ann.nearest_neighbours(clashing, "vec_id % 20 = 0", k=50).collect()) == sorted(every)
    twice = ann.nearest_neighbours(df.union(df.where("vec_id in (3, 20)")), "vec_id % 20 = 0", k=50).where("query_id = 0").collect()
    assert len(twice) == len(kept) - 1 + 2 and sum(r.vec_id == 3 for r in twice) == 2
    assert ann.nearest_neighbours(df.where("vec_id = 40"), "true").count() == 0
    assert ann.nearest_neighbours(df.limit(0), "true").count() == 0


def test_a_repeated_query_has_one_whole_result(spark):
    """And one for each vector where rows of one id have several."""
    rng = np.random.default_rng(9)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(200, 8)))]
    other = rng.normal(size=8).tolist()
    df = spark.createDataFrame([*rows, rows[40], rows[40], (60, other)], "vec_id long, embedding array<double>")
    found = {}
    for r in ann.nearest_neighbours(df, "vec_id % 20 = 0", 20, recall=1.0).collect():
        found.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert sorted(r for r, _, _ in found[40]) == list(range(1, 21)) and len({i for _, i, _ in found[40]}) == 20
    want = plain(rows, 40, 20)
    assert len(set(want) & {i for _, i, _ in found[40]}) >= 19
    assert sorted(r for r, _, _ in found[60]) == sorted([*range(1, 21)] * 2)
    assert all(len(found[q]) == 20 for q in range(0, 200, 20) if q != 60)
