import numpy as np
from pyspark.sql import functions as F

from pagewright.llm import quality as Q
from tests.llm.conftest import odd_rows


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    seen = labels.where("doc_id % 4 <> 0")
    scored = Q.score(docs, Q.train(docs, seen)).join(labels.where("doc_id % 4 = 0").withColumnRenamed("quality", "truth"), "doc_id")
    hits = scored.select(((F.col("score") >= Q.KEEP) == (F.col("truth") == 1)).cast("int").alias("hit"), ((F.col("metadata_score") >= 0.5) == (F.col("truth") == 1)).cast("int").alias("meta")).agg(F.avg("hit"), F.avg("meta"), F.count("*")).first()
    assert hits[2] > 60 and hits[0] >= 0.97 and hits[1] >= 0.8


def test_metadata_does_not_read_the_text():
    import inspect

    assert list(inspect.signature(Q.metadata_view).parameters) == ["lang", "source", "n_chars"]


def test_odd_documents(spark, odd, clashing, nothing):
    labels = spark.createDataFrame([(1, 1, 0), (5, None, 0), (None, 0, 0)], "doc_id long, quality int, toxic int")
    assert Q.train(odd, labels) is None and Q.good(odd, labels).count() == len(odd_rows())
    assert {r.score for r in Q.score(odd, None).collect()} == {1.0}
    for both in ([(i, i % 2, 0) for i in range(1, 17)], [(1, 1, 0), (8, 0, 0)], [(1, 1, 0), (8, 0, 0), (9, 0, 0)]):
        models = Q.train(odd, spark.createDataFrame(both, "doc_id long, quality int, toxic int"))
        rows = Q.score(odd, models).collect()
        assert len(rows) == len(odd_rows()) and all(0 <= r.score <= 1 for r in rows)
        assert Q.score(clashing, models).count() == len(rows)
    kept = Q.good(odd, spark.createDataFrame([(1, 1, 0), (8, 0, 0)], "doc_id long, quality int, toxic int")).collect()
    want = [r for r in Q.score(odd, Q.train(odd, spark.createDataFrame([(1, 1, 0), (8, 0, 0)], "doc_id long, quality int, toxic int"))).collect() if r.score >= Q.KEEP]
    assert sorted(map(str, kept)) == sorted(str(r).split(", content_score")[0] + ")" for r in want) and 0 < len(kept) < len(rows)
    assert Q.train(nothing, labels) is None and Q.score(nothing, models).count() == 0


def plain_co_training(views, y, pool, numbers):
    """The rounds on whole arrays in one place: views and y of labelled rows, the pool's views and dealing numbers."""
    every = [np.vstack([v, p]) for v, p in zip(views, pool)]
    held = np.arange(len(y)) % 3 == 0
    z = lambda k, x: np.clip((x - every[k].mean(0)) / (every[k].std(0) + 1e-6), -8, 8)

    def fit(a, w, t, steps):
        """Steps to the least of the tangent bound of the logistic loss."""
        a = np.column_stack([np.ones(len(a)), a])
        ridge = np.diag([1e-3] + [1.0] * (a.shape[1] - 1))
        for _ in range(steps):
            o = a @ w
            curve = np.tanh(abs(o) / 2 + 1e-9) / (2 * abs(o) + 4e-9)
            new = w - np.linalg.solve(a.T @ (a * curve[:, None]) + ridge, a.T @ (1 / (1 + np.exp(-np.clip(o, -30, 30))) - t) + ridge @ w)
            w, before = new, w
            if abs(w - before).max() < 1e-6:
                break
        return w

    raw = lambda k, w, x: np.clip(z(k, x) @ w[1:] + w[0], -30, 30)

    def odds(k, w, x):
        own = raw(k, w, views[k][held])
        mean, scale = own.mean(), own.std() + 1e-6
        c = fit(np.clip((own - mean) / scale, -8, 8)[:, None], np.zeros(2), y[held], 100)
        return np.clip(c[0] + c[1] * np.clip((raw(k, w, x) - mean) / scale, -8, 8), -30, 30)

    ws = [fit(z(k, v[~held]), np.zeros(v.shape[1] + 1), y[~held], 100) for k, v in enumerate(views)]
    given, rate, n = [{}, {}], float(np.clip(y.mean(), 0.02, 0.98)), len(numbers)
    for _ in range(Q.ROUNDS):
        new = [{}, {}]
        for me in (0, 1):
            o = odds(me, ws[me], pool[me])
            for label in (1, 0):
                most = Q.HANDED * n * (rate if label else 1 - rate)
                bins = {}
                for i in range(n):
                    at = int(Q._bin(np.array([o[i] if label else -o[i]]))[0])
                    if at >= 0 and i not in given[1 - me]:
                        bins.setdefault(at, []).append(i)
                for at in sorted(bins, reverse=True):
                    share = min(1.0, most / len(bins[at]))
                    new[1 - me] |= {i: label for i in bins[at] if share == 1.0 or numbers[i] < share}
                    most -= len(bins[at])
                    if most <= 0:
                        break
        for k in (0, 1):
            given[k] = new[k] | given[k]
            at = sorted(given[k])
            x = np.vstack([views[k][~held], pool[k][at]])
            ws[k] = fit(z(k, x), ws[k], np.concatenate([y[~held], [given[k][i] for i in at]]), Q.STEPS)
    return ws, given


def test_the_rounds_are_those_of_a_plain_version(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rows = {r.doc_id: r.quality for r in labels.orderBy("doc_id").limit(60).collect()}
    blocks = Q.features(docs)
    chosen = Q._rows_of(blocks, rows)
    views = [np.array([r[c] for r in chosen]) for c in ("content", "metadata")]
    y = np.array([r["quality"] for r in chosen]) > 0
    pool = Q.Pool(blocks, np.array(list(rows), np.int64))
    trained = Q.co_train(tuple(views), y, pool)
    ids, parts = [], [[], []]
    for b in blocks.collect():
        ids += b.ids
        for part, c in zip(parts, ("content", "metadata")):
            part.append(np.frombuffer(b[c]).reshape(len(b.ids), -1))
    free = ~np.isin(ids, list(rows))
    others = [np.vstack(p)[free] for p in parts]
    ws, given = plain_co_training(views, y.astype(float), others, Q.dealt(np.array(ids)[free]))
    assert len(given[0]) + len(given[1]) > 10
    for w, model in zip(ws, trained.models):
        assert np.allclose(w, model.model.w, atol=1e-4)


def test_the_exchange_covers_all_documents_without_a_training_label(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rows = {r.doc_id: r.quality for r in labels.orderBy('doc_id').limit(200).collect()}
    many = docs.drop("doc_id").selectExpr("*", "explode(sequence(1, 5)) as copy").selectExpr("monotonically_increasing_id() + 10000000 as doc_id", "lang", "source", "n_chars", "text")
    every = docs.select("doc_id", "lang", "source", "n_chars", "text").union(many)
    blocks = Q.features(every)
    pool = Q.Pool(blocks, np.array(list(rows), np.int64))
    chosen = Q._rows_of(blocks, rows)
    views = tuple(np.array([r[c] for r in chosen]) for c in ("content", "metadata"))
    Q.co_train(views, np.array([r["quality"] for r in chosen]) > 0, pool, 2)
    sums = pool.total(lambda some, got: {0: np.array([len(got[0]), *((~np.isnan(g)).sum() for g in got)], float)})
    n = every.count() - len(rows)
    assert sums[0][0] == n > 3000
    # each view may hand over 5 % of all in each of two rounds; a pool of 3,000 would give 300 at most
    assert max(sums[0][1:]) > 300 and max(sums[0][1:]) <= 0.1 * n * 1.1
