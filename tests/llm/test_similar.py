import random
from pathlib import Path

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from pagewright.llm import simhash as N
from pagewright.session import CLEANUP, durable, passing
from tests.llm import brute
from tests.llm.conftest import SCHEMA, odd_rows, prose


def sets_of(docs):
    def parts(text):
        w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}

    return {d: parts(t) for d, t in docs}


def second(text):
    """The fingerprint of the second family, in whole numbers."""
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    hashes, most = [], (1 << 64) - 1
    for i in range(max(1, len(w) - 4)):
        x = (xxhash.xxh64_intdigest(b" ".join(w[i : i + 5]), 42) + 0x9E3779B97F4A7C15) & most
        x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & most
        x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & most
        hashes.append(x ^ (x >> 31))
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain(docs):
    """doc_id: component of every document, all pairs compared on the words themselves."""
    sets, prints = sets_of(docs), {d: (brute.simhash(t, 5), second(t)) for d, t in docs}

    def linked(a, b):
        near = min((x ^ y).bit_count() for x, y in zip(prints[a], prints[b], strict=True)) <= N.WIDE or not sets[a] - {()}
        return near and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])

    return brute.classes(list(sets), linked)


def edited(text, rng, edits):
    w = text.split()
    for at in rng.sample(range(len(w)), edits):
        w[at] = f"edit{rng.random()}"
    return " ".join(w)


def test_edited_copies_are_grouped_as_a_plain_version_does(spark):
    rng = random.Random(3)
    rows = []
    for k in range(12):
        base = prose(100 + k, 400)
        rows += [base, *(edited(base, rng, n) for n in (1, 3, 5, 6, 7, 8, 9, 12))]
    rows = [(i * 7 % 1009, t) for i, t in enumerate(rows)] + [(2000 + r[0], r[1]) for r in odd_rows()[:16]]
    found = N.similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in found} == plain(rows) and len(found) == len(rows)


def test_a_large_group_and_no_rows(spark, nothing):
    rng = random.Random(4)
    base = prose(9, 300)
    rows = [(i, edited(base, rng, rng.randint(2, 6))) for i in range(150)] + [(900, prose(10, 300))]
    found = N.similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in found} == plain(rows)
    for crowd in (3, 20):  # stars first, nearly everywhere
        found = N.similar_documents(spark.createDataFrame(rows, "doc_id long, text string"), crowd=crowd).collect()
        assert {r.doc_id: r.component_id for r in found} == plain(rows)
    assert N.similar_documents(nothing).count() == 0


def test_the_stage_drops_copies_with_a_few_per_cent_of_edits(spark):
    base, rng = prose(11, 400), random.Random(5)
    rows = [(i, edited(base, rng, 4) if i else base, "en", "a", 1) for i in range(5)] + [(9, prose(12, 400), "en", "a", 1)]
    left = corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame(rows, SCHEMA), "").collect()
    assert {r.doc_id for r in left} == {0, 9}


def test_texts_edited_in_many_places_are_not_compared_with_all(spark):
    """A text in the middle, copies with few edits, which are like it, and with more, which are like none."""
    from pagewright.llm import shingles as S

    rng = random.Random(8)
    base = prose(21, 300)
    rows = [(0, base)] + [(i, edited(base, rng, 2 if i % 2 else 9 + i % 5)) for i in range(1, 160)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: r.component_id for r in N.similar_documents(docs, crowd=10).collect()}
    assert found == plain(rows)
    own = {r.id: r.n_own for r in S.own_shingles(spark.createDataFrame([(i, bytearray(S.shingles(S.normal(t.encode())).tobytes())) for i, t in rows], "id long, set binary")).collect()}
    sets = sets_of(rows)
    counts = {}
    for s in sets.values():
        for h in s:
            counts[h] = counts.get(h, 0) + 1
    assert own == {k: n for k, s in sets.items() if (n := sum(counts[h] == 1 for h in s))}


def test_bitmaps_bound_what_can_be_shared(spark):
    from pagewright.llm import shingles as S

    rng = np.random.default_rng(4)
    base = rng.integers(0, 2**63, 300).astype(np.uint64)
    sets = {k: np.unique(np.concatenate([base[: 300 - 20 * k], rng.integers(0, 2**63, 20 * k).astype(np.uint64)])) for k in range(8)} | {9: base[:0]}
    maps = S.sketches(spark.createDataFrame([(k, bytearray(s.tobytes())) for k, s in sets.items()], "id long, set binary"))
    a = maps.select(F.col("id").alias("a"), F.col("sketch").alias("a_sketch"))
    for r in maps.crossJoin(a).select("a", "id", S._missing("a_sketch", "sketch").alias("n")).collect():
        only = len(np.setdiff1d(sets[r.a], sets[r.id]))
        assert r.n <= only and (r.n >= 0.6 * only or r.a == 9)


def test_crowded_texts_are_linked_with_others_as_well(spark):
    """Chains of edits that lead away from a crowd: its bound must not touch pairs that are only partly in it."""
    rng, rows = random.Random(11), []
    base = prose(31, 260)
    for i in range(60):
        rows.append(edited(base, rng, i % 3))
    for chain in range(6):
        text = base
        for _ in range(9):
            text = edited(text, rng, (4, 6, 9)[chain % 3])
            rows += [text, edited(text, rng, 1)]
    for k in range(5):
        rows += [prose(40 + k, 200), prose(40 + k, 200) + " more", prose(60 + k, 50)]
    rows = [(i * 5 % 1009, t) for i, t in enumerate(rows)]
    want = plain(rows)
    assert 12 < len(set(want.values())) < len(rows) - 60
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for crowd in (4, 12, 30):
        assert {r.doc_id: r.component_id for r in N.similar_documents(docs, crowd=crowd).collect()} == want, crowd


def test_recall_at_the_limit(spark):
    """Pairs with a similarity of 0.8 to 0.86, whatever their fingerprints: nine in ten or more are linked, and no others."""
    rng, rows = random.Random(21), []
    for k in range(220):
        base = prose(500 + k, rng.randint(120, 500))
        n = len(base.split())
        rows += [(2 * k, base), (2 * k + 1, edited(base, rng, max(1, round(n * rng.uniform(0.015, 0.026)))))]
    sets = sets_of(rows)
    alike = {k for k in range(220) if len(sets[2 * k] & sets[2 * k + 1]) >= 0.8 * len(sets[2 * k] | sets[2 * k + 1])}
    found = {r.doc_id: r.component_id for r in N.similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    linked = {k for k in range(220) if found[2 * k + 1] == 2 * k}
    assert linked <= alike and len(linked) >= 0.9 * len(alike) and 60 < len(alike) < 220
    assert all(found[2 * k] == 2 * k for k in range(220))


def test_texts_that_meet_in_many_cells_are_paired_once(spark):
    rng = random.Random(12)
    centre = rng.getrandbits(64)
    rows = []
    for k in range(120):  # within a few bits of each other, so that they meet on most partitions
        fp = centre
        for bit in rng.sample(range(64), rng.randint(0, 8)):
            fp ^= 1 << bit
        rows.append((k, N._signed(fp), rng.choice((100, 101, 112, 124, 126, 155))))
    plan = [(bits, 1) for bits in ([*range(p, 64, 6)] for p in range(6))] + [([3, 5, 8], 0)]
    own = lambda size: F.floor(F.log(F.col(size).cast("double")) / -np.log(0.8).item()).cast("int")
    exact = [(p, sum(1 << b for b in bits), 0) for p, (bits, _) in enumerate(plan)]
    flips = [(p, exact[p][1], flip) for p, (bits, most) in enumerate(plan) for flip in N._flips(bits, most)]
    texts = spark.createDataFrame(rows, "id long, fp long, size long").withColumn("own", own("size"))
    a = N._cells(texts, F.col("fp"), flips, [0]).select("cell", *[F.col(c).alias(f"a_{c}") for c in ("id", "fp", "size")])
    met = a.join(N._cells(texts, F.col("fp"), exact, [0, -1]), "cell").where("a_id <> id").withColumn("first", N._first_meeting(plan, own))
    met = met.select(F.least("a_id", "id").alias("a"), F.greatest("a_id", "id").alias("b"), "first")
    pairs = met.groupBy("a", "b").agg(F.count("*").alias("n"), F.sum(F.col("first").cast("int")).alias("firsts")).collect()
    assert len(pairs) > 1000 and max(r.n for r in pairs) > 4 and {r.firsts for r in pairs} == {1}


def test_what_a_search_keeps_on_its_way_is_removed(spark):
    sc = spark.sparkContext
    texts = [(i, prose(200 + i // 2, 60) + " x" * (i % 2)) for i in range(12)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").selectExpr("*", "'en' lang", "'s' source", "1L n_chars")
    held = durable(docs)
    top = Path(sc.getCheckpointDir().removeprefix("file:")).parent
    before = {p.name for p in top.rglob("rdd-*")}
    found = corpus_pipeline.drop_near_duplicates(spark, held, "")
    assert len({p.name for p in top.rglob("rdd-*")} - before) == 1  # the components alone
    assert found.count() == 6 and held.count() == 12 and durable(docs).count() == 12
    assert spark.conf.get(CLEANUP) == "false"


def test_what_failed_leaves_nothing_and_settings_as_they_were(spark):
    top = Path(durable(spark.range(3)).sparkSession.sparkContext.getCheckpointDir().removeprefix("file:")).parent

    def fails():
        durable(spark.range(5))
        raise KeyError("on its way")

    with pytest.raises(KeyError):
        passing(spark, fails)
    assert not list(top.glob("passing-*")) and spark.conf.get(CLEANUP) == "false" and durable(spark.range(4)).count() == 4
    assert passing(spark, lambda: passing(spark, lambda: durable(spark.range(6)))).count() == 6


def test_sets_of_texts_that_are_close_by_chance_are_not_made(spark):
    """Fingerprints within a few bits of each other, of sets that have nothing in common but for two."""
    from pagewright.llm import shingles as S

    rng, centre = random.Random(14), random.Random(15).getrandbits(64)
    sets = {k: np.unique(np.array([rng.getrandbits(64) for _ in range(rng.randint(190, 200))], np.uint64)) for k in range(30)}
    sets[40] = np.sort(np.concatenate([sets[7][:-9], np.array([rng.getrandbits(64) for _ in range(4)], np.uint64)]))
    rows = []
    for k, own in sets.items():
        fps = [N._signed(centre ^ sum(1 << b for b in rng.sample(range(64), 3))) for _ in range(2)]
        rows.append((k, len(own), fps, S.bitmap(own)))
    made = set()

    class Recorded:
        def of(self, ids):
            asked = {r.id for r in ids.distinct().collect()}
            made.update(asked)
            return spark.createDataFrame([(k, bytearray(sets[k].tobytes())) for k in asked], "id long, set binary")

    texts = spark.createDataFrame(rows, "id long, size long, fps array<long>, map array<long>")
    assert {(r.a, r.b) for r in N.alike_links(texts, Recorded(), len(rows)).collect()} == {(7, 40)}
    assert made == {7, 40}


def test_fingerprints_that_share_a_cell_are_compared_as_tables(spark):
    from pagewright.llm import shingles as S

    rng, rows = random.Random(16), []
    for k in range(900):
        rows.append((k, N._signed(rng.getrandbits(64) & 0x3FFFF), rng.randint(100, 160), (-5, 0, 3, 8)[min(3, k // 200)]))  # the last cell is in several batches
    probes = [(1000 + i, fp, size, at) for i, fp, size, at in rows[::5]] + [(5000, 1, 120, 99)]
    kinds = "id long, fp long, size long, at long"
    batch = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "70")
    try:
        found = S.close_in_cells(spark.createDataFrame(probes, kinds), spark.createDataFrame(rows, kinds), 4).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    want = {(p[0], r[0], r[3]) for p in probes for r in rows if p[3] == r[3] and (p[1] ^ r[1]).bit_count() <= 4 and min(p[2], r[2]) >= 0.8 * max(p[2], r[2])}
    assert {(r.a_id, r.id, r.cell) for r in found} == want and len(found) == len(want) > 500


def test_pieces_of_a_crowded_cell_meet_in_all_pairs(spark, monkeypatch):
    from pagewright.llm import shingles as S

    monkeypatch.setattr(S, "PIECE", 10)
    kinds = "id long, cell long, sub long, members long"
    b = spark.createDataFrame([(i, 1, 0, 45) for i in range(45)] + [(i, 2, 0, None) for i in range(45, 50)], kinds)
    a = spark.createDataFrame([(100 + i, 1, 0, 45) for i in range(30)] + [(130, 2, 0, None)], kinds)
    met = S._tables(a, True).withColumnRenamed("id", "a").join(S._tables(b, False), "at").groupBy("a", "id").count().collect()
    assert {(r.a, r.id) for r in met} == {(100 + i, j) for i in range(30) for j in range(45)} | {(130, j) for j in range(45, 50)} and all(r["count"] == 1 for r in met)
    assert S._tables(b, False).groupBy("at").count().agg(F.max("count")).first()[0] < 25


def test_shingles_of_several_texts_are_hashed_together():
    from pagewright.llm import shingles as S

    rng = random.Random(17)
    data = bytes(rng.randrange(256) for _ in range(900))
    starts, sizes = np.array([rng.randrange(700) for _ in range(400)]), np.array([k % 200 for k in range(400)])
    want = [xxhash.xxh64_intdigest(data[a : a + n], 42) for a, n in zip(starts.tolist(), sizes.tolist(), strict=True)]
    assert S.span_hashes(data, starts, sizes).tolist() == want
    bodies = [S.normal((r[1] or "").encode()) for r in odd_rows()] + [b"", S.normal(prose(70, 30_000).encode()), b"a b c d e", b"a b c d e f", b""]
    for shingle in (1, 4, 5):
        made = list(S.hashes_of(bodies, shingle))
        assert len(made) == len(bodies) and all(np.array_equal(x, S.shingle_hashes(y, shingle)) for x, y in zip(made, bodies, strict=True))
    assert not list(S.hashes_of([]))


def test_dense_pairs_are_verified_in_turn(spark):
    from pagewright.llm import shingles as S

    base = np.arange(1, 301, dtype=np.uint64)
    sets = {k: np.sort(np.concatenate([base[k % 3 :], np.array([10**6 + k], np.uint64)])) for k in range(12)} | {20: np.arange(500, 800, dtype=np.uint64)}

    class Made:
        def of(self, ids):
            return spark.createDataFrame([(k, bytearray(v.tobytes())) for k, v in sets.items()], "id long, set binary")

    pairs = spark.createDataFrame([(a, b) for a in sets for b in sets if a < b], "a long, b long")
    links = {(r.a, r.b) for r in S.verified_in_turn(pairs, Made()).collect()}
    assert {x for pair in links for x in pair} == set(range(12)) and len(links) <= 15
    rest = spark.createDataFrame([(1, 5), (1, 20)], "a long, b long")
    assert [(r.a, r.b) for r in S.verified_in_turn(rest, Made()).collect()] == [(1, 5)]
