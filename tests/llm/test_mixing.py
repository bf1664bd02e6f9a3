import random

from pagewright.llm import mixing
from tests.llm.conftest import odd_rows


def plain_targets(size: dict) -> dict:
    order = sorted((s for s in size if s is not None), key=lambda s: s.encode()) + [None] * (None in size)
    weight = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(order)}
    total, fixed = sum(size.values()), {}
    while True:
        free = [s for s in size if s not in fixed]
        rest = total - sum(fixed.values())
        share = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 3 * size[s]]
        if not over:
            return fixed | share
        fixed |= {s: 3.0 * size[s] for s in over}


def test_targets(spark):
    rows = [(i, s, n) for i, (s, n) in enumerate([("a", 10), ("b", 1000), ("é", 5), ("z", 0), (None, 300), ("c", 2)])]
    sized = spark.createDataFrame(rows, "doc_id long, source string, size long")
    found = {r.source: r.target for r in mixing.targets(sized)[0].collect()}
    want = plain_targets({s: n for _, s, n in rows})
    assert found.keys() == want.keys() and all(abs(found[s] - want[s]) < 1e-9 * (1 + want[s]) for s in want)


def test_words_come_near_their_targets(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(["w"] * rng.choice([1, 5, 40, 300])), rng.choice("aaaaabbbcd")) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    mixed = mixing.mix(docs, block=16).collect()
    assert sorted(r.doc_id for r in mixed) == list(range(3000))
    plan = mixing.mix(docs, block=16)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
    again = {r.doc_id: r.copies for r in mixing.mix(docs.repartition(7), block=16).collect()}
    assert again == {r.doc_id: r.copies for r in mixed}
    for s in "abcd":
        own = [r for r in mixed if r.source == s]
        target, rate = own[0].target, own[0].target / own[0].source_size
        assert abs(sum(r.size * r.copies for r in own) - target) <= max(r.size for r in own) / 2 + 1e-6
        assert all(int(rate) <= r.copies <= min(3, int(rate) + 1) for r in own)


def test_every_document_has_its_chance(spark):
    docs = spark.createDataFrame([(i, " ".join(["w"] * (1 + i % 5)), "ab"[i % 2]) for i in range(60)], "doc_id long, text string, source string")
    total = {}
    for seed in range(3):
        for r in mixing.mix(docs, seed=seed * 1000, block=8).collect():
            total.setdefault(r.source, []).append(r.copies - r.target / r.source_size)
    assert all(abs(sum(x) / len(x)) < 0.2 for x in total.values())


def test_odd_documents(odd, clashing, nothing):
    rows = mixing.mix(odd).collect()
    assert sorted(str(r.doc_id) for r in rows) == sorted(str(r[0]) for r in odd_rows())
    assert all(r.copies * r.size <= 3 * r.size and r.copies >= 0 for r in rows)
    assert {r.size for r in rows if r.doc_id in (5, 6, 7)} == {0}
    same = mixing.mix(clashing).collect()
    assert sorted((str(r.doc_id), r.copies) for r in same) == sorted((str(r.doc_id), r.copies) for r in rows)
    assert mixing.mix(nothing).count() == 0



def test_repeats_of_a_row_are_dealt_over_blocks(spark):
    from pyspark.sql import functions as F

    docs = spark.range(3000).select(F.lit(7).cast("long").alias("doc_id"), F.lit("one two three").alias("text"), F.lit("a").alias("source"))
    sized = mixing.numbered(mixing.sizes(docs))
    blocks = sized.groupBy(F.pmod(F.xxhash64(F.lit(mixing.SEED), "body", "nth"), F.lit(47)).alias("block")).count().agg(F.max("count"), F.count("*")).first()
    assert blocks[0] < 150 and blocks[1] == 47
    more = docs.union(spark.createDataFrame([(1, "w " * 30_000, "b")], docs.schema))
    rows = mixing.mix(more).collect()
    assert len(rows) == 3001
    own = [r for r in rows if r.source == "a"]
    assert abs(sum(r.copies * r.size for r in own) - own[0].target) <= 1.5 + 1e-6
