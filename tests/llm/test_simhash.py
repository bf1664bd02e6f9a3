import random

import numpy as np

from pagewright.llm import simhash
from tests.llm import brute
from tests.llm.conftest import odd_rows


def fps(spark, values):
    return spark.createDataFrame([(v - (1 << 64) if v >> 63 else v,) for v in values], "fp long")


def test_text_fingerprint_matches_the_plain_one():
    for row in odd_rows():
        assert simhash.text_fingerprint((row[1] or "").encode()) == brute.simhash(row[1])


def test_thresholds_are_a_pigeonhole():
    rng = np.random.default_rng(1)
    sample = rng.integers(0, 2**63, 500, dtype=np.int64).view(np.uint64)
    for parts in range(2, 6):
        groups = simhash.bit_groups(sample, parts)
        assert sorted(b for g in groups for b in g) == list(range(64))
        _, chosen = simhash.thresholds(sample, groups, 4, 10_000)
        assert sum(chosen) == 4 - parts + 1


def near_groups(seed: int) -> list[int]:
    rng = random.Random(seed)
    out = set()
    for _ in range(60):
        centre = rng.getrandbits(64)
        for _ in range(rng.randint(1, 12)):
            out.add(centre)
            for _ in range(rng.randint(0, 4)):
                centre ^= 1 << rng.randrange(64)
    return sorted(out)


def linked(a: int, b: int) -> bool:
    return (a ^ b).bit_count() <= 4


def check(spark, values, hot):
    edges = simhash.links(fps(spark, values), len(values), 4, hot).collect()
    unsigned = lambda x: x % (1 << 64)
    found = {(unsigned(r.a), unsigned(r.b)) for r in edges}
    assert all(linked(a, b) for a, b in found)
    want = brute.classes(values, linked)
    have = brute.classes(values, lambda a, b: (a, b) in found or (b, a) in found)
    assert want == have
    return found


def test_links_are_all_pairs_within_the_radius(spark):
    values = near_groups(3)
    found = check(spark, values, simhash.HOT)
    assert {frozenset(p) for p in found} == {frozenset((a, b)) for i, a in enumerate(values) for b in values[:i] if linked(a, b)}


def test_hot_values_keep_every_connection(spark):
    check(spark, near_groups(4)[:80], hot=1)


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 200), (200, 300), (7, 7)]
    rows = simhash.components(spark.createDataFrame(chain, "a long, b long")).collect()
    assert len(rows) == 44 and len({r.root for r in rows}) == 2


def test_odd_documents(spark, odd, clashing, nothing):
    rows = sorted(simhash.near_duplicates(odd).collect(), key=str)
    prints = {r[1]: brute.simhash(r[1]) for r in odd_rows()}
    classes = brute.classes(sorted(set(prints.values())), linked)
    least = {}
    for doc, text, *_ in odd_rows():
        key = classes[prints[text]]
        least[key] = doc if key not in least or least[key] is None else min(x for x in (doc, least[key]) if x is not None)
    want = brute.counted((doc, prints[text], least[classes[prints[text]]]) for doc, text, *_ in odd_rows())
    assert brute.counted((r.doc_id, r.fp % (1 << 64), r.component_id) for r in rows) == want
    assert sorted(simhash.near_duplicates(clashing).collect(), key=str) == rows
    assert simhash.near_duplicates(nothing).count() == 0
