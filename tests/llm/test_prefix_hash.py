import os
import random

from pagewright.llm import prefix_hash as H
from tests.llm import brute
from tests.llm.conftest import odd_rows


def test_spans_and_extensions():
    rng = random.Random(1)
    for _ in range(60):
        a, b = ("".join(rng.choice("ab😀") for _ in range(rng.randint(0, 30))) for _ in range(2))
        x, y = H.Prefixes(a), H.Prefixes(b)
        for _ in range(20):
            i, j = rng.randint(0, len(a)), rng.randint(0, len(b))
            n = rng.randint(0, min(len(a) - i, len(b) - j))
            assert x.same_span(i, y, j, n) == (a[i : i + n] == b[j : j + n])
            k = 0
            while i + k < len(a) and j + k < len(b) and a[i + k] == b[j + k]:
                k += 1
            assert x.common_extension(i, y, j) == k
        assert (x.fingerprint() == y.fingerprint()) == (a == b)
        assert 0 <= H.likeness(x.fingerprint(), y.fingerprint()) <= 1 == H.likeness(x.fingerprint(), x.fingerprint())


def check(rows, docs):
    want = brute.edits(docs)
    assert {r.doc_id: (r.n_chars, r.edited_sha256) for r in rows} == {d: v[:2] for d, v in want.items()}
    text = {d: t or "" for d, t in docs}
    order = sorted(text, reverse=True)
    for r in rows:
        assert r.edited_fingerprint == H.Prefixes(want[r.doc_id][2]).fingerprint()
        own, other = text[r.doc_id], text[order[(order.index(r.doc_id) + 1) % len(order)]]
        for found, known in ((r.near_edited, want[r.doc_id][2]), (r.near_next, other)):
            assert abs(found - plain_likeness(own, known)) <= (0.3 if max(len(own), len(known)) > 95 else 1e-12)
        assert r.head_next == len(os.path.commonprefix([own, other])) and r.tail_next == len(os.path.commonprefix([own[::-1], other[::-1]]))


def test_sample_and_ranges(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    check(H.fingerprint_table(docs, 7).collect(), [tuple(r) for r in docs.select("doc_id", "text").collect()])


def test_odd_documents(spark, odd, clashing, nothing):
    unique = {r[0]: r[1] for r in odd_rows() if r[0] is not None}
    docs = spark.createDataFrame(list(unique.items()), "doc_id long, text string")
    check(H.fingerprint_table(docs, 5).collect(), list(unique.items()))
    assert H.fingerprint_table(odd, 3).count() == len(odd_rows()) == H.fingerprint_table(clashing, 3).count()
    assert H.fingerprint_table(nothing).count() == 0
    one = H.fingerprint_table(docs.where("doc_id = 9")).collect()
    assert len(one) == 1 and one[0].near_next == 1.0
    assert H.fingerprint_table(spark.createDataFrame([(None, "ab"), (None, "cd")], "doc_id long, text string"), 4).count() == 2


def spans(text):
    n = min(H.SPAN, len(text))
    return {text[i : i + n] for i in range(len(text) - n + 1)} if text else set()


def plain_likeness(a, b):
    """The shared share of the spans, on the texts themselves."""
    if a == b:
        return 1.0
    x, y = spans(a), spans(b)
    return len(x & y) / max(len(x), len(y)) if x and y else 0.0


def test_likeness_is_near_that_of_a_plain_version():
    rng = random.Random(2)
    base = "".join(rng.choice("abcd efg😀") for _ in range(900))
    other = "".join(rng.choice("abcd efg😀") for _ in range(500))
    texts = [base, other, "title " + base[5:-5] + " footer", base[:10] + "x" + base[11:880] + "y" + base[881:], other[:200] + base[300:600] + other[250:], base[100:140] * 12, base[:90], base[10:95], base[:20], base[:20] + "z", ""]
    off = []
    for a in texts:
        for b in texts:
            found, want = H.likeness(H.Prefixes(a).fingerprint(), H.Prefixes(b).fingerprint()), plain_likeness(a, b)
            assert abs(found - want) < (0.25 if max(len(a), len(b)) > 95 else 1e-12)
            off.append(found - want)
    assert abs(sum(off) / len(off)) < 0.02
    assert H.likeness(*(H.Prefixes(texts[k]).fingerprint() for k in (0, 2))) > 0.9


def plain_fingerprint(text):
    """By whole numbers, span by span."""
    n, length = len(text), min(H.SPAN, len(text))
    of = lambda part, base: sum((ord(c) + 1) * base**i for i, c in enumerate(part)) % H.PRIME
    marks = set()
    for i in range(n - length + 1 if n else 0):
        x, y = (of(text[i : i + length], base) for base in H.BASES[:2])
        mixed = ((x << 31) | y) * 0x9E3779B97F4A7C15 % 2**64
        marks.add((mixed ^ mixed >> 32) * 0xD6E8FEB86659FD93 % 2**64 >> 16)
    return f"{n:x}-" + "".join(f"{of(text, base):08x}" for base in H.BASES) + f"-{len(marks):x}-" + "".join(f"{m:012x}" for m in sorted(marks)[: H.KEPT])


def test_fingerprints_are_those_of_a_plain_version():
    rng = random.Random(6)
    for n in (0, 1, 5, 31, 32, 33, 95, 300):
        text = "".join(rng.choice("ab é😀") for _ in range(n))
        assert H.Prefixes(text).fingerprint() == plain_fingerprint(text)
