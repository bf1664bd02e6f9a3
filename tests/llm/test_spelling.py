import random
import re
import zlib
from collections import Counter

from pyspark.sql import functions as F

from pagewright.llm import spelling as P


def counted(docs, shortest=6, often=5):
    total = Counter()
    for doc, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 199 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            if len(run) >= shortest:
                total[run] += 1
    return {w: n for w, n in total.items() if n >= often}


def apart_by_one(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) > len(b):
        a, b = b, a
    k = next((i for i in range(len(a)) if a[i] != b[i]), len(a))
    return a[k + 1 :] == b[k + 1 :] if len(a) == len(b) else a[k:] == b[k + 1 :]


def plain(total, ratio=5):
    """word: form, root, n, n_near, form_n by comparing all words with all."""
    near = {w: [v for v in total if apart_by_one(w, v)] for w in total}
    form = {}
    for w, some in near.items():
        best = min(some, key=lambda v: (-total[v], v), default=None)
        form[w] = best if best is not None and total[best] >= ratio * total[w] else None
    out = {}
    for w in total:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, total[w], len(near[w]), form[w] and total[form[w]])
    return out


def rows_of(found):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in found}


def vocabulary(rng, letters, families, most=14):
    total = {}
    for _ in range(families):
        w = "".join(rng.choice(letters) for _ in range(rng.randint(6, most)))
        total[w] = rng.choice([5, 7, 40, 900])
        for _ in range(rng.randint(0, 6)):
            k, c, kind = rng.randrange(len(w)), rng.choice(letters), rng.randrange(3)
            v = w[:k] + c + w[k + 1 :] if kind == 0 else w[:k] + c + w[k:] if kind == 1 else w[:k] + w[k + 1 :]
            total[v] = rng.choice([5, 6, 30, 200, 4500])
            if rng.random() < 0.5:
                w = v
    return total


def test_equals_all_pairs(spark):
    """Few letters make crowded tries and runs of one letter; many make sparse ones; edits at both ends."""
    for seed, (letters, families) in enumerate([("ab", 60), ("abcd", 150), ("abcdefghijklmnopqrstuvwxyzàéöÿ÷É", 150)]):
        total = vocabulary(random.Random(seed), letters, families, 14 if seed else 9)
        words = spark.createDataFrame(list(total.items()), "word string, n long")
        want = plain(total)
        assert rows_of(P.group_variants(words).collect()) == want
        if seed == 1:
            assert rows_of(P.group_variants(words, levels=1).collect()) == want
            assert rows_of(P.group_variants(words, levels=20).collect()) == want
        assert sum(bool(v[0]) for v in want.values()) > 10


def test_long_words_and_chains_of_forms(spark):
    rng = random.Random(5)
    long = "".join(rng.choice("abc") for _ in range(63))
    total = {long[:k] + "x" + long[k + j :]: 5 * 6 ** (k % 3) for k in (0, 30, 31, 62) for j in (0, 1)}
    total |= {long: 5000, long + "a": 6, long + "ab": 7, "q" * 3000: 9, "q" * 3001: 50, "q" * 1500 + "r" + "q" * 1499: 50}
    total |= {"chain" + "abcdefgh"[k] + "abcdefgh"[(k * 3) % 8]: 0 for k in range(1)}
    chain = "chainaaaa"
    for k in range(6):  # every form is the near word of the one before it alone
        total["chain" + "b" * k + "a" * (6 - k)] = 5 ** (k + 1)
    total = {w: n for w, n in total.items() if n and w != chain}
    assert rows_of(P.group_variants(spark.createDataFrame(list(total.items()), "word string, n long")).collect()) == plain(total)
    want = plain(total)
    assert want["chainaaaaaa"][1] == "chainbbbbba"


def test_words_are_counted_over_whole_texts(spark, odd, clashing, nothing):
    rng = random.Random(6)
    made = ["Straße", "STRASSE", "naïveté", "Éclairs", "x" * 5, "don't", "multi7part", "日本語kanjis", "ÀÉÎÕÜ×", "letters"]
    docs = [(i, " ".join(rng.choice(made) for _ in range(100))) for i in range(300)] + [(None, "letters " * 3000), (99, None), (100, "")]
    docs += [docs[0], docs[0]]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(7)
    total = counted(docs)
    assert {r.word: r.n for r in P.words(df).collect()} == total and len(total) > 9
    assert rows_of(P.group_variants(P.words(df)).collect()) == plain(total)
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert rows_of(P.group_variants(P.words(clashing)).collect()) == plain(counted(rows))
    assert P.group_variants(P.words(nothing)).count() == 0
    assert P.words(df.withColumn("n", F.lit(1)), often=10**9).count() == 0


def test_query(spark, sf):
    found = P.op13_spelling(spark, sf)
    assert found.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    total = counted(docs)
    near = {}  # by deletions, as all pairs are too many
    for w in total:
        for v in {w} | {w[:k] + w[k + 1 :] for k in range(len(w))}:
            near.setdefault(v, []).append(w)
    pairs = {w: set() for w in total}
    for some in near.values():
        for w in some:
            pairs[w] |= {v for v in some if apart_by_one(w, v)}
    rows = rows_of(found.collect())
    assert set(rows) == set(total)
    for w, (form, root, n, n_near, form_n) in rows.items():
        best = min(pairs[w], key=lambda v: (-total[v], v), default=None)
        best = best if best is not None and total[best] >= 5 * total[w] else None
        assert (form, n, n_near, form_n) == (best, total[w], len(pairs[w]), best and total[best])
        assert root == (rows[form][1] if form else w)
