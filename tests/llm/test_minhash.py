import random

import numpy as np
import pytest

from pagewright.llm import minhash as M
from tests.llm import brute
from tests.llm.conftest import odd_rows, prose
from tests.llm.test_similar import edited


def sets_of(docs):
    out = {}
    for d, t in docs:
        w = brute.words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        out[d] = {tuple(w[i : i + 4]) for i in range(max(1, len(w) - 3))} if w else set()
    return out


def plain(docs):
    """doc_id: n_shingles, component_id; all pairs on the words themselves."""
    sets = sets_of(docs)
    found = brute.classes(list(sets), lambda a, b: bool(sets[a]) and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]))
    return {d: (len(sets[d]), found[d]) for d in sets}


def rows_of(found):
    rows = found.collect()
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows)
    return {r.doc_id: (r.n_shingles, r.component_id) for r in rows}


def test_signatures_estimate_similarity():
    """Shifts of one permutation do for many: the share of equal coordinates is near the similarity, without bias."""
    rng = np.random.default_rng(1)
    for alike in (0.3, 0.8):
        shares = []
        for _ in range(60):
            n = 400
            both = round(2 * n * alike / (1 + alike))
            x = rng.integers(0, 2**63, 2 * n - both).astype(np.uint64)
            shares.append(np.mean(M.signature(x[:n], 160) == M.signature(x[n - both :], 160)))
        assert abs(np.mean(shares) - alike) < 0.02 and np.std(shares) < 0.06
    assert len(set(M.band_cells(np.array([5], np.uint64)))) == M.BANDS


@pytest.mark.parametrize("crowd", [3, 20, 64])
def test_equals_all_pairs(spark, crowd):
    """Edits around the limit, chains, a crowd of which half is like its base, and texts on the limit itself."""
    rng, rows = random.Random(13), []
    for k in range(10):
        base = prose(100 + k, 300)
        rows += [base, base, *(edited(base, rng, n) for n in (1, 3, 6, 7, 8, 9, 12))]
    text = prose(300, 250)
    for _ in range(12):
        text = edited(text, rng, 4)
        rows += [text, edited(text, rng, 2)]
    base = prose(301, 300)
    rows += [edited(base, rng, 2 if i % 2 else 9 + i % 6) for i in range(120)]
    words = [f"w{i}" for i in range(23)]
    rows += [" ".join(words), " ".join(words[:19]), " ".join(words[:18]), "w0 w1 W2", "w0 w1 w2", "w0 w1"]  # 20, 16 and 15 shingles
    rows = [(i * 7 % 2003, t) for i, t in enumerate(rows)]
    assert rows_of(M.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), crowd=crowd)) == plain(rows)


def test_odd_rows(spark, odd, clashing, nothing):
    rows = odd_rows()
    want = plain([(r[0], r[1]) for r in rows[:16]])
    found = M.near_duplicates(clashing).collect()
    assert len(found) == len(rows)
    for r in found:
        if r.doc_id is not None:
            assert (r.n_shingles, r.component_id) == want[r.doc_id] and r.kept == (r.doc_id == r.component_id)
    alone = [r for r in found if r.doc_id is None]
    assert sorted((r.n_shingles, r.component_id, r.kept) for r in alone if r.n_shingles) == [(want[1][0], want[1][1], False)]
    assert [(r.component_id, r.kept) for r in alone if not r.n_shingles] == [(None, True)]
    assert M.near_duplicates(nothing).count() == 0
    assert M.near_duplicates(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")).count() == 2


def test_query(spark, sf):
    found = M.op11_minhash(spark, sf)
    assert found.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    assert rows_of(found) == plain([(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()])
