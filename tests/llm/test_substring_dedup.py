import numpy as np

from pagewright.llm import substring_dedup as S
from tests.llm import brute
from tests.llm.conftest import odd_rows

COLUMNS = ["doc_id", "n_words", "n_removed", "kept_sha256"]


def test_window_minimisers_are_sliding_minima():
    words = S.word_hashes([str(i % 40).encode() for i in range(200)])
    grams = S.rolling(words, 4, S.WORD_BASES[0], 3)
    want = [grams[i : i + 7].min() for i in range(len(words) - 10 + 1)]
    assert (S.window_minimisers(words, 10, 4) == np.array(want)).all()


def test_equal_windows_have_equal_hashes():
    words = [b"x", b"a", b"b", b"c", b"y", b"a", b"b", b"c"]
    h = S.rolling(S.word_hashes(words), 3, S.WORD_BASES[0], 7)
    assert h[1] == h[5] and len(set(h.tolist())) == 5


def test_intervals_merge():
    assert S.intervals(np.array([0, 1, 2, 60, 200]), 50) == [(0, 52), (60, 110), (200, 250)]
    assert S.intervals(np.array([0, 50]), 50) == [(0, 100)]


def test_odd_documents(odd, clashing, nothing):
    rows = brute.counted(S.dedup_substrings(odd).select(*COLUMNS).collect())
    assert rows == brute.counted(brute.substrings([r[:2] for r in odd_rows()]))
    assert brute.counted(S.dedup_substrings(clashing).select(*COLUMNS).collect()) == rows
    assert S.dedup_substrings(nothing).count() == 0


def test_other_lengths_and_texts(odd):
    rows = S.dedup_substrings(odd, window=8, gram=3, with_text=True)
    assert brute.counted(rows.select(*COLUMNS).collect()) == brute.counted(brute.substrings([r[:2] for r in odd_rows()], 8))
    for r in rows.where("kept is not null and not is_copy").collect():
        assert len(r.kept.split()) == r.n_words - r.n_removed


def test_sample(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = brute.substrings([tuple(r) for r in docs.select("doc_id", "text").collect()])
    assert brute.counted(S.op8_substring_dedup(spark, sf).select(*COLUMNS).collect()) == brute.counted(want)
