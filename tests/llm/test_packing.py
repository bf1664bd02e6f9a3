import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from pagewright.llm import packing
from pagewright.llm.common import durable
from tests.llm.conftest import odd_rows

PATH = public_tokenizers.path("byte_bpe_50k.json")


def reference():
    tokenizer = Tokenizer.from_file(PATH)
    return lambda t: tokenizer.encode(t, add_special_tokens=False).ids


def test_ids_are_those_of_the_tokenizer():
    ids, plain, rng = packing.encoder(PATH).ids, reference(), random.Random(5)
    texts = ["".join(rng.choice(" \n\ta'sb1.,é  <|") for _ in range(rng.randint(0, 14))) for _ in range(3000)]
    texts += ["".join(rng.choice(["<|endoftext|>", " ", "\n", "a", "b'll", "<|", "  "]) for _ in range(rng.randint(0, 9))) for _ in range(2000)]
    texts += ["<|endoftext|>", "a <|endoftext|> b", "<|endoftext|><|endoftext|>  x", "\n \n", "a   b", " ", "日本語 テスト", *(r[1] or "" for r in odd_rows())]
    for t in texts:
        assert np.frombuffer(ids(t), "<u4").tolist() == plain(t), repr(t)


def best_fit(histogram, capacity):
    bins = []
    for size in sorted(histogram, reverse=True):
        for _ in range(histogram[size]):
            room = [(r, i) for i, r in enumerate(bins) if r >= size]
            if room:
                bins[min(room)[1]] -= size
            else:
                bins.append(capacity - size)
    return sorted(bins)


def test_runs_are_best_fit_decreasing():
    rng = random.Random(2)
    for _ in range(200):
        capacity = rng.choice([10, 37, 64])
        histogram = {rng.randint(1, capacity): rng.randint(1, 9) for _ in range(rng.randint(1, 8))}
        bins, ranks = {}, {}
        for size, a, b, first, per, base in packing.best_fit_runs(histogram, capacity):
            ranks.setdefault(size, []).extend(range(a, b))
            for k in range(b - a):
                bins.setdefault(first + k // per, []).append((base + k % per * size, size))
        assert {s: sorted(r) for s, r in ranks.items()} == {s: list(range(n)) for s, n in histogram.items()}
        left = []
        for places in bins.values():
            at = 0
            for offset, size in sorted(places):
                assert offset == at
                at += size
            left.append(capacity - at)
        assert sorted(left) == best_fit(histogram, capacity)


def check(rows, docs):
    """Pieces restore every document's tokens, and sequences are gapless."""
    plain, want, sequences = reference(), [], {}
    for doc, text in docs:
        ids = [*plain(text or ""), 2]
        cut = len(ids) - (len(ids) - 1) // 1024 * 1024
        for k, (a, b) in enumerate(zip([0, *range(cut, len(ids), 1024)], range(cut, len(ids) + 1, 1024))):
            want.append((doc, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())))
    assert sorted(map(str, (tuple(r)[:5] for r in rows))) == sorted(map(str, want))
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 1024
    histogram = {}
    for *_, n, _ in want:
        histogram[n] = histogram.get(n, 0) + 1
    assert len(sequences) == len(best_fit(histogram, 1024))


COLUMNS = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]


def packed(docs, bucket):
    return packing.pack(durable(packing.token_pieces(docs, PATH)), bucket=bucket).select(*COLUMNS).collect()


def test_odd_documents(odd, clashing, nothing):
    docs = [r[:2] for r in odd_rows()]
    check(packed(odd, 4), docs)
    check(packed(clashing, packing.BUCKET), docs)
    assert packed(nothing, 4) == []


def test_ids_are_returned_on_request(odd):
    rows = packing.token_pieces(odd, PATH, with_ids=True).collect()
    assert all(len(r.ids) == r.length and zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 for r in rows)
