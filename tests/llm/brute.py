"""Plain single-machine versions that the operators are held against."""

from __future__ import annotations

import hashlib
from collections import Counter

import xxhash


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().split()


def simhash(text: str | None, shingle: int = 4) -> int:
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = words(lower)
    if not w:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(w[i : i + shingle]), 42) for i in range(max(1, len(w) - shingle + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(nodes: list[int], linked) -> dict[int, int]:
    """The smallest node that each node reaches."""
    root = {x: x for x in nodes}

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i, a in enumerate(nodes):
        for b in nodes[:i]:
            if linked(a, b):
                low, high = sorted((find(a), find(b)))
                root[high] = low
    return {x: find(x) for x in nodes}


def substrings(docs: list[tuple[int | None, str | None]], window: int = 50) -> list[tuple]:
    """doc_id, n_words, n_removed, kept_sha256."""
    first: dict[tuple, int] = {}
    for doc, text in docs:
        w = words(text)
        for i in range(len(w) - window + 1):
            if doc is not None:
                key = tuple(w[i : i + window])
                first[key] = min(first.get(key, doc), doc)
    out = []
    for doc, text in docs:
        w = words(text)
        gone = set()
        for i in range(len(w) - window + 1):
            if doc is not None and first[tuple(w[i : i + window])] < doc:
                gone.update(range(i, i + window))
        out.append((doc, len(w), len(gone), hashlib.sha256(b" ".join(x for i, x in enumerate(w) if i not in gone)).hexdigest()))
    return out


def counted(rows) -> Counter:
    return Counter(map(tuple, rows))


def edits(docs: list[tuple[int, str | None]]) -> dict[int, tuple[int, str, str]]:
    """doc_id: n_chars, edited_sha256, edited text."""
    order = sorted(docs, key=lambda r: -r[0])
    out = {}
    for k, (doc, text) in enumerate(order):
        text, following = text or "", order[(k + 1) % len(order)][1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        out[doc] = (len(text), hashlib.sha256(edited.encode()).hexdigest(), edited)
    return out
