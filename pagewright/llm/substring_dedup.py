"""Substring dedup by Rabin-Karp window hashes that Spark counts.

A word is dropped if a window of `window` words that covers it also starts in a document with a smaller doc_id. Every
window of a text is hashed by rolling (two 64-bit polynomial hashes over word hashes). Windows that cannot repeat are
left out before the count, without losing any: a window is keyed by its minimiser, the least hash of the word grams
within it, so equal windows have equal minimisers, and only windows whose minimiser also occurs in another document go
on to be counted. Exact copies of a smaller document need no windows at all: all their words go. Both are exact filters
before the count: what they leave out cannot repeat, or is decided already. Overlapping repeated windows merge into
maximal intervals, which are cut out.

Defined results: null text has no words; texts shorter than the window keep all; rows with a null doc_id keep all and
remove nothing elsewhere; rows that share a doc_id do not remove from each other; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.llm.common import BROADCAST_ROWS, durable, each_batch, flat_lists, raw_texts, table

WINDOW = 50
#: Words in a gram of which a window's least hash is its minimiser.
GRAM = 16
#: Odd multipliers for the polynomials over bytes and words.
BYTE_BASE, WORD_BASES = 0x9E3779B97F4A7C15, (0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93)

_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 ... base ** (n - 1) modulo 2 ** 64; grown by doubling and kept."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = 1 << max(10, (n - 1).bit_length())
        have = np.full(size, base, np.uint64)
        have[0] = 1
        have = np.cumprod(have, dtype=np.uint64)
        _powers[base] = have
    return have[:n]


def mixed(x: np.ndarray, salt: int) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = x + np.uint64(salt)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(words: list[bytes]) -> np.ndarray:
    """A hash of each word, from the prefix sums of one polynomial over the joined bytes."""
    data = np.frombuffer(b"".join(words), np.uint8).astype(np.uint64) + np.uint64(1)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))
    starts = np.concatenate(([0], ends[:-1]))
    prefix = np.concatenate((np.zeros(1, np.uint64), np.cumsum(data * powers(BYTE_BASE, len(data)), dtype=np.uint64)))
    back = powers(pow(BYTE_BASE, -1, 1 << 64), len(data))
    return mixed((prefix[ends] - prefix[starts]) * back[starts], 0) ^ (ends - starts).astype(np.uint64)


def rolling(values: np.ndarray, length: int, base: int, salt: int) -> np.ndarray:
    """Rabin-Karp hashes of all runs of so many values."""
    n = len(values) - length + 1
    prefix = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mixed(values, salt) * powers(base, len(values)), dtype=np.uint64)))
    return mixed((prefix[length:] - prefix[:n]) * powers(pow(base, -1, 1 << 64), n), salt)


def window_minimisers(words: np.ndarray, window: int, gram: int) -> np.ndarray:
    """The least gram hash within each window."""
    least, span, have = rolling(words, gram, WORD_BASES[0], 3), window - gram + 1, 1
    while have < span:
        step = min(have, span - have)
        least, have = np.minimum(least[:-step], least[step:]), have + step
    return least


def _bodies(docs: DataFrame) -> DataFrame:
    """doc_id, text, and a hash of the text that tells rows of one doc_id apart."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("body"))


def _profiles(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """doc_id, body, n_words, digest (SHA-256 of the words joined by spaces) and minimisers of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in each_batch(batches):
            counts, digests, keys = [], [], []
            for raw in raw_texts(batch.column("text")):
                words = (raw or b"").split()
                counts.append(len(words))
                digests.append(hashlib.sha256(b" ".join(words)).digest())
                keys.append(np.unique(window_minimisers(word_hashes(words), window, gram)) if len(words) >= window else np.empty(0, np.uint64))
            columns = [batch.column("doc_id"), batch.column("body"), pa.array(counts, pa.int64()), pa.array(digests, pa.binary()), flat_lists([k.view(np.int64) for k in keys], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "body", "n_words", "digest", "keys"])

    return _bodies(docs).mapInArrow(run, "doc_id long, body long, n_words long, digest binary, keys array<long>")


def _windows(shared: DataFrame, window: int, gram: int) -> DataFrame:
    """doc_id, body, h1, h2 of the distinct windows of a document whose minimiser is among its shared ones, and whether a
    smaller document has the minimiser too (later), without which the window stays. A window that a document repeats
    over and over is one row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in each_batch(batches, 500):
            ids, bodies, parts = batch.column("doc_id").to_pylist(), batch.column("body").to_pylist(), []
            for doc, body, raw, keys, later in zip(ids, bodies, raw_texts(batch.column("text")), batch.column("shared"), batch.column("later"), strict=True):
                words = word_hashes(raw.split())
                if len(words) < window:
                    continue
                least = window_minimisers(words, window, gram).view(np.int64)
                at = np.flatnonzero(np.isin(least, keys.values.to_numpy()))
                if len(at):
                    h1 = rolling(words, window, WORD_BASES[0], 7)[at].view(np.int64)
                    h1, once = np.unique(h1, return_index=True)
                    at = at[once]
                    h2 = rolling(words, window, WORD_BASES[1], 7)[at].view(np.int64)
                    parts.append((np.full(len(at), doc, np.int64), np.full(len(at), body, np.int64), h1, h2, np.isin(least[at], later.values.to_numpy())))
            for k in range(0, len(parts), 50):
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*parts[k : k + 50], strict=True)], ["doc_id", "body", "h1", "h2", "later"])

    return shared.select("doc_id", "body", "text", "shared", "later").mapInArrow(run, "doc_id long, body long, h1 long, h2 long, later boolean")


def intervals(at: np.ndarray, window: int) -> list[tuple[int, int]]:
    """Maximal runs of words that sorted repeated windows cover."""
    breaks = np.flatnonzero(np.diff(at) > window) + 1
    return [(int(run[0]), int(run[-1]) + window) for run in np.split(at, breaks) if len(run)]


def _cuts(flagged: DataFrame, window: int, with_text: bool) -> DataFrame:
    """doc_id, body, n_removed, digest and (if wanted) text of what is left, for documents with repeated windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in each_batch(batches, 500):
            removed, digests, texts = [], [], []
            for raw, gone in zip(raw_texts(batch.column("text")), batch.column("gone"), strict=True):
                words, kept, last = raw.split(), [], 0
                hashes = rolling(word_hashes(words), window, WORD_BASES[0], 7).view(np.int64)
                for start, end in intervals(np.flatnonzero(np.isin(hashes, gone.values.to_numpy())), window):
                    kept += words[last:start]
                    last = end
                kept += words[last:]
                texts.append(b" ".join(kept))
                removed.append(len(words) - len(kept))
                digests.append(hashlib.sha256(texts[-1]).digest())
            kept_texts = pa.array(texts, pa.binary()).cast(pa.string()) if with_text else pa.nulls(len(texts), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("body"), pa.array(removed, pa.int64()), pa.array(digests, pa.binary()), kept_texts], ["doc_id", "body", "n_removed", "digest", "kept"])

    return flagged.select("doc_id", "body", "text", "gone").mapInArrow(run, "doc_id long, body long, n_removed long, digest binary, kept string")


def _copies(profiles: DataFrame) -> DataFrame:
    """doc_id and body of the documents whose words a smaller document has too. Only texts that occur more than once
    are joined, and no keys with them; while such texts are few they are broadcast, so that one with very many copies
    needs no task of its own."""
    first = durable(profiles.groupBy("digest").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").select("digest", "first"))
    side = F.broadcast(first) if first.count() <= BROADCAST_ROWS else first
    return profiles.select("doc_id", "body", "digest").join(side, "digest").where("doc_id > first").select("doc_id", "body").distinct()


def repeated_windows(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, profiles: DataFrame | None = None, copies: DataFrame | None = None) -> DataFrame:
    """doc_id, body and h1 (the hash) of every distinct window that also starts in a document with a smaller doc_id, for
    documents that are not exact copies of a smaller one."""
    profiles = durable(_profiles(docs, window, gram)) if profiles is None else profiles
    copies = _copies(profiles) if copies is None else copies
    own = profiles.where("doc_id is not null").join(copies, ["doc_id", "body"], "left_anti").select("doc_id", "body", F.explode("keys").alias("key"))
    spread = own.groupBy("key").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most").select("key", "least")
    later = F.collect_set(F.when(F.col("doc_id") > F.col("least"), F.col("key")))
    shared = own.join(spread, "key").groupBy("doc_id", "body").agg(F.collect_set("key").alias("shared"), later.alias("later"))
    # not kept: hashing again costs less than the disk, and all readers share one shuffle of the texts
    windows = _windows(_bodies(docs).join(shared, ["doc_id", "body"]), window, gram)
    least = windows.groupBy("h1", "h2").agg(F.min("doc_id").alias("least"))
    return windows.where("later").drop("later").join(least, ["h1", "h2"]).where("doc_id > least").select("doc_id", "body", "h1")


def dedup_substrings(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, with_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every document, whether it is a copy of a smaller one, and (if wanted,
    where words were cut out of it) kept, its text without them."""
    profiles = durable(_profiles(docs, window, gram))
    copies = durable(_copies(profiles))
    gone = repeated_windows(docs, window, gram, profiles, copies).groupBy("doc_id", "body").agg(F.collect_set("h1").alias("gone"))
    cut = _cuts(_bodies(docs).join(gone, ["doc_id", "body"]), window, with_text)
    cut = cut.dropDuplicates(["doc_id", "body"]).select("doc_id", "body", F.col("n_removed").alias("cut"), F.col("digest").alias("left"), "kept")
    base = profiles.select("doc_id", "body", "n_words", "digest").join(copies.withColumn("_copy", F.lit(True)), ["doc_id", "body"], "left")
    copy = F.coalesce((F.col("n_words") >= window) & F.col("_copy"), F.lit(False))
    empty = F.lit(hashlib.sha256(b"").digest())
    return base.join(cut, ["doc_id", "body"], "left").select(
        "doc_id",
        "n_words",
        F.when(copy, F.col("n_words")).otherwise(F.coalesce("cut", F.lit(0))).alias("n_removed"),
        F.lower(F.hex(F.when(copy, empty).otherwise(F.coalesce("left", "digest")))).alias("kept_sha256"),
        copy.alias("is_copy"),
        F.when(copy, "").otherwise(F.col("kept")).alias("kept"),
    )


def op8_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of every document."""
    return dedup_substrings(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


ORACLE = f"""
WITH w AS (
    SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents
), windows AS (
    SELECT doc_id, i, md5(array_to_string(ws[i:i + {WINDOW - 1}], ' ')) AS h FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - {WINDOW - 2})) AS i FROM w)
), first_in AS (
    SELECT h, min(doc_id) AS least FROM windows GROUP BY 1
), gone AS (
    SELECT DISTINCT doc_id, unnest(range(i, i + {WINDOW})) AS k FROM windows JOIN first_in USING (h) WHERE doc_id > least
), each_word AS (
    SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS k FROM w
), kept AS (
    SELECT e.doc_id, string_agg(word, ' ' ORDER BY e.k) AS text, count(*) AS n FROM each_word e ANTI JOIN gone g ON e.doc_id = g.doc_id AND e.k = g.k GROUP BY 1
)
SELECT w.doc_id, len(ws) AS n_words, len(ws) - coalesce(n, 0) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256 FROM w LEFT JOIN kept ON w.doc_id = kept.doc_id
"""
