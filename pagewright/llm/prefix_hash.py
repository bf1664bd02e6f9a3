"""Document fingerprints from prefix polynomial hashes.

The prefix array of a text holds the polynomial hash of every prefix, modulo the prime 2**31 - 1 for two bases. The
difference of two entries is the hash of a span, so any two spans compare in constant time, and the longest common
extension of two positions is found by binary search. A fingerprint is a string of the text's length, its whole-text
residues for four bases, the number of its distinct spans of 32 code points, and the 64 least of their hashes. How alike
two texts are follows from their two fingerprints alone: the least hashes of both estimate how many spans they share,
wherever those stand, and likeness is the shared share of the text with more spans. Up to 64 distinct spans it is exact;
beyond, its standard error is at most 0.07.

Every document is compared with the next one by descending doc_id, also by the longest common extensions of their starts
and ends. The order is global, yet no task sees more than its range: ranges start at ids drawn from the data, and the
first document of each range is copied to the end of the range before it.

Defined results: null text counts as empty; two empty texts are alike (1.0), an empty and another are not (0.0); a text
of fewer than 32 code points is one span; rows with a null doc_id come after all others; rows of one doc_id are ordered
by a hash of their text; a table of one row is its own next; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.llm.common import each_batch, table

PRIME = (1 << 31) - 1
#: The first two have prefix arrays.
BASES = (1_000_003, 998_244_353, 1_234_567_891, 777_767_777)

#: Code points of a span, and how many span hashes a fingerprint keeps.
SPAN, KEPT = 32, 64

_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 ... base ** (n - 1) modulo the prime; grown by doubling and kept."""
    have = _powers.get(base)
    if have is None:
        have = np.ones(1, np.uint64)
    while len(have) < n:
        step = np.uint64(pow(base, len(have), PRIME))
        have = np.concatenate((have, have * step % np.uint64(PRIME)))
    _powers[base] = have
    return have[:n]


def _reduced(x: np.ndarray) -> np.ndarray:
    """x modulo the Mersenne prime, for x below 2 ** 62."""
    x = (x & np.uint64(PRIME)) + (x >> np.uint64(31))
    x = (x & np.uint64(PRIME)) + (x >> np.uint64(31))
    return np.where(x == PRIME, np.uint64(0), x)


class Prefixes:
    """The prefix arrays of one text."""

    def __init__(self, text: str):
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
        self.n = len(codes)
        terms = [_reduced(codes * powers(base, self.n)) for base in BASES]
        self.hash = [np.concatenate((np.zeros(1, np.uint64), _reduced(np.cumsum(t)))) for t in terms[:2]]
        self.whole = [int(h[-1]) for h in self.hash] + [int(t.sum() % np.uint64(PRIME)) for t in terms[2:]]

    def same_span(self, i: int, other: Prefixes, j: int, length: int) -> bool:
        """Whether so many code points from i on equal those of other from j on."""
        for k, base in enumerate(BASES[:2]):
            a = int(self.hash[k][i + length]) - int(self.hash[k][i])
            b = int(other.hash[k][j + length]) - int(other.hash[k][j])
            lift = int(powers(base, abs(i - j) + 1)[-1])
            if (a * (lift if j > i else 1) - b * (lift if i > j else 1)) % PRIME:
                return False
        return True

    def spans(self) -> np.ndarray:
        """A number for the span from each position on, equal for equal spans of any texts, and scattered."""
        length = min(SPAN, self.n)
        n, parts = (self.n - length + 1 if self.n else 0), []
        for k, base in enumerate(BASES[:2]):
            apart = self.hash[k][length : length + n] + np.uint64(PRIME) - self.hash[k][:n]
            parts.append(_reduced(_reduced(apart) * powers(pow(base, -1, PRIME), n)))
        mixed = ((parts[0] << np.uint64(31)) | parts[1]) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(16)

    def fingerprint(self) -> str:
        spans = np.unique(self.spans())
        return f"{self.n:x}-" + "".join(f"{r:08x}" for r in self.whole) + f"-{len(spans):x}-" + "".join(f"{x:012x}" for x in spans[:KEPT].tolist())

    def common_extension(self, i: int, other: Prefixes, j: int) -> int:
        """The most code points from i on that equal those of other from j on."""
        low, high = 0, min(self.n - i, other.n - j)
        while low < high:
            middle = (low + high + 1) // 2
            low, high = (middle, high) if self.same_span(i, other, j, middle) else (low, middle - 1)
        return low

    def common_end(self, other: Prefixes) -> int:
        """The most code points at the end that both have."""
        low, high = 0, min(self.n, other.n)
        while low < high:
            middle = (low + high + 1) // 2
            low, high = (middle, high) if self.same_span(self.n - middle, other, other.n - middle, middle) else (low, middle - 1)
        return low


def likeness(one: str, two: str) -> float:
    """How alike the texts of two fingerprints are, from 0 to 1."""
    if one == two:
        return 1.0
    (_, _, n, a), (_, _, m, b) = one.split("-"), two.split("-")
    n, m = int(n, 16), int(m, 16)
    if not n or not m:
        return 0.0
    a, b = ({x[k : k + 12] for k in range(0, len(x), 12)} for x in (a, b))
    least = sorted(a | b)[: KEPT if max(n, m) > KEPT else None]
    share = sum(x in a and x in b for x in least) / len(least)
    return min(1.0, share * (n + m) / (1 + share) / max(n, m))


def with_next(docs: DataFrame, ranges: int) -> DataFrame:
    """doc_id, text, and tail rows, dealt out to one partition per range of doc_id and sorted: each row is followed by
    the next by descending doc_id, the last of a range by a tail row."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    shares = [(i + 1) / ranges for i in range(ranges - 1)]
    drawn = docs.agg(F.max("doc_id").alias("most"), F.percentile_approx("doc_id", shares or [0.5], max(10_000, 20 * ranges)).alias("cuts")).first()
    most = drawn["most"]
    cuts = sorted(set(drawn["cuts"] or []) - {most}) if shares else []
    # the number of range starts that are not below the id: 0 for the highest ids
    below = F.size(F.filter(F.lit(cuts), lambda cut: cut < F.col("doc_id"))) if cuts else F.lit(0)
    place = F.when(F.col("doc_id").isNull(), F.lit(len(cuts))).otherwise(F.lit(len(cuts)) - below).cast("int")
    own = F.struct(place.alias("range"), F.lit(False).alias("tail"))
    before = F.when(F.col("doc_id") == F.lit(most), F.lit(len(cuts))).when(F.col("doc_id").isin(cuts), F.col("own.range") - 1)
    rows = docs.withColumn("own", own)
    rows = rows.select("doc_id", "text", F.inline(F.when(before.isNull(), F.array("own")).otherwise(F.array("own", F.struct(before.alias("range"), F.lit(True).alias("tail"))))))
    return rows.repartitionById(len(cuts) + 1, F.col("range")).sortWithinPartitions("tail", F.col("doc_id").desc_nulls_last(), F.xxhash64("text"))


def fingerprint_table(docs: DataFrame, ranges: int | None = None) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, head_next and tail_next
    (the code points at the start and end that the next document shares) of every document. The edited text has its last
    half replaced by as much of the start of the next document."""
    ranges = ranges or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def compare(doc: int | None, text: str, own: Prefixes, mark: str, text2: str, own2: Prefixes, mark2: str) -> tuple:
        half = own.n // 2
        edited = text[: own.n - half] + text2[:half]
        changed = Prefixes(edited).fingerprint()
        return doc, own.n, hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), mark, changed, likeness(mark, changed), likeness(mark, mark2), own.common_extension(0, own2, 0), own.common_end(own2)

    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64(), pa.int64()]
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "head_next", "tail_next"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, first, over, out = None, None, False, []
        for batch in each_batch(batches, 200):
            for doc, text, tail in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), batch.column("tail").to_pylist(), strict=True):
                if over:
                    continue
                own = Prefixes(text or "")
                here = (doc, text or "", own, own.fingerprint())
                if last:
                    out.append(compare(*last, *here[1:]))
                first, last, over = first or here, here, tail
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)
                out = []
        if last and not over:  # no id is known, so there is one range, which has no tail
            yield pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip(compare(*last, *first[1:]), kinds, strict=True)], names)

    return with_next(docs, ranges).select("doc_id", "text", "tail").mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, head_next long, tail_next long")


def op5_fingerprints(spark, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and its edited text, and how near the edited and the next text are."""
    return fingerprint_table(table(spark, sf_dir, "documents"))
