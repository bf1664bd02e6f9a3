"""Sets of word shingles, and the search for texts whose sets are alike.

Two texts are alike if their sets of shingles (words with ASCII letters lowered) have a Jaccard similarity of 0.8 or more.
An operator deals texts out to cells in which alike texts meet; here it is decided which of those that meet are alike, on
their full sets, so that all alike ones that met are connected:

1. Texts with the same set are one text (by a 128-bit digest of the set).
2. In every cell, each member is compared with one of them, a star. Most groups of copies are connected by that.
3. Members of a cell that are not connected yet are compared with each other. Of a crowded cell, texts that links connect
   already are a group of their own, which only others meet; and two bounds, by which nothing is lost, keep apart what was
   edited in too many places: shingles that no other crowded text has can't be shared; nor can a shingle whose place in a
   small bitmap of all places is empty in the other text's.

Only sorted shingle hashes move for a comparison, and each once for all its partners of a star; texts don't. Who is
compared is a join, so no group of copies is brought into one task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.llm.common import ASCII_LOWER, BROADCAST_ROWS, durable, each_batch, raw_texts
from pagewright.llm.graphs import components

SHINGLE, ALIKE = 5, 0.8
#: Into how many the comparisons of one text are dealt.
SALTS = 16
#: Members of a cell from which on it is crowded.
CROWD = 64
#: Longs of a bitmap of a crowded text's shingles.
WORDS = 16
#: Most places of a bitmap of any text's shingles.
MOST_PLACES = 1 << 14
#: Pairs of fingerprints that are compared at a time, and rows of a crowded cell that are brought into one task.
TABLE, PIECE = 1 << 17, 1 << 13
#: Partitions that the last bits of a cell's number tell apart.
PARTS = 64
#: Bytes of texts whose shingles are hashed together.
TOGETHER = 1 << 17
#: Stands for a null id, so that one join serves all.
NO_ID = -(1 << 63)


def normal(raw: bytes) -> bytes:
    """The words that count, one space apart."""
    return b" ".join(raw.translate(ASCII_LOWER).split())


def shingle_hashes(joined: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """The hash of every shingle of a normal text, in order."""
    words = joined.split(b" ")
    digest, n = xxhash.xxh64_intdigest, max(1, len(words) - shingle + 1)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    spans = zip(starts[:n].tolist(), ends[min(shingle, len(words)) - 1 :].tolist(), strict=True)
    return np.fromiter((digest(joined[a:b], 42) for a, b in spans), np.uint64, n)


def shingles(joined: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """The distinct shingle hashes of a normal text, sorted."""
    return np.unique(shingle_hashes(joined, shingle))


def _turned(x: np.ndarray, by: int) -> np.ndarray:
    return (x << np.uint64(by)) | (x >> np.uint64(64 - by))


def span_hashes(data: bytes, starts: np.ndarray, sizes: np.ndarray, seed: int = 42) -> np.ndarray:
    """XXH64 of many spans of these bytes, all of them a step at a time."""
    p1, p2, p3, p4, p5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    held = data + bytes(8)
    longs, ints, single = np.ndarray(len(data) + 1, "<u8", held, 0, 1), np.ndarray(len(data) + 1, "<u4", held, 0, 1), np.frombuffer(held, np.uint8)
    part = lambda own, word: _turned(own + word * p2, 31) * p1
    with np.errstate(over="ignore"):
        s = np.uint64(seed)
        found = np.full(len(starts), s + p5, np.uint64)
        some = np.flatnonzero(sizes >= 32)
        if len(some):
            lanes = [np.full(len(some), x, np.uint64) for x in (s + p1 + p2, s + p2, s, s - p1)]
            stripes = sizes[some] // 32
            for k in range(int(stripes.max())):
                on = np.flatnonzero(stripes > k)
                for lane in range(4):
                    lanes[lane][on] = part(lanes[lane][on], longs[starts[some[on]] + 32 * k + 8 * lane])
            own = sum((_turned(x, by) for x, by in zip(lanes[1:], (7, 12, 18), strict=True)), _turned(lanes[0], 1))
            for x in lanes:
                own = (own ^ part(np.uint64(0), x)) * p1 + p4
            found[some] = own
        found += sizes.astype(np.uint64)
        at, rest = starts + sizes // 32 * 32, sizes % 32
        for k in range(3):
            on = np.flatnonzero(rest >= 8 * (k + 1))
            found[on] = _turned(found[on] ^ part(np.uint64(0), longs[at[on] + 8 * k]), 27) * p1 + p4
        at, rest = at + rest // 8 * 8, rest % 8
        on = np.flatnonzero(rest >= 4)
        found[on] = _turned(found[on] ^ (ints[at[on]].astype(np.uint64) * p1), 23) * p2 + p3
        at, rest = at + rest // 4 * 4, rest % 4
        for k in range(3):
            on = np.flatnonzero(rest > k)
            found[on] = _turned(found[on] ^ (single[at[on] + k].astype(np.uint64) * p5), 11) * p1
        found = (found ^ (found >> np.uint64(33))) * p2
        found = (found ^ (found >> np.uint64(29))) * p3
    return found ^ (found >> np.uint64(32))


def hashes_of(bodies: list[bytes], shingle: int = SHINGLE) -> Iterator[np.ndarray]:
    """shingle_hashes of each of these normal texts, those of several texts made together."""
    while bodies:
        n, size = 0, 0
        while n < len(bodies) and (not n or size + len(bodies[n]) <= TOGETHER):
            size += len(bodies[n])
            n += 1
        data = b"\n".join(bodies[:n])  # no normal text has one
        bodies = bodies[n:]
        places = np.frombuffer(data, np.uint8)
        ends = np.append(np.flatnonzero((places == 32) | (places == 10)), len(data))
        starts = np.append(0, ends[:-1] + 1)
        after = np.append(np.flatnonzero(places[ends[:-1]] == 10), len(ends) - 1) + 1  # the word after the last of each text
        first = np.append(0, after[:-1])
        counts = np.maximum(1, after - first - shingle + 1)
        before = np.cumsum(counts) - counts
        at = np.arange(counts.sum()) + np.repeat(first - before, counts)
        last = np.minimum(at + shingle, np.repeat(after, counts)) - 1
        yield from np.split(span_hashes(data, starts[at], ends[last] - starts[at]), before[1:])


def set_key(hashes: np.ndarray) -> bytes:
    """128 bits that tell sets apart."""
    return xxhash.xxh3_128_digest(hashes.tobytes())


def profiles(docs: DataFrame, shingle: int, describe: Callable[[np.ndarray, np.ndarray], object], kind: str, empty: bool = True) -> DataFrame:
    """doc_id, key (of the set; null without words unless they count as alike), size (of the set) and what `describe`
    makes of a text's shingle hashes (in order, and distinct) of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in each_batch(batches, 500):
            keys, sizes, found = [], [], []
            bodies = [normal(raw or b"") for raw in raw_texts(batch.column("text"))]
            for body, hashes in zip(bodies, hashes_of(bodies, shingle), strict=True):
                if not body and not empty:
                    keys.append(None), sizes.append(0), found.append(None)
                    continue
                own = np.unique(hashes)
                keys.append(set_key(own)), sizes.append(len(own)), found.append(describe(hashes, own))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()), pa.array(found, pa.list_(pa.int64()))], ["doc_id", "key", "size", kind])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, f"doc_id long, key binary, size long, {kind} array<long>")


def distinct_texts(rows: DataFrame, kind: str) -> DataFrame:
    """id (a number of its own), key, first (the least doc_id), size and `kind` of every distinct set of profiles."""
    found = rows.where("key is not null").groupBy("key").agg(F.min("doc_id").alias("first"), F.first("size").alias("size"), F.first(kind).alias(kind))
    return durable(found.withColumn("id", F.monotonically_increasing_id()))


def few(side: DataFrame) -> DataFrame:
    """A side that is broadcast while it is counted to be few."""
    return F.broadcast(side) if side.count() <= BROADCAST_ROWS else side


class Sets:
    """The shingle sets of texts, made from the documents when they are needed, for those that are."""

    def __init__(self, docs: DataFrame, texts: DataFrame, shingle: int):
        self.docs, self.texts, self.shingle = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("_doc"), "text"), texts, shingle

    def of(self, ids: DataFrame) -> DataFrame:
        """id and set (sorted hashes as bytes) of these ids."""
        shingle = self.shingle

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in each_batch(batches, 500):
                own = [np.unique(x) for x in hashes_of([normal(raw or b"") for raw in raw_texts(batch.column("text"))], shingle)]
                yield pa.RecordBatch.from_arrays([pa.array([set_key(x) for x in own], pa.binary()), pa.array([x.tobytes() for x in own], pa.binary())], ["key", "set"])

        need = durable(self.texts.join(few(durable(ids.distinct())), "id", "left_semi").select("id", "key", F.coalesce("first", F.lit(NO_ID)).alias("_doc")))
        side = few(need)
        rows = self.docs.join(side.select("_doc").distinct() if need.count() > BROADCAST_ROWS else F.broadcast(need.select("_doc").distinct()), "_doc", "left_semi")
        made = rows.select("text").mapInArrow(run, "key binary, set binary")
        return durable(made.join(side.select("id", "key"), "key").groupBy("id").agg(F.first("set").alias("set")))


def own_shingles(sets: DataFrame) -> DataFrame:
    """id and n_own, how many of its shingles no other of these sets has; those without such are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in each_batch(batches, 200):
            parts = [np.frombuffer(x, np.int64) for x in batch.column("set").to_pylist()]
            ids = np.repeat(batch.column("id").to_numpy(), [len(p) for p in parts])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(np.concatenate([np.empty(0, np.int64), *parts]))], ["id", "hash"])

    rows = sets.mapInArrow(run, "id long, hash long")
    once = rows.groupBy("hash").agg(F.min("id").alias("id"), F.max("id").alias("last")).where(F.col("id") == F.col("last"))
    return once.groupBy("id").agg(F.count("*").alias("n_own"))


def sketches(sets: DataFrame) -> DataFrame:
    """id and sketch, a bitmap of the places that a set's hashes have among WORDS * 64."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in each_batch(batches, 500):
            maps = np.zeros((batch.num_rows, WORDS * 64), np.uint8)
            for k, held in enumerate(batch.column("set")):
                maps[k, np.frombuffer(held.as_buffer(), np.uint64) % np.uint64(WORDS * 64)] = 1
            packed = np.packbits(maps, axis=1, bitorder="little").view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(list(packed), pa.list_(pa.int64()))], ["id", "sketch"])

    return sets.mapInArrow(run, "id long, sketch array<long>")


def _missing(one: str, other: str) -> Column:
    """How many places of one bitmap are empty in the other."""
    total = F.lit(0)
    for k in range(WORDS):
        total = total + F.bit_count(F.col(one)[k].bitwiseAND(F.bitwise_not(F.col(other)[k])))
    return total


def compared(pairs: DataFrame, sets: DataFrame, alike: float = ALIKE) -> DataFrame:
    """Those pairs (a, b) of ids whose sets are alike. The partners of a text stream past its set, in up to SALTS streams."""
    pairs = pairs.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(SALTS)))
    partners = pairs.join(sets.withColumnRenamed("id", "b"), "b").select("a", "salt", F.col("b").alias("other"), "set")
    heads = pairs.select("a", "salt").distinct().join(sets.withColumnRenamed("id", "a"), "a").select("a", "salt", F.lit(None).cast("long").alias("other"), "set")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = np.empty(0, np.uint64)
        for batch in batches:
            found_a, found_b = [], []
            for a, b, held in zip(batch.column("a").to_pylist(), batch.column("other").to_pylist(), batch.column("set"), strict=True):
                own = np.frombuffer(held.as_buffer(), np.uint64)
                if b is None:
                    head = own.copy()
                    continue
                both = len(np.intersect1d(head, own, assume_unique=True))
                if both >= (alike - 1e-9) * (len(head) + len(own) - both):
                    found_a.append(a), found_b.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(found_a, pa.int64()), pa.array(found_b, pa.int64())], ["a", "b"])

    rows = partners.union(heads).repartition("a", "salt").sortWithinPartitions("a", "salt", F.col("other").asc_nulls_first())
    return durable(rows.mapInArrow(run, "a long, b long"))


def _verified(pairs: DataFrame, sets: Sets, alike: float) -> DataFrame:
    """The pairs (a, b), in any order and repeated, that are alike."""
    pairs = durable(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    return compared(pairs, sets.of(pairs.select(F.col("a").alias("id")).union(pairs.select("b"))), alike)


def _ends(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Columns as those of the other side of a meeting."""
    return rows.select(*[F.col(c).alias(f"a_{c}") if c not in ("cell", "sub") else F.col(c) for c in columns])


def bitmap(own: np.ndarray) -> list[int]:
    """Longs of a bitmap of the places of a set's hashes, about a bit for each; of texts of fitting sizes, one has as many
    places as the other, twice or half as many."""
    places = min(MOST_PLACES, max(64, 1 << (len(own) - 1).bit_length()))
    bits = np.zeros(places, np.uint8)
    bits[own % np.uint64(places)] = 1
    return np.packbits(bits, bitorder="little").view(np.int64).tolist()


def may_share(pairs: DataFrame, maps: DataFrame, alike: float = ALIKE) -> DataFrame:
    """Those pairs (a, b) whose bitmaps (id, size, map) leave room for what alike sets share: a shingle whose place is empty
    in the other text's bitmap is not shared."""
    for end in ("a", "b"):
        pairs = pairs.join(maps.select(F.col("id").alias(end), F.col("size").alias(f"size_{end}"), F.col("map").alias(f"map_{end}")), end)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in each_batch(batches):
            keep = []
            for n, m, one, other in zip(*(batch.column(c) for c in ("size_a", "size_b", "map_a", "map_b")), strict=True):
                x, y = (v.values.to_numpy().view(np.uint64) for v in (one, other))
                n, m = n.as_py(), m.as_py()
                while len(x) != len(y):
                    if len(x) > len(y):
                        x = x[: len(x) // 2] | x[len(x) // 2 :]
                    else:
                        y = y[: len(y) // 2] | y[len(y) // 2 :]
                both = min(n - int(np.bitwise_count(x & ~y).sum()), m - int(np.bitwise_count(y & ~x).sum()))
                keep.append(both >= (alike - 1e-9) * (n + m - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.mapInArrow(run, "a long, b long")


def in_part(cell: Column, part: Column) -> Column:
    """A cell's number with that of its partition in the last bits."""
    return cell.bitwiseAND(F.lit(-PARTS).cast("long")).bitwiseOR(part.cast("long"))


def close_in_cells(a: DataFrame, b: DataFrame, radius: int, alike: float = ALIKE, plan: list[tuple[int, int]] | None = None) -> DataFrame:
    """id, fp and size of both sides, those of a as a_id, a_fp and a_size, and cell of all (a, b) with the same `at` whose
    fingerprints differ in `radius` bits at most, whose sizes and bounds leave room for alike sets and whose roots differ (where they have some). Without a `cell`, `at` is it.
    With a plan (mask and threshold of each partition), of a pair's meetings only those in the first partition on which they
    are close count, and of two of one size class, which look for each other, the one of the lesser id.
    A task has the rows of one `at` side by side and compares their fingerprints as a table."""
    limit, told = alike - 1e-9, "shared" in b.columns
    sides, cell, root = ["id", "fp", "size"], "cell" if "cell" in b.columns else "at", "root" if "root" in b.columns else "id"

    def columns_of(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
        found = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in batch.schema.names if c != "sketch"}
        found["fp"] = found["fp"].view(np.uint64)
        if told:
            lists = batch.column("sketch")
            found["sketch"] = np.zeros((batch.num_rows, WORDS), np.uint64)
            found["sketch"][lists.is_valid().to_numpy(zero_copy_only=False)] = lists.flatten().to_numpy().view(np.uint64).reshape(-1, WORDS)
        return found

    def whole_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, np.ndarray]]:
        held: list[dict[str, np.ndarray]] = []
        for rows in (columns_of(b) for b in batches if b.num_rows):
            last = rows["at"][-1]
            first = int(np.searchsorted(rows["at"], last))  # the last cell may go on in the next batch
            if first or held and held[0]["at"][-1] != last:
                held.append({c: v[:first] for c, v in rows.items()})
                yield {c: np.concatenate([h[c] for h in held]) for c in rows}
                held = []
            held.append({c: v[first:] for c, v in rows.items()})
        if held:
            yield {c: np.concatenate([h[c] for h in held]) for c in held[0]}

    def near(rows: dict[str, np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Rows of probes, and those that they meet within the radius."""
        fps, at, most = rows["fp"], rows["at"], radius
        ends = [0, *(np.flatnonzero(at[1:] != at[:-1]) + 1).tolist(), len(at)]
        one, other = np.flatnonzero(rows["probe"]), np.flatnonzero(~rows["probe"])
        one_at, other_at = np.searchsorted(one, ends).tolist(), np.searchsorted(other, ends).tolist()
        found, n = [], 0
        for k in range(len(ends) - 1):
            x, y = one[one_at[k] : one_at[k + 1]], other[other_at[k] : other_at[k + 1]]
            if not (len(x) and len(y)):
                continue
            fp, step = fps[y], max(1, TABLE // len(y))
            for start in range(0, len(x), step):
                some = x[start : start + step]
                i, j = np.nonzero(np.bitwise_count(fps[some][:, None] ^ fp) <= most)
                if len(i):
                    found.append((some[i], y[j]))
                    n += len(i)
                if n >= TABLE:
                    yield tuple(map(np.concatenate, zip(*found, strict=True)))
                    found, n = [], 0
        if found:
            yield tuple(map(np.concatenate, zip(*found, strict=True)))

    def room(rows: dict[str, np.ndarray], i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Those of them that may be alike."""
        size, own = rows["size"], rows[root]
        keep = (own[i] != own[j]) & (np.minimum(size[i], size[j]) >= limit * np.maximum(size[i], size[j]))
        i, j = i[keep], j[keep]
        if plan:
            apart, first = rows["fp"][i] ^ rows["fp"][j], np.full(len(i), -1)
            for p in reversed(range(len(plan))):
                first[np.bitwise_count(apart & np.uint64(plan[p][0])) <= plan[p][1]] = p
            one, other = (np.log(size[x]) / -np.log(alike) for x in (i, j))
            sure = (np.abs(one - np.rint(one)) > 1e-6) & (np.abs(other - np.rint(other)) > 1e-6)  # whatever the rounding
            again = sure & (np.floor(one) == np.floor(other)) & (rows["id"][i] > rows["id"][j])
            keep = (first == (rows[cell][j] & (PARTS - 1))) & ~again
            i, j = i[keep], j[keep]
        if not told:
            return i, j
        known = (rows["shared"][i] >= 0) & (rows["shared"][j] >= 0)
        both = np.where(known, np.minimum(rows["shared"][i], rows["shared"][j]), np.minimum(size[i], size[j]))
        keep = both >= limit * (size[i] + size[j] - both)
        i, j, known = i[keep], j[keep], known[keep]
        keep = ~known
        for start in range(0, len(i), TABLE // WORDS):
            x, y = i[start : start + TABLE // WORDS], j[start : start + TABLE // WORDS]
            own, others = rows["sketch"][x], rows["sketch"][y]
            both = np.minimum(size[x] - np.bitwise_count(own & ~others).sum(1, np.int64), size[y] - np.bitwise_count(others & ~own).sum(1, np.int64))
            keep[start : start + len(x)] |= both >= limit * (size[x] + size[y] - both)
        return i[keep], j[keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_cells(batches):
            for i, j in near(rows):
                i, j = room(rows, i, j)
                found = {f"a_{c}": rows[c][i] for c in sides} | {c: rows[c][j] for c in sides} | {"cell": rows[cell][j]}
                yield pa.RecordBatch.from_pydict({c: pa.array(v.view(np.int64)) for c, v in found.items()})

    rows = a.withColumn("probe", F.lit(True)).unionByName(b.withColumn("probe", F.lit(False)))
    rows = rows.repartition("at").sortWithinPartitions("at")
    return rows.mapInArrow(run, "a_id long, a_fp long, a_size long, id long, fp long, size long, cell long")


def _tables(rows: DataFrame, probe: bool) -> DataFrame:
    """rows with `at`, where those of a cell (and sub) meet: in one table, or of a crowded cell (of so many members) in all
    tables of a grid, for each of which either side is cut into pieces of about PIECE rows."""
    n = F.ceil(F.coalesce("members", F.lit(1)) / PIECE).cast("int")
    own, others = F.pmod(F.xxhash64("id"), n).cast("int"), F.sequence(F.lit(0), n - 1)
    rows = rows.withColumns({"own": own, "n": n, "other": F.explode(others)})
    one, other = ("own", "other") if probe else ("other", "own")
    at = F.when((F.col("sub") == 0) & (F.col("n") == 1), F.col("cell")).otherwise(F.xxhash64("cell", "sub", one, other))
    return rows.withColumn("at", at).drop("own", "n", "other", "members", "sub")


def meetings(
    texts: DataFrame,
    sets: Sets,
    index: Callable[[DataFrame], DataFrame],
    probes: Callable[[DataFrame], DataFrame] | None = None,
    radius: int | None = None,
    alike: float = ALIKE,
    crowd: int = CROWD,
    known: DataFrame | None = None,
    plan: list[tuple[int, int]] | None = None,
    once: Column | None = None,
) -> tuple[DataFrame | None, DataFrame]:
    """Links (a, b) found on the way, if any, and pairs (a, b) to verify: those known, these links and the pairs that turn
    out to be alike connect all texts (id, size and, with a radius, fp) that are alike and meet.

    index makes a row for every cell of a text, probes for every cell that it looks into (without: its own), each with a
    long `cell`; with probes, stars are made in crowded cells only, and only those meet whose fingerprints differ in
    `radius` bits at most. Where two texts meet in several cells, once is a condition that one of these meetings fulfils; plan has the
    partitions (mask and threshold) by which tasks leave out most of the others already."""
    limit = F.lit(alike - 1e-9)
    texts = texts.withColumns({"shared": F.lit(None).cast("long"), "sketch": F.lit(None).cast("array<long>")})
    counts = index(texts).groupBy("cell").agg(F.count("*").alias("members")).where(F.col("members") > (1 if probes is None else crowd))
    counts = counts if probes is None else durable(counts)
    members = None if probes is not None and counts.isEmpty() else durable(index(texts).join(counts if probes is None else few(counts), "cell"))
    hot = F.col("members") > crowd
    crowded = None if members is None else durable(members.where(hot).select("id").distinct())
    if crowded is not None and not crowded.isEmpty():
        full = sets.of(crowded)
        own = sketches(full).join(own_shingles(full), "id", "left").withColumn("n_own", F.coalesce("n_own", F.lit(0).cast("long")))
        side = few(durable(own))
        told = lambda rows: rows.drop("sketch").join(side, "id", "left").withColumn("shared", F.col("size") - F.col("n_own")).drop("n_own")
        texts, members = told(texts), durable(told(members))

    fits = F.least("a_size", "size") >= limit * F.greatest("a_size", "size")
    both = F.when(F.col("a_shared").isNotNull() & F.col("shared").isNotNull(), F.least("a_shared", "shared")).otherwise(F.least("a_size", "size"))
    alike_with = lambda n: n >= limit * (F.col("a_size") + F.col("size") - n)
    may = fits & alike_with(both)
    may = may if radius is None else (F.bit_count(F.col("fp").bitwiseXOR(F.col("a_fp"))) <= radius) & may
    placed = F.least(F.col("a_size") - _missing("a_sketch", "sketch"), F.col("size") - _missing("sketch", "a_sketch"))
    may = may & (F.col("a_sketch").isNull() | F.col("sketch").isNull() | alike_with(placed))

    found = None
    if members is not None:
        columns = [c for c in members.columns if c != "members"]
        # the member with the least share of shingles of its own is what most others were made from
        rank = F.coalesce(1 - F.col("shared") / F.col("size"), F.lit(0.0))
        centre = members.groupBy("cell").agg(F.min_by(F.struct(*[c for c in columns if c != "cell"]), F.struct(rank, "id")).alias("c"))
        stars = members.join(centre.select("cell", *[F.col(f"c.{c}").alias(f"a_{c}") for c in columns if c != "cell"]), "cell")
        found = _verified(stars.where((F.col("id") != F.col("a_id")) & may).select(F.col("a_id").alias("a"), F.col("id").alias("b")), sets, alike)

    links = found if known is None else known if found is None else found.union(known)
    node = F.xxhash64("id")
    linked = links is not None and not links.isEmpty()
    if not linked:  # a text without links has no root, which takes no room in a shuffle
        rooted = lambda rows: rows.withColumn("root", F.lit(None).cast("long"))
    else:
        roots = few(durable(components(links)))
        rooted = lambda rows: rows.join(roots, node == roots["node"], "left").drop("node")
    dead = hot & F.coalesce(F.col("shared") < limit * F.col("size"), F.lit(False))
    groups = None
    if members is not None:
        members = durable(rooted(members))
        # of a crowded cell, what is connected already is a group that only others meet
        groups = durable(members.where(hot & ~dead & F.col("root").isNotNull()).groupBy("cell", F.col("root").alias("sub")).count().where(F.col("count") > crowd).select("cell", "sub"))
    if probes is None:
        b = a = members.where(~dead)
    else:
        texts = durable(rooted(texts)) if members is not None or linked else rooted(texts)
        a, b = probes(texts), index(texts)
        if members is not None:
            kept = lambda rows: rows.join(few(counts), "cell", "left").where(~F.coalesce(dead, F.lit(False)))
            a, b = kept(a), kept(b)
    columns = b.columns
    none = F.lit(0).cast("long")
    if groups is None or groups.isEmpty():
        a, b = a.withColumn("sub", none), b.withColumn("sub", none)
    else:
        some = few(groups)
        grouped = some.select("cell", F.col("sub").alias("root"), "sub")
        b = b.join(grouped, ["cell", "root"], "left").select(*columns, F.coalesce("sub", none).alias("sub"))
        others = a.join(some, "cell").where(F.col("root").isNull() | (F.col("root") != F.col("sub"))).select(*columns, "sub")
        a = a.select(*columns, none.alias("sub")).unionByName(others)
    if probes is None:
        columns = [*[c for c in columns if c != "members"], "sub"]
        met = _ends(a, columns).join(b.select(*columns), ["cell", "sub"])
        apart = F.col("root").isNull() | F.col("a_root").isNull() | (F.col("root") != F.col("a_root"))
        met = met.where(((F.col("a_id") < F.col("id")) | (F.col("sub") != 0)) & (F.col("a_id") != F.col("id")) & apart & may)
    else:
        alone = {"root": F.coalesce("root", node)} if linked else {}  # not that of any other
        if members is None:
            a, b = (rows.drop("sub", "shared", "sketch", *[] if linked else ["root"]).withColumnRenamed("cell", "at") for rows in (a, b))
        else:
            alone["shared"] = F.coalesce("shared", F.lit(-1).cast("long"))
            a, b = (_tables(rows, probe).drop(*[] if linked else ["root"]) for rows, probe in ((a, True), (b, False)))
        met = close_in_cells(a.withColumns(alone), b.withColumns(alone), radius, alike, plan)
        met = met if once is None else met.where(once)
    return found, met.select(F.col("a_id").alias("a"), F.col("id").alias("b"))


def connect(texts: DataFrame, sets: Sets, index: Callable[[DataFrame], DataFrame], alike: float = ALIKE, crowd: int = CROWD) -> DataFrame:
    """Links (a, b) that connect all texts (id, size) that are alike and meet in a cell of index."""
    found, pairs = meetings(texts, sets, index, alike=alike, crowd=crowd)
    return found.union(_verified(pairs, sets, alike))


def verified_in_turn(pairs: DataFrame, sets: Sets, known: DataFrame | None = None, alike: float = ALIKE) -> DataFrame:
    """Links (a, b) that, with those known, connect all pairs (a, b; distinct) that are alike. Where texts have many
    partners, each is compared with one first, and then with those to which no link leads yet."""
    full = sets.of(pairs.select(F.col("a").alias("id")).union(pairs.select("b")))
    once = durable(pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"))
    if pairs.count() <= 2 * once.count():
        return compared(pairs, full, alike)
    found = compared(once, full, alike)
    links = found if known is None else found.union(known)
    if not links.isEmpty():
        roots = durable(components(links))
        for end in ("a", "b"):
            own = few(roots.select(F.col("node").alias(f"node_{end}"), F.col("root").alias(f"root_{end}")))
            pairs = pairs.join(own, F.xxhash64(end) == F.col(f"node_{end}"), "left")
        pairs = pairs.where(~F.coalesce(F.col("root_a") == F.col("root_b"), F.lit(False))).select("a", "b")
    rest = durable(pairs.join(once, ["a", "b"], "left_anti"))
    return found if rest.isEmpty() else found.union(compared(rest, full, alike))


def named(rows: DataFrame, texts: DataFrame, links: DataFrame | None) -> DataFrame:
    """rows (with key) and component_id, the least doc_id that links reach from its text; null without a key."""
    owner = texts.select("key", "first", F.xxhash64("id").alias("node"))
    if links is not None and not links.isEmpty():
        owner = owner.join(components(links), "node", "left").withColumn("node", F.coalesce("root", "node"))
    owner = durable(owner.select("key", "first", "node"))
    owner = owner.join(owner.groupBy("node").agg(F.min("first").alias("component_id")), "node").select("key", "component_id")
    return rows.join(owner, "key", "left")
