"""SimHash near-duplicates by the generalised pigeonhole principle.

Every document gets a 64-bit SimHash of its word shingles. Distinct fingerprints within a Hamming radius are linked:
the 64 bits are grouped into partitions of correlated bits; dynamic programming gives each partition its own threshold
so that the thresholds add up to radius - partitions + 1 at the least estimated cost; then any two fingerprints within
the radius are within the threshold on some partition. Fingerprints probe the index of each partition with every value
within its threshold, and pairs are verified on all 64 bits inside the join. Partition values that very many
fingerprints share are linked without pairs: fingerprints within radius // 2 flips of one midpoint are within the radius
of each other, and two within the radius share a midpoint, so a star around each midpoint keeps every connection.

similar_documents() is the same with a wide radius, where fingerprints are candidates only: five-word shingles, 12 bits
of 64 (four fifths of the bits agree), and every pair is verified on its sets of shingles, which must have a similarity of
0.8 or more (see shingles.py). At that similarity one fingerprint brings only some five pairs in six within 12 bits, and
a wider radius costs far more than another fingerprint; so a text has two, of independent hashes of the same shingles, and
is linked by either. Only texts of fitting sizes meet.

Defined results: null text counts as empty; no words gives fingerprint 0, linked like any other; equal documents
share a fingerprint; a null id keeps its row and never names a component unless all ids of it are null; other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial
from itertools import combinations
from math import comb, log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.llm.common import durable, each_batch, passing, raw_texts, table
from pagewright.llm.graphs import components
from pagewright.llm.shingles import ALIKE, CROWD, MOST_PLACES, SHINGLE, Sets, bitmap, distinct_texts, in_part, may_share, meetings, named, normal, profiles, shingle_hashes, verified_in_turn

BITS = 64
#: Fingerprints in the sample that costs are estimated on. Any choice of partitions is exact.
SAMPLE = 4096
#: Rows that share a partition value beyond which no pairs are formed.
HOT = 2000
#: What a shuffled probe costs, in verified pairs: of a join, and of tables of fingerprints.
PROBE_COST, TABLE_PROBE_COST = 20, 150
#: Bits that may differ where texts are verified, and fingerprints of which one has to be that close.
WIDE, FAMILIES = 12, 2


def simhash(hashes: np.ndarray) -> int:
    """The unsigned SimHash of shingle hashes: a bit is set if over half of them set it."""
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(hashes), bitorder="little").tobytes(), "little")


def text_fingerprint(raw: bytes, shingle: int = 4) -> int:
    """The SimHash of one text; 0 without words."""
    joined = normal(raw)
    return simhash(shingle_hashes(joined, shingle)) if joined else 0


def fingerprints(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """doc_id and fp (the fingerprint as a signed long) of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in each_batch(batches):
            values = [text_fingerprint(raw or b"", shingle) for raw in raw_texts(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(np.array(values, np.uint64).view(np.int64))], ["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, fp long")


def bit_groups(sample: np.ndarray, parts: int) -> list[list[int]]:
    """Bits in `parts` groups of nearly equal width, the most correlated ones together."""
    bits = ((sample[:, None] >> np.arange(BITS, dtype=np.uint64)) & np.uint64(1)).astype(np.float64)
    bits -= bits.mean(0)
    spread = bits.std(0)
    tie = np.abs(bits.T @ bits / max(1, len(sample)) / np.maximum(np.outer(spread, spread), 1e-9))
    free, groups = set(range(BITS)), []
    for k in range(parts):
        width = BITS // parts + (k < BITS % parts)
        rest = sorted(free)
        group = [rest[int(np.argmax(tie[np.ix_(rest, rest)].sum(0)))]]
        free.discard(group[0])
        while len(group) < width:
            rest = sorted(free)
            group.append(rest[int(np.argmax(tie[np.ix_(rest, group)].sum(1)))])
            free.discard(group[-1])
        groups.append(sorted(group))
    return groups


def thresholds(sample: np.ndarray, groups: list[list[int]], radius: int, n: int, fit: float = 1.0, probe_cost: int = PROBE_COST) -> tuple[float, list[int]]:
    """The cheapest thresholds that add up to radius - partitions + 1, and their cost, where only a share `fit` of pairs
    can meet. -1 leaves a partition out."""
    some = sample[: SAMPLE // 4]
    costs = []
    for group in groups:
        mask = np.uint64(sum(1 << b for b in group))
        apart = np.bitwise_count((some[:, None] ^ some[None, :]) & mask)
        near = np.bincount(apart.ravel(), minlength=BITS + 1).cumsum() - len(some)
        width = len(group)
        cost = [0.0]
        for t in range(radius + 1):
            ball = sum(comb(width, k) for k in range(t + 1))
            share = max(near[t] / max(1, len(some) * (len(some) - 1)), ball / 2.0**width)
            cost.append(probe_cost * n * (ball + 1) + share * fit * n * n / 2)
        costs.append(cost)
    goal = radius - len(groups) + 1
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for cost in costs:
        new: dict[int, tuple[float, list[int]]] = {}
        for total, (spent, chosen) in best.items():
            for t in range(-1, radius + 1):
                found = (spent + cost[t + 1], [*chosen, t])
                if total + t not in new or found[0] < new[total + t][0]:
                    new[total + t] = found
        best = new
    return best[goal]


def plan_probes(sample: np.ndarray, n: int, radius: int, fit: float = 1.0, probe_cost: int = PROBE_COST) -> list[tuple[list[int], int]]:
    """Bits and threshold of each partition, for the number of partitions that costs least."""
    options = []
    for parts in range(2, radius + 2):
        groups = bit_groups(sample, parts)
        cost, chosen = thresholds(sample, groups, radius, n, fit, probe_cost)
        options.append((cost, [(g, t) for g, t in zip(groups, chosen, strict=True) if t >= 0]))
    return min(options, key=lambda x: x[0])[1]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _flips(bits: list[int], most: int) -> list[int]:
    """All masks that flip at most so many of the bits."""
    return [_signed(sum(1 << b for b in some)) for k in range(most + 1) for some in combinations(bits, k)]


def _keys(fps: DataFrame, cells: list[tuple[int, int, int]]) -> DataFrame:
    """For each fingerprint a row per cell with part, the partition, and key, its bits after the flip."""
    cell = F.array(*[F.struct(F.lit(p).alias("part"), F.lit(_signed(mask)).cast("long").alias("mask"), F.lit(flip).cast("long").alias("flip")) for p, mask, flip in cells])
    key = F.transform(cell, lambda c: F.struct(c["part"].alias("part"), F.col("fp").bitwiseAND(c["mask"]).bitwiseXOR(c["flip"]).alias("key")))
    return fps.select(*fps.columns, F.inline(key))


def links(fps: DataFrame, n: int, radius: int = 4, hot: int = HOT) -> DataFrame:
    """Pairs (a, b) of distinct fingerprints that connect exactly those within the radius, which is even: each pair
    found through an ordinary value, and a star per midpoint among those that meet in a hot value."""
    if radius % 2:
        raise ValueError("the radius must be even, so that two fingerprints have a midpoint")
    drawn = fps.orderBy(F.xxhash64("fp")).limit(SAMPLE).collect()
    plan = plan_probes(np.array([r.fp for r in drawn], np.int64).view(np.uint64), n, radius)
    masks = [sum(1 << b for b in bits) for bits, _ in plan]
    index = _keys(fps, [(p, mask, 0) for p, mask in enumerate(masks)])
    probes = _keys(fps, [(p, masks[p], flip) for p, (bits, t) in enumerate(plan) for flip in _flips(bits, t)])
    crowded = durable(index.groupBy("part", "key").count().where(F.col("count") > hot).select("part", "key"))
    dense = None
    if not crowded.isEmpty():
        dense = index.join(crowded, ["part", "key"], "left_semi").select("fp").union(probes.join(crowded, ["part", "key"], "left_semi").select("fp")).distinct()
        index = index.join(crowded, ["part", "key"], "left_anti")
    a, b = probes.withColumnRenamed("fp", "a"), index.withColumnRenamed("fp", "b")
    found = a.join(b, ["part", "key"]).where((F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)).select("a", "b")
    if dense is None:
        return found
    half = _flips(list(range(BITS)), radius // 2)
    around = dense.select("fp", F.explode(F.transform(F.lit(half), lambda flip: F.col("fp").bitwiseXOR(flip))).alias("mid"))
    centre = around.groupBy("mid").agg(F.min("fp").alias("a"), F.count("*").alias("n")).where("n > 1").select("mid", "a")
    star = around.join(centre, "mid").where((F.col("a") < F.col("fp")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("fp"))) <= radius))
    return found.union(star.select("a", F.col("fp").alias("b"))).distinct()


def near_duplicates(docs: DataFrame, shingle: int = 4, radius: int = 4, hot: int = HOT) -> DataFrame:
    """doc_id, fp and component_id (the least doc_id that links reach) of every document."""
    marked = durable(fingerprints(docs, shingle))
    first = durable(marked.groupBy("fp").agg(F.min("doc_id").alias("first")))
    n = first.count()
    edges = durable(links(first.select("fp"), n, radius, hot)) if n > 1 else None
    if edges is None or edges.isEmpty():
        owner = first.select("fp", F.col("first").alias("component_id"))
    else:
        rooted = first.withColumn("node", F.xxhash64("fp")).join(components(edges), "node", "left").withColumn("root", F.coalesce("root", "node"))
        rooted = durable(rooted.select("fp", "first", "root"))
        least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
        owner = rooted.join(least, "root").select("fp", "component_id")
    return marked.join(owner, "fp").select("doc_id", "fp", "component_id")


def mixed(hashes: np.ndarray, family: int) -> np.ndarray:
    """Hashes of another family, made from these one to one; family 0 leaves them as they are."""
    if not family:
        return hashes
    x = hashes + np.uint64(0x9E3779B97F4A7C15 * family % (1 << 64))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _cells(rows: DataFrame, fp, cells: list[tuple[int, int, int]], slots: list[int]) -> DataFrame:
    """A row for each partition and flip and each of the size classes that these steps lead to: cell tells them apart."""
    of = F.array(*[F.struct(F.lit(p).alias("part"), F.lit(_signed(mask)).cast("long").alias("mask"), F.lit(flip).cast("long").alias("flip")) for p, mask, flip in cells])

    def keys_of(step: int):
        return F.transform(of, lambda c: in_part(F.xxhash64(c["part"], fp.bitwiseAND(c["mask"]).bitwiseXOR(c["flip"]), F.col("own") + step), c["part"]))

    keys = [keys_of(step) for step in slots]
    return rows.select(*[c for c in rows.columns if c != "own"], F.explode(keys[0] if len(keys) == 1 else F.concat(*keys)).alias("cell"))


def _first_meeting(plan: list[tuple[list[int], int]], own: Callable[[str], Column]) -> Column:
    """Of all meetings of a probe (a_fp, a_size) with an indexed text (fp, size), the one in the first partition on which
    they are close enough; of the two of texts of one size class, which look for each other, the one of the lesser id."""
    cell = None
    for p, (bits, most) in enumerate(plan):
        mask = F.lit(_signed(sum(1 << b for b in bits))).cast("long")
        near = F.bit_count(F.col("fp").bitwiseXOR(F.col("a_fp")).bitwiseAND(mask)) <= most
        filed = in_part(F.xxhash64(F.lit(p), F.col("fp").bitwiseAND(mask), own("a_size")), F.lit(p))
        cell = F.when(near, filed) if cell is None else cell.when(near, filed)
    return ((F.col("a_id") < F.col("id")) | (own("a_size") != own("size"))) & (F.col("cell") == cell)


def alike_links(texts: DataFrame, sets: Sets, n: int, radius: int = WIDE, alike: float = ALIKE, crowd: int = CROWD) -> DataFrame:
    """Links (a, b) that connect all texts (id, size, fps, map) which are alike and within the radius in one of their
    fingerprints."""
    drawn = texts.select("id", "size", "fps").orderBy(F.xxhash64("id")).limit(SAMPLE).collect()
    slots = np.array([int(log(r["size"]) / -log(alike)) for r in drawn])
    fit = float(np.mean(np.isin(slots[:1000, None] - slots[None, :1000], (0, 1)))) / 2 + 0.5 / len(slots)
    own = lambda size: F.floor(F.log(F.col(size).cast("double")) / -log(alike)).cast("int")
    known = pairs = None
    for family in range(len(drawn[0]["fps"])):
        plan = plan_probes(np.array([r["fps"][family] for r in drawn], np.int64).view(np.uint64), n, radius, fit, TABLE_PROBE_COST)
        masks = [sum(1 << b for b in bits) for bits, _ in plan]
        exact = [(p, mask, 0) for p, mask in enumerate(masks)]
        flips = [(p, masks[p], flip) for p, (bits, t) in enumerate(plan) for flip in _flips(bits, t)]
        rows = texts.select("id", "size", F.col("fps")[family].alias("fp"))
        filed = lambda rows, cells, slots: _cells(rows.withColumn("own", own("size")), F.col("fp"), cells, slots)
        # a text looks for those of its own size class and the next one up, which are filed under theirs and the one below
        search = partial(
            meetings,
            rows,
            sets,
            index=partial(filed, cells=exact, slots=[0, -1]),
            probes=partial(filed, cells=flips, slots=[0]),
            radius=radius,
            alike=alike,
            crowd=max(crowd, int(8 * fit * n / 2.0 ** min(len(bits) for bits, _ in plan))),  # four times what chance brings into a cell
            known=known,
            plan=list(zip(masks, (t for _, t in plan), strict=True)),
            once=_first_meeting(plan, own),
        )
        both = passing(texts.sparkSession, partial(_linked_or_met, search))
        links, met = both.where("linked").select("a", "b"), both.where("not linked").select("a", "b")
        known, pairs = (links, met) if known is None else (known.union(links), pairs.union(met))
    pairs = durable(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    pairs = durable(may_share(pairs, texts.select("id", "size", "map"), alike))
    return known.union(verified_in_turn(pairs, sets, known, alike))


def _linked_or_met(search: Callable[[], tuple[DataFrame | None, DataFrame]]) -> DataFrame:
    """Links and pairs as one table."""
    links, pairs = search()
    pairs = pairs.distinct().withColumn("linked", F.lit(False))
    return pairs if links is None else pairs.union(links.distinct().withColumn("linked", F.lit(True)))


def similar_documents(docs: DataFrame, shingle: int = SHINGLE, radius: int = WIDE, alike: float = ALIKE, crowd: int = CROWD, families: int = FAMILIES) -> DataFrame:
    """doc_id, fps and component_id (the least doc_id that links reach) of every document. Texts are linked whose
    fingerprints differ in `radius` bits at most in one of the families and whose shingles are alike."""

    def describe(hashes: np.ndarray, own: np.ndarray) -> list[int]:
        return [*(_signed(simhash(mixed(hashes, k))) for k in range(families)), *bitmap(own)]

    rows = durable(profiles(docs, shingle, describe, "marks"))
    texts = distinct_texts(rows, "marks")
    fps, places = F.slice("marks", 1, families).alias("fps"), F.slice("marks", families + 1, MOST_PLACES // 64).alias("map")
    n = texts.count()
    links = alike_links(texts.select("id", "size", fps, places), Sets(docs, texts, shingle), n, radius, alike, crowd) if n > 1 else None
    return named(rows, texts, links).select("doc_id", fps, "component_id")


def op1_simhash(spark, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every document."""
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
