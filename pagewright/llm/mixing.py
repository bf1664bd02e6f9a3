"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame and SQL functions only.

Every source has a weight and gets its share of all words, but no more than a few times its own size; what a capped
source leaves is shared again by weight. A source's documents are then taken target / size times each: the whole part
for certain, the fraction by pivotal rounding. Two fractional documents play against each other: one gains and the other
loses the same number of words, in a direction drawn so that expectations stay, until one of them is decided. So a
source's words stay exactly at the target until one document is left, which is rounded to the nearer side; long documents play
first, so that it is mostly a short one. The games are a reduction tree: blocks of some 64 documents of one source are
folded to one undecided document each, blocks of those are folded again, and so on to one per source; no block grows
with the source or with the repeats of a row, so a hot one makes more blocks, not larger ones. Draws are hashes of the documents and the seed, so a rerun agrees.

Defined results: null text has size 0 and is taken 0 words; a null source is a source of its own, last in order; a
source without words has target 0; repeated rows are separate documents; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.llm.common import BROADCAST_ROWS, durable, global_rank, table

WEIGHTS = (5, 2, 1)
MOST = 3
BLOCK = 64
SEED = 20240601
WORDS = r"[^\x20\x09-\x0D]+"


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source, size (words of the text) and body (a hash that tells rows of one doc_id apart)."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", F.coalesce(F.regexp_count("text", F.lit(WORDS)), F.lit(0)).cast("long").alias("size"), F.xxhash64("doc_id", "source", "text").alias("body"))


def numbered(rows: DataFrame) -> DataFrame:
    """rows with nth, which tells equal rows apart: they are counted, and dealt out again by number."""
    counted = rows.groupBy(*rows.columns).agg(F.count("*").cast("int").alias("_n"))
    return counted.withColumn("nth", F.explode(F.sequence(F.lit(1), F.col("_n")))).drop("_n")


def targets(sized: DataFrame, weights: tuple = WEIGHTS, most: int = MOST) -> tuple[DataFrame, int]:
    """source, source_size, documents, target of every source, and the number of sources."""
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.when(F.col("size") > 0, 1)).alias("documents"))
    ranked = global_rank(sources, F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    weighed = durable(ranked.select("source", "source_size", "documents", weight.cast("long").alias("weight"), (most * F.col("source_size")).alias("cap")))
    total, all_weights, n = weighed.agg(F.sum("source_size"), F.sum("weight"), F.count("*")).first()
    level, capped = (total or 0) / (all_weights or 1), None
    while True:  # a few numbers each time; at most as often as sources reach their cap
        above = F.col("cap") <= F.col("weight") * F.lit(level)
        words, free, now = weighed.agg(F.sum(F.when(above, F.col("cap"))), F.sum(F.when(~above, F.col("weight"))), F.count(F.when(above, 1))).first()
        if now == capped or not free:
            break
        level, capped = (total - (words or 0)) / free, now
    return weighed.select("source", "source_size", "documents", F.least(F.col("cap").cast("double"), F.col("weight") * F.lit(level)).alias("target")), n


def _fold(draw: str) -> str:
    """One block's games in order, as SQL: the document still undecided (open) and those decided (done)."""
    up, down = "least((1 - a.open.p) * a.open.size, x.p * x.size)", "least(a.open.p * a.open.size, (1 - x.p) * x.size)"
    outcome = f"""CASE WHEN {draw} * ({up} + {down}) < {down}
        THEN CASE WHEN (1 - a.open.p) * a.open.size <= x.p * x.size THEN 'taken' ELSE 'new left' END
        ELSE CASE WHEN a.open.p * a.open.size <= (1 - x.p) * x.size THEN 'left' ELSE 'new taken' END END"""

    def still_open(row: str, p: str) -> str:
        return f"named_struct('doc_id', {row}.doc_id, 'body', {row}.body, 'nth', {row}.nth, 'size', {row}.size, 'p', {p})"

    def decided(row: str, pick: str) -> str:
        return f"named_struct('doc_id', {row}.doc_id, 'body', {row}.body, 'nth', {row}.nth, 'size', {row}.size, 'pick', {pick})"

    game = f"""transform(array({outcome}), won -> named_struct(
        'open', CASE won
            WHEN 'taken' THEN {still_open("x", "x.p - (1 - a.open.p) * a.open.size / x.size")}
            WHEN 'new left' THEN {still_open("a.open", "a.open.p + x.p * x.size / a.open.size")}
            WHEN 'left' THEN {still_open("x", "x.p + a.open.p * a.open.size / x.size")}
            ELSE {still_open("a.open", "a.open.p - (1 - x.p) * x.size / a.open.size")} END,
        'done', array_append(a.done, CASE WHEN won IN ('taken', 'left') THEN {decided("a.open", "int(won = 'taken')")} ELSE {decided("x", "int(won = 'new taken')")} END)))[0]"""
    row = "doc_id: BIGINT, body: BIGINT, nth: INT, size: DOUBLE"
    return f"""aggregate(items,
        CAST(named_struct('open', NULL, 'done', array()) AS STRUCT<open: STRUCT<{row}, p: DOUBLE>, done: ARRAY<STRUCT<{row}, pick: INT>>>),
        (a, x) -> CASE WHEN a.open IS NULL THEN named_struct('open', {still_open("x", "x.p")}, 'done', a.done) ELSE {game} END)"""


def _draw(seed: int, *columns: str) -> str:
    """A number from 0 up to 1 that these columns and the seed fix."""
    return f"(shiftrightunsigned(xxhash64({seed}L, {', '.join(columns)}), 11) / 9007199254740992D)"


def pivotal(parts: DataFrame, blocks: int, seed: int = SEED, block: int = BLOCK) -> DataFrame:
    """doc_id, body, source, size and pick (0 or 1) of every row of parts: source, block (of the `blocks` at most that
    a source has), doc_id, body, nth (among equal rows), size, p (how likely it is picked)."""
    rows, decided = parts.select("source", "block", "doc_id", "body", "nth", F.col("size").cast("double").alias("size"), "p"), None
    while True:
        seed += 1
        items = f"sort_array(collect_list(named_struct('small', -size, 'order', xxhash64({seed}L, body, doc_id, nth), 'doc_id', doc_id, 'body', body, 'nth', nth, 'size', size, 'p', p)))"
        folded = rows.groupBy("source", "block").agg(F.expr(items).alias("items"))
        folded = durable(folded.select("source", "block", F.expr(_fold(_draw(seed, "x.body", "x.doc_id", "x.nth"))).alias("f")).select("source", "block", "f.open", "f.done"))
        done = folded.select("source", F.inline("done")).drop("nth")
        decided = done if decided is None else decided.unionByName(done)
        if blocks <= 1:
            last = folded.select("source", "open.doc_id", "open.body", "open.size", F.expr("int(open.p >= 0.5)").alias("pick"))
            return decided.unionByName(last)
        blocks = -(-blocks // block)
        rows = folded.select("source", F.floor(F.col("block") / block).alias("block"), "open.*")


def mix(docs: DataFrame, weights: tuple = WEIGHTS, most: int = MOST, seed: int = SEED, block: int = BLOCK) -> DataFrame:
    """doc_id, body, source, size, source_size, target and copies (how often it is taken) of every document."""
    sized = durable(numbered(sizes(docs)))
    sources, n = targets(sized, weights, most)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    blocks = F.greatest(F.lit(1), F.ceil(F.col("documents") / block))
    known = durable(sources.select(F.col("source").alias("_source"), "source_size", "target", rate.alias("rate"), blocks.alias("blocks")))
    most_blocks = known.agg(F.max("blocks")).first()[0] or 1

    def per_source(rows: DataFrame) -> DataFrame:
        """The rows with what is known of their source; broadcast only while sources are few."""
        side = F.broadcast(known) if n <= BROADCAST_ROWS else known
        return rows.join(side, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")

    rows = per_source(sized).withColumn("p", F.col("rate") - F.floor("rate"))
    playing = (F.col("size") > 0) & (F.col("p") > 0)
    games = rows.where(playing).select("source", F.pmod(F.xxhash64(F.lit(seed), "body", "nth"), "blocks").alias("block"), "doc_id", "body", "nth", "size", "p")
    sure = rows.where(~playing).select("source", "doc_id", "body", "size", F.lit(0).alias("pick"))
    picked = per_source(pivotal(games, most_blocks, seed, block).unionByName(sure))
    return picked.select("doc_id", "body", "source", F.col("size").cast("long").alias("size"), "source_size", "target", (F.floor("rate") + F.col("pick")).cast("long").alias("copies"))


def op10_mixing(spark, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target and taken of every document."""
    mixed = mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))
