"""Line dedup by how many sites a line is spread over.

Every line hash gets HyperLogLog sketches of the sites and of the distinct texts it stands in, merged by aggregation. A
line far above or below the threshold is decided by its sketches; one near it gets exact distinct counts. A line in
`sites` sites or more (and as many distinct texts, so that copies of one text do not make its lines boilerplate) is
boilerplate: it goes from every document but that with the smallest doc_id. Unless it is given, `sites` is 10, or half
of all sites where there are fewer than 20, but 2 at least.

Defined results: null text has no lines and stays null; lines are compared without white space (space and
\\x09-\\x0D) around them and kept as they are; blank lines are never counted nor removed; a null source is no
site; rows with a null doc_id lose their boilerplate lines; rows are told apart by doc_id and text, so repeated rows are
treated alike; other columns are kept.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.llm.common import BROADCAST_ROWS, durable, each_batch, raw_texts, table

SITES = 10
#: What is trimmed off a line before it is compared, so a line is one with either line end.
SPACE = " \t\n\x0b\x0c\r"
#: Base-2 logarithm of a sketch's registers, and the relative error that this gives.
LOG_K = 12
ERROR = 1.04 / 2 ** (LOG_K / 2)


def line_rows(docs: DataFrame) -> DataFrame:
    """doc_id, body (a hash of the text), source, at (line number) and h1, h2 (of the trimmed line) of every line that is not blank."""
    lines = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("body"), "source", F.posexplode(F.split("text", "\n")).alias("at", "line"))
    lines = lines.withColumn("line", F.trim("line", F.lit(SPACE))).where("line <> ''")
    return lines.select("doc_id", "body", "source", "at", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"))


def _few(lines: DataFrame) -> DataFrame:
    """Lines to join others with: counted, and broadcast while they are few, so that a line that is everywhere needs no
    task of its own; past the bound the join shuffles."""
    lines = durable(lines)
    return F.broadcast(lines) if lines.count() <= BROADCAST_ROWS else lines


def boilerplate(lines: DataFrame, sites: int = SITES) -> DataFrame:
    """h1, h2 and first (the smallest doc_id) of the lines in so many sites and distinct texts."""
    sketch = [F.hll_sketch_estimate(F.hll_sketch_agg(c, F.lit(LOG_K))).alias(n) for c, n in (("source", "n_sites"), ("body", "n_texts"))]
    spread = lines.groupBy("h1", "h2").agg(*sketch, F.min("doc_id").alias("first"))
    slack = max(1, round(4 * ERROR * sites))
    spread = durable(spread.where((F.col("n_sites") >= sites - slack) & (F.col("n_texts") >= sites - slack)))
    sure = (F.col("n_sites") > sites + slack) & (F.col("n_texts") > sites + slack)
    near = spread.where(~sure).select("h1", "h2", "first")
    exact = lines.join(_few(near), ["h1", "h2"]).groupBy("h1", "h2", "first").agg(F.countDistinct("source").alias("n_sites"), F.countDistinct("body").alias("n_texts"))
    exact = exact.where((F.col("n_sites") >= sites) & (F.col("n_texts") >= sites))
    return spread.where(sure).select("h1", "h2", "first").unionByName(exact.select("h1", "h2", "first"))


def enough_sites(docs: DataFrame) -> int:
    """How many sites make a line boilerplate."""
    return min(SITES, max(2, -(-docs.agg(F.countDistinct("source")).first()[0] // 2)))


def dedup_lines(docs: DataFrame, sites: int | None = None) -> DataFrame:
    """docs without boilerplate lines, with n_lines, n_removed and kept_sha256 (of the text that is left)."""
    lines, sites = line_rows(docs), sites or enough_sites(docs)
    common = _few(boilerplate(lines, sites))
    drop = lines.join(common, ["h1", "h2"]).where("doc_id is null or doc_id > first")
    drop = drop.groupBy("doc_id", "body").agg(F.collect_set("at").alias("drop"))
    kept = [f for f in docs.schema.fields if f.name not in ("n_lines", "n_removed", "kept_sha256")]
    rows = docs.select(F.struct(*[f"`{f.name}`" for f in kept]).alias("doc"), F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("own"))
    rows = rows.join(drop, F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("own") == F.col("body")), "left").select("doc", "drop")
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), "n_lines long, n_removed long, kept_sha256 string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in each_batch(batches, 1000):
            texts, counts, removed, digests = [], [], [], []
            doc = {f.name: batch.column("doc").field(k) for k, f in enumerate(kept)}
            for raw, drop in zip(raw_texts(doc["text"]), batch.column("drop").to_pylist(), strict=True):
                parts = [] if raw is None else raw.split(b"\n")
                gone = set(drop or ())
                left = raw if not gone else b"\n".join(x for i, x in enumerate(parts) if i not in gone)
                texts.append(left)
                counts.append(len(parts))
                removed.append(len(gone))
                digests.append(hashlib.sha256(left or b"").hexdigest())
            columns = [pa.array(texts, pa.binary()).cast(pa.string()) if f.name == "text" else doc[f.name] for f in kept]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(digests, pa.string())], [*(f.name for f in kept), "n_lines", "n_removed", "kept_sha256"])

    return rows.mapInArrow(run, schema)


def op3_line_dedup(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_removed and kept_sha256 of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_removed", "kept_sha256")


_SPACE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
ORACLE = f"""
WITH enough AS (
    SELECT least({SITES}, greatest(2, (count(DISTINCT source) + 1) // 2)) AS n FROM documents
), lines AS (
    SELECT doc_id, source, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n
    FROM documents
), spread AS (
    SELECT trim(line, {_SPACE}) AS line, min(doc_id) AS first_id
    FROM lines WHERE trim(line, {_SPACE}) <> ''
    GROUP BY 1 HAVING count(DISTINCT source) >= (SELECT n FROM enough) AND count(DISTINCT md5(text)) >= (SELECT n FROM enough)
), kept AS (
    SELECT doc_id, count(*) AS n_lines, count(s.line) FILTER (WHERE doc_id > first_id) AS n_removed,
        string_agg(l.line, chr(10) ORDER BY n) FILTER (WHERE s.line IS NULL OR NOT doc_id > first_id) AS text
    FROM lines l LEFT JOIN spread s ON trim(l.line, {_SPACE}) = s.line
    GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(k.text, '')) AS kept_sha256
FROM documents d LEFT JOIN kept k USING (doc_id)
"""
