"""Near-duplicates by circulant MinHash.

A document's set of four-word shingles, hashed to 64 bits, is scattered by one permutation of all 64-bit numbers; another
permutation, shifted circularly by 0, 1, 2 ..., then gives every coordinate of the signature: coordinate k is the least
pi(sigma(hash) - k). Both are fixed invertible mixing functions, so no table of them is kept. Signatures are cut into
bands, and texts that agree in all rows of a band meet in its cell; those that meet are decided on their full sets (see
shingles.py), so a link is never an estimate. With 32 bands of five rows a pair at a similarity of 0.8 is missed with a
probability of 3 in a million, at 0.85 of 1 in 100 million.

Defined results: documents without words or text have an empty set, are linked with nothing and are their own component;
fewer words than a shingle are one shingle, the whole sequence; equal sets are one text; a null id keeps its row and
names a component only where no id of it is known; repeated rows stay; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.llm.common import durable, table
from pagewright.llm.shingles import ALIKE, CROWD, Sets, connect, distinct_texts, named, profiles

BANDS, ROWS, SHINGLE = 32, 5, 4
#: Shingles that are hashed together.
CHUNK = 512


def _mix(x: np.ndarray, first: int, second: int) -> np.ndarray:
    """A permutation of all 64-bit numbers, in place."""
    x ^= x >> np.uint64(32)
    x *= np.uint64(first)
    x ^= x >> np.uint64(29)
    x *= np.uint64(second)
    x ^= x >> np.uint64(32)
    return x


def scatter(hashes: np.ndarray) -> np.ndarray:
    """The permutation that comes before all shifts."""
    return _mix(hashes.copy(), 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)


def shifted(x: np.ndarray) -> np.ndarray:
    """The permutation that is shifted, in place."""
    return _mix(x, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53)


def signature(hashes: np.ndarray, length: int) -> np.ndarray:
    """Coordinate k: the least value of the shifted permutation over all (distinct) hashes."""
    shifts = np.arange(length, dtype=np.uint64)[:, None]
    least = np.full(length, np.iinfo(np.uint64).max, np.uint64)
    scattered = scatter(hashes)
    for at in range(0, len(scattered), CHUNK):
        np.minimum(least, shifted(scattered[None, at : at + CHUNK] - shifts).min(1), out=least)
    return least


def band_cells(own: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> list[int]:
    """A number for each band of a set's signature."""
    values = signature(own, bands * rows).reshape(bands, rows)
    cells = np.arange(1, bands + 1, dtype=np.uint64)
    for k in range(rows):
        cells = _mix(cells ^ values[:, k], 0x9FB21C651E98DF25, 0xE7037ED1A0B428DB)
    return cells.view(np.int64).tolist()


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, alike: float = ALIKE, bands: int = BANDS, rows: int = ROWS, crowd: int = CROWD) -> DataFrame:
    """doc_id, n_shingles, component_id (the least doc_id that links reach) and kept of every document."""
    found = durable(profiles(docs, shingle, lambda hashes, own: band_cells(own, bands, rows), "bands", empty=False))
    texts = distinct_texts(found, "bands")
    links = connect(
        texts.select("id", "size", "bands"),
        Sets(docs, texts, shingle),
        index=lambda t: t.select(*[c for c in t.columns if c != "bands"], F.explode("bands").alias("cell")),
        alike=alike,
        crowd=crowd,
    )
    rows_of = named(found.select("doc_id", "key", "size"), texts, durable(links))
    component = F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return rows_of.select("doc_id", F.col("size").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def op11_minhash(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every document."""
    return near_duplicates(table(spark, sf_dir, "documents"))


ORACLE = """
WITH RECURSIVE w AS (
    SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws
    FROM documents
), s AS (
    SELECT DISTINCT doc_id, array_to_string(ws[i:i + 3], ' ') AS shingle FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 2, 2))) AS i FROM w WHERE len(ws) > 0)
), n AS (
    SELECT doc_id, count(*) AS n FROM s GROUP BY 1
), shared AS (
    SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY 1, 2
), links AS (
    SELECT a, b FROM shared JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * k >= 80 * (na.n + nb.n - k)
), both_ways AS (
    SELECT a, b FROM links UNION SELECT b, a FROM links
), reach AS (
    SELECT doc_id, doc_id AS other FROM documents
    UNION
    SELECT r.doc_id, e.b FROM reach r JOIN both_ways e ON r.other = e.a
), c AS (
    SELECT doc_id, min(other) AS component_id FROM reach GROUP BY 1
)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d JOIN c ON c.doc_id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""
