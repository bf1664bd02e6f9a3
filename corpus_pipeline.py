"""A training corpus from `documents`: reject poor documents, cut boilerplate lines, keep one of each group of near
duplicates, mix sources to their weights, pack into sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.

Defined results beyond those of the operators: a document that boilerplate removal leaves blank goes; n_chars follows the
text; of repeated rows one stays after the near-duplicate stage; the mix repeats a row as often as it is taken.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.llm import line_dedup, mixing, packing, quality, simhash
from pagewright.llm.common import durable, passing, shared_dir, table
from pagewright.session import remove

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps."""
    return quality.good(docs.select(*COLUMNS), table(spark, sf_dir, "labels"))


def cut_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that many sites share."""
    cut = line_dedup.dedup_lines(docs.select(*COLUMNS))
    changed = F.col("n_removed") > 0
    cut = cut.where(~(changed & (F.trim("text", F.lit(line_dedup.SPACE)) == "")))
    return cut.withColumn("n_chars", F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group of near duplicates (SimHash of five-word shingles, verified
    at a similarity of 0.8 or more); repeated rows once."""
    found = passing(spark, lambda: simhash.similar_documents(docs))
    key = lambda c: F.coalesce(F.col(c).cast("long"), F.lit(-(1 << 63)))  # noqa: E731  never null, so one shuffle of the texts serves join and repeats
    first = found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(key("doc_id").alias("_key")).distinct()
    rows = docs.select(*COLUMNS, key("doc_id").alias("_key")).join(first, "_key", "left_semi")
    return rows.dropDuplicates(["_key", "doc_id", "text"]).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it."""
    docs = docs.select(*COLUMNS)
    taken = mixing.mix(docs).groupBy("body").agg(F.sum("copies").alias("copies")).where("copies > 0")
    rows = docs.withColumn("body", F.xxhash64(F.col("doc_id").cast("long"), "source", "text"))
    rows = rows.dropDuplicates(["body"])
    return rows.join(taken, "body").select(*COLUMNS, F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("nth")).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where the tokens of every document stand in the training sequences."""
    import public_tokenizers

    return packing.pack(durable(packing.token_pieces(docs, public_tokenizers.path("byte_bpe_50k.json"))))


STAGES = [
    ("quality classifier", keep_good),
    ("line dedup", cut_boilerplate),
    ("SimHash near-dedup", drop_near_duplicates),
    ("mixing sources to target weights", mix_sources),
    ("best-fit packing", pack),
]

#: SQL has neither the hashes nor the tokenizer; the stages are tested against plain versions instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage leaves is written to the shared folder, read by the next, and removed when
    that has written its own."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        path = f"{shared_dir(spark)}/{name.replace(' ', '-').lower()}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            remove(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
