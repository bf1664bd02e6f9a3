"""Operators on batches of uploads and on the pages of documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from pagewright.functions.scalars import is_image_name, suffix


def first_uploads(uploads: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The first upload of each key; null keys count as empty."""
    same = [F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys]
    nth = F.row_number().over(Window.partitionBy(*same).orderBy(order))
    return uploads.withColumn("_nth", nth).where("_nth = 1").drop("_nth")


def accepted(uploads: DataFrame, name: str = "name") -> DataFrame:
    """Uploads with a name and an image suffix."""
    return uploads.where((F.length(name) > 0) & is_image_name(F.col(name)))


def counted(rows: DataFrame, name: str, **conditions: Column) -> tuple[DataFrame, Observation]:
    """rows, and an observation of how many there are (`rows`) and how many of them meet each condition: known as soon as
    an action has read them all, without a job of its own."""
    seen = Observation(name)
    return rows.observe(seen, F.count(F.lit(1)).alias("rows"), *[F.count(F.when(c, 1)).alias(k) for k, c in conditions.items()]), seen


def accepted_and_counted(uploads: DataFrame, name: str = "name") -> tuple[DataFrame, Observation]:
    """Accepted uploads, and an observation of the rows offered, those skipped because they have no name (`nameless`), and
    those that are no image by their name (`unsupported`)."""
    empty = F.coalesce(F.length(name), F.lit(0)) == 0
    rows, seen = counted(uploads, "uploads", nameless=empty, unsupported=~empty & ~is_image_name(F.col(name)))
    return accepted(rows, name), seen


def scanned_and_counted(pages: DataFrame, name: str = "pages") -> tuple[DataFrame, Observation]:
    """Pages (with data and error), and an observation of how many there are, were scanned and have failed."""
    return counted(pages, name, scanned=F.col("error").isNull() & F.col("data").isNotNull(), failed=F.col("error").isNotNull())


def reject_pdfs(uploads: DataFrame, name: str = "name") -> DataFrame:
    """uploads, or an error if one of them is a PDF: it belongs in a document job."""
    pdf = suffix(F.col(name)) == ".pdf"
    return uploads.where(F.when(pdf, F.raise_error(F.concat(F.lit("a PDF in an image batch: "), F.col(name)))).otherwise(True))


def page_limit(pages: DataFrame, limit: Column, doc: str = "doc_id", page: str = "page_no") -> DataFrame:
    """The first pages of each document; all where the limit is null."""
    nth = F.row_number().over(Window.partitionBy(doc).orderBy(page))
    return pages.withColumn("_nth", nth).where(limit.isNull() | (F.col("_nth") <= limit)).drop("_nth")


def parsed_limit(text: Column) -> Column:
    """A page limit as sent: null if it is no number; below one is an error."""
    n = F.trim(text).try_cast("int")
    return F.when(n < 1, F.raise_error(F.lit("the page limit must be at least 1"))).otherwise(n)


def chunks(pages: DataFrame, size: int, doc: str = "doc_id", page: str = "page_no") -> DataFrame:
    """Runs of pages: doc, chunk, first, last, pages (a string of numbers from 1)."""
    size = max(1, int(size))
    numbered = pages.withColumn("_nth", F.row_number().over(Window.partitionBy(doc).orderBy(page)))
    rows = numbered.groupBy(doc, F.floor((F.col("_nth") - 1) / size).alias("chunk"))
    return rows.agg(F.min("_nth").alias("first"), F.max("_nth").alias("last"), F.array_join(F.transform(F.array_sort(F.collect_list("_nth")), lambda n: n.cast("string")), ",").alias("pages"))


def selection_signature(files: DataFrame, key: str, parts: list[str]) -> DataFrame:
    """One text per key that says which files were picked, in whatever order."""
    one = F.concat_ws(":", *[F.col(p).cast("string") for p in parts])
    return files.groupBy(key).agg(F.array_join(F.array_sort(F.collect_list(one)), "|").alias("signature"))


def described(results: DataFrame) -> DataFrame:
    """Scan results as JSON: name and error, or name, id, width and height; nulls are left out."""
    good = F.col("error").isNull()
    row = F.struct("name", *[F.when(good, F.col(c)).alias(c) for c in ("id", "width", "height")], "error")
    return results.select("name", F.to_json(row).alias("json"))
