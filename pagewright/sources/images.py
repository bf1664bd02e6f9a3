"""Image files and image-only PDFs (see pdfs.py) as rows.

Files are read by Spark's own readers, so any store that Spark reaches will do; a file that cannot be decoded becomes a
row with an error and is never dropped silently.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagewright import params as P
from pagewright.functions.scalars import is_image_name
from pagewright.sources.pdfs import decoded_pages, read_page_streams


def suffix_glob(suffixes: tuple[str, ...]) -> str:
    """A glob for file names with these suffixes in any spelling."""
    return "*.{" + ",".join("".join(f"[{c}{c.upper()}]" for c in s.removeprefix(".")) for s in suffixes) + "}"


GLOB = suffix_glob(P.IMAGE_SUFFIXES)
PAGE_SCHEMA = "name string, page_no int, width int, height int, channels int, data binary, error string"


def _name(path: str):
    return F.element_at(F.split(F.col(path), "/"), -1)


def exif_orientation(data: bytes) -> int:
    """The orientation tag of a JPEG, 1 if there is none."""
    at = 2
    while data[:2] == b"\xff\xd8" and at + 4 <= len(data) and data[at] == 0xFF:
        size = int.from_bytes(data[at + 2 : at + 4], "big")
        block = data[at + 4 : at + 2 + size]
        if data[at + 1] == 0xE1 and block[:6] == b"Exif\0\0":
            tiff = block[6:]
            order = "little" if tiff[:2] == b"II" else "big"
            start = int.from_bytes(tiff[4:8], order)
            for k in range(int.from_bytes(tiff[start : start + 2], order)):
                entry = tiff[start + 2 + 12 * k : start + 14 + 12 * k]
                if int.from_bytes(entry[:2], order) == 0x0112:
                    value = int.from_bytes(entry[8:10], order)
                    return value if 1 <= value <= 8 else 1
            return 1
        if data[at + 1] == 0xDA:
            break
        at += 2 + size
    return 1


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """A file or folder of images: name, page_no (by name, from 0), image, orientation, error. Only names and the heads
    of files are ranked and searched; the decoded images are joined to those."""

    def orient(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            turned = [exif_orientation(head or b"") for head in batch.column("head").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(turned, pa.int32())], ["path", "orientation"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", GLOB).load(path)
    heads = files.select("path", F.substring("content", 1, 1 << 17).alias("head")).mapInArrow(orient, "path string, orientation int")
    folder = F.regexp_replace("path", "[^/]*$", "")
    nth = F.row_number().over(Window.partitionBy(folder).orderBy(_name("path"))) - 1
    heads = heads.select("path", "orientation", nth.alias("page_no"))
    decoded = spark.read.format("image").option("dropInvalid", True).option("pathGlobFilter", GLOB).load(path).select(F.col("image.origin").alias("origin"), "image")
    rows = heads.join(decoded, F.regexp_replace("path", "^file:/+", "/") == F.regexp_replace("origin", "^file:/+", "/"), "left")
    return rows.select(_name("path").alias("name"), "page_no", "image", "orientation", F.when(F.col("image").isNull(), "not a readable image").alias("error"))


def upright(image: np.ndarray, orientation: int) -> np.ndarray:
    """An image turned and mirrored as its orientation tag says."""
    if orientation >= 5:
        image = image.swapaxes(0, 1)
    if orientation in (2, 3, 6, 7):
        image = image[:, ::-1]
    return image[::-1] if orientation in (3, 4, 7, 8) else image


def oriented(pixels: DataFrame) -> DataFrame:
    """Pixels (with w, h and the orientation of their page) turned upright: only coordinates change."""
    x, y, o = F.col("x"), F.col("y"), F.col("orientation")
    back, down = F.col("w") - 1 - x, F.col("h") - 1 - y
    across = F.when(o.isin(1, 4), x).when(o.isin(2, 3), back).when(o.isin(5, 8), y).otherwise(down)
    along = F.when(o.isin(1, 2), y).when(o.isin(3, 4), down).when(o.isin(5, 6), x).otherwise(back)
    return pixels.withColumns({"x": across.cast("int"), "y": along.cast("int")})


def read_uploads(spark: SparkSession, path: str) -> DataFrame:
    """Uploads under a path: name, content_type, size, content. What is no image by its name is left out before its
    content is read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", GLOB).load(path)
    kind = F.concat(F.lit("image/"), F.regexp_replace(F.lower(F.regexp_extract(_name("path"), r"\.([^.]+)$", 1)), "^jpg$", "jpeg"))
    return files.select(_name("path").alias("name"), kind.alias("content_type"), F.col("length").alias("size"), "content").where(is_image_name(F.col("name")))


def read_pdfs(spark: SparkSession, path: str, page_limit: int | None = None) -> DataFrame:
    """The pages of PDFs under a path, in PAGE_SCHEMA; pages beyond the limit are not decoded, and what can't be decoded
    is a row with an error."""
    return decoded_pages(read_page_streams(spark, path, page_limit))


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["name", "page_no", "width", "height", "channels", "data", "error"])


def collect_pages(spark: SparkSession, path: str, page_limit: int | None = None) -> DataFrame:
    """Pages of a PDF, an image or a folder of images, in PAGE_SCHEMA; images stand upright, whatever way they were stored."""
    if path.lower().endswith(".pdf"):
        return read_pdfs(spark, path, page_limit)
    if "." in path.rsplit("/", 1)[-1] and not path.lower().endswith(P.IMAGE_SUFFIXES):
        raise ValueError(f"no page source: {path}")
    rows = read_images(spark, path)
    rows = rows if page_limit is None else rows.where(F.col("page_no") < page_limit)

    def turned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                name, no, w, h, n, orientation, error = (batch.column(c)[k].as_py() for c in ("name", "page_no", "width", "height", "channels", "orientation", "error"))
                if error is not None:
                    yield _rows([(name, no, None, None, None, None, error)])
                    continue
                image = np.frombuffer(batch.column("data")[k].as_buffer(), np.uint8).reshape(h, w, n)[:, :, : 3 if n > 3 else n]
                image = upright(image, orientation)
                yield _rows([(name, no, image.shape[1], image.shape[0], image.shape[2], np.ascontiguousarray(image).tobytes(), None)])

    flat = rows.select("name", "page_no", F.col("image.width").alias("width"), F.col("image.height").alias("height"), F.col("image.nChannels").alias("channels"), F.col("image.data").alias("data"), "orientation", "error")
    return flat.mapInArrow(turned, PAGE_SCHEMA)
