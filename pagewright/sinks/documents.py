"""Pages as PNG or JPEG, documents as PDF, thumbnails, and an artifact store.

Artifacts are rows of name and content, so they can be kept as a table by Spark's own writers; export (artifacts.py) puts
them into a folder, each file complete or absent.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright import params as P
from pagewright.functions.scalars import frame_thickness, page_layout, sanitize_name
from pagewright.operators import rasters as R
from pagewright.sinks.artifacts import export, safely_named
from pagewright.sinks.jpeg import jpeg

__all__ = ["Artifacts", "assemble", "downloadable", "encoded", "export", "framed", "page_artifacts", "png", "thumbnails", "to_images"]


def to_images(pixels: DataFrame) -> DataFrame:
    """Pixel rows (page_id, canvas_w, canvas_h, y, x, v) as one gray image per page: page_id, width, height, channels,
    data. What is not listed is white."""

    def draw(page: pd.DataFrame) -> pd.DataFrame:
        w, h = int(page["canvas_w"].iloc[0]), int(page["canvas_h"].iloc[0])
        canvas = np.full((h, w), 255, np.uint8)
        canvas[page["y"], page["x"]] = page["v"]
        return pd.DataFrame({"page_id": [page["page_id"].iloc[0]], "width": [w], "height": [h], "channels": [1], "data": [canvas.tobytes()]})

    return pixels.select("page_id", "canvas_w", "canvas_h", "y", "x", "v").groupBy("page_id").applyInPandas(draw, "page_id long, width int, height int, channels int, data binary")


def framed(image: np.ndarray, thickness: int) -> np.ndarray:
    """A black frame, one stroke inside the edges."""
    h, w = image.shape[:2]
    out, half = image.copy(), thickness // 2
    edge = np.zeros((h, w), bool)
    edge[max(0, thickness - half) : h - thickness + half, max(0, thickness - half) : w - thickness + half] = True
    edge[thickness + half + 1 : h - 1 - thickness - half, thickness + half + 1 : w - 1 - thickness - half] = False
    out[edge] = 0
    return out


def png(width: int, height: int, channels: int, data: bytes) -> bytes:
    rows = np.frombuffer(data, np.uint8).reshape(height, width, channels)[:, :, ::-1].reshape(height, -1)
    raw = np.hstack([np.zeros((height, 1), np.uint8), rows]).tobytes()
    block = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    head = struct.pack(">IIBBBBB", width, height, 8, 2 if channels == 3 else 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + block(b"IHDR", head) + block(b"IDAT", zlib.compress(raw)) + block(b"IEND", b"")


def encoded(width: int, height: int, channels: int, data: bytes, kind: str = "png", quality: int = 95) -> bytes | None:
    """An image file; None for what is no image."""
    try:
        return png(width, height, channels, data) if kind == "png" else jpeg(np.frombuffer(data, np.uint8).reshape(height, width, channels), quality)
    except (ValueError, TypeError):
        return None


def page_artifacts(images: DataFrame, prefix: str = "page_", kind: str = "png", quality: int = 95) -> DataFrame:
    """images (page_no, width, height, channels, data) as PNG or JPEG artifacts numbered from 1; pages without data give
    none."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):  # one page at a time
                file = encoded(*(batch.column(c)[k].as_py() for c in ("width", "height", "channels", "data")), kind, quality)
                if file is not None:
                    yield pa.RecordBatch.from_arrays([pa.array([batch.column("name")[k].as_py()]), pa.array([file], pa.binary())], ["name", "content"])

    named = images.select(F.format_string(f"{prefix}%04d.{kind}", F.col("page_no") + 1).alias("name"), "width", "height", "channels", "data")
    return named.mapInArrow(encode, "name string, content binary")


def thumbnails(images: DataFrame, side: int = P.THUMBNAIL) -> DataFrame:
    """images with a long side of at most so many pixels, never enlarged; each pixel is the mean of its area."""

    def small(image: np.ndarray) -> np.ndarray:
        h, w = image.shape[:2]
        scale = min(1.0, side / max(w, h))
        size = max(1, int(w * scale + 0.5)), max(1, int(h * scale + 0.5))
        return image if scale == 1.0 else np.dstack([R.shrunk(image[:, :, k], *size) for k in range(image.shape[2])])

    return R.each_page(images, small)


def _pdf(pages: list[tuple], border: bool, quality: int | None) -> bytes:
    """A PDF of one image per page, without loss or as JPEG of a quality. pages: width, height, channels, data, thickness, page box and image box."""
    objects: list[bytes] = [b"<< /Type /Catalog /Pages 2 0 R >>", b""]
    kids = []
    for w, h, n, data, thickness, page_w, page_h, x0, y0, x1, y1 in pages:
        image = np.frombuffer(data, np.uint8).reshape(h, w, n)
        image = framed(image, thickness) if border else image
        body = zlib.compress(image[:, :, ::-1].tobytes()) if quality is None else jpeg(image, quality)
        form = "FlateDecode" if quality is None else "DCTDecode"
        draw = f"q {x1 - x0:.4f} 0 0 {y1 - y0:.4f} {x0:.4f} {page_h - y1:.4f} cm /I Do Q".encode()
        at = len(objects) + 1
        space = "DeviceRGB" if n == 3 else "DeviceGray"
        objects.append(f"<< /Type /XObject /Subtype /Image /Width {w} /Height {h} /ColorSpace /{space} /BitsPerComponent 8 /Filter /{form} /Length {len(body)} >>\nstream\n".encode() + body + b"\nendstream")
        objects.append(f"<< /Length {len(draw)} >>\nstream\n".encode() + draw + b"\nendstream")
        objects.append(f"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 {page_w:g} {page_h:g}] /Resources << /XObject << /I {at} 0 R >> >> /Contents {at + 1} 0 R >>".encode())
        kids.append(f"{at + 2} 0 R")
    objects[1] = f"<< /Type /Pages /Kids [{' '.join(kids)}] /Count {len(kids)} >>".encode()
    out, places = bytearray(b"%PDF-1.4\n"), []
    for k, body in enumerate(objects, 1):
        places.append(len(out))
        out += f"{k} 0 obj\n".encode() + body + b"\nendobj\n"
    start = len(out)
    out += f"xref\n0 {len(objects) + 1}\n0000000000 65535 f \n".encode() + b"".join(f"{p:010d} 00000 n \n".encode() for p in places)
    return bytes(out + f"trailer\n<< /Size {len(objects) + 1} /Root 1 0 R >>\nstartxref\n{start}\n%%EOF\n".encode())


def assemble(images: DataFrame, page_size: str | None = "A4", margin: float = 0.0, border: bool = True, quality: int | None = None) -> DataFrame:
    """One PDF artifact per document of images (doc_id, page_no, width, height, channels, data): name, content; pages are
    kept without loss, or as JPEG of a quality. A task
    assembles one document at a time; the sources bound a document's pages and bytes."""
    box = page_layout(F.col("width"), F.col("height"), page_size, margin)
    rows = images.select("doc_id", "page_no", "width", "height", "channels", "data", frame_thickness(F.col("width"), F.col("height")).alias("thickness"), box.alias("box")).select("*", "box.*").drop("box")

    def write(pages: pd.DataFrame) -> pd.DataFrame:
        pages = pages.sort_values("page_no")
        columns = ["width", "height", "channels", "data", "thickness", "page_w", "page_h", "x0", "y0", "x1", "y1"]
        content = _pdf(list(pages[columns].itertuples(index=False, name=None)), border, quality)
        return pd.DataFrame({"doc_id": [pages["doc_id"].iloc[0]], "content": [content]})

    done = rows.groupBy("doc_id").applyInPandas(write, "doc_id string, content binary") if dict(images.dtypes)["doc_id"] == "string" else rows.withColumn("doc_id", F.col("doc_id").cast("string")).groupBy("doc_id").applyInPandas(write, "doc_id string, content binary")
    return done.select(sanitize_name(F.concat(F.lit("scanned_"), "doc_id", F.lit(".pdf"))).alias("name"), "content")


class Artifacts:
    """Artifacts kept as a table of name and content under a path of any store that Spark writes: saved, read, looked
    up and deleted by name. Content is written once; a deletion is a row of its own, so nothing is rewritten. Versions
    are in one order: by time, then by the save (a random name), then by row."""

    VERSION = "struct(at, save, nth)"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _append(self, rows: DataFrame) -> None:
        version = [F.current_timestamp().alias("at"), F.lit(uuid.uuid4().hex).alias("save"), F.monotonically_increasing_id().alias("nth")]
        rows.select("name", "content", *version).write.mode("append").parquet(self.path)

    def save(self, artifacts: DataFrame) -> None:
        """Keep artifacts (name, content); a name that is there already gets the new content, and of one name given twice
        the later row stays."""
        self._append(safely_named(artifacts).select("name", F.coalesce("content", F.lit(b"")).alias("content")))

    def delete(self, names: DataFrame) -> None:
        """Forget the artifacts with these names (a column name); unknown ones are no error."""
        self._append(names.select("name", F.lit(None).cast("binary").alias("content")))

    def read(self) -> DataFrame:
        """name and content of every artifact."""
        last = self._table().groupBy("name").agg(F.max_by("content", F.expr(self.VERSION)).alias("content"))
        return last.where("content is not null")

    def exists(self, names: DataFrame) -> DataFrame:
        """names with found: whether there is such an artifact. Contents are not read."""
        there = self._table().select("name", F.expr(self.VERSION).alias("version"), F.col("content").isNotNull().alias("kept"))
        there = there.groupBy("name").agg(F.max_by("kept", "version").alias("found"))
        return names.select("name").join(there, "name", "left").select("name", F.coalesce("found", F.lit(False)).alias("found"))

    def _table(self) -> DataFrame:
        return self.spark.read.schema("name string, content binary, at timestamp, save string, nth long").parquet(self.path)


def downloadable(names: DataFrame) -> DataFrame:
    """Artifact names that a client may fetch as a document: flat, and made by assemble."""
    name = F.col("name")
    return names.where((name == sanitize_name(name)) & name.startswith("scanned_") & name.endswith(".pdf"))
