"""WARC archives written and read as a table of record chunks.

A payload becomes rows of record and chunk number, of a chunk of bytes each, and its digest is carried from chunk to
chunk, when it is looked for among others and again when it is written. Short payloads are written as one response
record, oversized ones as WARC segments (a response and continuation records), none of which holds more than a chunk; so
beyond the table's own row no step holds a whole oversized payload. Spark's text writer commits the rows, with the
record end of the format as its line end, so a task that is lost or run twice leaves no half archive. Archives are read
and parsed once. Reading splits archives at record starts; a record that fits one chunk is digested where it is read, and the chunks of
longer ones come together in order under a digest that is carried from chunk to chunk. Chunks never hold the text that
starts a record, so splitting is exact whatever the payload.

Of equal payloads of at least `revisit_bytes` that with the smallest page_id is stored, the others refer to it.

Defined results: null html counts as empty; rows with a null page_id are stored only if no other has their payload, and
read back with a null page_id; repeated rows of the smallest page_id are all responses; an empty table gives no
rows and no archives; control characters in an address are percent-encoded; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.llm.common import BROADCAST_ROWS, durable, each_batch, shared_dir, table

START, GAP = b"WARC/1.1\r\n", b"\r\n\r\n"
#: Most bytes of payload in one record.
CHUNK = 1 << 16
#: Payloads from this size on are stored once.
REVISIT_BYTES = 0
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8" + GAP
DATE = "2024-01-01T00:00:00Z"


def chunk_rows(pages: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """The payloads as rows of record and chunk number: page_id, url, body (a hash of the payload), total (its bytes),
    at (from 0), of (how many chunks) and piece (at most so many bytes). The chunks of a record follow each other, so
    what reads them holds no more than one."""
    html = F.coalesce("html", F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", html.alias("payload"), F.xxhash64(F.coalesce("html", F.lit(""))).alias("body"))
    of = F.greatest(F.lit(1), F.ceil(F.octet_length("payload") / chunk)).cast("int")
    rows = rows.select("*", F.octet_length("payload").cast("long").alias("total"), of.alias("of"), F.explode(F.sequence(F.lit(0), of - 1)).alias("at"))
    return rows.select("page_id", "url", "body", "total", "at", "of", F.substring("payload", F.col("at") * chunk + 1, F.lit(chunk)).alias("piece"))


def base32(state) -> str:
    return base64.b32encode(state.digest()).decode()


def digests(pages: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """page_id, body, payload_bytes and payload_digest of every page; the digest is carried from chunk to chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None
        for batch in batches:
            out = []
            for page, body, total, at, of, piece in zip(*(batch.column(c).to_pylist() for c in ("page_id", "body", "total", "at", "of", "piece")), strict=True):
                state = hashlib.sha1(piece) if at == 0 else state
                if at:
                    state.update(piece)
                if at == of - 1:
                    out.append((page, body, total, base32(state)))
            if out:
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], ["page_id", "body", "payload_bytes", "payload_digest"])

    rows = chunk_rows(pages, chunk).select("page_id", "body", "total", "at", "of", "piece")
    return rows.mapInArrow(run, "page_id long, body long, payload_bytes long, payload_digest string")


def _few(side: DataFrame) -> DataFrame:
    """A side that is broadcast while it is counted to be few, so that no digest needs a task of its own."""
    return F.broadcast(side) if side.count() <= BROADCAST_ROWS else side


def revisits(pages: DataFrame, revisit_bytes: int = REVISIT_BYTES, chunk: int = CHUNK) -> DataFrame:
    """page_id, body, payload_digest and first (the smallest page_id with that payload) of the pages that refer to
    another."""
    known = durable(digests(pages, chunk))
    first = known.groupBy("payload_digest", "payload_bytes").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    first = durable(first.where((F.col("n") > 1) & (F.col("payload_bytes") >= revisit_bytes)).select("payload_digest", "first"))
    later = known.select("page_id", "body", "payload_digest").join(_few(first), "payload_digest").where("page_id is null or page_id > first")
    return durable(later.where("first is not null").distinct())


def pieces(raw: bytes) -> list[bytes]:
    """The bytes cut within every record start in them."""
    out = []
    while (k := raw.find(START)) >= 0:
        out.append(raw[: k + len(START) // 2])
        raw = raw[k + len(START) // 2 :]
    return [*out, raw]


def _record(fields: dict[str, object], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in fields.items() if v is not None)
    return START + head.encode() + f"Content-Length: {len(block)}".encode() + GAP + block


def write_archives(pages: DataFrame, path: str, chunk: int = CHUNK, revisit_bytes: int = REVISIT_BYTES, compression: str = "gzip") -> None:
    """Write a record for each row of pages (page_id, url, html) to archives under path. A record of several segments
    has its digest and length in the last one, when all of it has been seen."""
    later = revisits(pages, revisit_bytes, chunk)
    rows = pages.select("page_id", "url", "html", F.xxhash64(F.coalesce("html", F.lit(""))).alias("_body"))
    same = F.col("page_id").eqNullSafe(F.col("_page")) & (F.col("_body") == F.col("body"))
    other = later.withColumnRenamed("page_id", "_page")
    stored = chunk_rows(rows.join(_few(other.select("_page", "body")), same, "left_anti").select("page_id", "url", "html"), chunk)
    stored = stored.select("page_id", "url", "at", "of", "piece", F.lit(None).cast("string").alias("digest"), F.lit(None).cast("long").alias("first"))
    again = rows.select("page_id", "url", "_body").join(_few(other), same).select("page_id", "url", F.lit(0).alias("at"), F.lit(1).alias("of"), F.lit(None).cast("binary").alias("piece"), F.col("payload_digest").alias("digest"), "first")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n, k, state, total, name = TaskContext.get().partitionId(), 0, 0, None, 0, ""
        for batch in batches:
            out = []
            for page, url, at, of, piece, digest, first in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "at", "of", "piece", "digest", "first")), strict=True):
                if at == 0:
                    n, k, total, state = n + 1, 0, 0, hashlib.sha1()
                    name = f"<urn:page:{'' if page is None else page}:{part}:{n}"
                fields = {"WARC-Date": DATE, "WARC-Target-URI": None if url is None else quote(url, safe="!#$%&'()*+,/:;=?@[]~^|{}`\\\"<>")}
                if first is not None:
                    out.append(_record({"WARC-Type": "revisit", "WARC-Record-ID": f"{name}:1>"} | fields | {"WARC-Payload-Digest": f"sha1:{digest}", "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Refers-To": f"<urn:page:{first}>"}, b""))
                    continue
                state.update(piece)
                total += len(piece)
                cut = pieces(piece)
                for j, part_of in enumerate(cut):
                    k += 1
                    last = at == of - 1 and j == len(cut) - 1
                    segments = {"WARC-Segment-Number": None if k == 1 and last else k, "WARC-Segment-Origin-ID": f"{name}:1>" if k > 1 else None, "WARC-Segment-Total-Length": len(HTTP) + total if last and k > 1 else None}
                    kind = {"WARC-Type": "continuation" if k > 1 else "response", "WARC-Record-ID": f"{name}:{k}>", "Content-Type": None if k > 1 else "application/http; msgtype=response"}
                    seen = {"WARC-Payload-Digest": f"sha1:{base32(state)}" if last else None}
                    out.append(_record(kind | fields | seen | segments, (b"" if k > 1 else HTTP) + part_of))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])

    lines = stored.mapInArrow(run, "value binary").unionByName(again.mapInArrow(run, "value binary"))
    lines.select(F.col("value").cast("string")).write.option("lineSep", GAP.decode()).option("compression", compression).text(path)


def _fields(head: bytes) -> dict[str, str]:
    return dict(line.split(": ", 1) for line in head.decode().split("\r\n") if ": " in line)


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """page_id, record (its first record's id), chunk, last (whether it ends the record), record_type, refers_to,
    declared digest, and of chunks that are whole records bytes and digest, of others the chunk itself."""
    lines = spark.read.option("lineSep", (GAP + START).decode()).text(path).select(F.col("value").cast("binary"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in each_batch(batches, 200):
            rows = []
            for raw in batch.column("value").to_pylist():
                head, gap, rest = raw.removeprefix(START).partition(GAP)
                f = _fields(head)
                size = int(f["Content-Length"])
                if not gap or len(rest) < size:
                    raise ValueError(f"cut off record {f.get('WARC-Record-ID')}")
                record = f.get("WARC-Segment-Origin-ID", f["WARC-Record-ID"])
                page = record.split(":")[2]
                kind, k = f["WARC-Type"], int(f.get("WARC-Segment-Number", 1))
                block = rest[:size].split(GAP, 1)[1] if kind == "response" else rest[:size]
                whole = "WARC-Segment-Number" not in f
                digest = base64.b32encode(hashlib.sha1(block).digest()).decode() if whole and kind == "response" else None
                refers = int(f["WARC-Refers-To"].split(":")[2].rstrip(">")) if kind == "revisit" else None
                rows.append((int(page) if page else None, record, k, "WARC-Segment-Total-Length" in f, "response" if kind == "continuation" else kind, refers, f.get("WARC-Payload-Digest", "").removeprefix("sha1:"), len(block) if digest else None, digest, None if whole else block))
            if rows:
                kinds = [pa.int64(), pa.string(), pa.int32(), pa.bool_(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["page_id", "record", "chunk", "last", "record_type", "refers_to", "declared", "bytes", "digest", "payload"])

    return lines.mapInArrow(run, "page_id long, record string, chunk int, last boolean, record_type string, refers_to long, declared string, bytes long, digest string, payload binary")


def _carried(parts: DataFrame) -> DataFrame:
    """One row for each record of several chunks, digested chunk by chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        record, state, total, at = None, None, 0, 0
        for batch in each_batch(batches, 50):
            out = []
            for page, rec, k, last, declared, payload in zip(*(batch.column(c).to_pylist() for c in ("page_id", "record", "chunk", "last", "declared", "payload")), strict=True):
                if rec != record:
                    record, state, total, at = rec, hashlib.sha1(), 0, 0
                if k != at + 1:
                    raise ValueError(f"chunk {at + 1} of {rec} is missing")
                state.update(payload)
                total, at = total + len(payload), k
                if last:
                    out.append((page, "response", None, declared, total, base64.b32encode(state.digest()).decode()))
            if out:
                kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], ["page_id", "record_type", "refers_to", "declared", "bytes", "digest"])

    ordered = parts.repartition(F.col("record")).sortWithinPartitions("record", "chunk")
    return ordered.select("page_id", "record", "chunk", "last", "declared", "payload").mapInArrow(run, "page_id long, record_type string, refers_to long, declared string, bytes long, digest string")


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every record in the archives under path."""
    rows = durable(read_chunks(spark, path))
    columns = ["page_id", "record_type", "refers_to", "declared", "bytes", "digest"]
    whole = rows.where("payload is null").select(*columns).unionByName(_carried(rows.where("payload is not null")))
    stored = whole.where("record_type = 'response'").withColumn("digest", F.when(F.col("digest") == F.col("declared"), F.col("digest")).otherwise(F.raise_error(F.concat(F.lit("damaged payload of page "), F.col("page_id")))))
    again = whole.where("record_type = 'revisit'").drop("bytes", "digest")
    known = again.select(F.col("declared").alias("digest")).distinct()
    lengths = durable(stored.join(known, "digest", "left_semi").groupBy("digest").agg(F.max("bytes").alias("bytes")))
    again = again.withColumnRenamed("declared", "digest").join(_few(lengths), "digest", "left")
    every = stored.select("page_id", "bytes", "digest", "record_type", "refers_to").unionByName(again.select("page_id", "bytes", "digest", "record_type", "refers_to"))
    return every.select("page_id", F.col("bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"), "record_type", "refers_to")


def op6_warc(spark, sf_dir: str) -> DataFrame:
    """Every page's record, written to archives and read back."""
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_archives(table(spark, sf_dir, "pages"), path)
    return read_records(spark, path)


_BASE32 = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (CAST('0x' || substr(sha1(coalesce(html, '')), {1 + 5 * k}, 5) AS INT) >> {shift}) % 32 + 1, 1)" for k in range(8) for shift in (15, 10, 5, 0))

ORACLE = f"""
WITH p AS (SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, {_BASE32} AS payload_digest FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS least FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id > least AND payload_bytes >= {REVISIT_BYTES} THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN page_id > least AND payload_bytes >= {REVISIT_BYTES} THEN least END AS refers_to FROM f
"""
