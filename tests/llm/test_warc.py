import base64
import gzip
import hashlib
import uuid

from pagewright.llm import warc
from pagewright.llm.common import shared_dir


def plain(pages, least=0):
    digest = lambda h: base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode()
    first = {}
    for page, _, html in pages:
        if page is not None:
            first[digest(html)] = min(first.get(digest(html), page), page)
    out = []
    for page, _, html in pages:
        n, d = len((html or "").encode()), digest(html)
        one = first.get(d)
        revisit = n >= least and one is not None and page != one
        out.append((page, n, d, "revisit" if revisit else "response", one if revisit else None))
    return out


def round_trip(spark, pages, columns="page_id long, url string, html string", **options):
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    warc.write_archives(spark.createDataFrame(pages, columns), path, **options)
    return path, sorted(map(str, map(tuple, warc.read_records(spark, path).collect())))


TRICKY = "a\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\nWARC/1.1\r\n"
PAGES = [
    (1, "http://a/", "<p>é</p>"),
    (7, "http://b/ü?q=1\r\nX: y", "<p>é</p>"),
    (3, None, None),
    (4, "http://c/", ""),
    (5, "http://d/", "WARC/1.1\r\n"),
    (6, "http://e/", TRICKY * 5),
    (8, "http://f/", "\r\nWARC/1.1\r\n\r\n"),
    (9, "http://g/", "long " * 9000 + TRICKY),
    (None, "http://h/", "<p>é</p>"),
    (None, "http://i/", "only here"),
    (10, "http://j/", "twice"),
    (10, "http://j/", "twice"),
]


def test_round_trip(spark):
    _, rows = round_trip(spark, PAGES, chunk=1000)
    assert rows == sorted(map(str, plain(PAGES)))
    _, rows = round_trip(spark, PAGES, chunk=3)
    assert rows == sorted(map(str, plain(PAGES)))
    _, rows = round_trip(spark, PAGES, revisit_bytes=6)
    assert rows == sorted(map(str, plain(PAGES, 6)))


def test_pieces_never_hold_a_record_start():
    for raw in (b"", TRICKY.encode() * 3, b"x" * 100, b"WARC/1.1\r\n" * 4):
        cut = warc.pieces(raw)
        assert b"".join(cut) == raw and all(b"WARC/1.1\r\n" not in p for p in cut)


def test_payloads_become_chunk_rows(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    for size in (1, 7, 1000):
        rows = {}
        for r in warc.chunk_rows(pages, size).collect():
            assert len(r.piece) <= size and 0 <= r["at"] < r["of"]
            rows.setdefault((r.page_id, r.body), {}).setdefault(r["at"], bytes(r.piece))
        whole = {(page, (html or "").encode()) for page, _, html in PAGES}
        assert {(page, b"".join(parts[k] for k in sorted(parts))) for (page, _), parts in rows.items()} == whole
        found = {(r.page_id, r.payload_bytes, r.payload_digest) for r in warc.digests(pages, size).collect()}
        assert found == {x[:3] for x in plain(PAGES)}


def test_archives_are_plain_records(spark):
    path, _ = round_trip(spark, PAGES[:2])
    local = path.removeprefix("file:")
    import glob

    data = b"".join(gzip.open(f).read() for f in glob.glob(f"{local}/*.gz"))
    assert data.count(b"WARC/1.1\r\n") == 2 and data.endswith(b"\r\n\r\n") and b"WARC-Type: revisit" in data


def test_empty_and_clashing(spark):
    assert round_trip(spark, [])[1] == []
    pages = spark.createDataFrame([(*p, "x", 1) for p in PAGES[:3]], "page_id long, url string, html string, payload_digest string, first long")
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    warc.write_archives(pages, path)
    assert warc.read_records(spark, path).count() == 3
