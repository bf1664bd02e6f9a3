import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagewright import cli
from pagewright.operators import images as I
from pagewright.params import ScanParams
from pagewright.sinks import documents as D
from pagewright.sources import images as S

SCHEMA = "doc_id string, page_no int, width int, height int, channels int, data binary"


@pytest.fixture(scope="module")
def drawn():
    rng = np.random.default_rng(3)
    return [rng.integers(0, 256, (12, 9, 3), np.uint8), rng.integers(0, 256, (7, 20, 3), np.uint8)]


def rows(pages, doc="d"):
    return [(doc, k, p.shape[1], p.shape[0], p.shape[2], p.tobytes()) for k, p in enumerate(pages)]


def test_png_round_trip_through_sparks_reader(spark, drawn, tmp_path):
    D.export(D.page_artifacts(spark.createDataFrame(rows(drawn), SCHEMA)), str(tmp_path))
    (tmp_path / "broken.png").write_bytes(b"no image")
    (tmp_path / "notes.txt").write_text("no page")
    assert sorted(p.name for p in tmp_path.iterdir()) == ["broken.png", "notes.txt", "page_0001.png", "page_0002.png"]
    got = {r["name"]: r for r in S.read_images(spark, str(tmp_path)).collect()}
    assert sorted(got) == ["broken.png", "page_0001.png", "page_0002.png"] and got["broken.png"].error and got["page_0002.png"].page_no == 2
    for k, page in enumerate(drawn, 1):
        assert bytes(got[f"page_000{k}.png"].image.data) == page.tobytes()
    assert {r["name"]: r["content_type"] for r in S.read_uploads(spark, str(tmp_path)).collect()}["page_0001.png"] == "image/png"
    pixels = I.from_images(S.read_images(spark, str(tmp_path)).where("error is null").withColumn("page_id", F.col("page_no")))
    first = {(r.y, r.x): (r.b, r.g, r.r) for r in pixels.where("page_id = 1").collect()}
    assert first == {(y, x): tuple(map(int, drawn[0][y, x])) for y in range(12) for x in range(9)}


def test_pdf_round_trip(spark, drawn, tmp_path):
    D.export(D.assemble(spark.createDataFrame(rows(drawn), SCHEMA), border=False), str(tmp_path))
    (tmp_path / "bad.pdf").write_bytes(b"%PDF-1.4 nothing")
    pages = {(r["name"], r["page_no"]): r for r in S.read_pdfs(spark, str(tmp_path)).collect()}
    assert pages["bad.pdf", 0].error == "no page images"
    for k, page in enumerate(drawn):
        assert bytes(pages["scanned_d.pdf", k].data) == page.tobytes()
    assert S.read_pdfs(spark, str(tmp_path / "scanned_d.pdf"), page_limit=1).count() == 1
    text = (tmp_path / "scanned_d.pdf").read_bytes()
    assert b"/MediaBox [0 0 595 842]" in text and b"/MediaBox [0 0 842 595]" in text and b"/Count 2" in text


@pytest.mark.parametrize("shape", [(40, 61, 3), (8, 8, 1), (1, 1, 3), (120, 97, 3), (17, 9, 1)])
def test_jpeg_is_what_sparks_reader_decodes(spark, shape, tmp_path):
    y, x = np.mgrid[: shape[0], : shape[1]]
    page = np.dstack([(128 + 80 * np.sin(x / (7 + c)) + 30 * np.cos(y / 5)).clip(0, 255) for c in range(shape[2])]).astype(np.uint8)
    pages = spark.createDataFrame([*rows([page]), ("d", 1, None, None, None, None)], SCHEMA)
    D.export(D.page_artifacts(pages, kind="jpg"), str(tmp_path))
    (got,) = S.collect_pages(spark, str(tmp_path)).collect()
    assert (got["name"], got.width, got.height, got.channels, got.error) == ("page_0001.jpg", shape[1], shape[0], shape[2], None)
    assert np.abs(np.frombuffer(got.data, np.uint8).astype(int) - page.ravel()).mean() < 1.5
    assert len(D.encoded(*rows([page])[0][2:], "jpg", 30)) <= len(D.encoded(*rows([page])[0][2:], "jpg", 95))
    assert D.encoded(3, 3, 3, b"short", "jpg") is None


def test_huffman_codes_fit_and_are_complete_but_for_one():
    from pagewright.sinks.jpeg import code_lengths

    counts = np.zeros(256, np.int64)
    counts[:40] = [int(1.6**k) for k in range(40)]  # unlimited codes would be longer
    lengths = code_lengths(counts)
    assert len(lengths) == 40 and max(lengths.values()) <= 16
    assert sum(2 ** (16 - n) for n in lengths.values()) < 2**16


def test_images_are_turned_upright(spark, tmp_path):
    page = np.arange(24, dtype=np.uint8).reshape(4, 6).repeat(8, 0).repeat(8, 1)[:, :, None].repeat(3, 2) * 10
    for o in range(1, 9):
        tiff = b"II*\0\x08\0\0\0\x01\0" + struct.pack("<HHIHH", 0x0112, 3, 1, o, 0)
        app1 = b"Exif\0\0" + tiff
        file = D.encoded(page.shape[1], page.shape[0], 3, page.tobytes(), "jpg", 100)
        (tmp_path / f"p{o}.JpG").write_bytes(file[:2] + b"\xff\xe1" + struct.pack(">H", len(app1) + 2) + app1 + file[2:])
    want = {1: page, 2: page[:, ::-1], 3: page[::-1, ::-1], 4: page[::-1], 5: page.swapaxes(0, 1), 6: np.rot90(page, -1), 7: np.rot90(page, -1)[:, ::-1].swapaxes(0, 1)[::-1, ::-1].swapaxes(0, 1), 8: np.rot90(page)}
    want[7] = page[::-1, ::-1].swapaxes(0, 1)
    got = S.collect_pages(spark, str(tmp_path)).collect()
    assert len(got) == 8
    for r in got:
        image = np.frombuffer(r.data, np.uint8).reshape(r.height, r.width, r.channels)
        expected = want[int(r["name"][1])]
        assert image.shape == expected.shape and np.abs(image.astype(int) - expected).mean() < 2, r["name"]


def test_artifacts_are_saved_read_found_and_deleted(spark, tmp_path):
    store = D.Artifacts(spark, str(tmp_path / "store"))
    store.save(spark.createDataFrame([("a.pdf", bytearray(b"1")), ("../b c.png", bytearray(b"2")), ("e", None)], "name string, content binary"))
    store.save(spark.createDataFrame([("a.pdf", bytearray(b"3"))], "name string, content binary"))
    store.delete(spark.createDataFrame([("e",), ("never",)], "name string"))
    assert {r["name"]: bytes(r.content) for r in store.read().collect()} == {"a.pdf": b"3", "_b_c.png": b"2"}
    asked = spark.createDataFrame([("a.pdf",), ("e",), ("x",)], "name string")
    assert {r["name"]: r.found for r in store.exists(asked).collect()} == {"a.pdf": True, "e": False, "x": False}


def test_thumbnails(spark, drawn):
    wide = np.full((30, 2000, 3), 9, np.uint8)
    pages = spark.createDataFrame([(k, p.shape[1], p.shape[0], 3, p.tobytes(), None) for k, p in enumerate([wide, drawn[0]])], D.R.SCHEMA)
    got = {r.page_id: r for r in D.thumbnails(pages).collect()}
    assert (got[0].width, got[0].height) == (960, 14) and set(got[0].data) == {9} and bytes(got[1].data) == drawn[0].tobytes()


def test_frame(drawn):
    out = D.framed(np.full((40, 30), 255, np.uint8), 3)
    assert (out[0] == 255).all() and (out[3, 3:27] == 0).all() and (out[6:34, 6:24] == 255).all()


@pytest.mark.parametrize("orientation", range(1, 9))
def test_orientation(spark, orientation):
    tiff = b"II*\0\x08\0\0\0\x01\0" + struct.pack("<HHIHH", 0x0112, 3, 1, orientation, 0)
    app1 = b"Exif\0\0" + tiff
    assert S.exif_orientation(b"\xff\xd8\xff\xe1" + struct.pack(">H", len(app1) + 2) + app1 + b"\xff\xda\0\2") == orientation
    if orientation not in (3, 6, 8):
        return
    image = np.arange(6).reshape(2, 3)
    df = spark.createDataFrame([(y, x, int(v), 3, 2, orientation) for (y, x), v in np.ndenumerate(image)], "y int, x int, v int, w int, h int, orientation int")
    want = np.rot90(image, {3: 2, 6: -1, 8: 1}[orientation])
    assert {(r.y, r.x): r.v for r in S.oriented(df).collect()} == {(y, x): int(v) for (y, x), v in np.ndenumerate(want)}


def test_command_line(spark, tmp_path):
    page = np.full((40, 30, 3), 225, np.uint8)
    for y in range(6, 36, 5):
        page[y : y + 2, 5:25] = 35
    source = tmp_path / "in"
    D.export(D.page_artifacts(spark.createDataFrame(rows([page]), SCHEMA)), str(source))
    bad = cli.run(spark, str(source), str(tmp_path / "out.pdf"), ScanParams(kernel=9, aspect=None))
    assert bad.count() == 0 and S.read_pdfs(spark, str(tmp_path / "out.pdf")).count() == 1
    with pytest.raises(ValueError):
        S.collect_pages(spark, str(tmp_path / "x.doc"))


def test_downloads(spark):
    names = spark.createDataFrame([("scanned_a.pdf",), ("../scanned_a.pdf",), ("a.pdf",), ("scanned_a.png",)], "name string")
    assert [r["name"] for r in D.downloadable(names).collect()] == ["scanned_a.pdf"]
    assert zlib.crc32(b"") == 0
