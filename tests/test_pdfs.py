import zlib

import numpy as np
import pytest

from pagewright.sinks import documents as D
from pagewright.sinks.jpeg import jpeg
from pagewright.sources import images as S
from pagewright.sources import jpeg as J
from pagewright.sources import pdfs

SCHEMA = "doc_id string, page_no int, width int, height int, channels int, data binary"


def picture(h, w, seed=0):
    y, x = np.mgrid[:h, :w]
    return np.dstack([(128 + 90 * np.sin((x + seed) / (9 + 4 * c)) + 35 * np.cos(y / (6 + c))).clip(0, 255) for c in range(3)]).astype(np.uint8)


def jvm_jpeg(spark, image, progressive=False, gray=False, quality=0.9):
    """A file by another encoder: colours at half size, and by several scans if wanted."""
    jvm = spark.sparkContext._jvm
    h, w = image.shape[:2]
    holder = jvm.java.awt.image.BufferedImage(w, h, 10 if gray else 1)
    for y in range(h):
        for x in range(w):
            b, g, r = (int(v) for v in image[y, x])
            if gray:
                holder.getRaster().setSample(x, y, 0, b)
            else:
                holder.setRGB(x, y, (r << 16) | (g << 8) | b)
    writer = jvm.javax.imageio.ImageIO.getImageWritersByFormatName("jpeg").next()
    out = jvm.java.io.ByteArrayOutputStream()
    writer.setOutput(jvm.javax.imageio.ImageIO.createImageOutputStream(out))
    param = writer.getDefaultWriteParam()
    param.setCompressionMode(2)
    param.setCompressionQuality(quality)
    if progressive:
        param.setProgressiveMode(1)
    writer.write(None, jvm.javax.imageio.IIOImage(holder, None, None), param)
    writer.dispose()
    return bytes(out.toByteArray())


@pytest.mark.parametrize("shape", [(8, 8), (1, 1), (33, 70), (64, 17)])
def test_own_jpeg_round_trip(shape):
    page = picture(*shape)
    got = J.decoded(jpeg(page, 97))[:, :, ::-1]
    assert got.shape == page.shape and np.abs(got.astype(int) - page).mean() < 1.5
    gray = J.decoded(jpeg(page[:, :, :1], 97))
    assert gray.shape == (*shape, 1) and np.abs(gray.astype(int) - page[:, :, :1]).mean() < 1.5


def test_jpeg_of_another_encoder_and_of_kinds_that_are_refused(spark):
    page = picture(45, 61)
    got = J.decoded(jvm_jpeg(spark, page))[:, :, ::-1]
    assert got.shape == page.shape and np.abs(got.astype(int) - page).mean() < 4  # colours at half size
    assert np.abs(J.decoded(jvm_jpeg(spark, page, gray=True)).astype(int)[:, :, 0] - page[:, :, 0]).mean() < 2.5
    with pytest.raises(ValueError, match="progressive"):
        J.decoded(jvm_jpeg(spark, page, progressive=True))
    whole = jpeg(page, 90)
    for broken in (whole[: len(whole) // 2], b"\xff\xd8\xff\xd9", b"", whole[:300] + bytes(400)):
        with pytest.raises(ValueError):
            J.decoded(broken)
    with pytest.raises(ValueError, match="pixels"):
        J.decoded(whole, most=100)


def test_jpeg_with_restarts():
    """Restart markers reset the predictions: the stream of two halves, each encoded on its own with the same tables."""
    top, bottom = np.full((8, 16, 1), 40, np.uint8), np.full((8, 16, 1), 40, np.uint8)
    one = jpeg(np.vstack([top, bottom]), 90)
    alone = jpeg(top, 90)
    assert np.abs(J.decoded(one).astype(int) - 40).max() <= 1
    scan = alone.index(b"\xff\xda")
    head, body = alone[:scan], alone[scan:-2]
    size = head.index(b"\xff\xc0") + 5
    head = head[:size] + b"\0\x10" + head[size + 2 :]
    joined = head + b"\xff\xdd\0\x04\0\x02" + body + b"\xff\xd0" + body[10:] + b"\xff\xd9"
    assert np.array_equal(J.decoded(joined), np.vstack([J.decoded(alone)] * 2))


def obj(n, body):
    return b"%d 0 obj\n" % n + body + b"\nendobj\n"


def image_obj(n, w, h, space, raw, more=b"", packed=True, form=b"/FlateDecode"):
    body = zlib.compress(raw) if packed else raw
    return obj(n, b"<< /Type /XObject /Subtype /Image /Width %d /Height %d /ColorSpace %s /BitsPerComponent 8 /Filter %s %s /Length %d >>\nstream\n" % (w, h, space, form, more, len(body)) + body + b"\nendstream")


def leaf(n, shown, parent=2, more=b""):
    return obj(n, b"<< /Type /Page /Parent %d 0 R %s /Resources << /XObject << /I %d 0 R >> >> >>" % (parent, more, shown))


def with_table(objects):
    """A file with a cross-reference table; objects as (number, bytes)."""
    data, places = b"%PDF-1.4\n", {}
    for n, body in objects:
        places[n] = len(data)
        data += body
    start, size = len(data), max(places) + 1
    table = b"xref\n0 %d\n0000000000 65535 f \n" % size + b"".join(b"%010d 00000 %s \n" % (places.get(n, 0), b"n" if n in places else b"f") for n in range(1, size))
    return data + table + b"trailer\n<< /Size %d /Root 1 0 R >>\nstartxref\n%d\n%%%%EOF\n" % (size, start)


def pages_of(data, limit=None):
    return [None if r[-1] else pdfs.page_image(*r[1:-1]).tolist() for r in pdfs.page_streams(data, limit)]


def test_pages_come_in_the_order_of_the_tree_with_and_without_a_table():
    objects = [
        (3, image_obj(3, 2, 1, b"/DeviceCMYK", bytes([10, 20, 30, 0, 255, 0, 5, 9]))), (4, leaf(4, 3)), (5, image_obj(5, 1, 1, b"/DeviceGray", b"\x07")), (6, leaf(6, 5)),
        (7, image_obj(7, 1, 1, b"/DeviceRGB", bytes([1, 2, 3]))), (8, leaf(8, 7)), (9, obj(9, b"<< /Type /Pages /Kids [8 0 R 4 0 R] /Count 2 >>")),
        (2, obj(2, b"<< /Type /Pages /Kids [6 0 R 9 0 R] /Count 3 >>")), (1, obj(1, b"<< /Type /Catalog /Pages 2 0 R >>")),
    ]
    want = [[[[7, 7, 7]]], [[[3, 2, 1]]], [[[225, 235, 245], [250, 255, 0]]]]
    table = with_table(objects)
    assert pages_of(table) == want and pages_of(table, 1) == want[:1]
    assert pages_of(b"%PDF-1.4\n" + b"".join(b for _, b in objects)) == want  # no table: found by a search
    assert pages_of(table.replace(b"startxref\n", b"startxref\n9")) == want  # a table that is not there


def test_streams_with_predictors_palettes_bits_turns_and_object_streams():
    rows = np.arange(24, dtype=np.uint8).reshape(2, 4, 3) * 9
    up = b"\x01" + np.diff(rows[0].astype(int), axis=0, prepend=0).astype(np.uint8).tobytes() + b"\x02" + (rows[1] - rows[0]).tobytes()
    parms = b"/DecodeParms << /Predictor 15 /Colors 3 /Columns 4 >>"
    inner = [(11, b"<< /Type /Page /Parent 2 0 R /Resources 12 0 R >>"), (12, b"<< /XObject << /A 3 0 R >> >>"), (13, b"<< /Type /Page /Rotate 90 /Resources << /XObject << /B 4 0 R >> >> >>")]
    heads, body = b"", b""
    for n, text in inner:
        heads += b"%d %d " % (n, len(body))
        body += text + b" "
    packed = zlib.compress(heads + body)
    objects = [
        (1, obj(1, b"<< /Type /Catalog /Pages 2 0 R >>")), (2, obj(2, b"<< /Type /Pages /Kids [11 0 R 13 0 R 14 0 R 15 0 R] >>")), (3, image_obj(3, 4, 2, b"[/ICCBased 5 0 R]", up, parms)),
        (4, image_obj(4, 3, 1, b"[/Indexed /DeviceRGB 2 <000000 0a0b0c ffffff>]", bytes([0, 1, 2]))), (5, obj(5, b"<< /N 3 /Length 0 >>\nstream\n\nendstream")),
        (6, obj(6, b"<< /Type /ObjStm /N 3 /First %d /Filter /FlateDecode /Length %d >>\nstream\n" % (len(heads), len(packed)) + packed + b"\nendstream")),
        (7, obj(7, b"<< /Subtype /Image /Width 5 /Height 2 /ColorSpace /DeviceGray /BitsPerComponent 1 /Length 8 0 R >>\nstream\n\xa8\x50\nendstream")), (8, obj(8, b"2")),
        (14, leaf(14, 7)), (15, leaf(15, 9)), (9, image_obj(9, 1, 1, b"/DeviceGray", b"\1\2\3", form=b"/CCITTFaxDecode")),
    ]
    data, entries = b"%PDF-1.5\n", {}
    for n, text in objects:
        entries[n] = (1, len(data), 0)
        data += text
    entries |= {n: (2, 6, k) for k, (n, _) in enumerate(inner)} | {16: (1, len(data), 0), 0: (0, 0, 255)}
    wide = max(entries) + 1
    table = b"".join(bytes([k]) + a.to_bytes(3, "big") + bytes([b]) for k, a, b in (entries.get(n, (0, 0, 0)) for n in range(wide)))
    head = b"<< /Type /XRef /Size %d /W [1 3 1] /Root 1 0 R /Filter /FlateDecode /DecodeParms << /Predictor 12 /Columns 5 >> /Length %d >>\nstream\n"
    plain = np.frombuffer(table, np.uint8).reshape(-1, 5)
    coded = zlib.compress(b"".join(b"\x02" + (row - above).tobytes() for row, above in zip(plain, np.vstack([np.zeros((1, 5), np.uint8), plain[:-1]]))))
    whole = data + obj(16, head % (wide, len(coded)) + coded + b"\nendstream") + b"startxref\n%d\n%%%%EOF" % len(data)
    got = pages_of(whole)
    assert got[0] == rows[:, :, ::-1].tolist()
    assert got[1] == [[[0, 0, 0]], [[12, 11, 10]], [[255, 255, 255]]]  # turned clockwise
    assert [[p[0] for p in row] for row in got[2]] == [[255, 0, 255, 0, 255], [0, 255, 0, 255, 0]]
    assert got[3] is None and "CCITTFax" in list(pdfs.page_streams(whole))[3][-1]
    for kind, raw in ((3, [9, 5, 250]), (4, [9, 5, 250])):
        back = pdfs.unpredicted(bytes([0, 10, 20, 30, kind, *raw]), 15, 1, 8, 3)
        left, want = 0, []
        for i, (r, u) in enumerate(zip(raw, [10, 20, 30])):
            c = [10, 20, 30][i - 1] if i else 0
            best = min((abs(u - c), 0, left), (abs(left - c), 1, u), (abs(left + u - 2 * c), 2, c))[2]
            left = (r + ((left + u) // 2 if kind == 3 else best)) & 255
            want.append(left)
        assert list(back[3:]) == want


def test_two_hundred_jpeg_pages_are_decoded_by_several_tasks(spark, tmp_path):
    """In the order of their tree; one that is broken is an error row, the others stay."""
    from pyspark.sql import functions as F

    pages = [picture(24, 16, k) for k in range(200)]
    rows = [("d", k, 16, 24, 3, p.tobytes()) for k, p in enumerate(pages)]
    D.export(D.assemble(spark.createDataFrame(rows, SCHEMA).repartition(3), border=False, quality=95), str(tmp_path))
    data = bytearray((tmp_path / "scanned_d.pdf").read_bytes())
    at = [i for i in range(len(data)) if data[i : i + 3] == b"\xff\xd8\xff"][17]
    data[at : at + 2] = b"\0\0"
    (tmp_path / "scanned_d.pdf").write_bytes(data)
    found = S.read_pdfs(spark, str(tmp_path))
    assert found.select(F.spark_partition_id()).distinct().count() > 2
    got = {r.page_no: r for r in found.collect()}
    assert sorted(got) == list(range(200)) and got[17].error == "no JPEG" and sum(r.error is not None for r in got.values()) == 1
    for k, page in enumerate(pages):
        if k != 17:
            assert np.abs(np.frombuffer(got[k].data, np.uint8).reshape(24, 16, 3).astype(int) - page).mean() < 3, k
    assert S.read_pdfs(spark, str(tmp_path), page_limit=5).count() == 5


def test_documents_beyond_the_limits(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(pdfs.P, "MAX_DOCUMENT_PAGES", 2)
    rows = list(pdfs.page_streams(with_table([(3, image_obj(3, 1, 1, b"/DeviceGray", b"\1")), (4, leaf(4, 3)), (2, obj(2, b"<< /Type /Pages /Kids [4 0 R 5 0 R 6 0 R] >>")), (5, leaf(5, 3)), (6, leaf(6, 3)), (1, obj(1, b"<< /Type /Catalog /Pages 2 0 R >>"))])))
    assert [r[-1] for r in rows] == [None, None, "the document has too many pages"]
    for k, junk in enumerate((b"%PDF-1.4 nothing", b"%PDF\n1 0 obj\n<< /Type /Catalog /Pages 2 0 R >>\nendobj\n2 0 obj\n<< /Kids [2 0 R] >>\nendobj\n", b"1 0 obj << [ >> startxref 0")):
        (tmp_path / f"{k}.PDF").write_bytes(junk)
    found = S.read_pdfs(spark, str(tmp_path)).collect()
    assert sorted(r["name"] for r in found) == ["0.PDF", "1.PDF", "2.PDF"] and all(r.error and r.page_no == 0 for r in found)
