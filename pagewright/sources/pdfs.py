"""PDFs whose pages are images, a page a row.

A document is read by Spark's binary reader and cut up in a first step: the cross-reference tables lead to the page tree
and to every page's image, whose stream goes on as it is, compressed, in a row of its own. Those rows are dealt out, so
the pages of one document are decoded by many tasks, one at a time; a page that can't be decoded is an error row among
the others. (A Python data source would open files with Python, which not every store that Spark reads allows, and would
plan all documents on the driver.)
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright import params as P
from pagewright.sources import jpeg

STREAMS = "name string, page_no int, width int, height int, components int, bits int, filter string, predictor int, turn int, palette binary, stream binary, error string"
#: Pixels of a page image that are decoded at most.
MOST_PIXELS = 4 * P.CANVAS_PIXELS
_TOKEN = re.compile(rb"[\s\0]*(?:%[^\r\n]*[\s\0]*)*(<<|>>|\[|\]|/[^\s\0/<>\[\]()%{}]*|\((?:[^()\\]|\\.|\((?:[^()\\]|\\.)*\))*\)|<[0-9A-Fa-f\s]*>|\d+\s+\d+\s+R\b|[^\s\0/<>\[\]()%{}]+|\S)", re.S)
_COMPONENTS = {"/DeviceGray": 1, "/CalGray": 1, "/G": 1, "/DeviceRGB": 3, "/CalRGB": 3, "/RGB": 3, "/DeviceCMYK": 4, "/CMYK": 4}


class Ref(int):
    """The number of an object that is referred to."""


def value_at(data: bytes, at: int) -> tuple[object, int]:
    """The value that begins at a place, and where it ends: dict, list, name as str, number, Ref or bytes."""
    stack: list[list] = []
    while True:
        found = _TOKEN.match(data, at)
        if not found:
            raise ValueError("a PDF value without an end")
        token, at = found[1], found.end()
        if token in (b"<<", b"["):
            stack.append([token])
            continue
        if token in (b">>", b"]"):
            if not stack or (stack[-1][0] == b"<<") != (token == b">>"):
                raise ValueError("a PDF value without an end")
            items = stack.pop()[1:]
            value: object = dict(zip(items[::2], items[1::2], strict=False)) if token == b">>" else items
        elif token[:1] == b"/":
            value = token.decode("latin-1")
        elif token[-1:] == b"R" and token[:1].isdigit():
            value = Ref(token.split()[0])
        elif re.fullmatch(rb"[+-]?(?:\d+\.?\d*|\.\d+)", token):
            value = float(token) if b"." in token else int(token)
        elif token[:1] == b"<":
            digits = re.sub(rb"\s", b"", token[1:-1])
            value = bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
        else:
            value = token[1:-1] if token[:1] == b"(" else token
        if not stack:
            return value, at
        stack[-1].append(value)


def unpredicted(raw: bytes, predictor: int, components: int, bits: int, columns: int) -> bytes:
    """Bytes of rows from what a predictor made of them: 1 nothing, 2 differences, 10 and up a kind for each row."""
    if predictor < 2:
        return raw
    step, width = max(1, components * bits // 8), -(-columns * components * bits // 8)
    if predictor == 2:
        if bits != 8:
            raise ValueError("differences of other than bytes")
        rows = np.frombuffer(raw[: len(raw) // width * width], np.uint8).reshape(-1, columns, components)
        return np.cumsum(rows, axis=1, dtype=np.uint8).tobytes()
    rows = np.frombuffer(raw[: len(raw) // (width + 1) * (width + 1)], np.uint8).reshape(-1, width + 1)
    out, above = np.zeros((len(rows), width), np.uint8), np.zeros(width, np.uint8)
    for k, row in enumerate(rows):
        kind, line = row[0], row[1:].copy()
        if kind == 1:
            for c in range(step):
                line[c::step] = np.cumsum(line[c::step], dtype=np.uint8)
        elif kind == 2:
            line += above
        elif kind in (3, 4):
            full, up = [0] * step + line.tolist(), [0] * step + above.tolist()
            for i in range(step, len(full)):
                a, b, c = full[i - step], up[i], up[i - step]
                near = min((abs(b - c), 0, a), (abs(a - c), 1, b), (abs(a + b - 2 * c), 2, c))[2]
                full[i] = (full[i] + ((a + b) // 2 if kind == 3 else near)) & 255
            line = np.array(full[step:], np.uint8)
        out[k] = above = line
    return out.tobytes()


class Document:
    """Where the objects of a PDF are, by its cross-reference tables and streams; by a search where those are broken."""

    def __init__(self, data: bytes):
        self.data, self.places, self.inside, self.trailer = data, {}, {}, {}
        self.packed: dict[int, tuple[dict, bytes]] = {}
        try:
            start = int(re.findall(rb"startxref\s+(\d+)", data[-2048:])[-1])
            self._tables(start)
            self._pages_root()
        except (ValueError, IndexError, KeyError, zlib.error, TypeError):
            self.inside, self.trailer = {}, {}
            self.places = {int(m[1]): m.start(1) for m in re.finditer(rb"(?:^|(?<=\s))(\d+) \d+ obj\b", data)}

    def _tables(self, at: int) -> None:
        seen = set()
        while at not in seen:
            seen.add(at)
            table = re.compile(rb"\s*xref\s+").match(self.data, at)
            if table:
                here = table.end()
                while section := re.compile(rb"(\d+) (\d+)\s+").match(self.data, here):
                    first, n, here = int(section[1]), int(section[2]), section.end()
                    for k in range(n):
                        entry = self.data[here + 20 * k : here + 20 * k + 18]
                        if entry[17:18] == b"n":
                            self.places.setdefault(first + k, int(entry[:10]))
                    here += 20 * n
                head, _ = value_at(self.data, self.data.index(b"trailer", here) + 7)
            else:
                head, body = self._stream(at)
                widths = head["/W"]
                index = head.get("/Index", [0, head["/Size"]])
                numbers = [first + k for first, n in zip(index[::2], index[1::2], strict=True) for k in range(n)]
                for k, number in enumerate(numbers):
                    row, fields = body[k * sum(widths) : (k + 1) * sum(widths)], []
                    for n in widths:
                        fields.append(int.from_bytes(row[:n], "big"))
                        row = row[n:]
                    kind = fields[0] if widths[0] else 1
                    if number not in self.places and number not in self.inside:
                        if kind == 1:
                            self.places[number] = fields[1]
                        elif kind == 2:
                            self.inside[number] = fields[1]
            self.trailer = head | self.trailer
            for more in ("/XRefStm", "/Prev"):
                if isinstance(head.get(more), int):
                    at = head[more]

    def _stream(self, at: int) -> tuple[dict, bytes]:
        """Dictionary and bytes, without compression, of the stream object at a place."""
        head, raw = self.raw(at)
        parms = self.plain(head.get("/DecodeParms")) or {}
        if head.get("/Filter") in ("/FlateDecode", ["/FlateDecode"]):
            raw = zlib.decompressobj().decompress(raw)
            parms = parms[0] if isinstance(parms, list) else parms
            raw = unpredicted(raw, parms.get("/Predictor", 1), parms.get("/Colors", 1), parms.get("/BitsPerComponent", 8), parms.get("/Columns", 1))
        return head, raw

    def raw(self, at: int) -> tuple[dict, bytes]:
        """Dictionary and bytes as they are of the stream object at a place."""
        begin = re.compile(rb"\s*\d+\s+\d+\s+obj").match(self.data, at)
        if not begin:
            raise ValueError("no object where the table says")
        head, end = value_at(self.data, begin.end())
        opened = re.compile(rb"\s*stream(?:\r\n|\n|\r)").match(self.data, end)
        if not isinstance(head, dict) or not opened:
            raise ValueError("an object without a stream")
        size = self.plain(head.get("/Length"))
        size = size if isinstance(size, int) else self.data.index(b"endstream", opened.end()) - opened.end()
        return head, self.data[opened.end() : opened.end() + size]

    def plain(self, value: object, depth: int = 0) -> object:
        """A value, or that of the object it refers to."""
        if not isinstance(value, Ref) or depth > 20:
            return value
        if value in self.places:
            begin = re.compile(rb"\s*\d+\s+\d+\s+obj").match(self.data, self.places[value])
            return self.plain(value_at(self.data, begin.end())[0], depth + 1) if begin else None
        if value in self.inside:
            holder = self.inside[value]
            if holder not in self.packed:
                self.packed[holder] = self._stream(self.places[holder])
            head, body = self.packed[holder]
            pairs = list(map(int, body[: head["/First"]].split()))
            return self.plain(value_at(body, head["/First"] + dict(zip(pairs[::2], pairs[1::2], strict=False))[value])[0], depth + 1)
        return None

    def _pages_root(self) -> object:
        root = self.plain(self.trailer["/Root"])
        if not isinstance(self.plain(root["/Pages"]), dict):
            raise ValueError("no page tree")
        return root["/Pages"]

    def pages(self) -> Iterator[dict]:
        """The page dictionaries in the order of the tree, with what they inherit."""
        if self.trailer:
            roots = [self._pages_root()]
        else:
            heads = [self.plain(Ref(n)) for n in self.places]
            roots = [h["/Pages"] for h in heads if isinstance(h, dict) and h.get("/Type") == "/Catalog" and "/Pages" in h][:1]
        todo, seen = [(r, {}) for r in roots], set()
        while todo:
            ref, own = todo.pop()
            if ref in seen if isinstance(ref, Ref) else False:
                continue
            seen.add(ref if isinstance(ref, Ref) else None)
            node = self.plain(ref)
            if not isinstance(node, dict):
                continue
            own = own | {k: node[k] for k in ("/Resources", "/Rotate") if k in node}
            kids = self.plain(node.get("/Kids"))
            if isinstance(kids, list):
                todo += [(kid, own) for kid in reversed(kids)]
            else:
                yield node | own

    def _space(self, space: object) -> tuple[int, bytes | None]:
        """Components of a colour space, and its palette of RGB."""
        space = self.plain(space)
        if isinstance(space, str):
            return _COMPONENTS.get(space, 0), None
        if isinstance(space, list) and space:
            kind = space[0]
            if kind == "/ICCBased":
                return int((self.plain(space[1]) or {}).get("/N", 0)), None
            if kind in ("/Indexed", "/I") and self._space(space[1])[0] == 3:
                table = space[3]
                known = self._stream(self.places[table])[1] if isinstance(table, Ref) and isinstance(self.plain(table), dict) else self.plain(table)
                return 1, known if isinstance(known, bytes) and b"\\" not in known else None
            return _COMPONENTS.get(kind, 0), None
        return 0, None

    def image(self, page: dict) -> tuple:
        """The fields of STREAMS, from width to stream, of the one image of a page."""
        shown = self.plain((self.plain(page.get("/Resources")) or {}).get("/XObject")) or {}
        refs = [r for r in shown.values() if isinstance(r, Ref) and r in self.places and (self.plain(r) or {}).get("/Subtype") == "/Image"]
        if len(refs) != 1 or len(shown) != 1:
            raise ValueError("a page that is not a plain image")
        head, raw = self.raw(self.places[refs[0]])
        filters, parms = self.plain(head.get("/Filter")), self.plain(head.get("/DecodeParms"))
        filters = filters if isinstance(filters, list) else [filters] if filters else []
        parms = (parms[-1] if parms else {}) if isinstance(parms, list) else parms or {}
        parms = self.plain(parms) or {}
        if filters[:-1] == ["/FlateDecode"]:
            raw, filters = zlib.decompress(raw), filters[-1:]
        if filters not in (["/FlateDecode"], ["/DCTDecode"], []):
            raise ValueError(f"a page image by {' '.join(f.removeprefix('/') for f in filters)}")
        n, palette = self._space(head.get("/ColorSpace"))
        kind = filters[0].removeprefix("/") if filters else ""
        numbers = [self.plain(head.get(k)) or 0 for k in ("/Width", "/Height")]
        return (*numbers, n, self.plain(head.get("/BitsPerComponent")) or 8, kind, parms.get("/Predictor", 1), int(page.get("/Rotate", 0)) % 360, palette, raw)


def page_streams(data: bytes, limit: int | None = None) -> Iterator[tuple]:
    """page_no and the fields of STREAMS from width on, of every page in order."""
    document = Document(data)
    for no, page in enumerate(document.pages()):
        if limit is not None and no >= limit:
            return
        if no >= P.MAX_DOCUMENT_PAGES:
            yield (no, *[None] * 9, "the document has too many pages")
            return
        try:
            yield (no, *document.image(page), None)
        except (ValueError, KeyError, TypeError, zlib.error, AttributeError) as error:
            yield (no, *[None] * 9, str(error) or type(error).__name__)


def as_bgr(raw: np.ndarray) -> np.ndarray:
    """Pixels (height x width x components) as BGR: gray three times; of four and more the inverse of three."""
    if raw.shape[2] == 1:
        return np.repeat(raw, 3, axis=2)
    return (255 - raw[:, :, :3] if raw.shape[2] >= 4 else raw)[:, :, ::-1]


def page_image(width: int, height: int, components: int, bits: int, filter: str, predictor: int, turn: int, palette: bytes | None, stream: bytes) -> np.ndarray:
    """The BGR pixels of one page stream."""
    if filter == "DCTDecode":
        raw = jpeg.decoded(stream, MOST_PIXELS)
    else:
        if bits not in (1, 8) or not components or not 0 < width * height <= MOST_PIXELS:
            raise ValueError("a page that is not a plain image")
        raw = zlib.decompress(stream) if filter else stream
        raw = np.frombuffer(unpredicted(raw, predictor, components, bits, width), np.uint8)
        if bits == 1:
            row = -(-width * components // 8)
            if len(raw) < row * height:
                raise ValueError("image bytes do not match the page's size")
            raw = np.unpackbits(raw[: row * height].reshape(height, row), axis=1)[:, : width * components].reshape(-1) * (1 if palette else 255)
        if len(raw) != width * height * components:
            raise ValueError("image bytes do not match the page's size")
        raw = raw.reshape(height, width, components)
        if palette:
            table = np.zeros((256, 3), np.uint8)
            known = np.frombuffer(palette[: len(palette) // 3 * 3], np.uint8).reshape(-1, 3)[:256]
            table[: len(known)] = known
            raw = table[raw[:, :, 0]]
    return np.rot90(as_bgr(raw), -(turn // 90)) if turn else as_bgr(raw)


def read_page_streams(spark: SparkSession, path: str, page_limit: int | None = None) -> DataFrame:
    """A row for each page of the PDFs under a path, in STREAMS, still compressed. A document that is too large or has no
    pages gives one row with an error; files without a byte are left out by Spark's reader."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), *[pa.int32()] * 5, pa.string(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.string()]
        names = [f.split()[0] for f in STREAMS.split(", ")]

        def row(*values) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], names)

        for batch in batches:
            for k in range(batch.num_rows):
                where, size = batch.column("path")[k].as_py(), batch.column("length")[k].as_py()
                name, no = where.rsplit("/", 1)[-1], -1
                if size > P.MAX_DOCUMENT_BYTES:
                    yield row(name, 0, *[None] * 9, "the document is too large")
                    continue
                try:
                    for no, *fields in page_streams(batch.column("content")[k].as_py(), page_limit):  # noqa: B020
                        yield row(name, no, *fields)
                    if no < 0:
                        yield row(name, 0, *[None] * 9, "no page images")
                except (ValueError, KeyError, TypeError, zlib.error, AttributeError, RecursionError) as error:
                    yield row(name, no + 1, *[None] * 9, str(error) or type(error).__name__)

    glob = "*.{" + "".join(f"[{c}{c.upper()}]" for c in "pdf") + "}"
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
    # a document above the limit is not read at all
    small = F.when(F.col("length") <= P.MAX_DOCUMENT_BYTES, F.col("content"))
    return files.select("path", "length", small.alias("content")).mapInArrow(cut, STREAMS)


def decoded_pages(streams: DataFrame, spread: bool = True) -> DataFrame:
    """Pages of compressed streams, decoded: name, page_no, width, height, channels, data, error. Unless spread is off,
    the pages of a document are dealt out over the tasks."""
    schema = "name string, page_no int, width int, height int, channels int, data binary, error string"

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), *[pa.int32()] * 4, pa.binary(), pa.string()]
        for batch in batches:
            for k in range(batch.num_rows):
                r = {c: batch.column(c)[k].as_py() for c in batch.schema.names}
                size, data, error = (None, None, None), None, r.pop("error")
                name, no = r.pop("name"), r.pop("page_no")
                if error is None:
                    try:
                        image = page_image(**r)
                        size, data = (image.shape[1], image.shape[0], 3), np.ascontiguousarray(image).tobytes()
                    except (ValueError, zlib.error, KeyError, IndexError, MemoryError) as why:
                        error = str(why) or type(why).__name__
                values = (name, no, *size, data, error)
                yield pa.RecordBatch.from_arrays([pa.array([v], kind) for v, kind in zip(values, kinds, strict=True)], [f.split()[0] for f in schema.split(", ")])

    spark = streams.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    dealt = streams.repartition(tasks, "name", "page_no") if spread else streams
    return dealt.mapInArrow(decode, schema)
