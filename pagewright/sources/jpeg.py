"""Baseline JPEG streams as pixels: what a scanned page is inside a PDF.

Spark's image reader decodes files; a page's stream is part of one, so it is decoded here. Codes are looked up by the
sixteen bits at a place, which are made for all places of a stream at once; dequantising, the inverse cosine transform,
enlarging of colour and the change of colours are array operations over all blocks.
"""

from __future__ import annotations

import re
import struct
from array import array

import numpy as np

from pagewright.sinks.jpeg import _COSINES, ZIGZAG

_PLAIN = {0xC0, 0xC1}
_OTHER = {0xC2: "progressive", 0xC3: "lossless", 0xC9: "arithmetic coding", 0xCA: "arithmetic coding"}


def _lookup(per: bytes, symbols: bytes) -> array:
    """symbol * 32 + length for every sixteen bits that begin with its code; 0 for none."""
    table, code, at = np.zeros(1 << 16, np.int64), 0, 0
    for length, n in enumerate(per, 1):
        for symbol in symbols[at : at + n]:
            table[code << (16 - length) : (code + 1) << (16 - length)] = symbol * 32 + length
            code += 1
        at, code = at + n, code << 1
    return array("l", table.tolist())


def _windows(data: bytes) -> array:
    """The sixteen bits that follow each bit of data, which is filled up with ones."""
    b = np.frombuffer(data + b"\xff" * 8, np.uint8).astype(np.uint32)
    wide = b[:-2] << 16 | b[1:-1] << 8 | b[2:]
    return array("H", ((wide[:, None] >> np.arange(8, 0, -1, dtype=np.uint32)) & 0xFFFF).astype(np.uint16).tobytes())


def _read(windows: array, units: list, n: int, before: list[int], places: array, values: array, first: int) -> None:
    """Coefficients of n rounds over units (component, its two tables, where its blocks stand), as place and value."""
    at, end = 0, len(windows) - 48
    for k in range(first, first + n):
        if at > end:
            raise ValueError("the JPEG stream ends early")
        for component, dc, ac, blocks in units:
            base = blocks[k] * 64
            found = dc[windows[at]]
            size, length = found >> 5, found & 31
            if not length or size > 15:
                raise ValueError("a code that the JPEG has no symbol for")
            at += length
            if size:
                bits = windows[at] >> (16 - size)
                before[component] += bits if bits >> (size - 1) else bits - (1 << size) + 1
                at += size
            places.append(base)
            values.append(before[component])
            place = 1
            while place < 64:
                found = ac[windows[at]]
                if not found:
                    raise ValueError("a code that the JPEG has no symbol for")
                at += found & 31
                size = (found >> 5) & 15
                if not size:
                    if found >> 9 != 15:
                        break
                    place += 16
                    continue
                place += found >> 9
                if place > 63:
                    raise ValueError("a JPEG block with too many values")
                bits = windows[at] >> (16 - size)
                places.append(base + place)
                values.append(bits if bits >> (size - 1) else bits - (1 << size) + 1)
                at += size
                place += 1


def _marks(data: bytes):
    """Marker and body of every segment before and including the start of the scan, and where the scan's bytes begin."""
    at = 2
    while at + 4 <= len(data):
        if data[at] != 0xFF:
            raise ValueError("a JPEG without a scan")
        if data[at + 1] in (0xFF, 0x01):
            at += 1 if data[at + 1] == 0xFF else 2
            continue
        size = struct.unpack(">H", data[at + 2 : at + 4])[0]
        yield data[at + 1], data[at + 4 : at + 2 + size], at + 2 + size
        if data[at + 1] == 0xDA:
            return
        at += 2 + size
    raise ValueError("a JPEG without a scan")


def decoded(data: bytes, most: int = 1 << 26) -> np.ndarray:
    """The samples of a baseline JPEG, height x width x components: gray, RGB, or CMYK as printing inks. Others, and
    those of more than so many pixels, are a ValueError that says what they are."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("no JPEG")
    steps, tables, frame, interval, adobe = {}, {}, None, 0, None
    for mark, body, after in _marks(data):
        if mark in _OTHER:
            raise ValueError(f"a JPEG by {_OTHER[mark]}")
        if mark == 0xDB:
            while body:
                wide = body[0] >> 4
                values = np.frombuffer(body[1 : 1 + 64 * (1 + wide)], ">u2" if wide else np.uint8)
                steps[body[0] & 15] = values.astype(np.float64)
                body = body[1 + 64 * (1 + wide) :]
        elif mark == 0xC4:
            while body:
                n = sum(body[1:17])
                tables[body[0]] = _lookup(body[1:17], body[17 : 17 + n])
                body = body[17 + n :]
        elif mark in _PLAIN:
            bits, h, w, n = struct.unpack(">BHHB", body[:6])
            if bits != 8 or not h or not w or n not in (1, 3, 4) or h * w > most:
                raise ValueError(f"a JPEG of {w} x {h} pixels, {n} components and {bits} bits")
            frame = w, h, [(body[6 + 3 * k], body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]) for k in range(n)]
        elif mark == 0xDD:
            interval = struct.unpack(">H", body[:2])[0]
        elif mark == 0xEE and body[:5] == b"Adobe":
            adobe = body[11]
        elif mark == 0xDA:
            scan = {body[1 + 2 * k]: body[2 + 2 * k] for k in range(body[0])}
    if frame is None or len(scan) != len(frame[2]) or any(c[0] not in scan for c in frame[2]):
        raise ValueError("a JPEG of several scans")
    w, h, parts = frame
    wide, tall = max(c[1] for c in parts), max(c[2] for c in parts)
    if len(parts) == 1:
        parts, wide, tall = [(parts[0][0], 1, 1, parts[0][3])], 1, 1
    across, down = -(-w // (8 * wide)), -(-h // (8 * tall))
    units, total = [], 0
    for k, (name, fx, fy, _) in enumerate(parts):
        if (scan[name] >> 4) not in tables or (16 | scan[name] & 15) not in tables:
            raise ValueError("a JPEG without its code tables")
        for y in range(fy):
            for x in range(fx):
                place = (np.arange(down)[:, None] * fy + y) * across * fx + np.arange(across) * fx + x
                units.append((k, tables[scan[name] >> 4], tables[16 | scan[name] & 15], (total + place.ravel()).tolist()))
        total += across * fx * down * fy
    rest = data[after:]
    end = re.search(rb"\xff[^\x00\xd0-\xd7\xff]", rest)
    pieces = re.split(rb"\xff+[\xd0-\xd7]", rest[: end.start()] if end else rest)
    places, values, done, rounds = array("l"), array("l"), 0, across * down
    for piece in pieces:
        n = min(interval or rounds, rounds - done)
        if n:
            _read(_windows(piece.replace(b"\xff\x00", b"\xff")), units, n, [0] * len(parts), places, values, done)
        done += n
    if done < rounds:
        raise ValueError("the JPEG stream ends early")
    spectrum = np.zeros(total * 64, np.float32)
    spectrum[np.frombuffer(places, np.int64)] = np.frombuffer(values, np.int64)
    spectrum, out, start = spectrum.reshape(-1, 64), [], 0
    back = _COSINES.astype(np.float32)
    for _, fx, fy, step in parts:
        n = across * fx * down * fy
        own = np.empty((n, 64), np.float32)
        own[:, ZIGZAG] = spectrum[start : start + n] * steps[step].astype(np.float32)
        flat = (back.T @ own.reshape(-1, 8, 8) @ back).reshape(down * fy, across * fx, 8, 8).swapaxes(1, 2).reshape(down * fy * 8, -1)
        flat = flat.repeat(tall // fy, 0).repeat(wide // fx, 1)[:h, :w]
        out.append(flat + 128)
        start += n
    return _coloured(out, adobe)


def _coloured(parts: list[np.ndarray], adobe: int | None) -> np.ndarray:
    """Components as gray, RGB or inks. adobe: the transform that an Adobe segment names."""
    if len(parts) >= 3 and (adobe != 0 if len(parts) == 3 else adobe == 2):
        y, cb, cr = parts[0], parts[1] - 128, parts[2] - 128
        parts = [y + 1.402 * cr, y - 0.344136286 * cb - 0.714136286 * cr, y + 1.772 * cb, *parts[3:]]
    out = np.clip(np.rint(np.dstack(parts)), 0, 255).astype(np.uint8)
    return 255 - out if len(parts) == 4 and adobe is not None else out
