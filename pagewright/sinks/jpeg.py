"""Page images as JPEG: the baseline process, with Huffman codes made for each image.

A page is cut into blocks of 8 x 8 values of luminance and two colour differences; their cosine transforms are divided
by the quality's steps, and what is left is written as runs of zeros and values.
"""

from __future__ import annotations

import heapq
import struct

import numpy as np

# The steps at quality 50 that decoders and other encoders share, by row, for luminance and colour.
LUMINANCE = [
    16, 11, 10, 16, 24, 40, 51, 61, 12, 12, 14, 19, 26, 58, 60, 55, 14, 13, 16, 24, 40, 57, 69, 56, 14, 17, 22, 29, 51, 87, 80, 62,
    18, 22, 37, 56, 68, 109, 103, 77, 24, 35, 55, 64, 81, 104, 113, 92, 49, 64, 78, 87, 103, 121, 120, 101, 72, 92, 95, 98, 112, 100, 103, 99,
]
COLOUR = [
    17, 18, 24, 47, 99, 99, 99, 99, 18, 21, 26, 66, 99, 99, 99, 99, 24, 26, 56, 99, 99, 99, 99, 99, 47, 66, 99, 99, 99, 99, 99, 99,
    99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99,
]
#: The places of a block along its diagonals, up and down in turn.
ZIGZAG = sorted(range(64), key=lambda i: (i // 8 + i % 8, (i // 8, i % 8)[(i // 8 + i % 8) % 2 == 0]))
_COSINES = np.array([[np.sqrt((1 + (u > 0)) / 8) * np.cos((2 * x + 1) * u * np.pi / 16) for x in range(8)] for u in range(8)])


def steps(base: list[int], quality: int) -> np.ndarray:
    quality = min(100, max(1, quality))
    scale = 5000 // quality if quality < 50 else 200 - 2 * quality
    return np.clip((np.array(base) * scale + 50) // 100, 1, 255)


def _blocks(channel: np.ndarray, step: np.ndarray) -> np.ndarray:
    """The divided transforms of the blocks of a channel, in zigzag order; the edge is repeated to fill the last ones."""
    h, w = channel.shape
    full = np.pad(channel, ((0, -h % 8), (0, -w % 8)), mode="edge") - 128.0
    blocks = full.reshape(full.shape[0] // 8, 8, -1, 8).swapaxes(1, 2).reshape(-1, 8, 8)
    spectrum = (_COSINES @ blocks @ _COSINES.T).reshape(-1, 64)
    return np.rint(spectrum / step).astype(np.int32)[:, ZIGZAG]


def _sized(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many bits each value takes, and those bits as a number."""
    size = np.ceil(np.log2(np.abs(values) + 1)).astype(np.int64)
    return size, np.where(values < 0, values + (1 << size) - 1, values).astype(np.int64)


def _symbols(blocks: np.ndarray) -> tuple[np.ndarray, ...]:
    """block, order, is-first-value, symbol, extra bits and how many, of everything one channel writes."""
    n = len(blocks)
    size, bits = _sized(np.diff(blocks[:, 0], prepend=0))
    parts = [(np.arange(n), np.zeros(n, np.int64), np.ones(n, bool), size, bits, size)]
    block, place = np.nonzero(blocks[:, 1:])
    size, bits = _sized(blocks[:, 1:][block, place])
    before = np.where(np.diff(block, prepend=-1) != 0, -1, np.concatenate(([-1], place[:-1]))) if len(block) else place
    zeros = place - before - 1
    order = 4 * (place + 1)
    parts.append((block, order + 3, np.zeros(len(block), bool), zeros % 16 * 16 + size, bits, size))
    for k in range(3):  # sixteen zeros have a symbol of their own
        at = np.flatnonzero(zeros // 16 > k)
        parts.append((block[at], order[at] + k, np.zeros(len(at), bool), np.full(len(at), 0xF0), np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)))
    last = np.full(n, -1)
    np.maximum.at(last, block, place)
    ends = np.flatnonzero(last < 62)
    parts.append((ends, np.full(len(ends), 1000), np.zeros(len(ends), bool), np.zeros(len(ends), np.int64), np.zeros(len(ends), np.int64), np.zeros(len(ends), np.int64)))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def code_lengths(counts: np.ndarray) -> dict[int, int]:
    """Huffman code lengths of the symbols that occur, at most 16, none of them all ones."""
    heap = [(int(counts[s]), k, [s]) for k, s in enumerate(np.flatnonzero(counts).tolist())]
    heap.append((0, len(heap) + 1000, [256]))  # keeps the code of all ones free
    heapq.heapify(heap)
    depth = dict.fromkeys((s for _, _, some in heap for s in some), 0)
    made = 10_000
    while len(heap) > 1:
        (a, _, x), (b, _, y) = heapq.heappop(heap), heapq.heappop(heap)
        for s in x + y:
            depth[s] += 1
        made += 1
        heapq.heappush(heap, (a + b, made, x + y))
    per = [0] * (max(depth.values()) + 1)
    for d in depth.values():
        per[d] += 1
    for long in range(len(per) - 1, 16, -1):  # pairs that are too deep move up beside a shallower leaf
        while per[long]:
            short = long - 2
            while not per[short]:
                short -= 1
            for at, more in ((long, -2), (long - 1, 1), (short + 1, 2), (short, -1)):
                per[at] += more
    ranked = sorted(depth, key=lambda s: (depth[s], s == 256, -counts[s] if s < 256 else 0, s))
    lengths = [d for d, n in enumerate(per) for _ in range(n)]
    return {s: d for s, d in zip(ranked, lengths, strict=True) if s != 256}


def _codes(lengths: dict[int, int]) -> tuple[np.ndarray, np.ndarray, bytes]:
    """Code and length by symbol, and the table as it is written."""
    ranked = sorted(lengths, key=lambda s: (lengths[s], s))
    code, width, last = np.zeros(256, np.int64), np.zeros(256, np.int64), 0
    value = 0
    for s in ranked:
        value <<= lengths[s] - last
        last = lengths[s]
        code[s], width[s] = value, last
        value += 1
    per = [sum(n == k for n in lengths.values()) for k in range(1, 17)]
    return code, width, bytes(per) + bytes(ranked)


def jpeg(image: np.ndarray, quality: int = 95) -> bytes:
    """A gray or BGR image (height x width x channels, bytes) as a JPEG file."""
    h, w, n = image.shape
    if not (0 < h < 65536 and 0 < w < 65536):
        raise ValueError(f"no JPEG can have {w} x {h} pixels")
    tables = [steps(LUMINANCE, quality), steps(COLOUR, quality)]
    if n >= 3:
        b, g, r = (image[:, :, k].astype(np.float64) for k in range(3))
        luma = 0.299 * r + 0.587 * g + 0.114 * b
        channels = [luma, (b - luma) * 0.564334086 + 128, (r - luma) * 0.713266762 + 128]
    else:
        channels = [image[:, :, 0].astype(np.float64)]
    written = [_symbols(_blocks(c, tables[k > 0])) for k, c in enumerate(channels)]
    heads, code_of = b"", {}
    for k in range(min(2, len(written))):
        own = written[:1] if k == 0 else written[1:]
        for first in (True, False):
            counts = sum(np.bincount(s[3][s[2] == first], minlength=256) for s in own)
            code, width, table = _codes(code_lengths(counts))
            code_of[k, first] = code, width
            heads += b"\xff\xc4" + struct.pack(">HB", 3 + len(table), (0 if first else 16) + k) + table
    rows = []
    for k, (block, order, first, symbol, bits, size) in enumerate(written):
        picked = [np.where(first, code_of[k > 0, True][j][symbol], code_of[k > 0, False][j][symbol]) for j in (0, 1)]
        rows.append((block * len(written) + k, order, picked[0] << size | bits, picked[1] + size))
    unit, order, value, width = (np.concatenate(x) for x in zip(*rows, strict=True))
    inturn = np.lexsort((order, unit))
    value, width = value[inturn], width[inturn]
    at = np.arange(width.sum()) - np.repeat(np.cumsum(width) - width, width)
    ones = (np.repeat(value, width) >> (np.repeat(width, width) - 1 - at)) & 1
    body = np.packbits(np.concatenate((ones, np.ones(-len(ones) % 8, np.int64))).astype(np.uint8)).tobytes().replace(b"\xff", b"\xff\x00")
    parts = len(channels)
    quantised = b"".join(b"\xff\xdb" + struct.pack(">HB", 67, k) + bytes(tables[k][ZIGZAG].astype(np.uint8)) for k in range(min(2, parts)))
    frame = b"\xff\xc0" + struct.pack(">HBHHB", 8 + 3 * parts, 8, h, w, parts) + b"".join(bytes([k + 1, 0x11, k > 0]) for k in range(parts))
    scan = b"\xff\xda" + struct.pack(">HB", 6 + 2 * parts, parts) + b"".join(bytes([k + 1, 0x11 * (k > 0)]) for k in range(parts)) + b"\0\x3f\0"
    return b"\xff\xd8\xff\xe0\0\x10JFIF\0\1\1\0\0\1\0\1\0\0" + quantised + frame + heads + scan + body + b"\xff\xd9"
