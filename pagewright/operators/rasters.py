"""Operators on whole page images: rows of page_id, width, height, channels, data (gray or BGR bytes) and error.

A page is one row, so nothing is shuffled to work on it, and a task holds one page at a time. A page on which a step
fails keeps its row, with the error and without data, and later steps pass it on; so one bad page never ends a job.
The same measures exist on pixel rows (operators/images.py), which is what these are checked against.

Defined results: a null or cut short image gives an error row; an empty table gives no rows; what has an error already
keeps it; other columns are ignored.
"""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from pagewright import params as P
from pagewright.operators import votes as V
from pagewright.operators.images import gaussian

LOG = logging.getLogger(__name__)
#: Pixels that a ruling is high at most, and gaps in it that are closed, on a page of 1000 pixels across.
THIN, GAP = 6, 20
SCHEMA = "page_id long, width int, height int, channels int, data binary, error string"
NAMES = ["page_id", "width", "height", "channels", "data", "error"]
_TYPES = {"long": pa.int64(), "double": pa.float64(), "array<double>": pa.list_(pa.float64())}
_KINDS = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.string()]


def page_row(page_id, image: np.ndarray | None, error: str | None) -> pa.RecordBatch:
    h, w = image.shape[:2] if image is not None else (None, None)
    values = (page_id, w, h, image.shape[2] if image is not None else None, None if image is None else np.ascontiguousarray(image).tobytes(), error)
    return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, _KINDS, strict=True)], NAMES)


def _pages(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, np.ndarray | None, str | None]]:
    """Each row with its image as an array of height x width x channels, or what is wrong with it."""
    for batch in batches:
        for k in range(batch.num_rows):
            row = {name: batch.column(name)[k].as_py() for name in batch.schema.names if name != "data"}
            data, error, image = batch.column("data")[k], row["error"], None
            if error is None:
                shape = row["height"], row["width"], row["channels"]
                if not data.is_valid or None in shape or min(shape) < 1 or len(data.as_buffer()) != shape[0] * shape[1] * shape[2]:
                    error = "not a whole image"
                else:
                    image = np.frombuffer(data.as_buffer(), np.uint8).reshape(shape)
            yield row, image, error


def each_page(images: DataFrame, step: Callable, *columns: str) -> DataFrame:
    """images with a step applied: a function of the page's array (and of these columns) that returns its new array."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, image, error in _pages(batches):
            if error is None:
                try:
                    image = step(image, *(row[c] for c in columns))
                except Exception as problem:  # whatever is wrong with one page, the others go on
                    image, error = None, f"{getattr(step, '__name__', 'step')}: {problem or type(problem).__name__}"
            yield page_row(row["page_id"], image if error is None else None, error)

    return images.select(*NAMES, *columns).mapInArrow(run, SCHEMA)


def in_turn(image: np.ndarray, *steps: Callable) -> np.ndarray:
    """A page after these steps; one that fails on it, or leaves nothing of it, is left out, so the page is never worse
    off than before."""
    for step in steps:
        try:
            after = step(image)
            image = after if after.size else image
        except Exception:
            LOG.warning("%s is left out", getattr(step, "__name__", "a step"), exc_info=True)
    return image


def measured(images: DataFrame, measure: Callable, schema: str) -> DataFrame:
    """page_id and what a measure of each page's array returns: a list of rows of this schema. Pages with an error, or
    on which it fails, give none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, image, error in _pages(batches):
            try:
                found = measure(image) if error is None else []
            except Exception:  # no evidence; the executor's log says why
                LOG.warning("page %s can't be measured", row["page_id"], exc_info=True)
                found = []
            if found:
                columns = list(zip(*found, strict=True))
                arrays = [pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([row["page_id"]] * len(found), pa.int64()), *arrays], ["page_id", *names])

    names, kinds = zip(*((part.split()[0], _TYPES[part.split()[1]]) for part in schema.split(", ")), strict=True)
    return images.select(*NAMES).mapInArrow(run, f"page_id long, {schema}")


# ------------------------------------------------------------------------------------------------- arrays of one page


def gray(image: np.ndarray) -> np.ndarray:
    if image.ndim == 2 or image.shape[2] == 1:
        return image.reshape(image.shape[:2])
    b, g, r = (image[:, :, k].astype(np.float64) for k in range(3))
    return np.rint(r * 0.299 + g * 0.587 + b * 0.114).astype(np.uint8)


def _mirrored(a: np.ndarray, r: int, axis: int) -> np.ndarray:
    width = [(0, 0)] * a.ndim
    width[axis] = (r, r)
    return np.pad(a, width, mode="reflect")


def box_mean(channel: np.ndarray, k: int) -> np.ndarray:
    """The rounded mean of the k x k box around each value, mirrored at the borders: running sums, whatever k is."""
    total = channel.astype(np.int32 if 255 * k * (max(channel.shape) + k) < 1 << 31 else np.int64)
    for axis in (1, 0):
        run = np.cumsum(_mirrored(total, k // 2, axis), axis=axis, dtype=total.dtype)
        run = np.concatenate((np.zeros_like(run.take([0], axis)), run), axis=axis)
        n = total.shape[axis]
        total = run.take(range(k, k + n), axis) - run.take(range(n), axis)
    return np.rint(total / (k * k))


def blurred(channel: np.ndarray, kernel: list[float]) -> np.ndarray:
    """A symmetric separable kernel, mirrored at the borders, rounded."""
    out, r = channel.astype(np.float64), len(kernel) // 2
    for axis in (1, 0):
        n, wide = out.shape[axis], _mirrored(out, r, axis)
        part = lambda k: wide[:, k : k + n] if axis else wide[k : k + n]  # noqa: B023, E731
        out = part(r) * kernel[r]
        for k in range(1, r + 1):
            out += (part(r - k) + part(r + k)) * kernel[r + k]
    return np.rint(out)


def reference_look(image: np.ndarray, k: int = P.FLATTEN_KERNEL, saturation: float = P.SATURATION, white: int = P.WHITE_POINT, blacks: tuple = P.BLACK_POINTS) -> np.ndarray:
    """Flattened against the local mean, saturated and stretched; one truncation at the end."""
    if image.shape[2] not in (1, 3):
        raise ValueError("neither a gray nor a colour page")
    flat = [np.clip(c - box_mean(c, k) + 127.0, 0, 255) for c in (image[:, :, n] for n in range(image.shape[2]))]
    if len(flat) == 3:
        b, g, r = flat
        mean = (r + g + b) / 3.0
        flat = [mean + (c - mean) * saturation for c in flat]
    out = []
    for c in flat:
        c = np.clip(np.minimum(c, white) * 255.0 / white, 0, 255)
        for black in blacks:
            c = np.clip((c - float(black)) * 255.0 / (255.0 - black), 0, 255)
        out.append(np.floor(c).astype(np.uint8))
    return np.dstack(out)


def legacy_gray(image: np.ndarray, k: int = 51, white: int = P.WHITE_POINT, black: int = P.BLACK_POINTS[0]) -> np.ndarray:
    """Flattened and stretched channel by channel, truncated after each step."""
    out = []
    for n in range(image.shape[2]):
        c = image[:, :, n]
        flat = np.floor(np.clip(c - box_mean(c, k) + 127.0, 0, 255))
        flat = np.floor(np.clip(np.minimum(flat, white) * 255.0 / white, 0, 255))
        out.append(np.floor(np.clip((flat - float(black)) * 255.0 / (255.0 - black), 0, 255)).astype(np.uint8))
    return np.dstack(out)


def unsharp(image: np.ndarray, amount: float = 1.3, kernel: list[float] | None = None) -> np.ndarray:
    kernel = kernel or gaussian(7, 0.8)
    sharp = lambda c: np.clip(np.rint(c * amount + blurred(c, kernel) * (1.0 - amount)), 0, 255).astype(np.uint8)
    return np.dstack([sharp(image[:, :, n]) for n in range(image.shape[2])])


def ink_free(g: np.ndarray, ink: int = P.WHITE_FILL, within: tuple[float, float, float, float] = (0.08,) * 4) -> tuple[int, int, int, int]:
    """The box left when lines without ink go from each side, within shares of the left, right, top and bottom."""
    ends = []
    for axis, low, high in ((0, within[0], within[1]), (1, within[2], within[3])):
        least = g.min(axis)
        n, has = len(least), np.flatnonzero(least <= ink)
        first, last = (int(has[0]), int(has[-1]) + 1) if len(has) else (n, 0)
        ends.append((min(first, int(n * low) + 1), max(last, n - int(n * high)), n))
    (x0, x1, w), (y0, y1, h) = ends
    return (0, 0, w, h) if x1 - x0 < max(1, w // 2) or y1 - y0 < max(1, h // 2) else (x0, y0, x1, y1)


def smeared_top(g: np.ndarray, within: float = 0.10, share: float = 0.50) -> int:
    """The rows at the top whose energy is below a share of the median row's."""
    a = g.astype(np.int32)
    wide = _mirrored(a, 1, 1)
    d = wide[:, 2:] - wide[:, :-2]
    tall = _mirrored(d, 1, 0)
    energy = np.abs(tall[:-2] + 2 * d + tall[2:]).mean(1)
    base, most = float(np.median(energy)), int(len(g) * within)
    strong = np.flatnonzero(energy >= share * base)
    return min(int(strong[0]) if len(strong) else len(g), most) if base > 0 else 0


def dark_left(g: np.ndarray, most: float = 0.25, within: float = 0.06, smooth: int = 15) -> int:
    """The dark columns at the left; none on clean pages or where half the page would go."""
    h, w = g.shape
    if g.mean() > P.CLEAN:
        return 0
    window = max(1, int(h * 0.25))
    starts = range(0, max(0, h - window) + 1, max(1, window // 2))
    top = np.max([(g[y : y + window] < P.DARK).mean(0) for y in starts], axis=0)
    darkness = np.convolve(np.pad(top, smooth // 2), np.ones(smooth) / smooth, mode="valid")
    light = np.flatnonzero(darkness <= most)
    cut = min(int(light[0]) if len(light) else w, int(w * within) + 1)
    return 0 if w - cut < max(1, w // 2) else cut


class Runs:
    """The horizontal runs of a mask, and which of them are joined in eight directions."""

    def __init__(self, mask: np.ndarray):
        h, w = mask.shape
        flat = np.zeros((h, w + 1), np.int8)
        flat[:, :w] = mask
        edge = np.diff(flat.ravel(), prepend=0)
        start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        self.y, self.x0, self.x1 = start // (w + 1), start % (w + 1), end % (w + 1)
        low = np.searchsorted(end, start + w + 1, "left")
        high = np.searchsorted(start, end + w + 1, "right")
        n = np.maximum(0, high - low)
        upper = np.repeat(np.arange(len(start)), n)
        lower = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)
        self.label = joined(len(start), upper, lower)
        self.length = self.x1 - self.x0

    def area(self) -> np.ndarray:
        """The pixels of each run's component."""
        return np.bincount(self.label, self.length, len(self.label))[self.label]

    def box(self) -> tuple[np.ndarray, ...]:
        """x0, y0, x1, y1 of each run's component."""
        out = []
        for of, value in ((np.minimum, self.x0), (np.minimum, self.y), (np.maximum, self.x1), (np.maximum, self.y + 1)):
            best = value.copy()
            of.at(best, self.label, value)
            out.append(best[self.label])
        return tuple(out)

    def paint(self, image: np.ndarray, some: np.ndarray, value: int) -> np.ndarray:
        image = image.copy()
        for k in np.flatnonzero(some):
            image[self.y[k], self.x0[k] : self.x1[k]] = value
        return image


def joined(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least number that each of n things is joined with by the pairs, directly or through others."""
    label = np.arange(n)
    while True:
        least = np.minimum(label[a], label[b])
        new = label.copy()
        for side in (a, b):
            np.minimum.at(new, label[side], least)
            np.minimum.at(new, side, least)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def ink_box(g: np.ndarray, ink: int = P.INK, noise: int = 15) -> tuple[int, int, int, int] | None:
    """The box around components of at least `noise` pixels, or around all ink where there are none; None without ink."""
    runs = Runs(g < ink)
    if not len(runs.label):
        return None
    big = runs.area() >= noise
    some = big if big.any() else np.ones(len(big), bool)
    return int(runs.x0[some].min()), int(runs.y[some].min()), int(runs.x1[some].max()), int(runs.y[some].max()) + 1


def fringed(g: np.ndarray, box: tuple[int, int, int, int], faint: int = P.FAINT, share: float = P.FRINGE) -> tuple[int, int, int, int]:
    """The box grown over faint pixels just outside it: first up and down, then left and right."""
    (h, w), (x0, y0, x1, y1) = g.shape, box
    far_y, far_x = max(1, int(h * share)), max(1, int(w * share))
    light = g < faint
    rows, columns = light[:, x0:x1].any(1), None
    up = np.flatnonzero(rows[max(0, y0 - far_y) : y0])
    down = np.flatnonzero(rows[y1 : y1 + far_y])
    y0, y1 = (max(0, y0 - far_y) + int(up[0]) if len(up) else y0), (y1 + int(down[-1]) + 1 if len(down) else y1)
    columns = light[y0:y1].any(0)
    left = np.flatnonzero(columns[max(0, x0 - far_x) : x0])
    right = np.flatnonzero(columns[x1 : x1 + far_x])
    return (max(0, x0 - far_x) + int(left[0]) if len(left) else x0), y0, (x1 + int(right[-1]) + 1 if len(right) else x1), y1


def whiten_border(image: np.ndarray, ink: int = P.INK, depth: float = 0.12, white: int = 252) -> np.ndarray:
    """Ink components painted white that touch the border and do not reach deep into the page."""
    g = gray(image)
    h, w = g.shape
    runs = Runs(g <= ink)
    if not len(runs.label):
        return image
    x0, y0, x1, y1 = runs.box()
    reach = np.max([np.where(x0 <= 1, x1, 0), np.where(x1 >= w - 2, w - x0, 0), np.where(y0 <= 1, y1, 0), np.where(y1 >= h - 2, h - y0, 0)], axis=0)
    return runs.paint(image, (reach > 0) & (reach < max(w * depth, h * depth)), white)


def whiten_corners(image: np.ndarray, bright: int = 150, step: int = 18, most: float = 0.06, size: int = 9, white: int = 252) -> np.ndarray:
    """Smears painted white: what is reached from a bright corner over small steps of the blurred page, if it is a small
    part of the page without strokes."""
    g = gray(image)
    h, w = g.shape
    blur = blurred(g, gaussian(size))
    breaks = np.ones((h, w), bool)
    breaks[:, 1:] = np.abs(np.diff(blur, axis=1)) > step
    run = np.cumsum(breaks.ravel()).reshape(h, w) - 1
    down = np.abs(np.diff(blur, axis=0)) <= step
    fresh = down.copy()  # one edge for each stretch over which two runs touch
    fresh[:, 1:] &= ~down[:, :-1] | breaks[:-1, 1:] | breaks[1:, 1:]
    label = joined(int(run[-1, -1]) + 1, run[:-1][fresh], run[1:][fresh])[run]
    gone = np.zeros((h, w), bool)
    for y, x in ((0, 0), (0, w - 1), (h - 1, 0), (h - 1, w - 1)):
        if blur[y, x] >= bright:
            seen = label == label[y, x]
            if 0.0005 < seen.mean() < most and not (g[seen] < P.INK).any():
                gone |= seen
    out = image.copy()
    out[gone] = white
    return out


def _taps(kernel: str, t: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """Offsets and weights of a kernel at these fractions."""
    if kernel == "linear":
        return [(0, 1.0 - t), (1, t)]
    if kernel == "cubic":
        near = lambda d: ((P.CUBIC + 2) * d - (P.CUBIC + 3)) * d * d + 1
        far = lambda d: ((P.CUBIC * d - 5 * P.CUBIC) * d + 8 * P.CUBIC) * d - 4 * P.CUBIC
        return [(-1, far(t + 1)), (0, near(t)), (1, near(1.0 - t)), (2, far(2.0 - t))]
    raw = []
    for k in range(-3, 5):
        a = (t - k) * np.pi
        small = np.abs(t - k) < 1e-9
        raw.append((k, np.where(small, 1.0, np.sin(a) * np.sin(a / 4) * 4 / np.where(small, 1.0, a * a))))
    total = sum(x for _, x in raw)
    return [(k, x / total) for k, x in raw]


def _to_bytes(x: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(np.round(x, 9)), 0, 255).astype(np.uint8)


def remapped(image: np.ndarray, source: Callable, shape: tuple[int, int], kernel: str = "cubic", beyond: int = 255, rows: int = 128) -> np.ndarray:
    """A page of this shape whose values are taken at source(y, x), given as columns and rows of places; some rows at a
    time. Beyond the page is that value."""
    h, w, n = image.shape
    flat = np.concatenate((image.reshape(-1, n), np.full((1, n), beyond, np.uint8)))
    out = np.empty((*shape, n), np.uint8)
    for top in range(0, shape[0], rows):
        ys = np.arange(top, min(top + rows, shape[0]), dtype=np.float64)[:, None]
        sy, sx = np.broadcast_arrays(*source(ys, np.arange(shape[1], dtype=np.float64)[None, :]))
        fy, fx = np.floor(sy), np.floor(sx)
        ty, tx = sy - fy, sx - fx
        across = [(0, np.ones_like(tx))] if not tx.any() else _taps(kernel, tx)
        total = np.zeros((*sy.shape, n))
        for j, wy in _taps(kernel, ty) if ty.any() else [(0, np.ones_like(ty))]:
            py = fy.astype(np.int64) + j
            for i, wx in across:
                px = fx.astype(np.int64) + i
                at = np.where((py >= 0) & (py < h) & (px >= 0) & (px < w), py * w + px, h * w)
                total += flat[at] * (wy * wx)[..., None]
        out[top : top + rows] = _to_bytes(total)
    return out


def resized(image: np.ndarray, w2: int, h2: int, kernel: str = "lanczos") -> np.ndarray:
    """The page at another size, the edge repeated beyond it."""
    out = image.astype(np.float64)
    for axis, now in ((0, h2), (1, w2)):
        n = out.shape[axis]
        at = (np.arange(now) + 0.5) * n / now - 0.5
        first = np.floor(at)
        total = 0.0
        for k, weight in _taps(kernel, at - first):
            total = total + out.take(np.clip(first.astype(np.int64) + k, 0, n - 1), axis) * weight.reshape((-1, 1, 1) if axis == 0 else (1, -1, 1))
        out = total
    return _to_bytes(out)


def shrunk(g: np.ndarray, w2: int, h2: int) -> np.ndarray:
    """A gray page made smaller: every pixel is the mean of the area that it covers."""
    out = g.astype(np.float64)
    for axis, now in ((0, h2), (1, w2)):
        n = out.shape[axis]
        total = np.concatenate((np.zeros_like(out.take([0], axis)), np.cumsum(out, axis)), axis)
        at = np.arange(now + 1) * n / now
        whole = np.minimum(np.floor(at).astype(np.int64), n - 1)
        part = (at - whole).reshape((-1, 1) if axis == 0 else (1, -1))
        upto = total.take(whole, axis) + out.take(whole, axis) * part
        out = np.diff(upto, axis=axis) * now / n
    return np.rint(out).astype(np.uint8)


def probe(g: np.ndarray, width: int = P.PROBE_WIDTH) -> tuple[np.ndarray, float]:
    """A gray page of at most this width, and its scale."""
    h, w = g.shape
    return (shrunk(g, width, max(1, round(h * width / w))), width / w) if w > width else (g, 1.0)


def ink_block(width: int) -> int:
    """The side of the surroundings that ink is told from: a fifteenth of the width, odd, from 21 to 101."""
    block = max(21, width // 15)
    return min(101, block + (1 - block % 2))


def ruled(ink: np.ndarray, run: int) -> np.ndarray:
    """What of the ink may be rulings: long horizontal runs, and such as small gaps in thin ink leave when they are
    closed (dashes, dots); gaps between those are closed as well."""
    kept = V.opened(ink, run) | V.opened(V.closed(V.thin(ink, THIN), GAP), max(3, run // 3))
    return V.closed(kept, max(GAP, run // 2))


def strokes(image: np.ndarray, block: int | None = None, run: int | None = None, length: int | None = None, smooth: int = 5, votes: int | None = None) -> list[tuple]:
    """seg_id, x1, y1, x2, y2, w, h of the long, nearly level strokes of a page, in pixels of the page: lines that the
    middles of its horizontal ink vote for, with gaps, dashes and dots."""
    g = gray(image)
    small, scale = probe(g)
    if smooth:
        small = blurred(small, gaussian(smooth)).astype(np.uint8)
    h, w = small.shape
    ink = small <= blurred(small, gaussian(block or ink_block(w))) - 7
    long = length or max(100, w // 4)
    found = V.lines(ruled(ink, run or max(30, w // 12)), ink, long, votes=min(80, long) if votes is None else votes)
    return [(k, x0 / scale, y0 / scale, x1 / scale, y1 / scale, w / scale, h / scale) for k, (x0, y0, x1, y1) in enumerate(found)]


def pink_strokes(image: np.ndarray, above: int = 25, gap: int = 15) -> list[tuple]:
    """seg_id, x1, y1, x2, y2, w, h of long strokes of reddish ink: gray ink does not show where red is compared with
    green. Gaps within a stroke are closed; each component has the least-squares line through it."""
    if image.shape[2] < 3:
        return []
    h0, w0 = image.shape[:2]
    pink = np.clip(image[:, :, 2].astype(np.int16) - image[:, :, 1], 0, 255).astype(np.uint8)
    small, scale = probe(pink)
    mask = V.closed(small > above, gap)
    h, w = mask.shape
    out = []
    for k, (x0, y0, x1, y1) in enumerate(lines(Runs(mask), int(min(h, w) * 0.3))):
        out.append((k, x0 / scale, y0 / scale, x1 / scale, y1 / scale, float(w0), float(h0)))
    return out


def lines(runs: Runs, length: float) -> list[tuple[float, float, float, float]]:
    """The ends of the least-squares lines through the components that are at least so long."""
    n = runs.length.astype(np.float64)
    sx = (runs.x0 + runs.x1 - 1) / 2.0 * n
    sxx = (runs.x1 - 1.0) * runs.x1 * (2 * runs.x1 - 1) / 6 - (runs.x0 - 1.0) * runs.x0 * (2 * runs.x0 - 1) / 6
    sums = [np.bincount(runs.label, x, len(runs.label)) for x in (n, sx, runs.y * n, sxx, runs.y * sx)]
    x0, _, x1, _ = runs.box()
    out = []
    for k in np.unique(runs.label).tolist():
        m, a, b, aa, ab = (s[k] for s in sums)
        if x1[k] - 1 - x0[k] >= max(1, length):
            slope = (m * ab - a * b) / (m * aa - a * a)
            start = (b - slope * a) / m
            out.append((float(x0[k]), float(slope * x0[k] + start), float(x1[k] - 1), float(slope * (x1[k] - 1) + start)))
    return out


def edges(g: np.ndarray, low: int = 30, high: int = 120) -> np.ndarray:
    """Thin edges of a gray page: where the gradient is a ridge, strong or joined with what is strong."""
    a = blurred(g, gaussian(5))
    wide, tall = _mirrored(a, 1, 1), _mirrored(a, 1, 0)
    dx, dy = wide[:, 2:] - wide[:, :-2], tall[2:] - tall[:-2]
    dx, dy = _mirrored(dx, 1, 0), _mirrored(dy, 1, 1)
    gx, gy = dx[:-2] + 2 * dx[1:-1] + dx[2:], dy[:, :-2] + 2 * dy[:, 1:-1] + dy[:, 2:]
    size = np.abs(gx) + np.abs(gy)
    around = np.pad(size, 1)
    h, w = size.shape
    at = lambda y, x: around[1 + y : 1 + y + h, 1 + x : 1 + x + w]
    flat, steep = np.abs(gy) <= np.abs(gx) * 0.4142, np.abs(gy) >= np.abs(gx) * 2.4142
    falling = gx * gy > 0
    before = np.where(flat, at(0, -1), np.where(steep, at(-1, 0), np.where(falling, at(-1, -1), at(-1, 1))))
    after = np.where(flat, at(0, 1), np.where(steep, at(1, 0), np.where(falling, at(1, 1), at(1, -1))))
    ridge = (size > before) & (size >= after) & (size > low)
    runs = Runs(ridge)
    count = np.concatenate(([0], np.cumsum((size > high).ravel())))
    strong = count[runs.y * w + runs.x1] - count[runs.y * w + runs.x0]
    kept = np.bincount(runs.label, strong, len(runs.label))[runs.label] > 0
    out = np.zeros((h, w), bool)
    for k in np.flatnonzero(kept):
        out[runs.y[k], runs.x0[k] : runs.x1[k]] = True
    return out


def grown(mask: np.ndarray) -> np.ndarray:
    """The mask and all pixels beside it."""
    m = np.pad(mask, 1)
    m = m[:-2] | m[1:-1] | m[2:]
    return m[:, :-2] | m[:, 1:-1] | m[:, 2:]


def simplified(polygon: np.ndarray, tolerance: float) -> np.ndarray:
    """The corners of a closed polygon that are further than the tolerance from the sides that the others make."""
    far = lambda p: int(np.argmax(((polygon - p) ** 2).sum(1)))
    one = far(polygon[0])
    two = far(polygon[one])
    keep, todo = {one, two}, [tuple(sorted((one, two))), (max(one, two), min(one, two) + len(polygon))]
    while todo:
        a, b = todo.pop()
        p, q = polygon[a % len(polygon)], polygon[b % len(polygon)]
        some = np.arange(a + 1, b)
        if not len(some):
            continue
        d = polygon[some % len(polygon)] - p
        away = np.abs(d[:, 0] * (q - p)[1] - d[:, 1] * (q - p)[0]) / max(1e-9, float(np.hypot(*(q - p))))
        k = int(np.argmax(away))
        if away[k] > tolerance:
            keep.add(int(some[k]) % len(polygon))
            todo += [(a, int(some[k])), (int(some[k]), b)]
    return polygon[sorted(keep)]


#: The places around a pixel (down, right), clockwise from the right.
_AROUND = [(0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1), (-1, 0), (-1, 1)]


def border(mask: np.ndarray) -> np.ndarray:
    """x and y of the outer border of the mask's first component, pixel by pixel, clockwise from its topmost left one;
    where the component is one pixel thin the border comes back along it."""
    wide = mask.shape[1] + 2
    flat = bytearray(np.pad(mask, 1).astype(np.uint8).tobytes())
    start = flat.find(1)
    if start < 0:
        return np.empty((0, 2), np.int64)
    steps = [dy * wide + dx for dy, dx in _AROUND]
    back_to = {step: k for k, step in enumerate(steps)}
    path, at, back, second = [start], start, 4, None  # what is to the left of the first pixel is empty
    while True:
        for k in range(1, 9):
            turn = (back + k) & 7
            if flat[at + steps[turn]]:
                break
        else:
            break  # one pixel alone
        following = at + steps[turn]
        if at == start and following == second:
            path.pop()  # round once
            break
        second = following if second is None else second
        back = back_to[at + steps[(turn - 1) & 7] - following]
        at = following
        path.append(at)
    path = np.array(path)
    return np.column_stack([path % wide - 1, path // wide - 1])


def enclosed(ring: np.ndarray) -> float:
    """The area of a closed polygon."""
    x, y = ring[:, 0], ring[:, 1]
    return abs(float((x * np.roll(y, -1) - y * np.roll(x, -1)).sum())) / 2


def convex(corners: np.ndarray) -> bool:
    """Whether a closed polygon turns one way only."""
    side = np.roll(corners, -1, 0) - corners
    following = np.roll(side, -1, 0)
    turn = side[:, 0] * following[:, 1] - side[:, 1] * following[:, 0]
    return bool((turn > 0).all() or (turn < 0).all())


def outlines(image: np.ndarray, most: int = 7) -> list[tuple]:
    """idx, area, w, h and points (x and y of four corners; null if it has no four that turn one way) of the largest
    edges of a page: their outer borders are followed, measured, and simplified until four corners are left."""
    g, scale = probe(gray(image))
    mask = grown(edges(g))
    runs = Runs(mask)
    h, w = mask.shape
    out = []
    if not len(runs.label):
        return out
    x0, y0, x1, y1 = runs.box()
    first = np.unique(runs.label)
    span = (x1 - x0)[first] * (y1 - y0)[first]
    for k in first[np.argsort(-span, kind="stable")][:most].tolist():
        if (x1[k] - x0[k]) * (y1[k] - y0[k]) < 0.2 * h * w:
            continue
        own = np.zeros((h, w), bool)
        for j in np.flatnonzero(runs.label == k):
            own[runs.y[j], runs.x0[j] : runs.x1[j]] = True
        ring = border(own).astype(np.float64)
        area = enclosed(ring)
        sides = np.roll(ring, -1, 0) - ring
        around, points = float(np.hypot(sides[:, 0], sides[:, 1]).sum()), None
        for share in (0.02, 0.03, 0.05):
            corners = simplified(ring, share * around)
            if len(corners) == 4 and convex(corners):
                points = (corners / scale).ravel().tolist()
                break
        out.append((k, area / scale**2, w / scale, h / scale, points))
    return out


# --------------------------------------------------------------------------------------------------------- on DataFrames


def from_pixels(pixels: DataFrame) -> DataFrame:
    """Pixel rows (page_id, y, x, and b, g, r or v) as images; a task draws one page at a time."""
    colour = "b" in pixels.columns
    values = ["b", "g", "r"] if colour else ["v"]

    def draw(page: pa.Table) -> pa.Table:
        y, x = page["y"].to_numpy(), page["x"].to_numpy()
        image = np.full((int(y.max()) + 1, int(x.max()) + 1, len(values)), 255, np.uint8)
        for k, c in enumerate(values):
            image[y, x, k] = page[c].to_numpy()
        return pa.Table.from_batches([page_row(page["page_id"][0].as_py(), image, None)])

    return pixels.select("page_id", "y", "x", *values).groupBy("page_id").applyInArrow(draw, SCHEMA)


def to_pixels(images: DataFrame) -> DataFrame:
    """Images as pixel rows: page_id, y, x, and b, g, r (of gray pages the same three times)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, image, error in _pages(batches):
            if error is None:
                h, w, n = image.shape
                for top in range(0, h, max(1, 100_000 // w)):
                    part = image[top : top + max(1, 100_000 // w)]
                    y, x = np.divmod(np.arange(part.shape[0] * w, dtype=np.int32), w)
                    values = [part[:, :, min(k, n - 1)].ravel().astype(np.int32) for k in range(3)]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(y), row["page_id"], np.int64)), pa.array(y.astype(np.int32) + np.int32(top)), pa.array(x.astype(np.int32)), *map(pa.array, values)], ["page_id", "y", "x", "b", "g", "r"])

    return images.select(*NAMES).mapInArrow(run, "page_id long, y int, x int, b int, g int, r int")


_SEGMENT = "seg_id long, x1 double, y1 double, x2 double, y2 double, w double, h double"


def segments(images: DataFrame, **options) -> DataFrame:
    """page_id, seg_id, x1, y1, x2, y2, w, h of the strokes of every page."""

    def measure(image: np.ndarray) -> list[tuple]:
        return strokes(image, **options)

    return measured(images, measure, _SEGMENT)


def pink_segments(images: DataFrame) -> DataFrame:
    """The same of reddish strokes."""
    return measured(images, pink_strokes, _SEGMENT)


def contours(images: DataFrame) -> DataFrame:
    """page_id, idx, area, w, h, points of the largest closed edges of every page."""
    return measured(images, outlines, "idx long, area double, w double, h double, points array<double>")
