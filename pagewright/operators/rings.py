"""Spiral bindings on enhanced pages: found as what is very dark, thick, tall and at the right, or as long diagonals that
share one angle there, and filled from the paper around them.

A step for one page (see rasters.each_page); a page without such a binding is returned as it is.
"""

from __future__ import annotations

import numpy as np

from pagewright import params as P
from pagewright.operators import rasters as R

#: How far around a pixel what is known fills it.
REACH = 5


def distances(mask: np.ndarray, most: float = np.inf) -> np.ndarray:
    """The exact distance of every masked pixel from the nearest pixel of the page that is not, 0 elsewhere; distances
    beyond `most` are only known to be larger. Beyond the page is nothing."""
    h, w = mask.shape
    far = float(h + w)
    up = np.empty((h, w))
    last = np.full(w, far)
    for y in range(h):  # along columns first
        last = np.where(mask[y], last + 1, 0)
        up[y] = last
    last = np.full(w, far)
    for y in range(h - 1, -1, -1):
        last = np.where(mask[y], last + 1, 0)
        up[y] = np.minimum(up[y], last)
    best, k = np.minimum(up, far) ** 2, 1
    high = up**2
    while k < w and k * k < min(best.max(initial=0), (most + 1) ** 2):
        best[:, k:] = np.minimum(best[:, k:], high[:, :-k] + k * k)
        best[:, :-k] = np.minimum(best[:, :-k], high[:, k:] + k * k)
        k += 1
    return np.sqrt(best)


def _ellipse(size: int) -> list[tuple[int, int]]:
    """The places of a filled ellipse in a square of this odd size."""
    r = size // 2
    wide = lambda dy: round(r * np.sqrt(max(0.0, 1 - dy * dy / (r * r))))
    return [(dy, dx) for dy in range(-r, r + 1) for dx in range(-wide(dy), wide(dy) + 1)]


def spread(mask: np.ndarray, places: list[tuple[int, int]], all_of: bool = False) -> np.ndarray:
    """Whether any (or all) of the places around each pixel are in the mask; beyond the page all are for `all_of`, none
    otherwise."""
    r = max(max(abs(a), abs(b)) for a, b in places)
    wide = np.pad(mask, r, constant_values=all_of)
    h, w = mask.shape
    parts = [wide[r + dy : r + dy + h, r + dx : r + dx + w] for dy, dx in places]
    return np.logical_and.reduce(parts) if all_of else np.logical_or.reduce(parts)


def _drawn(runs: R.Runs, some: np.ndarray, shape: tuple[int, int]) -> np.ndarray:
    out = np.zeros(shape, bool)
    for k in np.flatnonzero(some):
        out[runs.y[k], runs.x0[k] : runs.x1[k]] = True
    return out


def thick_rings(g: np.ndarray, zone: float = P.RING_ZONE, dark: int = 70, least_area: int = 40, least_height: int = 20, thickness: float = 2.0) -> np.ndarray:
    """The pixels of dark blobs too thick for strokes that stand mostly in the right zone; long level lines are left out
    first."""
    h, w = g.shape
    runs = R.Runs(g < dark)
    thick = distances(_drawn(runs, runs.length < max(25, w // 18), (h, w)), thickness) > thickness
    blobs = R.Runs(thick)
    if not len(blobs.label):
        return thick
    x0, y0, x1, y1 = blobs.box()
    right = np.clip(blobs.x1 - np.maximum(blobs.x0, int(w * zone)), 0, None)
    area = blobs.area()
    share = np.bincount(blobs.label, right, len(blobs.label))[blobs.label] / area
    some = (area >= least_area) & (y1 - y0 >= least_height) & (share > 0.6) & ((x1 - x0 > 6) | (y1 - y0 > 6))
    return spread(_drawn(blobs, some, (h, w)), _ellipse(5))


def straight_edges(g: np.ndarray, length: float = 80.0, off: float = 1.5) -> list[tuple[float, float, np.ndarray, np.ndarray]]:
    """Angle (0 to 90 degrees), length, and the pixels (y and x) of the edges of a page that are straight and long."""
    runs = R.Runs(R.edges(g, 50, 150))
    out = []
    if not len(runs.label):
        return out
    x0, y0, x1, y1 = runs.box()
    for k in np.unique(runs.label[np.hypot(x1 - x0, y1 - y0) >= length]).tolist():
        own = np.flatnonzero(runs.label == k)
        x = np.concatenate([np.arange(runs.x0[j], runs.x1[j]) for j in own])
        y = np.repeat(runs.y[own], runs.length[own])
        points = np.column_stack([x, y]) - [x.mean(), y.mean()]
        spreads, axes = np.linalg.eigh(points.T @ points / len(x))
        along = points @ axes[:, 1]
        if spreads[0] <= off * off and along.max() - along.min() >= length:
            angle = abs(np.degrees(np.arctan2(axes[1, 1], axes[0, 1])))
            out.append((float(min(angle, 180 - angle)), float(along.max() - along.min()), y, x))
    return out


def diagonal_rings(g: np.ndarray, zone: float = P.RING_ZONE, bin_width: int = 5, least: int = 5, most: float = 0.03) -> np.ndarray | None:
    """The pixels around the long edges of the right zone that share the most common steep angle (upright ones, which
    tables have, do not count); None unless five agree, or where they would take more than a small part of the page."""
    h, w = g.shape
    start = int(w * zone)
    found = [e for e in straight_edges(g[:, start:]) if 55.0 <= e[0] <= 90.0 and not 86.0 <= e[0] <= 94.0]
    bins = [int(e[0] // bin_width) * bin_width for e in found]
    peak = max(dict.fromkeys(bins), key=bins.count, default=None)
    if peak is None or bins.count(peak) < least:
        return None
    mask = np.zeros((h, w), bool)
    for angle, _, y, x in found:
        if abs(angle - (peak + bin_width / 2)) <= 10.0:
            mask[y, x + start] = True
    mask[:, start:] = spread(mask[:, start:], _ellipse(7))
    return None if mask.sum() > most * h * w else mask


def _slopes(values: np.ndarray, known: np.ndarray, axis: int) -> np.ndarray:
    """Differences along an axis between what is known: of both sides, of one side, or none."""
    wide, there = np.pad(values, [(1, 1), (1, 1), (0, 0)], mode="edge"), np.pad(known, 1)
    side = lambda a, k: a[1 + k : a.shape[0] - 1 + k, 1:-1] if axis == 0 else a[1:-1, 1 + k : a.shape[1] - 1 + k]
    before, after = side(there, -1)[..., None], side(there, 1)[..., None]
    back, ahead = values - side(wide, -1), side(wide, 1) - values
    return np.where(before & after, (back + ahead) / 2, np.where(before, back, np.where(after, ahead, 0.0))) * known[..., None]


def filled_in(image: np.ndarray, mask: np.ndarray, reach: int = REACH) -> np.ndarray:
    """The masked pixels filled from the rim inwards, in the order in which a front from there arrives: each continues
    the values and slopes of what is known around it, nearer pixels, those the front comes from and those of the same
    depth counting more. With unit speed the front arrives after the exact distance, so no queue is needed, and pixels at
    which it arrives together are filled together."""
    ys, xs = np.nonzero(mask)
    if not len(ys):
        return image
    margin = 2 * reach + 1
    part = slice(max(0, ys.min() - margin), ys.max() + margin + 1), slice(max(0, xs.min() - margin), xs.max() + margin + 1)
    values, hole = image[part].astype(np.float64), mask[part]
    if hole.all():
        return image
    arrival = distances(hole) - np.minimum(distances(~hole, 2 * reach), 2 * reach)
    ty, tx = np.gradient(arrival) if min(arrival.shape) > 1 else (np.zeros_like(arrival), np.zeros_like(arrival))
    steps = [(dy, dx) for dy in range(-reach, reach + 1) for dx in range(-reach, reach + 1) if 0 < dy * dy + dx * dx <= reach * reach]
    dy, dx = (np.array(s) for s in zip(*steps, strict=True))
    known, (h, w) = ~hole, hole.shape
    order = np.floor(2 * arrival).astype(int)
    for front in np.unique(order[hole]):
        gy, gx = _slopes(values, known, 0), _slopes(values, known, 1)
        for py, px in zip(*(np.array_split(p, max(1, len(p) // 2000)) for p in np.nonzero(hole & (order == front))), strict=True):
            qy, qx = py[:, None] + dy, px[:, None] + dx
            there = (qy >= 0) & (qy < h) & (qx >= 0) & (qx < w)
            qy, qx = np.clip(qy, 0, h - 1), np.clip(qx, 0, w - 1)
            there &= known[qy, qx]
            long = np.hypot(dy, dx)
            facing = np.abs(dy * ty[py, px][:, None] + dx * tx[py, px][:, None]) / long
            level = 1.0 / (1.0 + np.abs(arrival[py, px][:, None] - arrival[qy, qx]))
            weight = np.where(there, np.maximum(facing, 1e-6) * level / long**2, 0.0)[..., None]
            toward = values[qy, qx] - gy[qy, qx] * dy[:, None] - gx[qy, qx] * dx[:, None]
            total = weight.sum(1)
            values[py, px] = np.where(total > 0, (weight * toward).sum(1) / np.where(total > 0, total, 1.0), values[py, px])
        np.clip(values, 0, 255, out=values)
        known = known | (hole & (order == front))
    out = image.copy()
    out[part][hole] = np.rint(values[hole])
    return out


def without_rings(image: np.ndarray, zone: float = P.RING_ZONE, least: int = 50) -> np.ndarray:
    """A page with the rings of its binding filled in; as it is where hardly any are found."""
    g = R.gray(image)
    mask = thick_rings(g, zone)
    diagonal = diagonal_rings(g, zone)
    mask = mask if diagonal is None else mask | diagonal
    return image if mask.sum() < least else filled_in(image, mask)
