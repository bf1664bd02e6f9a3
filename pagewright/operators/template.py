"""Pages brought onto a template that the caller gives: a form, a printed sheet, a photographed page.

Keypoints of a page (where differences of Gaussians peak over place and scale) carry descriptors of the gradients around
them. Each is joined with its two nearest among the template's; those that are much nearer than the second are matches,
and the projective map that most of a page's matches agree with moves it onto the template. A template's points are
bounded, so they go with the tasks; a page's points never leave its group.

Defined results: a page without enough matches or agreement has no map and stays as it is, as has a page with an error;
without a template of two points nothing matches; null descriptors match nothing, and shorter ones count as filled up with zeros.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright import params as P
from pagewright.operators import rasters as R

# How much nearer a match is than the second, how many matches and agreeing ones a page needs, and how far
# from its place a match may be moved, in pixels of the template.
RATIO, MATCHES, AGREEING, OFF = 0.7, 12, 25, 5.0
#: Points that a page has at most (its strongest), the width that they are sought at, and maps that are tried.
POINTS, WIDTH, TRIES = 1500, 800, 2000
#: Points that a template has at most where it is a table.
TEMPLATE_POINTS = 10_000
#: Scales of an octave, the blur of its first, and how strong and how round a peak has to be.
SCALES, SIGMA, CONTRAST, EDGE = 3, 1.6, 4.0, 10.0


def _smooth(g: np.ndarray, sigma: float) -> np.ndarray:
    r = int(np.ceil(3 * sigma))
    weights = np.exp(-(np.arange(-r, r + 1) ** 2) / (2 * sigma**2))
    weights /= weights.sum()
    for axis in (0, 1):
        wide = np.pad(g, [(r, r) if a == axis else (0, 0) for a in (0, 1)], mode="reflect" if min(g.shape) > r else "symmetric")
        g = sum(w * wide.take(range(k, k + g.shape[axis]), axis) for k, w in enumerate(weights))
    return g


def _octaves(g: np.ndarray) -> Iterator[tuple[float, list[np.ndarray]]]:
    """The scale of each octave's pixels and its blurred images."""
    now, step, base = g.astype(np.float64), 1.0, _smooth(g.astype(np.float64), (SIGMA**2 - 0.25) ** 0.5)
    while min(now.shape) >= 24:
        stack = [base]
        for k in range(1, SCALES + 3):
            before, after = SIGMA * 2 ** ((k - 1) / SCALES), SIGMA * 2 ** (k / SCALES)
            stack.append(_smooth(stack[-1], (after**2 - before**2) ** 0.5))
        yield step, stack
        base = now = stack[SCALES][::2, ::2]
        step *= 2


def _peaks(stack: list[np.ndarray]) -> list[tuple[float, int, float, float]]:
    """Strength, level, y and x of the places where differences of blurs are largest or smallest of all around."""
    d = np.stack([b - a for a, b in zip(stack, stack[1:])])
    inner, out = d[1:-1, 1:-1, 1:-1], []
    around = [d[1 + s : d.shape[0] - 1 + s, 1 + y : d.shape[1] - 1 + y, 1 + x : d.shape[2] - 1 + x] for s in (-1, 0, 1) for y in (-1, 0, 1) for x in (-1, 0, 1) if (s, y, x) != (0, 0, 0)]
    extreme = ((inner > np.maximum.reduce(around)) | (inner < np.minimum.reduce(around))) & (np.abs(inner) > CONTRAST)
    for s, y, x in np.argwhere(extreme) + 1:
        v = d[s]
        dxx, dyy = v[y, x + 1] + v[y, x - 1] - 2 * v[y, x], v[y + 1, x] + v[y - 1, x] - 2 * v[y, x]
        dxy = (v[y + 1, x + 1] + v[y - 1, x - 1] - v[y + 1, x - 1] - v[y - 1, x + 1]) / 4
        det = dxx * dyy - dxy * dxy
        if det <= 0 or (dxx + dyy) ** 2 * EDGE >= (EDGE + 1) ** 2 * det:
            continue
        gx, gy = (v[y, x + 1] - v[y, x - 1]) / 2, (v[y + 1, x] - v[y - 1, x]) / 2
        shift = np.clip([-(dyy * gx - dxy * gy) / det, -(dxx * gy - dxy * gx) / det], -0.6, 0.6)
        out.append((abs(float(v[y, x])), int(s), float(y + shift[1]), float(x + shift[0])))
    return out


def _described(level: np.ndarray, places: np.ndarray, sigma: float) -> np.ndarray:
    """128 numbers for each place: gradients of 4 x 4 cells by eight directions, turned by the direction most have."""
    gy, gx = np.gradient(level)
    size, turn = np.hypot(gx, gy), np.arctan2(gy, gx)
    h, w = level.shape

    def at(y, x):
        y, x = np.clip(np.rint(y), 0, h - 1).astype(int), np.clip(np.rint(x), 0, w - 1).astype(int)
        return size[y, x], turn[y, x]

    n = len(places)
    reach = np.arange(-6, 7) * 0.75 * sigma
    dy, dx = (m.ravel() for m in np.meshgrid(reach, reach, indexing="ij"))
    s, t = at(places[:, :1] + dy, places[:, 1:] + dx)
    weight = s * np.exp(-(dy**2 + dx**2) / (2 * (1.5 * sigma) ** 2))
    histogram = np.zeros((n, 36))
    np.add.at(histogram, (np.arange(n)[:, None], (np.floor((t + np.pi) / (2 * np.pi) * 36).astype(int)) % 36), weight)
    wide = np.concatenate([histogram[:, -2:], histogram, histogram[:, :2]], axis=1)
    histogram = wide[:, :-4] + wide[:, 4:] + 4 * (wide[:, 1:-3] + wide[:, 3:-1]) + 6 * wide[:, 2:-2]
    best = histogram.argmax(1)
    left, mid, right = (histogram[np.arange(n), (best + k) % 36] for k in (-1, 0, 1))
    bend = left + right - 2 * mid
    lean = np.where(bend < 0, 0.5 * (left - right) / np.where(bend < 0, bend, -1.0), 0.0)
    main = (best + 0.5 + lean) * 2 * np.pi / 36 - np.pi
    u, v = (m.ravel() for m in np.meshgrid((np.arange(16) - 7.5), (np.arange(16) - 7.5), indexing="ij"))
    c, q = np.cos(main)[:, None], np.sin(main)[:, None]
    s, t = at(places[:, :1] + (u * c + v * q) * 0.75 * sigma, places[:, 1:] + (v * c - u * q) * 0.75 * sigma)
    s = s * np.exp(-(u**2 + v**2) / 128)
    way = ((t - main[:, None]) / (2 * np.pi) * 8) % 8
    out = np.zeros((n, 4, 4, 8))
    rows = np.arange(n)[:, None]
    cy, cx = u / 4 + 1.5, v / 4 + 1.5
    for oy in (0, 1):
        for ox in (0, 1):
            for oa in (0, 1):
                y, x, a = np.floor(cy).astype(int) + oy, np.floor(cx).astype(int) + ox, np.floor(way).astype(int) + oa
                share = (1 - np.abs(cy - y)) * (1 - np.abs(cx - x)) * (1 - np.abs(way - a))
                inside = (y >= 0) & (y < 4) & (x >= 0) & (x < 4)
                np.add.at(out, (rows, np.broadcast_to(np.clip(y, 0, 3), way.shape), np.broadcast_to(np.clip(x, 0, 3), way.shape), a % 8), np.where(inside, s * share, 0.0))
    out = out.reshape(n, 128)
    for _ in range(2):
        out = np.minimum(out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9), 0.2)
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


def keypoints(g: np.ndarray, most: int = POINTS, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """x, y (pixels of the gray page) and descriptors of its strongest keypoints."""
    small, scale = R.probe(g, width)
    found, levels = [], []
    for step, stack in _octaves(small):
        for strength, level, y, x in _peaks(stack):
            found.append((strength, len(levels) + level, y, x, step))
        levels += [(im, SIGMA * 2 ** (k / SCALES)) for k, im in enumerate(stack)]
    found.sort(key=lambda f: (-f[0], f[1:]))
    found = found[:most]
    points, described = np.zeros((len(found), 2)), np.zeros((len(found), 128), np.float32)
    for level in sorted({f[1] for f in found}):
        own = [k for k, f in enumerate(found) if f[1] == level]
        places = np.array([found[k][2:4] for k in own])
        image, sigma = levels[level]
        described[own] = _described(image, places, sigma)
        points[own] = [((found[k][3] * found[k][4] + 0.5) / scale - 0.5, (found[k][2] * found[k][4] + 0.5) / scale - 0.5) for k in own]
    return points, described


def page_keypoints(images: DataFrame) -> DataFrame:
    """page_id, point, x, y and descriptor of the keypoints of every page."""

    def measure(image: np.ndarray) -> list[tuple]:
        points, described = keypoints(R.gray(image))
        return [(k, float(x), float(y), d.astype(np.float64).tolist()) for k, ((x, y), d) in enumerate(zip(points, described, strict=True))]

    return R.measured(images, measure, "point long, x double, y double, descriptor array<double>")


def template_points(points: DataFrame, most: int = TEMPLATE_POINTS) -> pd.DataFrame:
    """point, x, y and descriptor of a template that is a table; more points than the bound are an error."""
    rows = points.where("descriptor is not null").select("point", "x", "y", "descriptor").limit(most + 1).toPandas()
    if len(rows) > most:
        raise ValueError(f"a template of more than {most} points")
    return rows.sort_values("point", ignore_index=True)


def two_nearest(points: DataFrame, template: pd.DataFrame) -> DataFrame:
    """page_id, point, x, y, match, match_x, match_y, near and second (the distances) of every point and its nearest
    in the template, ties to the smaller one."""
    kinds = "page_id long, point long, x double, y double, match long, match_x double, match_y double, near double, second double"
    width = max((len(d) for d in template["descriptor"]), default=0)

    def filled(rows) -> np.ndarray:
        out = np.zeros((len(rows), width))
        for k, r in enumerate(rows):
            out[k, : len(r)] = r
        return out

    known = filled(template["descriptor"])
    ids, xs, ys = (template[c].to_numpy() for c in ("point", "x", "y"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows if len(known) > 1 else 0, 1024):
                batch = whole.slice(at, 1024)
                own = batch.column("descriptor").to_pylist()
                if any(d is None or len(d) > width for d in own):
                    keep = [k for k, d in enumerate(own) if d is not None and len(d) <= width]
                    batch, own = batch.take(pa.array(keep, pa.int64())), [own[k] for k in keep]
                d = filled(own)
                # the least by the product of matrices; those close to it once more, exactly
                rough = (d**2).sum(1)[:, None] - 2 * d @ known.T + (known**2).sum(1)
                some = np.sort(np.argpartition(rough, min(7, len(known) - 1), axis=1)[:, :8], axis=1)
                exact = ((d[:, None, :] - known[some]) ** 2).sum(2)
                order = np.argsort(exact, axis=1, kind="stable")
                first = some[np.arange(len(d)), order[:, 0]] if len(d) else np.empty(0, int)
                near, second = (np.sqrt(exact[np.arange(len(d)), order[:, k]]) if len(d) else np.empty(0) for k in (0, 1))
                columns = [batch.column(c) for c in ("page_id", "point", "x", "y")] + [pa.array(v) for v in (ids[first].astype(np.int64), xs[first].astype(float), ys[first].astype(float), near, second)]
                yield pa.RecordBatch.from_arrays(columns, [k.split()[0] for k in kinds.split(", ")])

    return points.select(F.col("page_id").cast("long").alias("page_id"), F.col("point").cast("long").alias("point"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), F.col("descriptor").cast("array<double>").alias("descriptor")).mapInArrow(run, kinds)


def good(found: DataFrame, ratio: float = RATIO) -> DataFrame:
    """The matches that are much nearer than the second."""
    return found.where(F.col("near") < ratio * F.col("second"))


def projective(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The maps (eight numbers) that bring four places or more onto others, by least squares; many sets at once."""
    x, y, u, v = a[..., 0], a[..., 1], b[..., 0], b[..., 1]
    one, zero = np.ones_like(x), np.zeros_like(x)
    rows = np.concatenate([np.stack([x, y, one, zero, zero, zero, -u * x, -u * y], -1), np.stack([zero, zero, zero, x, y, one, -v * x, -v * y], -1)], -2)
    goal = np.concatenate([u, v], -1)[..., None]
    square = np.swapaxes(rows, -1, -2)
    return np.linalg.solve(square @ rows + 1e-12 * np.eye(8), square @ goal)[..., 0]


def mapped(m: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Places under a map, or under each of many."""
    x, y, m = p[:, 0], p[:, 1], m[..., None, :]
    depth = m[..., 6] * x + m[..., 7] * y + 1.0
    depth = np.where(np.abs(depth) < 1e-9, 1e-9, depth)
    return np.stack([(m[..., 0] * x + m[..., 1] * y + m[..., 2]) / depth, (m[..., 3] * x + m[..., 4] * y + m[..., 5]) / depth], -1)


def agreed(a: np.ndarray, b: np.ndarray, off: float = OFF, tries: int = TRIES, seed: int = 1) -> tuple[np.ndarray | None, int]:
    """The map from a to b that most pairs of places agree with, and how many do; refined on those."""
    if len(a) < 4:
        return None, 0
    # numbers around zero and one keep the equations well posed
    ca, cb, sa, sb = a.mean(0), b.mean(0), max(a.std(), 1e-9), max(b.std(), 1e-9)
    a0, b0 = (a - ca) / sa, (b - cb) / sb
    rng = np.random.default_rng(seed)
    picks = rng.random((tries, len(a))).argpartition(3, axis=1)[:, :4]
    maps = projective(a0[picks], b0[picks])
    best, most = None, -1
    for at in range(0, tries, 250):
        n = ((mapped(maps[at : at + 250], a0) - b0) ** 2).sum(-1) <= (off / sb) ** 2
        k = int(n.sum(1).argmax())
        if n[k].sum() > most:
            best, most = n[k], int(n[k].sum())
    for _ in range(4):
        if best.sum() < 4:
            return None, int(best.sum())
        m = projective(a0[best], b0[best])
        best = ((mapped(m, a0) - b0) ** 2).sum(-1) <= (off / sb) ** 2
    whole = lambda c, s: np.array([[1 / s, 0, -c[0] / s], [0, 1 / s, -c[1] / s], [0, 0, 1]])
    h = np.linalg.inv(whole(cb, sb)) @ np.append(m, 1.0).reshape(3, 3) @ whole(ca, sa)
    return (h / h[2, 2]).ravel()[:8], int(best.sum())


def template_moves(matches: DataFrame, width: int, height: int, least: int = MATCHES, agreeing: int = AGREEING) -> DataFrame:
    """page_id, kind and numbers (the template's size, and the map from it to the page) of the pages whose matches agree."""

    def solve(page: pd.DataFrame) -> pd.DataFrame:
        page = page.sort_values("point")
        a, b = page[["match_x", "match_y"]].to_numpy(), page[["x", "y"]].to_numpy()
        rows = []
        if len(page) >= least:
            m, _ = agreed(b, a)  # distances are measured on the template
            if m is not None:
                back = np.linalg.inv(np.append(m, 1.0).reshape(3, 3))
                back = (back / back[2, 2]).ravel()[:8]
                near = ((mapped(m, b) - a) ** 2).sum(-1) <= OFF**2
                if near.sum() >= agreeing:
                    rows = [(page["page_id"].iloc[0], "quad", [float(width), float(height), *back.tolist()])]
        return pd.DataFrame(rows, columns=["page_id", "kind", "numbers"])

    # a page has a bounded number of points
    return matches.groupBy("page_id").applyInPandas(solve, "page_id long, kind string, numbers array<double>")


def alignment(images: DataFrame, template: np.ndarray) -> DataFrame:
    """page_id, kind and numbers of the pages that can be brought onto the template, an image."""
    points, described = keypoints(R.gray(template if template.ndim == 3 else template[:, :, None]))
    known = pd.DataFrame({"point": range(len(points)), "x": points[:, 0], "y": points[:, 1], "descriptor": list(described.astype(np.float64))})
    return template_moves(good(two_nearest(page_keypoints(images), known)), template.shape[1], template.shape[0])


def template_size(template: np.ndarray | None) -> tuple[int, int] | None:
    """Width and height of a template, None without one."""
    return None if template is None or not template.size else (template.shape[1], template.shape[0])


def template_aspect(template: np.ndarray | None) -> float:
    """Width by height of a template, or what is known of the usual one."""
    size = template_size(template)
    return size[0] / size[1] if size else P.ASPECT
