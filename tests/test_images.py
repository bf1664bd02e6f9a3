import numpy as np
import pytest

from pagewright.operators import images as I
from pagewright.params import ScanParams
from pagewright.plans.scan import scan


def pixels(spark, *pages):
    rows = [(k, y, x, int(v)) for k, page in enumerate(pages) for (y, x), v in np.ndenumerate(page)]
    return spark.createDataFrame(rows, "page_id long, y int, x int, v int")


def page(df, k, shape, column="v"):
    out = np.zeros(shape)
    for r in df.where(f"page_id = {k}").collect():
        out[r.y, r.x] = r[column]
    return out


@pytest.fixture(scope="module")
def noise():
    rng = np.random.default_rng(5)
    return [rng.integers(0, 256, (7, 11)), rng.integers(0, 256, (1, 6)), rng.integers(0, 256, (9, 4))]


@pytest.mark.parametrize("k", [3, 7, 21])
def test_box_mean_mirrors_at_any_size(spark, noise, k):
    df = I.box_mean(pixels(spark, *noise), k)
    for n, image in enumerate(noise):
        r = k // 2
        index = [np.array([_mirror(i, size) for i in range(-r, size + r)]) for size in image.shape]
        big = image[np.ix_(*index)]
        want = [[round(big[y : y + k, x : x + k].sum() / k**2) for x in range(image.shape[1])] for y in range(image.shape[0])]
        assert (page(df, n, image.shape, "mean") == want).all()


def _mirror(i, n):
    if n == 1:
        return 0
    i %= 2 * (n - 1)
    return min(i, 2 * (n - 1) - i)


def test_components_against_a_flood(spark):
    mask = np.random.default_rng(8).random((20, 30)) < 0.45
    spiral = np.zeros((9, 9), bool)
    spiral[0, :] = spiral[:, 8] = spiral[8, 2:] = spiral[2:, 2] = spiral[2, 2:7] = True
    for shape in (mask, spiral):
        df = pixels(spark, np.where(shape, 0, 255))
        got = {(r.y, r.x): r.label for r in I.components(I.ink_mask(df)).collect()}
        seen = {}
        for start in zip(*np.nonzero(shape)):
            if start in seen:
                continue
            todo, group = [start], set()
            while todo:
                y, x = todo.pop()
                if (y, x) in group or not (0 <= y < shape.shape[0] and 0 <= x < shape.shape[1]) or not shape[y, x]:
                    continue
                group.add((y, x))
                todo += [(y + a, x + b) for a in (-1, 0, 1) for b in (-1, 0, 1)]
            label = min(y * shape.shape[1] + x for y, x in group)
            seen |= {(int(y), int(x)): int(label) for y, x in group}
        assert got == {(int(y), int(x)): v for (y, x), v in seen.items()}


def test_blank_and_written_pages_survive_the_plan(spark):
    blank, written = np.full((40, 30), 255), np.full((44, 32), 225)
    for y in range(6, 40, 5):
        written[y : y + 2, 5:27] = 35
    rows = pixels(spark, blank, written)
    colour = rows.select("page_id", "y", "x", *[rows.v.alias(c) for c in "bgr"])
    out = scan(colour, ScanParams(kernel=9, aspect=None))
    sizes = {r.page_id: (r.canvas_w, r.canvas_h) for r in out.select("page_id", "canvas_w", "canvas_h").distinct().collect()}
    assert set(sizes) == {0, 1}
    ink = out.where("page_id = 1 and v < 100").count()
    assert ink > 100 and out.where("page_id = 0 and v < 200").count() == 0
    bad = out.where("x < 0 or y < 0 or x >= canvas_w or y >= canvas_h").count()
    assert bad == 0


def test_warps(spark, noise):
    from pagewright.operators import warp as W

    image = noise[0]
    df = pixels(spark, image)
    h, w = image.shape
    same = W.remap(df, W.rotation(I.sizes(df).selectExpr("page_id", "w", "h", "0.0 as angle")))
    assert (page(same, 0, image.shape) == image).all()
    level = W.remap(df, W.unbending(spark.createDataFrame([(0, w, y, 0.0) for y in range(h)], "page_id long, w int, y int, slope double")), "lanczos")
    assert (page(level, 0, image.shape) == image).all()
    corners = [[0.0, 0.0], [w - 1.0, 0.0], [w - 1.0, h - 1.0], [0.0, h - 1.0]]
    quad = spark.createDataFrame([(0, w, h, corners)], "page_id long, w int, h int, corners array<array<double>>")
    flat = W.remap(df, W.warping(quad), "cubic", 0)
    assert (page(flat, 0, (h - 1, w - 1))[0, 0], flat.count()) == (image[0, 0], (h - 1) * (w - 1))
    half = W.remap(df, W.resizing(I.sizes(df).selectExpr("page_id", "w", "h", "w * 2 as new_w", "h * 2 as new_h")), "linear", None)
    assert half.count() == 4 * h * w and page(half, 0, (2 * h, 2 * w))[0, 0] == image[0, 0]


def test_corner_smears(spark):
    image = np.full((60, 40), 255)
    image[:4, :4] = 170  # a smear
    image[54:, :6] = 175
    image[56, 2] = 20  # a stroke within
    out = page(I.whiten_corners(pixels(spark, image), step=4, size=3), 0, image.shape)
    assert (out[0, :2] == 252).all() and out[56, 2] == 20 and (out[30] == 255).all()


def test_tilted_pages_are_levelled(spark):
    from pagewright.operators import segments as G
    from pagewright.plans.scan import straighten

    h, w, slope = 150, 170, 0.05
    image = np.full((h, w), 225)
    for start in range(25, 130, 13):
        for x in range(20, 150):
            y = round(start + slope * (x - w / 2))
            image[y : y + 3, x] = 30
    df = pixels(spark, image, np.full((20, 20), 240))
    colour = df.select("page_id", "y", "x", *[df.v.alias(c) for c in "bgr"])
    params = ScanParams(ink_block=15, ruling_run="12", ruling_length="60")

    def tilt(rows):
        segments = G.rulings(I.ruling_segments(I.by_page(rows), params.ink_block, params.ruling_run, params.ruling_length))
        return {r.page_id: r.tilt for r in G.weighted_median_angle(segments).collect()}

    assert abs(tilt(df)[0] - np.degrees(np.arctan(slope))) < 0.2
    level = straighten(colour, params)
    assert abs(tilt(I.gray(level))[0]) < 0.2
    assert level.where("page_id = 1 and v = 240".replace("v", "b")).count() == 400


def test_small_pages_have_rulings_and_content_at_the_edge_survives(spark):
    from pagewright.plans.scan import SMALL, scan

    image = np.full((8, 8), 225)
    image[1, 1:7] = image[4, 1:7] = image[6, 1:7] = 20
    df = pixels(spark, image)
    assert I.ruling_segments(I.by_page(df), SMALL.ink_block, SMALL.ruling_run, SMALL.ruling_length).count() >= 2
    edge = np.full((60, 44), 225)
    for y in range(10, 50, 8):
        edge[y : y + 3, 8:36] = 35
    edge[57:60, 10:34] = 35  # a line of writing that the page's edge cuts
    rows = pixels(spark, edge)
    colour = rows.select("page_id", "y", "x", *[rows.v.alias(c) for c in "bgr"])
    out = scan(colour, ScanParams(kernel=9, aspect=None, margins=(0.2,) * 4))
    inked = {r.y for r in out.where("v < 100").select("y").distinct().collect()}
    # six lines, the last at the edge, stand apart
    assert sum(y - 1 not in inked for y in inked) == 6


def test_a_trapezoid_is_squared(spark):
    from pagewright.operators import warp as W

    sides = spark.createDataFrame([(0, 41, 41, 0.1, -0.1, 10.0, 30.0)], "page_id long, w int, h int, top double, bottom double, y_top double, y_bottom double")
    at = {(r.y, r.x): (r.sy, r.sx) for r in W.squaring(sides).collect()}
    mid = (10 - 2.05 + 10 - 2.05 + 4) / 2
    rows = {y: at[(y, 40)][0] - at[(y, 0)][0] for y in (10, 30)}
    assert abs(rows[10] - 4.0) < 0.3 and abs(rows[30] + 4.0) < 0.3 and abs(mid - 9.95) < 1e-9
