import numpy as np
import pandas as pd
import pytest

from pagewright.operators import rasters as R
from pagewright.operators import template as T
from pagewright.plans import pages as P


def form(seed=0, w=600, h=848):
    """A printed form: boxes, strokes and blots in places of its own."""
    rng = np.random.default_rng(seed)
    g = np.full((h, w), 235, np.float64)
    for _ in range(45):
        y, x, a, b = rng.integers(20, h - 90), rng.integers(20, w - 120), rng.integers(10, 60), rng.integers(15, 90)
        g[y : y + a, x : x + b] = rng.integers(30, 200)
    for _ in range(260):
        y, x = rng.integers(15, h - 40), rng.integers(15, w - 40)
        g[y : y + rng.integers(3, 22), x : x + rng.integers(3, 22)] = rng.integers(20, 220)
    return np.repeat(np.rint(T._smooth(g, 0.8)).astype(np.uint8)[:, :, None], 3, axis=2)


def photo(page, corners, size, seed=1):
    """A page as it looks when its corners are at these places of a picture, with noise and uneven light."""
    h, w = page.shape[:2]
    m = T.projective(np.array(corners, float), np.array([[0, 0], [w - 1, 0], [w - 1, h - 1], [0, h - 1]], float))
    depth = lambda y, x: m[6] * x + m[7] * y + 1
    out = R.remapped(page, lambda y, x: ((m[3] * x + m[4] * y + m[5]) / depth(y, x), (m[0] * x + m[1] * y + m[2]) / depth(y, x)), (size[1], size[0]), beyond=90)
    light = np.linspace(0.85, 1.05, size[0])[None, :, None]
    return np.clip(out * light + np.random.default_rng(seed).normal(0, 3, out.shape), 0, 255).astype(np.uint8)


CORNERS = {1: [(60, 40), (640, 75), (610, 905), (35, 860)], 2: [(130, 90), (560, 50), (600, 700), (90, 740)], 3: [(675, 100), (668, 560), (20, 570), (25, 95)]}


def test_pages_come_back_within_a_pixel(spark):
    """Photographs at an angle, smaller, and turned by a quarter; another page and an error stay as they are."""
    template = form()
    shots = {k: photo(template, c, (700, 950), k) for k, c in CORNERS.items()}
    rows = [(k, s.shape[1], s.shape[0], 3, s.tobytes(), None) for k, s in shots.items()]
    other = form(9)
    rows += [(8, other.shape[1], other.shape[0], 3, other.tobytes(), None), (9, None, None, None, None, "broken"), (10, 40, 30, 3, bytes(3600), None)]
    images = spark.createDataFrame(rows, R.SCHEMA)
    found = {r.page_id: r for r in T.alignment(images, template).collect()}
    assert sorted(found) == [1, 2, 3]
    h, w = template.shape[:2]
    ends = np.array([[0, 0], [w - 1, 0], [w - 1, h - 1], [0, h - 1]], float)
    for k, r in found.items():
        assert r.kind == "quad" and r.numbers[:2] == [600.0, 848.0]
        assert np.abs(T.mapped(np.array(r.numbers[2:]), ends) - np.array(CORNERS[k])).max() < 1.0, k


def test_the_plan_with_a_template(spark):
    template, other = form(), form(9)
    shot = photo(template, CORNERS[1], (700, 950))
    rows = [(1, 700, 950, 3, shot.tobytes(), None), (2, 600, 848, 3, other.tobytes(), None), (3, None, None, None, None, "broken")]
    done = {r.page_id: r for r in P.scan_images(spark.createDataFrame(rows, R.SCHEMA), template=template).collect()}
    assert sorted(done) == [1, 2, 3] and done[3].error == "broken"
    assert all((done[k].width, done[k].height) == (600, 848) for k in (1, 2))
    page = np.frombuffer(done[1].data, np.uint8).reshape(848, 600, 3)
    flat = R.unsharp(R.reference_look(template), 1.9)
    inner = np.s_[40:-40, 80:-40]
    dark = flat[inner][:, :, 0] < 128
    assert ((page[inner][:, :, 0] < 128) == dark).mean() > 0.97 and (page[:, :47] == 255).all()


def test_two_nearest_and_maps_equal_plain_versions(spark):
    rng = np.random.default_rng(3)
    known, own = rng.random((40, 8)), rng.random((300, 8))
    known[7] = known[5]
    own[3] = known[5]
    template = pd.DataFrame({"point": range(40), "x": 1.0, "y": 2.0, "descriptor": list(known)})
    rows = [(k // 30, k % 30, 0.0, 0.0, d.tolist()) for k, d in enumerate(own)] + [(99, 0, 0.0, 0.0, None), (99, 1, 0.0, 0.0, [0.1] * 9), (99, 2, 0.0, 0.0, [0.5])]
    points = spark.createDataFrame(rows, "page_id long, point long, x double, y double, descriptor array<double>")
    found = {(r.page_id, r.point): r for r in T.two_nearest(points, template).collect()}
    assert len(found) == 301
    for k, d in enumerate(own):
        order = np.argsort(((known - d) ** 2).sum(1), kind="stable")
        r = found[k // 30, k % 30]
        assert r.match == order[0] and np.allclose([r.near, r.second], np.sqrt(((known[order[:2]] - d) ** 2).sum(1)))
    assert found[0, 3].match == 5 and found[0, 3].second == 0
    assert T.good(T.two_nearest(points, template)).count() == sum(r.near < 0.7 * r.second for r in found.values())
    assert T.two_nearest(points, template[:1]).count() == 0
    with pytest.raises(ValueError):
        T.template_points(points, 10)
    a = rng.random((60, 2)) * 500
    m = np.array([1.1, 0.05, 3, -0.04, 0.9, 7, 1e-4, -5e-5])
    b = T.mapped(m, a)
    b[:20] += rng.random((20, 2)) * 300 + 30
    got, n = T.agreed(a, b)
    assert n == 40 and np.abs(T.mapped(got, a[20:]) - b[20:]).max() < 1e-6
    assert T.agreed(a[:3], b[:3]) == (None, 0)
    assert T.template_aspect(None) == P.ScanParams().aspect and T.template_aspect(form()) == 600 / 848 and T.template_size(None) is None
