import numpy as np
import pytest

from pagewright.operators import rasters as R
from pagewright.operators import votes as V


def test_masks_equal_plain_loops():
    rng = np.random.default_rng(2)
    mask = rng.random((23, 31)) < 0.6

    def runs(row):
        out, x = [], 0
        while x < len(row):
            if row[x]:
                end = x
                while end < len(row) and row[end]:
                    end += 1
                out.append((x, end))
                x = end
            x += 1
        return out

    opened, closed, thin, middles = np.zeros_like(mask), mask.copy(), np.zeros_like(mask), []
    for y, row in enumerate(mask):
        for a, b in runs(row):
            opened[y, a:b] = b - a >= 3
        for (_, b), (c, _) in zip(runs(row), runs(row)[1:]):
            if c - b < 3:
                closed[y, b:c] = True
    for x, column in enumerate(mask.T):
        for a, b in runs(column):
            thin[a:b, x] = b - a <= 2
            middles.append(((a + b - 1) // 2, x))
    assert (V.opened(mask, 3) == opened).all() and (V.closed(mask, 3) == closed).all() and (V.thin(mask, 2) == thin).all()
    assert list(zip(*map(list, V.middles(mask)))) == middles
    nothing = np.zeros((4, 5), bool)
    assert not V.closed(nothing, 3).any() and not V.opened(nothing, 1).any() and V.lines(nothing, nothing, 2) == []
    assert V.opened(~nothing, 5).all() and not V.opened(~nothing, 6).any()


def page(style, slope, width=1737, height=2456, seed=0):
    """Tilted rulings, dashed, dotted, with gaps or crossed by ink, and where they are at the middle of the page."""
    rng = np.random.default_rng(seed)
    g = np.clip(rng.normal(226, 3, (height, width)), 0, 255).astype(np.uint8)
    x = np.arange(120, width - 120)
    on = {"solid": x >= 0, "gaps": x % 120 >= 24, "dashed": x % 40 < 22, "dotted": x % 14 < 6, "crossed": x >= 0}[style]
    starts = list(range(400, height - 300, 150))
    for start in starts:
        for k in range(4):
            g[np.round(start + slope * (x - width / 2)).astype(int)[on] + k, x[on]] = 70
        if style == "crossed":
            for left in range(150, width - 160, 45):
                g[start - 25 : start + 28, left : left + 6] = 30
    return np.repeat(g[:, :, None], 3, axis=2), starts


@pytest.mark.parametrize("style", ["solid", "gaps", "dashed", "dotted", "crossed"])
@pytest.mark.parametrize("slope", [0.0, 0.021, -0.06])
def test_rulings_are_found_with_gaps_dashes_dots_and_crossings(style, slope):
    image, starts = page(style, slope)
    found = R.strokes(image)
    for start in starts:
        own = [(x1, y1, x2, y2) for _, x1, y1, x2, y2, _, _ in found if abs((y1 + y2) / 2 + slope * (1737 / 2 - (x1 + x2) / 2) - start - 1.5) < 6]
        assert sum(x2 - x1 for x1, _, x2, _ in own) > 0.6 * 1497, (start, own)
        assert all(abs((y2 - y1) / (x2 - x1) - slope) < 0.008 for x1, y1, x2, y2 in own)
        assert abs(sum(y2 - y1 for _, y1, _, y2 in own) / sum(x2 - x1 for x1, _, x2, _ in own) - slope) < 0.004
    assert len(found) < 3 * len(starts)


def test_pages_without_rulings_have_none():
    rng = np.random.default_rng(5)
    blank = np.clip(rng.normal(226, 3, (900, 700, 3)), 0, 255).astype(np.uint8)
    assert R.strokes(blank) == []
    for y, x in zip(rng.integers(50, 850, 400), rng.integers(50, 640, 400)):
        blank[y : y + 14, x : x + 4] = 30  # upright strokes
    assert R.strokes(blank) == []


def test_peaks_beat_their_neighbours():
    table = np.zeros((9, 20), int)
    table[4, 5] = table[4, 6] = 7
    table[6, 6], table[1, 15], table[8, 15] = 9, 7, 7
    assert V.peaks(table, 5) == [(6, 6), (1, 15), (8, 15)] and V.peaks(table, 10) == []
