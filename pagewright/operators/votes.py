"""Ruling lines by votes: nearly level lines that may have gaps, cross ink or be dashed or dotted.

Points (one for each column of a stroke, in its middle) vote for all lines through them, by angle and distance from the
origin; a bin that none of its neighbours beats is a line; and along it points are linked over gaps. The same table of
votes exists on pixel rows, as a join with the angles and a count.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Steps of an angle, in a degree, and the largest angle.
FINE, WIDEST = 2, 13
#: How far around a bin others are suppressed: angles, distances.
AROUND = (3, 2)
#: How far from its line a point may be, in pixels.
NEAR = 1.5


def angle_steps(fine: int = FINE, widest: int = WIDEST) -> np.ndarray:
    return np.arange(-fine * widest, fine * widest + 1)


def _runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Starts and ends of the horizontal runs of a mask, as places in rows that are one pixel wider, and that width."""
    flat = np.zeros((mask.shape[0], mask.shape[1] + 1), np.int8)
    flat[:, :-1] = mask
    edge = np.diff(flat.ravel(), prepend=0)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), flat.shape[1]


def _filled(shape: tuple[int, int], start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A mask of these runs, no two of which touch."""
    marks = np.zeros(shape[0] * (shape[1] + 1), np.int8)
    marks[start], marks[end] = 1, -1
    return np.cumsum(marks, dtype=np.int8).reshape(shape[0], shape[1] + 1)[:, :-1] > 0


def opened(mask: np.ndarray, run: int) -> np.ndarray:
    """What of a mask is in horizontal runs of at least so many pixels."""
    start, end, _ = _runs(mask)
    long = end - start >= run
    return _filled(mask.shape, start[long], end[long])


def thin(mask: np.ndarray, most: int) -> np.ndarray:
    """What of a mask is at most so many pixels high."""
    start, end, _ = _runs(mask.T)
    low = end - start <= most
    return _filled(mask.T.shape, start[low], end[low]).T


def closed(mask: np.ndarray, gap: int) -> np.ndarray:
    """The mask with horizontal gaps of fewer pixels filled."""
    start, end, wide = _runs(mask)
    if not len(start):
        return mask.copy()
    apart = (np.diff(start // wide) > 0) | (start[1:] - end[:-1] >= gap)
    return _filled(mask.shape, start[np.append(True, apart)], end[np.append(apart, True)])


def middles(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """y and x of the middle (the upper one of two) of every vertical run of a mask."""
    start, end, tall = _runs(mask.T)
    return (start % tall + end % tall - 1) // 2, start // tall


def _distances(y: np.ndarray, x: np.ndarray, steps: np.ndarray, fine: int) -> np.ndarray:
    """The distance of the line through each point at each angle, in whole pixels."""
    turn = np.radians(steps / fine)[:, None]
    return np.floor(np.round(y * np.cos(turn) - x * np.sin(turn) + 0.5, 9)).astype(np.int64)


def vote_table(y: np.ndarray, x: np.ndarray, fine: int = FINE, widest: int = WIDEST) -> tuple[np.ndarray, int]:
    """Votes by angle step and distance, and the distance of the first column."""
    steps = angle_steps(fine, widest)
    if not len(y):
        return np.zeros((len(steps), 1), np.int64), 0
    rho = _distances(y, x, steps, fine)
    least = int(rho.min())
    wide = int(rho.max()) - least + 1
    places = (rho - least) + np.arange(len(steps))[:, None] * wide
    return np.bincount(places.ravel(), minlength=len(steps) * wide).reshape(len(steps), wide), least


def peaks(table: np.ndarray, votes: int) -> list[tuple[int, int]]:
    """Row and column of the bins with at least so many votes that no neighbour beats: by votes, then by the smaller turn,
    then by the earlier angle and distance. The best come first."""
    rows, columns = np.nonzero(table >= max(1, votes))
    if not len(rows):
        return []
    flat = np.abs(rows - len(table) // 2)
    order = np.lexsort((columns, rows, flat, -table[rows, columns]))
    place = np.full(table.shape, len(order), np.int64)
    place[rows[order], columns[order]] = np.arange(len(order))
    padded = np.pad(place, [(n, n) for n in AROUND], constant_values=len(order))
    best = place
    for axis, n in enumerate(AROUND):
        best = padded if axis == 0 else best
        size = best.shape[axis] - 2 * n
        best = np.minimum.reduce([best.take(range(k, k + size), axis) for k in range(2 * n + 1)])
    kept = np.flatnonzero(best[rows[order], columns[order]] == np.arange(len(order)))
    return [(int(rows[order[k]]), int(columns[order[k]])) for k in kept]


def _pieces(places: np.ndarray, x: np.ndarray, gap: int) -> list[np.ndarray]:
    """Places in the order of x, cut where a gap has more pixels."""
    places = places[np.argsort(x[places], kind="stable")]
    return np.split(places, np.flatnonzero(np.diff(x[places]) > gap) + 1)


def _fit(y: np.ndarray, x: np.ndarray) -> tuple[float, float]:
    """Slope and start of the least-squares line through points."""
    mx, my = x.mean(), y.mean()
    slope = ((x - mx) * (y - my)).sum() / ((x - mx) ** 2).sum()
    return slope, my - slope * mx


def lines(mask: np.ndarray, ink: np.ndarray, length: float, gap: int = 30, votes: int = 80, share: float = 0.3) -> list[tuple[float, float, float, float]]:
    """The ends of lines of a mask: pieces along its peaks that are at least so long, without gaps of more pixels, of
    whose columns at least this share has ink; each by least squares through its points, which are sought again along
    that line (the angles of peaks have steps); a point is in one line only."""
    y, x = middles(mask)
    table, least = vote_table(y, x)
    steps, free, out = angle_steps(), np.ones(len(y), bool), []
    inked = ink | np.roll(ink, 1, 0) | np.roll(ink, -1, 0)
    for row, column in peaks(table, votes):
        turn = np.radians(steps[row] / FINE)
        off = np.abs(y * np.cos(turn) - x * np.sin(turn) - (column + least))
        for piece in _pieces(np.flatnonzero(free & (off <= NEAR)), x, gap):
            if len(piece) < 2 or x[piece[-1]] - x[piece[0]] < max(1, length / 2) or not free[piece].all():
                continue
            for _ in range(3):
                slope, start = _fit(y[piece], x[piece])
                near = _pieces(np.flatnonzero(free & (np.abs(y - slope * x - start) <= NEAR)), x, gap)
                piece = max(near, key=lambda p: len(np.intersect1d(p, piece, assume_unique=True)))
                if len(piece) < 2 or x[piece[-1]] == x[piece[0]]:
                    break
            x0, x1 = float(x[piece[0]]), float(x[piece[-1]])
            if x1 - x0 < max(1, length) or len(np.unique(x[piece[inked[y[piece], x[piece]]]])) < share * (x1 - x0 + 1):
                continue
            slope, start = _fit(y[piece], x[piece])
            out.append((x0, float(slope * x0 + start), x1, float(slope * x1 + start)))
            free[(x >= x0) & (x <= x1) & (np.abs(y - slope * x - start) <= 2 * NEAR)] = False
    return out


def line_votes(points: DataFrame, fine: int = FINE, widest: int = WIDEST) -> DataFrame:
    """page_id, step, rho and votes of every line that has any, from points (page_id, y, x): the angle is step / fine
    degrees. Votes are counted where the points are before they are brought together."""
    steps = F.array(*[F.lit(int(k)) for k in angle_steps(fine, widest)])
    turn = F.radians(F.col("step") / float(fine))
    rho = F.floor(F.round(F.col("y") * F.cos(turn) - F.col("x") * F.sin(turn) + 0.5, 9))
    cast = points.select("page_id", "y", "x", F.explode(steps).alias("step"))
    return cast.groupBy("page_id", "step", rho.alias("rho")).agg(F.count("*").alias("votes"))
