"""Geometry as relations: where each target pixel comes from is a row, its taps are joined and summed.

Targets are rows of page_id, y, x, sy, sx (where the value is taken from, as doubles). The taps of a target and the
pixels share page_id, so the join stays within a page's partition however many pages there are.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.params import CUBIC


def _linear(t: Column) -> list[tuple[int, Column]]:
    return [(0, 1.0 - t), (1, t)]


def _cubic(t: Column) -> list[tuple[int, Column]]:
    near = lambda d: ((CUBIC + 2) * d - (CUBIC + 3)) * d * d + 1
    far = lambda d: ((CUBIC * d - 5 * CUBIC) * d + 8 * CUBIC) * d - 4 * CUBIC
    return [(-1, far(t + 1)), (0, near(t)), (1, near(1.0 - t)), (2, far(2.0 - t))]


def _lanczos(t: Column) -> list[tuple[int, Column]]:
    def weight(d: Column) -> Column:
        a = d * math.pi
        return F.when(F.abs(d) < 1e-9, 1.0).otherwise(F.sin(a) * F.sin(a / 4) * 4 / (a * a))

    raw = [(k, weight(t - k)) for k in range(-3, 5)]
    total = sum((w for _, w in raw[1:]), raw[0][1])
    return [(k, w / total) for k, w in raw]


KERNELS = {"linear": _linear, "cubic": _cubic, "lanczos": _lanczos}


def remap(pixels: DataFrame, targets: DataFrame, kernel: str = "cubic", beyond: int | None = 255, values: tuple[str, ...] = ("v",)) -> DataFrame:
    """page_id, y, x and values of every target: the kernel's taps around its source, rounded half to even (after nine
    decimals, so that the order of summing does not matter). Beyond the page is
    that value, or with None the nearest edge pixel."""
    taps = {}
    for axis in "yx":
        at = F.col(f"s{axis}")
        taps[axis] = F.array(*[F.struct((F.floor(at).cast("int") + k).alias("at"), w.alias("w")) for k, w in KERNELS[kernel](at - F.floor(at))])
    rows = targets.select("page_id", "y", "x", taps["x"].alias("tx"), F.explode(taps["y"]).alias("ty")).select("page_id", "y", "x", "ty", F.explode("tx").alias("tx"))
    rows = rows.select("page_id", "y", "x", F.col("ty.at").alias("py"), F.col("tx.at").alias("px"), (F.col("ty.w") * F.col("tx.w")).alias("w"))
    source = pixels.select("page_id", F.col("y").alias("py"), F.col("x").alias("px"), *values)
    if beyond is None:
        ends = pixels.groupBy("page_id").agg(F.max("x").alias("mx"), F.max("y").alias("my"))
        inside = lambda c, most: F.least(F.greatest(F.col(c), F.lit(0)), F.col(most)).alias(c)
        rows = rows.join(ends, "page_id").select("page_id", "y", "x", inside("py", "my"), inside("px", "mx"), "w")
    value = lambda c: F.coalesce(F.col(c), F.lit(255 if beyond is None else beyond))
    summed = rows.join(source, ["page_id", "py", "px"], "left").groupBy("page_id", "y", "x").agg(*[F.sum(F.col("w") * value(c)).alias(c) for c in values])
    return summed.select("page_id", "y", "x", *[F.least(F.lit(255), F.greatest(F.lit(0), F.bround(F.round(c, 9)).cast("int"))).alias(c) for c in values])


def grid(sizes: DataFrame) -> DataFrame:
    """page_id, w, h, y, x of every pixel of pages of these sizes."""
    return sizes.withColumn("y", F.explode(F.sequence(F.lit(0), F.col("h") - 1))).withColumn("x", F.explode(F.sequence(F.lit(0), F.col("w") - 1)))


def rotation(angles: DataFrame) -> DataFrame:
    """Targets that turn each page (page_id, w, h, angle in degrees, counter-clockwise) about its centre."""
    cx, cy = F.col("w") / 2.0, F.col("h") / 2.0
    c, s = F.cos(F.radians("angle")), F.sin(F.radians("angle"))
    dx, dy = F.col("x") - cx, F.col("y") - cy
    return grid(angles).select("page_id", "y", "x", (cy + s * dx + c * dy).alias("sy"), (cx + c * dx - s * dy).alias("sx"))


def unbending(slopes: DataFrame) -> DataFrame:
    """Targets that level each row (page_id, w, y, slope) about the middle column."""
    rows = slopes.withColumn("x", F.explode(F.sequence(F.lit(0), F.col("w") - 1)))
    return rows.select("page_id", F.col("y").cast("int").alias("y"), "x", (F.col("y") + F.col("slope") * (F.col("x") - F.col("w") / 2.0)).alias("sy"), F.col("x").cast("double").alias("sx"))


def resizing(sizes: DataFrame) -> DataFrame:
    """Targets of new_w x new_h pixels for each page (page_id, w, h, new_w, new_h)."""
    new = grid(sizes.select("page_id", F.col("w").alias("w0"), F.col("h").alias("h0"), F.col("new_w").alias("w"), F.col("new_h").alias("h")))
    at = lambda c, old, now: ((F.col(c) + 0.5) * F.col(old) / F.col(now) - 0.5)
    return new.select("page_id", "y", "x", at("y", "h0", "h").alias("sy"), at("x", "w0", "w").alias("sx"))


def quad_maps(quads: DataFrame) -> DataFrame:
    """page_id and m: the width and height of the rectangle that each page's quadrilateral becomes, and the eight
    coefficients of the map from it back to the page. quads: page_id, w, h, and corners, an array of the x and y of the
    top left, top right, bottom right and bottom left, which is grown by a hundredth first."""

    @F.pandas_udf("array<double>")
    def solved(corners: pd.Series, w: pd.Series, h: pd.Series) -> pd.Series:
        """Width, height and the eight coefficients of the map from the rectangle back to the page."""
        out = []
        for quad, wide, high in zip(corners, w, h, strict=True):
            q = np.array(list(quad), np.float64).reshape(4, 2)
            q = q.mean(0) + (q - q.mean(0)) * 1.01
            q = np.column_stack([q[:, 0].clip(0, wide - 1), q[:, 1].clip(0, high - 1)])
            side = lambda i, j: float(np.linalg.norm(q[i] - q[j]))
            nw, nh = max(1, int(max(side(2, 3), side(1, 0)))), max(1, int(max(side(1, 2), side(0, 3))))
            rect = [(0, 0), (nw - 1, 0), (nw - 1, nh - 1), (0, nh - 1)]
            rows = [r for (x, y), (u, v) in zip(rect, q, strict=True) for r in ([x, y, 1, 0, 0, 0, -x * u, -y * u], [0, 0, 0, x, y, 1, -x * v, -y * v])]
            out.append([nw, nh, *np.linalg.lstsq(np.array(rows, np.float64), q.ravel(), rcond=None)[0].tolist()])
        return pd.Series(out)

    return quads.select("page_id", solved("corners", "w", "h").alias("m"))


def warping(quads: DataFrame) -> DataFrame:
    """Targets that make each page's quadrilateral a rectangle."""
    maps = quad_maps(quads)
    rows = grid(maps.select("page_id", "m", F.col("m")[0].cast("int").alias("w"), F.col("m")[1].cast("int").alias("h")))
    a, x, y = (lambda k: F.col("m")[k + 2]), F.col("x"), F.col("y")
    depth = a(6) * x + a(7) * y + 1.0
    return rows.select("page_id", "y", "x", ((a(3) * x + a(4) * y + a(5)) / depth).alias("sy"), ((a(0) * x + a(1) * y + a(2)) / depth).alias("sx"))


def square_maps(sides: DataFrame) -> DataFrame:
    """page_id, w, h and m, the eight coefficients of the map from the page with its trapezoid squared back to the page.
    sides: page_id, w, h, top and bottom slopes, y_top and y_bottom at mid width."""

    @F.pandas_udf("array<double>")
    def solved(w: pd.Series, h: pd.Series, top: pd.Series, bottom: pd.Series, y_top: pd.Series, y_bottom: pd.Series) -> pd.Series:
        """The eight coefficients of the map from the levelled page back to the page."""
        out = []
        for wide, high, mt, mb, yt, yb in zip(w, h, top, bottom, y_top, y_bottom, strict=True):
            end = wide - 1
            ends = [(y - m * wide / 2, y - m * wide / 2 + m * end) for m, y in ((mt, yt), (mb, yb))]
            (tl, tr), (bl, br) = ends
            yt, yb = np.clip((tl + tr) / 2, 0, high - 1), np.clip((bl + br) / 2, 0, high - 1)
            pairs = [((0, yt), (0, tl)), ((end, yt), (end, tr)), ((end, yb), (end, br)), ((0, yb), (0, bl))]
            rows = [r for (x, y), (u, v) in pairs for r in ([x, y, 1, 0, 0, 0, -x * u, -y * u], [0, 0, 0, x, y, 1, -x * v, -y * v])]
            out.append(np.linalg.lstsq(np.array(rows, np.float64), np.array([q for _, q in pairs], np.float64).ravel(), rcond=None)[0].tolist())
        return pd.Series(out)

    return sides.select("page_id", "w", "h", solved("w", "h", "top", "bottom", "y_top", "y_bottom").alias("m"))


def squaring(sides: DataFrame) -> DataFrame:
    """Targets that make the trapezoid between each page's top and bottom line a rectangle over the page's width."""
    maps = square_maps(sides)
    a, x, y = (lambda k: F.col("m")[k]), F.col("x"), F.col("y")
    depth = a(6) * x + a(7) * y + 1.0
    return grid(maps).select("page_id", "y", "x", ((a(3) * x + a(4) * y + a(5)) / depth).alias("sy"), ((a(0) * x + a(1) * y + a(2)) / depth).alias("sx"))
