"""Operators on pixels: rows of page_id, y, x and v (gray, 0 to 255), or b, g, r.

All rows of a page share page_id, so one shuffle by page_id (by_page) serves every window and group below.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright import params as P
from pagewright.functions.tones import flattened, luminance, reference_tones, saturated

#: Pixels in one batch of those that an image becomes.
ROWS = 100_000


def by_page(pixels: DataFrame) -> DataFrame:
    """Pixels dealt out so that those of a page are together."""
    return pixels.repartition("page_id")


def from_vectors(vectors: DataFrame, width: int = 8) -> DataFrame:
    """Each vector as a gray page of this width: middle gray 128, 240 steps a unit."""
    rows = vectors.select(F.col("vec_id").alias("page_id"), F.posexplode("embedding").alias("at", "value"))
    v = F.least(F.lit(255), F.greatest(F.lit(0), F.floor(F.col("value").cast("double") * 240 + 128).cast("int")))
    return rows.select("page_id", F.floor(F.col("at") / width).cast("int").alias("y"), (F.col("at") % width).alias("x"), v.alias("v"))


def colour_from_vectors(vectors: DataFrame, width: int = 8) -> DataFrame:
    """Three consecutive vectors as the blue, green and red of a page; incomplete triples are left out."""
    rows = from_vectors(vectors, width).withColumn("channel", F.col("page_id") % 3).withColumn("page_id", F.floor(F.col("page_id") / 3))
    channels = [F.max(F.when(F.col("channel") == k, F.col("v"))).alias(c) for k, c in enumerate("bgr")]
    return rows.groupBy("page_id", "y", "x").agg(*channels).where("b is not null and g is not null and r is not null")


def from_images(images: DataFrame, page_id: str = "page_id") -> DataFrame:
    """Rows of Spark's image source (a struct `image`, BGR) as colour pixels; what is gray has its value three times."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                page, w, n = (batch.column(c)[k].as_py() for c in ("page_id", "w", "n"))
                values = np.frombuffer(batch.column("data")[k].as_buffer(), np.uint8).reshape(-1, n)
                for top in range(0, len(values), ROWS):
                    part = values[top : top + ROWS].astype(np.int32)
                    y, x = np.divmod(np.arange(top, top + len(part), dtype=np.int32), np.int32(w))
                    channels = [part[:, c if n >= 3 else 0] for c in range(3)]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), page, np.int64)), *map(pa.array, (y, x, *channels))], ["page_id", "y", "x", "b", "g", "r"])

    image = F.col("image")
    rows = images.select(F.col(page_id).cast("long").alias("page_id"), image["width"].alias("w"), image["nChannels"].alias("n"), image["data"].alias("data"))
    return rows.where("data is not null").mapInArrow(run, "page_id long, y int, x int, b int, g int, r int")


def gray(pixels: DataFrame) -> DataFrame:
    return pixels.select("page_id", "y", "x", F.bround(luminance(F.col("b"), F.col("g"), F.col("r"))).cast("int").alias("v"))


def sizes(pixels: DataFrame) -> DataFrame:
    return pixels.groupBy("page_id").agg((F.max("x") + 1).alias("w"), (F.max("y") + 1).alias("h"))


def _sized(pixels: DataFrame) -> DataFrame:
    page = Window.partitionBy("page_id")
    return pixels.withColumn("w", F.max("x").over(page) + 1).withColumn("h", F.max("y").over(page) + 1)


def _mirrored(at: str, n: str, r: int) -> Column:
    """Where index `at` of n shows up between -r and n - 1 + r when the line is mirrored about its end pixels."""
    period = f"greatest(1, 2 * ({n} - 1))"
    first = "cast({s} - {p} * floor(({s} + {r}) / {p}) as int)"
    spots = [f"if({start} <= {n} - 1 + {r}, sequence({start}, greatest({start}, {n} - 1 + {r}), {period}), array())" for start in (first.format(s=s, p=period, r=r) for s in (at, f"(-{at})"))]
    return F.expr(f"filter(array_distinct(concat({', '.join(spots)})), p -> p between -{r} and {n} - 1 + {r})")


def box_sums(pixels: DataFrame, k: int, values: dict[str, str]) -> DataFrame:
    """pixels with new columns (name: value) that hold the sums of a k x k box around each, mirrored at the borders. Two
    sliding windows for all values together, whatever k is."""
    r = k // 2
    rows = _sized(pixels)
    for axis, n, other in (("x", "w", "y"), ("y", "h", "x")):
        span = Window.partitionBy("page_id", other).orderBy("_at").rangeBetween(-r, r)
        sums = {name: F.sum(value if axis == "x" else name).over(span) for name, value in values.items()}
        rows = rows.select("*", F.explode(_mirrored(axis, n, r)).alias("_at")).withColumns(sums).where(F.col("_at") == F.col(axis)).drop("_at")
    return rows.drop("w", "h")


def box_mean(pixels: DataFrame, k: int = P.FLATTEN_KERNEL, value: str = "v", name: str = "mean") -> DataFrame:
    """The rounded mean of the box (half to even)."""
    return box_sums(pixels, k, {name: value}).withColumn(name, F.bround(F.col(name) / (k * k)).cast("int"))


def gaussian(size: int, sigma: float | None = None) -> list[float]:
    """The weights of a Gaussian of that many taps; without a sigma that which goes with the size."""
    sigma = sigma or 0.3 * ((size - 1) * 0.5 - 1) + 0.8
    raw = [math.exp(-((k - size // 2) ** 2) / (2 * sigma * sigma)) for k in range(size)]
    return [x / sum(raw) for x in raw]


def convolved(pixels: DataFrame, kernel: list[float], value: str = "v", name: str = "blur") -> DataFrame:
    """pixels with a symmetric separable kernel applied, mirrored at the borders; a double."""
    r = len(kernel) // 2
    rows = _sized(pixels)
    for axis, n, other in (("x", "w", "y"), ("y", "h", "x")):
        source = F.col(value if axis == "x" else name).cast("double")
        line = Window.partitionBy("page_id", other).orderBy("_at")
        rows = rows.select("*", F.explode(_mirrored(axis, n, r)).alias("_at"))
        total = source * kernel[r]
        for k in range(1, r + 1):
            total = total + (F.lag(source, k).over(line) + F.lead(source, k).over(line)) * kernel[r + k]
        rows = rows.withColumn(name, total).where(F.col("_at") == F.col(axis)).drop("_at")
    return rows.drop("w", "h")


def unsharp(pixels: DataFrame, sigma: float = 0.8, size: int = 7, amount: float = 1.3) -> DataFrame:
    """pixels away from their blur: amount of the pixel less the rest of the rounded blur."""
    rows = convolved(pixels, gaussian(size, sigma)).withColumn("blur", F.bround("blur"))
    return rows.select("page_id", "y", "x", F.least(F.lit(255), F.greatest(F.lit(0), F.bround(F.col("v") * amount + F.col("blur") * (1.0 - amount)).cast("int"))).alias("v"))


def adaptive_ink(pixels: DataFrame, block: int = 21, below: int = 7) -> DataFrame:
    """Pixels darker than their surroundings' weighted mean by so much: page_id, y, x."""
    return convolved(pixels, gaussian(block)).where(F.col("v") <= F.bround("blur") - below).select("page_id", "y", "x")


def high_pass(pixels: DataFrame, k: int = P.FLATTEN_KERNEL) -> DataFrame:
    return box_mean(pixels, k).select("page_id", "y", "x", F.floor(flattened(F.col("v"), F.col("mean"))).cast("int").alias("v"))


def reference_look(pixels: DataFrame, k: int = P.FLATTEN_KERNEL, saturation: float = P.SATURATION) -> DataFrame:
    """Colour pixels flattened, saturated and stretched; one truncation at the end."""
    rows = box_sums(pixels, k, {f"sum_{c}": c for c in "bgr"})
    rows = rows.withColumns({c: flattened(F.col(c), F.bround(F.col(f"sum_{c}") / (k * k))) for c in "bgr"})
    b, g, r = (F.col(c) for c in "bgr")
    return rows.select("page_id", "y", "x", *[reference_tones(saturated(F.col(c), b, g, r, saturation)).alias(c) for c in "bgr"])


def _beside(column: Column, line: Window, forward: bool) -> Column:
    """The next (or last) value along a line, mirrored at its end."""
    first, second = (F.lead, F.lag) if forward else (F.lag, F.lead)
    return F.coalesce(first(column).over(line), second(column).over(line), column)


def laplacian(pixels: DataFrame) -> DataFrame:
    """pixels with lap, the sum of the four neighbours less four times the pixel."""
    row, column = Window.partitionBy("page_id", "y").orderBy("x"), Window.partitionBy("page_id", "x").orderBy("y")
    v = F.col("v")
    return pixels.withColumn("lap", sum(_beside(v, line, forward) for line in (row, column) for forward in (True, False)) - 4 * v)


def sharpness(pixels: DataFrame) -> DataFrame:
    """The population variance of the Laplacian of each page."""
    return laplacian(pixels).groupBy("page_id").agg(F.var_pop("lap").alias("sharpness"))


def sobel_x(pixels: DataFrame) -> DataFrame:
    row, column = Window.partitionBy("page_id", "y").orderBy("x"), Window.partitionBy("page_id", "x").orderBy("y")
    slope = pixels.withColumn("d", _beside(F.col("v"), row, True) - _beside(F.col("v"), row, False))
    return slope.withColumn("grad", _beside(F.col("d"), column, True) + 2 * F.col("d") + _beside(F.col("d"), column, False)).drop("d")


def row_energy(pixels: DataFrame) -> DataFrame:
    return sobel_x(pixels).groupBy("page_id", "y").agg(F.avg(F.abs("grad")).alias("energy"))


def smeared_top(pixels: DataFrame, within: float = 0.10, share: float = 0.50) -> DataFrame:
    """page_id and cut, the rows at the top whose energy is below a share of the median row's."""
    rows = row_energy(pixels)
    base = rows.groupBy("page_id").agg(F.median("energy").alias("base"), (F.max("y") + 1).alias("h"))
    first = rows.join(base, "page_id").groupBy("page_id", "base", "h").agg(F.min(F.when(F.col("energy") >= share * F.col("base"), F.col("y"))).alias("first"))
    return first.select("page_id", F.when(F.col("base") > 0, F.least(F.coalesce("first", "h"), F.floor(F.col("h") * within).cast("int"))).otherwise(0).cast("int").alias("cut"))


def white_bands(pixels: DataFrame, ink: int = P.WHITE_FILL, within: float | tuple[float, float, float, float] = 0.08) -> DataFrame:
    """page_id and the box x0, y0, x1, y1 left when lines without ink go from each side; the whole page if that took half.
    within is the share that may go from every side, or from the left, right, top and bottom."""
    left, right, top, bottom = within if isinstance(within, tuple) else (within,) * 4

    def ends(axis: str, n: str) -> DataFrame:
        lines = pixels.groupBy("page_id", axis).agg(F.min("v").alias("least"))
        has = F.when(F.col("least") <= ink, F.col(axis))
        return lines.groupBy("page_id").agg((F.max(axis) + 1).alias(n), F.min(has).alias(f"first_{axis}"), F.max(has).alias(f"last_{axis}"))

    both = ends("x", "w").join(ends("y", "h"), "page_id")
    box = {}
    for axis, n, low, high in (("x", "w", left, right), ("y", "h", top, bottom)):
        cap = lambda share, n=n: F.floor(F.col(n) * share).cast("int")
        box[f"{axis}0"] = F.least(F.coalesce(f"first_{axis}", n), cap(low) + 1)
        box[f"{axis}1"] = F.greatest(F.coalesce(F.col(f"last_{axis}") + 1, F.lit(0)), F.col(n) - cap(high))
    both = both.withColumns(box)
    half = lambda n: F.greatest(F.lit(1), F.floor(F.col(n) / 2))
    whole = (F.col("x1") - F.col("x0") < half("w")) | (F.col("y1") - F.col("y0") < half("h"))
    return both.select("page_id", *[F.when(whole, w).otherwise(F.col(c)).cast("int").alias(c) for c, w in (("x0", F.lit(0)), ("y0", F.lit(0)), ("x1", F.col("w")), ("y1", F.col("h")))])


def edge_darkness(pixels: DataFrame, dark: int = P.DARK, smooth: int = 15, window: float = 0.25) -> DataFrame:
    """page_id, x, darkness: the darkest share of a column over half-overlapping row windows, smoothed over columns
    with nothing beyond the page."""
    rows = _sized(pixels).withColumn("win", F.greatest(F.lit(1), F.floor(F.col("h") * window).cast("int")))
    rows = rows.withColumn("step", F.greatest(F.lit(1), F.floor(F.col("win") / 2).cast("int")))
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.col("h") - F.col("win")), F.col("step"))
    rows = rows.select("page_id", "x", "y", "v", "win", F.explode(starts).alias("y0")).where("y >= y0 and y < y0 + win")
    share = rows.groupBy("page_id", "x", "y0").agg(F.avg((F.col("v") < dark).cast("int")).alias("share"))
    top = share.groupBy("page_id", "x").agg(F.max("share").alias("share"))
    near = Window.partitionBy("page_id").orderBy("x").rangeBetween(-(smooth // 2), smooth // 2)
    return top.select("page_id", "x", (F.sum("share").over(near) / smooth).alias("darkness"))


def dark_left(pixels: DataFrame, most: float = 0.25, within: float = 0.06, smooth: int = 15) -> DataFrame:
    """page_id and cut, the dark columns at the left; none on clean pages or where half the page would go."""
    clean = pixels.groupBy("page_id").agg(F.avg("v").alias("mean"), (F.max("x") + 1).alias("w"))
    first = edge_darkness(pixels, smooth=smooth).groupBy("page_id").agg(F.min(F.when(F.col("darkness") <= most, F.col("x"))).alias("first"))
    cut = F.least(F.coalesce("first", "w"), F.floor(F.col("w") * within).cast("int") + 1)
    keep = (F.col("mean") > P.CLEAN) | (F.col("w") - cut < F.greatest(F.lit(1), F.floor(F.col("w") / 2)))
    return clean.join(first, "page_id").select("page_id", F.when(keep, 0).otherwise(cut).cast("int").alias("cut"))


def page_stats(pixels: DataFrame) -> DataFrame:
    """Gray statistics of each page."""
    v = F.col("v")
    share = lambda bound: 100.0 * F.avg((v < bound).cast("int"))
    return pixels.groupBy("page_id").agg(F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.avg(F.when(v < P.FAINT, v)).alias("ink_mean"), share(90).alias("below_90"), share(128).alias("below_128"))


def chroma(pixels: DataFrame) -> DataFrame:
    """The 99th percentile of how far the channels of a pixel are apart."""
    apart = F.abs(F.col("r") - F.col("b")) + F.abs(F.col("g") - F.col("b")) + F.abs(F.col("r") - F.col("g"))
    return pixels.groupBy("page_id").agg(F.percentile(apart, 0.99).alias("chroma"))


def auto_black_point(pixels: DataFrame, share: float = 0.08) -> DataFrame:
    return pixels.groupBy("page_id").agg(F.least(F.lit(120.0), F.greatest(F.lit(10.0), F.percentile("v", share))).alias("black"))


def shared_region(a: DataFrame, b: DataFrame, ink: int = P.SHARED_INK, grown: int = 2, pad: int = 5, least: int = 100) -> DataFrame:
    """page_id, y, x, v, v2 of the part of two pages around what is ink in either: the box of the ink grown by some
    pixels and padded by some more, within the page; moved to its corner. Pages with that little ink or less are left
    out."""
    both = a.join(b.withColumnRenamed("v", "v2"), ["page_id", "y", "x"]).select("page_id", "y", "x", "v", "v2")
    inked = (F.col("v") < ink) | (F.col("v2") < ink)
    spot = lambda of, c: of(F.when(inked, F.col(c))).alias(f"{of.__name__}_{c}")
    found = both.groupBy("page_id").agg(F.count(F.when(inked, 1)).alias("n"), spot(F.min, "y"), spot(F.max, "y"), spot(F.min, "x"), spot(F.max, "x"), F.max("y").alias("h"), F.max("x").alias("w"))
    out = {}
    for c, most in (("y", "h"), ("x", "w")):
        out[f"{c}0"] = F.greatest(F.lit(0), F.greatest(F.lit(0), F.col(f"min_{c}") - grown) - pad)
        out[f"{c}1"] = F.least(F.col(most) + 1, F.least(F.col(most), F.col(f"max_{c}") + grown) + pad + 1)
    return crop(both, found.where(F.col("n") > least).withColumns(out).select("page_id", *out))


def difference(a: DataFrame, b: DataFrame, **region) -> DataFrame:
    """page_id, mad and psnr: mean absolute difference and peak signal-to-noise ratio of two pages around their ink."""
    both = shared_region(a, b, **region)
    gap = F.col("v") - F.col("v2")
    mse = F.greatest(F.avg(gap * gap), F.lit(1e-9))
    return both.groupBy("page_id").agg(F.avg(F.abs(gap)).alias("mad"), (10 * F.log10(F.lit(65025.0) / mse)).alias("psnr"))


def structure_likeness(a: DataFrame, b: DataFrame, size: int = 11, sigma: float = 1.5, **region) -> DataFrame:
    """SSIM with Gaussian weights, averaged over the part of two pages around their ink."""
    both = shared_region(a, b, **region)
    both = both.withColumns({"aa": F.col("v") * F.col("v"), "bb": F.col("v2") * F.col("v2"), "ab": F.col("v") * F.col("v2")})
    for c in ("v", "v2", "aa", "bb", "ab"):
        both = convolved(both, gaussian(size, sigma), c, f"m_{c}")
    ma, mb, aa, bb, ab = (F.col(f"m_{c}") for c in ("v", "v2", "aa", "bb", "ab"))
    c1, c2 = (0.01 * 255) ** 2, (0.03 * 255) ** 2
    one = (2 * ma * mb + c1) * (2 * (ab - ma * mb) + c2) / ((ma * ma + mb * mb + c1) * ((aa - ma * ma) + (bb - mb * mb) + c2))
    return both.groupBy("page_id").agg(F.avg(one).alias("ssim"))


def normal_ink_box(pixels: DataFrame, ink: int = P.DARK) -> DataFrame:
    """page_id, top, bottom, left, right: the first and last rows and columns with ink, as shares of the page."""
    inked = F.col("v") < ink
    size = pixels.groupBy("page_id").agg((F.max("y") + 1).alias("h"), (F.max("x") + 1).alias("w"), *[of(F.when(inked, F.col(c))).alias(f"{of.__name__}_{c}") for c in "yx" for of in (F.min, F.max)])
    return size.where("min_y is not null").select("page_id", (F.col("min_y") / F.col("h")).alias("top"), (F.col("max_y") / F.col("h")).alias("bottom"), (F.col("min_x") / F.col("w")).alias("left"), (F.col("max_x") / F.col("w")).alias("right"))


def components(mask: DataFrame) -> DataFrame:
    """Mask pixels (page_id, y, x) with label, the least y * w + x of those joined to it in eight directions. A task
    sees one page at a time."""

    def label(page: pa.Table) -> pa.Table:
        ys, xs = page["y"].to_numpy(), page["x"].to_numpy()
        h, w = int(ys.max()) + 1, page["width"][0].as_py()
        none = h * w
        grid = np.full((h + 2, w + 2), none, np.int64)
        grid[ys + 1, xs + 1] = ys.astype(np.int64) * w + xs
        on = grid < none
        while True:
            rows = np.minimum(np.minimum(grid[:-2], grid[1:-1]), grid[2:])
            best = grid.copy()
            best[1:-1, 1:-1] = np.minimum(np.minimum(rows[:, :-2], rows[:, 1:-1]), rows[:, 2:])
            best[~on] = none
            flat = np.append(best[1:-1, 1:-1].ravel(), none)
            best[1:-1, 1:-1] = flat[best[1:-1, 1:-1]]  # jump to the label of the label
            if (best == grid).all():
                break
            grid = best
        return pa.table({"page_id": page["page_id"], "y": page["y"], "x": page["x"], "label": pa.array(grid[ys + 1, xs + 1])})

    rows = mask.select(F.col("page_id").cast("long").alias("page_id"), "y", "x", "width")
    return rows.groupBy("page_id").applyInArrow(label, "page_id long, y int, x int, label long")


def ink_mask(pixels: DataFrame, ink: int = P.INK) -> DataFrame:
    """The pixels darker than ink, with the page's width and height."""
    return _sized(pixels).where(F.col("v") < ink).select("page_id", "y", "x", F.col("w").alias("width"), F.col("h").alias("height"))


def component_stats(labelled: DataFrame) -> DataFrame:
    return labelled.groupBy("page_id", "label").agg(F.min("x").alias("x"), F.min("y").alias("y"), (F.max("x") - F.min("x") + 1).alias("w"), (F.max("y") - F.min("y") + 1).alias("h"), F.count("*").alias("area"))


def ink_box(pixels: DataFrame, ink: int = P.INK, noise: int = 15) -> DataFrame:
    """The box around components of at least `noise` pixels, or around all ink where there are none."""
    labelled = components(ink_mask(pixels, ink))
    big = F.count("*").over(Window.partitionBy("page_id", "label")) >= noise
    some = labelled.withColumn("big", big.cast("int")).withColumn("any", F.max("big").over(Window.partitionBy("page_id"))).where("big = any")
    return some.groupBy("page_id").agg(F.min("x").alias("x0"), F.min("y").alias("y0"), (F.max("x") + 1).alias("x1"), (F.max("y") + 1).alias("y1"))


def whiten_border(pixels: DataFrame, ink: int = P.INK, depth: float = 0.12, white: int = 252) -> DataFrame:
    """pixels with ink components painted white that touch the border and do not reach deep into the page."""
    mask = ink_mask(pixels, ink + 1)
    labelled = components(mask)
    stats = component_stats(labelled).join(mask.groupBy("page_id").agg(F.max("width").alias("pw"), F.max("height").alias("ph")), "page_id")
    x, y, right, below = F.col("x"), F.col("y"), F.col("x") + F.col("w"), F.col("y") + F.col("h")
    zero = F.lit(0)
    reach = F.greatest(F.when(x <= 1, right).otherwise(zero), F.when(right >= F.col("pw") - 2, F.col("pw") - x).otherwise(zero), F.when(y <= 1, below).otherwise(zero), F.when(below >= F.col("ph") - 2, F.col("ph") - y).otherwise(zero))
    specks = stats.where((reach > 0) & (reach < F.greatest(F.col("pw") * depth, F.col("ph") * depth))).select("page_id", "label")
    gone = labelled.join(specks, ["page_id", "label"]).select("page_id", "y", "x", F.lit(True).alias("gone"))
    return pixels.join(gone, ["page_id", "y", "x"], "left").select("page_id", "y", "x", F.when(F.col("gone"), white).otherwise(F.col("v")).alias("v"))


def horizontal_runs(mask: DataFrame, least: str) -> DataFrame:
    """Mask pixels (page_id, y, x, width) that stand in horizontal runs of at least so many, an expression of width."""
    island = F.col("x") - F.row_number().over(Window.partitionBy("page_id", "y").orderBy("x"))
    rows = mask.withColumn("_run", island)
    return rows.withColumn("_n", F.count("*").over(Window.partitionBy("page_id", "y", "_run"))).where(F.col("_n") >= F.expr(least)).drop("_run", "_n")


def ruling_segments(pixels: DataFrame, block: int = 21, run: str = "greatest(30, floor(width / 12))", length: str = "greatest(100, floor(w / 4))") -> DataFrame:
    """page_id, seg_id, x1, y1, x2, y2, w, h: the long, nearly level strokes of each page. A stroke is a component of the
    ink's horizontal runs, and its segment the least-squares line through its pixels."""
    size = sizes(pixels)
    mask = adaptive_ink(pixels, block).join(size.select("page_id", F.col("w").alias("width")), "page_id")
    strokes = components(horizontal_runs(mask, run)).groupBy("page_id", F.col("label").alias("seg_id"))
    x, y = F.col("x").cast("double"), F.col("y").cast("double")
    fits = strokes.agg(F.min(x).alias("x1"), F.max(x).alias("x2"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("start")).join(size, "page_id")
    ends = {k: F.col("slope") * F.col(f"x{k[1]}") + F.col("start") for k in ("y1", "y2")}
    return fits.where(F.col("x2") - F.col("x1") >= F.expr(length)).withColumns(ends).select("page_id", "seg_id", "x1", "y1", "x2", "y2", F.col("w").cast("double").alias("w"), F.col("h").cast("double").alias("h"))


def whiten_corners(pixels: DataFrame, bright: int = 150, step: int = 18, most: float = 0.06, size: int = 9, white: int = 252) -> DataFrame:
    """pixels with smears painted white: what a flood from a bright corner reaches over steps of the blurred page, if it
    is a small part of the page without strokes."""

    def flood(page: pd.DataFrame) -> pd.DataFrame:
        h, w = int(page["y"].max()) + 1, int(page["x"].max()) + 1
        blur, v = np.zeros((h, w)), np.zeros((h, w))
        blur[page["y"], page["x"]], v[page["y"], page["x"]] = page["blur"], page["v"]
        down, right = np.abs(np.diff(blur, axis=0)) <= step, np.abs(np.diff(blur, axis=1)) <= step
        gone = np.zeros((h, w), bool)
        for y, x in ((0, 0), (0, w - 1), (h - 1, 0), (h - 1, w - 1)):
            if blur[y, x] < bright:
                continue
            seen, before = np.zeros((h, w), bool), 0
            seen[y, x] = True
            while seen.sum() > before:
                before = seen.sum()
                for k in range(1, h):
                    seen[k] |= seen[k - 1] & down[k - 1]
                for k in range(h - 1, 0, -1):
                    seen[k - 1] |= seen[k] & down[k - 1]
                for k in range(1, w):
                    seen[:, k] |= seen[:, k - 1] & right[:, k - 1]
                for k in range(w - 1, 0, -1):
                    seen[:, k - 1] |= seen[:, k] & right[:, k - 1]
            if 0.0005 < seen.mean() < most and not (v[seen] < P.INK).any():
                gone |= seen
        return page.assign(v=np.where(gone[page["y"], page["x"]], white, page["v"]))[["page_id", "y", "x", "v"]]

    blurred = convolved(pixels, gaussian(size)).withColumn("blur", F.bround("blur"))
    return blurred.select("page_id", "y", "x", "v", "blur").groupBy("page_id").applyInPandas(flood, "page_id long, y int, x int, v int")


def crop(pixels: DataFrame, boxes: DataFrame) -> DataFrame:
    """pixels inside their page's box x0, y0, x1, y1, moved to its corner."""
    inside = pixels.join(boxes, "page_id").where("x >= x0 and x < x1 and y >= y0 and y < y1")
    return inside.withColumns({"x": F.col("x") - F.col("x0"), "y": F.col("y") - F.col("y0")}).drop("x0", "y0", "x1", "y1")


def mask_union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("page_id", "y", "x").union(b.select("page_id", "y", "x")).distinct()


def mask_except(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("page_id", "y", "x").join(b.select("page_id", "y", "x"), ["page_id", "y", "x"], "left_anti")
