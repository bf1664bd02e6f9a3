"""The page plan: colour pixels in, clean and reframed gray-white pages out, all as DataFrame operators.

One shuffle by page_id serves every window and group of a page; only the components of the clean-up see a whole page in
a task, and a page is bounded by the pixel budget.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.functions import scalars as S
from pagewright.operators import images as I
from pagewright.operators import segments as G
from pagewright.operators import warp as W
from pagewright.params import ScanParams
from pagewright.session import durable

#: For pages of a few pixels, such as the tests use.
SMALL = ScanParams(kernel=5, ink=100, margins=(0.1, 0.1, 0.1, 0.1), aspect=None, border_depth=0.5, noise_area=2, ink_block=5, ruling_run="3", ruling_length="3")


def boxes(pixels: DataFrame) -> DataFrame:
    """The box of each gray page that the trims leave: dark left columns, lines without ink, a smeared top."""
    left = I.dark_left(pixels).withColumnRenamed("cut", "left")
    top = I.smeared_top(pixels).withColumnRenamed("cut", "top")
    box = I.white_bands(pixels).join(left, "page_id").join(top, "page_id")
    return box.select("page_id", F.greatest("x0", "left").alias("x0"), F.greatest("y0", "top").alias("y0"), "x1", "y1")


def _rulings(gray: DataFrame, params: ScanParams) -> DataFrame:
    return durable(G.rulings(I.ruling_segments(I.by_page(gray), params.ink_block, params.ruling_run, params.ruling_length)))


def _bent(segments: DataFrame, size: DataFrame) -> DataFrame:
    """Targets that level the rows of the pages with evidence in enough bands."""
    evident = size.join(segments.select("page_id").distinct(), "page_id")
    rows = evident.select("page_id", F.explode(F.sequence(F.lit(0), F.col("h") - 1)).alias("y"))
    return W.unbending(G.row_slopes(segments, rows).join(size.select("page_id", "w"), "page_id"))


def straighten(pixels: DataFrame, params: ScanParams = ScanParams()) -> DataFrame:
    """Colour pages levelled by their rulings: row by row where enough bands have evidence, else by making the trapezoid
    of the top and bottom rulings a rectangle, else by one turn; pages without evidence stay as they are, and so do
    those that one turn would move too little or too much to trust."""
    gray = I.by_page(I.gray(pixels))
    segments = _rulings(gray, params)
    size = durable(I.sizes(gray))
    bent = durable(_bent(segments, size))
    left = size.join(bent.select("page_id").distinct(), "page_id", "left_anti")
    squared = durable(W.squaring(left.join(G.keystone(segments), "page_id")))
    left = left.join(squared.select("page_id").distinct(), "page_id", "left_anti")
    turned = left.join(G.skew(segments).where("angle <> 0"), "page_id")
    targets = durable(bent.unionByName(squared).unionByName(W.rotation(turned)))
    moved = W.remap(pixels, targets, values=("b", "g", "r"))
    return moved.unionByName(pixels.select("page_id", "y", "x", "b", "g", "r").join(targets.select("page_id").distinct(), "page_id", "left_anti"))


def settle(pixels: DataFrame, params: ScanParams = ScanParams(), tolerance: float = 0.25) -> DataFrame:
    """Gray pages whose rulings still tilt, levelled by one turn or row by row, whichever leaves less tilt, if either does."""
    pixels = pixels.select("page_id", "y", "x", "v")
    segments = _rulings(pixels, params)
    tilts = durable(G.weighted_median_angle(segments).where(F.abs("tilt") > tolerance))
    segments, size = segments.join(tilts, "page_id", "left_semi"), I.sizes(pixels).join(tilts, "page_id")
    turned = size.join(G.skew(segments).where("angle <> 0"), "page_id")
    ways = [durable(W.remap(pixels, targets)) for targets in (W.rotation(turned), _bent(segments, size))]
    tried = None
    for k, way in enumerate(ways):
        tilt = way.select("page_id").distinct().join(G.weighted_median_angle(_rulings(way, params)), "page_id", "left")
        rows = tilt.select("page_id", F.abs(F.coalesce("tilt", F.lit(0.0))).alias("rest"), F.lit(k).alias("way"))
        tried = rows if tried is None else tried.unionByName(rows)
    better = tried.join(tilts, "page_id").where(F.col("rest") < F.abs("tilt"))
    best = durable(better.groupBy("page_id").agg(F.min(F.struct("rest", "way")).alias("b")).select("page_id", F.col("b.way").alias("way")))
    out = pixels.join(best, "page_id", "left_anti")
    for k, way in enumerate(ways):
        out = out.unionByName(way.join(best.where(F.col("way") == k), "page_id", "left_semi"))
    return out


def enhance(pixels: DataFrame, params: ScanParams = ScanParams()) -> DataFrame:
    return I.reference_look(pixels, params.kernel, params.saturation)


def reframe(pixels: DataFrame, params: ScanParams = ScanParams()) -> DataFrame:
    """Gray pages with their ink box on a white canvas: page_id, canvas_w, canvas_h and the content's pixels moved to
    their place, made smaller with the canvas where that has more pixels than the budget. Pages without ink stay as they
    are."""
    box = I.ink_box(pixels, params.ink, params.noise_area)
    size = I.sizes(pixels).join(box, "page_id", "left")
    bw, bh = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    usable = F.coalesce((bw >= F.floor(F.col("w") / 4)) & (bh >= F.floor(F.col("h") / 4)), F.lit(False))
    canvas = S.reframe_canvas(bw, bh, params.margins, params.aspect, params.budget)
    plan = durable(size.select("page_id", "w", "h", usable.alias("usable"), "x0", "y0", "x1", "y1", bw.alias("bw"), bh.alias("bh"), canvas.alias("c")))
    whole = pixels.join(plan.where("not usable"), "page_id").select("page_id", F.col("w").alias("canvas_w"), F.col("h").alias("canvas_h"), "y", "x", "v")
    framed = plan.where("usable").select("page_id", "x0", "y0", "x1", "y1", "bw", "bh", "c.*")
    content = I.crop(pixels.select("page_id", "y", "x", "v"), framed.select("page_id", "x0", "y0", "x1", "y1"))
    smaller = framed.where("content_w <> bw or content_h <> bh").select("page_id", F.col("bw").alias("w"), F.col("bh").alias("h"), F.col("content_w").cast("int").alias("new_w"), F.col("content_h").cast("int").alias("new_h"))
    resized = W.remap(content.join(smaller.select("page_id"), "page_id", "left_semi"), W.resizing(smaller), "lanczos", None)
    content = content.join(smaller.select("page_id"), "page_id", "left_anti").select("page_id", "y", "x", "v").unionByName(resized)
    placed = content.join(framed, "page_id").select("page_id", F.col("canvas_w").cast("int").alias("canvas_w"), F.col("canvas_h").cast("int").alias("canvas_h"), (F.col("y") + F.col("oy")).cast("int").alias("y"), (F.col("x") + F.col("ox")).cast("int").alias("x"), "v")
    return whole.unionByName(placed)


def filled(rows: DataFrame) -> DataFrame:
    """All pixels of the canvases that reframe() describes: page_id, y, x, v; what they do not list is white."""
    canvas = rows.select("page_id", F.col("canvas_w").alias("w"), F.col("canvas_h").alias("h")).distinct()
    return W.grid(canvas).join(rows.select("page_id", "y", "x", "v"), ["page_id", "y", "x"], "left").select("page_id", "y", "x", F.coalesce("v", F.lit(255)).alias("v"))


def fitted(pixels: DataFrame, aspect: float | None) -> DataFrame:
    """Pages whose width does not follow from their height by the aspect, resized to it."""
    if aspect is None:
        return pixels
    size = I.sizes(pixels).withColumns({"new_w": F.greatest(F.lit(1), F.bround(F.col("h") * aspect).cast("int")), "new_h": F.col("h")})
    off = durable(size.where("new_w <> w"))
    resized = W.remap(pixels, W.resizing(off), "lanczos", None)
    return pixels.select("page_id", "y", "x", "v").join(off, "page_id", "left_anti").unionByName(resized)


def scan(pixels: DataFrame, params: ScanParams = ScanParams()) -> DataFrame:
    """page_id, canvas_w, canvas_h, y, x, v of every canvas pixel of every page: levelling and trims, enhancement,
    reframing, levelling by the rulings that this exposes, a trim of the top, reframing with half the margins, and only
    then, where the edges are margins, the whitening of corner smears and border specks; sharpening and final size."""
    pixels = durable(straighten(durable(pixels), params))
    trimmed = I.by_page(I.crop(pixels, boxes(I.by_page(I.gray(pixels)))))
    gray = durable(I.gray(enhance(trimmed, params)))
    level = durable(settle(durable(filled(reframe(I.by_page(gray), params))), params))
    topped = durable(I.crop(level, I.white_bands(level, params.ink, (0.0, 0.0, 0.12, 0.0))))
    half = replace(params, margins=tuple(m / 2 for m in params.margins))
    framed = durable(filled(reframe(I.by_page(topped), half)))
    clean = durable(I.whiten_border(I.by_page(durable(I.whiten_corners(I.by_page(framed)))), params.ink, params.border_depth))
    out = durable(fitted(durable(I.unsharp(I.by_page(clean))), params.aspect))
    size = I.sizes(out).select("page_id", F.col("w").alias("canvas_w"), F.col("h").alias("canvas_h"))
    return out.join(size, "page_id").select("page_id", "canvas_w", "canvas_h", "y", "x", "v")
