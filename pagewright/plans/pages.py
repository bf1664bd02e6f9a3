"""The page plan over whole images: colour pages in, clean and reframed colour pages out.

Python works on one page at a time, in short steps (operators/rasters.py); what a page needs done to it is worked out
from rows of ruling segments by joins, groups and windows (operators/segments.py) and joined back to the pages. Those
rows are few a page; while they are counted to be few in all they are broadcast, so the images are not shuffled.

Defined results: a page that cannot be read or on which a step fails keeps its row, with an error; a blank page stays
blank; a step of levelling, trimming or cleaning that fails on a page is left out there, and the executor's log says
why; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import replace
from math import sqrt

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.operators import rasters as R
from pagewright.operators import segments as G
from pagewright.operators import template as T
from pagewright.operators import warp as W
from pagewright.operators.rings import without_rings
from pagewright.params import AUTO_TRIM, INK, TOP_TRIM, ScanParams
from pagewright.session import durable

#: Most rows of a side that is broadcast; the number is counted first.
BROADCAST_ROWS = 100_000
#: What the strokes of a page must measure: None follows from its width.
STROKES = {"block": None, "run": None, "length": None, "smooth": 5}


def _rulings(images: DataFrame, strokes: dict) -> DataFrame:
    return durable(G.rulings(R.segments(images, **strokes)))


def _rows_moves(segments: DataFrame, least: int = 3) -> DataFrame:
    """page_id, kind and numbers (the centres and slopes of the bands) of the pages with evidence in enough bands."""
    slopes = G.band_slopes(segments)
    good = slopes.groupBy("page_id").agg(F.count("slope").alias("good")).where(F.col("good") >= least).select("page_id")
    level = G.smoothed(G.filled(slopes.join(good, "page_id", "left_semi")))
    bands = F.sort_array(F.collect_list(F.struct("centre", "slope")))  # six a page
    return level.groupBy("page_id").agg(F.flatten(F.transform(bands, lambda b: F.array(b["centre"], b["slope"]))).alias("numbers")).select("page_id", F.lit("rows").alias("kind"), "numbers")


def _turn_moves(segments: DataFrame) -> DataFrame:
    return G.skew(segments).where("angle <> 0").select("page_id", F.lit("turn").alias("kind"), F.array("angle").alias("numbers"))


def _square_moves(segments: DataFrame) -> DataFrame:
    size = segments.groupBy("page_id").agg(F.max("w").alias("w"), F.max("h").alias("h"))
    return W.square_maps(size.join(G.keystone(segments), "page_id")).select("page_id", F.lit("square").alias("kind"), F.col("m").alias("numbers"))


def _pink_moves(images: DataFrame) -> DataFrame:
    """A turn by the tilt of reddish rulings, which gray pages do not show; at least three of them, and a tilt that is
    neither too small nor too large to trust."""
    level = R.pink_segments(images).where(F.abs(F.col("y2") - F.col("y1")) <= G.TANGENT * (F.col("x2") - F.col("x1")))
    tilt = G.weighted_median_angle(durable(level), 3).where(F.abs("tilt").between(0.3, 10.0))
    return tilt.select("page_id", F.lit("turn").alias("kind"), F.array("tilt").alias("numbers"))


def _quad_moves(images: DataFrame) -> DataFrame:
    """page_id, kind and numbers (the map that makes it a rectangle) of the pages whose largest outlines have four
    corners: of the seven largest, each between a quarter and nearly all of the page, the first with four."""
    found = G.largest_contours(durable(R.contours(images))).where("points is not null")
    best = found.groupBy("page_id").agg(F.min_by(F.struct("points", "w", "h"), "rank").alias("q"))
    corner = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda k: F.struct(k.cast("long").alias("idx"), F.element_at("q.points", 2 * k + 1).alias("px"), F.element_at("q.points", 2 * k + 2).alias("py")))
    named = G.ordered_corners(best.select("page_id", F.inline(corner)))
    places = F.array(*[F.array(f"{c}.px", f"{c}.py") for c in ("top_left", "top_right", "bottom_right", "bottom_left")])
    quads = named.join(best.select("page_id", F.round("q.w").cast("int").alias("w"), F.round("q.h").cast("int").alias("h")), "page_id").select("page_id", "w", "h", places.alias("corners"))
    return W.quad_maps(quads).select("page_id", F.lit("quad").alias("kind"), F.col("m").alias("numbers"))


def move(image: np.ndarray, kind: str | None, numbers: list[float] | None) -> np.ndarray:
    """A page made of its quadrilateral, levelled row by row, squared by a map, turned by an angle, or as it is."""
    h, w = image.shape[:2]
    if kind == "quad":
        w, h, kind, numbers = int(numbers[0]), int(numbers[1]), "square", numbers[2:]
    if kind == "rows":
        centres, slopes = numbers[::2], numbers[1::2]
        source = lambda y, x: (y + np.interp(y, centres, slopes) * (x - w / 2.0), x)
    elif kind == "square":
        a = numbers
        depth = lambda y, x: a[6] * x + a[7] * y + 1.0
        source = lambda y, x: ((a[3] * x + a[4] * y + a[5]) / depth(y, x), (a[0] * x + a[1] * y + a[2]) / depth(y, x))
    elif kind == "turn":
        c, s = np.cos(np.radians(numbers[0])), np.sin(np.radians(numbers[0]))
        source = lambda y, x: (h / 2.0 + s * (x - w / 2.0) + c * (y - h / 2.0), w / 2.0 + c * (x - w / 2.0) - s * (y - h / 2.0))
    else:
        return image
    return R.remapped(image, source, (h, w))


def _moved(images: DataFrame, moves: DataFrame, how: str = "left", step=move) -> DataFrame:
    moves = durable(moves)
    few = F.broadcast(moves) if moves.count() <= BROADCAST_ROWS else moves
    return R.each_page(images.join(few, "page_id", how), step, "kind", "numbers")


def level_moves(images: DataFrame, strokes: dict = STROKES) -> DataFrame:
    """page_id, kind and numbers of what each page needs: its outline made a rectangle where it shows one; else to be
    levelled by its rulings, row by row where enough bands have evidence, else by making the trapezoid of the top and
    bottom rulings a rectangle, else by one turn, if that is neither too small nor too large to trust, by the rulings or
    by reddish ones."""
    segments = _rulings(images, strokes)
    ranked = None
    for rank, moves in enumerate((_quad_moves(images), _rows_moves(segments), _square_moves(segments), _turn_moves(segments), _pink_moves(images))):
        moves = moves.withColumn("rank", F.lit(rank))
        ranked = moves if ranked is None else ranked.unionByName(moves)
    return ranked.groupBy("page_id").agg(F.min_by(F.struct("kind", "numbers"), "rank").alias("m")).select("page_id", "m.*")


def straighten(images: DataFrame, strokes: dict = STROKES) -> DataFrame:
    """Pages with what level_moves finds done to them."""
    return _moved(images, level_moves(images, strokes))


def settle(images: DataFrame, strokes: dict = STROKES, tolerance: float = 0.25) -> DataFrame:
    """Pages whose rulings still tilt, levelled by one turn or row by row, whichever leaves less tilt, if either does."""
    segments = _rulings(images, strokes)
    tilts = durable(G.skew(segments).where(F.abs("angle") > tolerance))
    if tilts.isEmpty():
        return images
    segments = segments.join(tilts, "page_id", "left_semi")
    ways = [durable(_moved(images, moves, "inner")) for moves in (_turn_moves(segments), _rows_moves(segments))]
    tried = None
    for k, way in enumerate(ways):
        tilt = way.where("error is null").select("page_id").join(G.skew(_rulings(way, strokes)), "page_id", "left")
        rows = tilt.select("page_id", F.abs(F.coalesce("angle", F.lit(0.0))).alias("rest"), F.lit(k).alias("way"))
        tried = rows if tried is None else tried.unionByName(rows)
    better = tried.join(tilts, "page_id").where(F.col("rest") < F.abs("angle"))
    best = durable(better.groupBy("page_id").agg(F.min(F.struct("rest", "way")).alias("b")).select("page_id", F.col("b.way").alias("way")))
    few = F.broadcast(best) if best.count() <= BROADCAST_ROWS else best
    out = images.join(few, "page_id", "left_anti")
    for k, way in enumerate(ways):
        out = out.unionByName(way.join(few.where(F.col("way") == k), "page_id", "left_semi"))
    return out


def trimmed(image: np.ndarray) -> np.ndarray:
    """A raw page without the dark columns at its left, bands without ink, a smeared top and ink-free rims; a trim that
    fails is left out."""

    def dark_left(page: np.ndarray) -> np.ndarray:
        return page[:, R.dark_left(R.gray(page)) :]

    def bands(page: np.ndarray) -> np.ndarray:
        x0, y0, x1, y1 = R.ink_free(R.gray(page))
        return page[y0:y1, x0:x1]

    def smeared_top(page: np.ndarray) -> np.ndarray:
        return page[R.smeared_top(R.gray(page)) :]

    def rims(page: np.ndarray) -> np.ndarray:
        x0, y0, x1, y1 = R.ink_free(R.gray(page), INK, AUTO_TRIM)
        return page[y0:y1, x0:x1]

    return R.in_turn(image, dark_left, bands, smeared_top, rims)


def reframed(image: np.ndarray, params: ScanParams = ScanParams()) -> np.ndarray:
    """The page's ink on a white canvas with the given margins and aspect, both made smaller where the canvas would have
    more pixels than the budget. Pages without ink, or with little, stay as they are."""
    g = R.gray(image)
    h, w = g.shape
    box = R.ink_box(g, params.ink, params.noise_area)
    if box is None:
        return image
    x0, y0, x1, y1 = R.fringed(g, box)
    bw, bh = x1 - x0, y1 - y0
    if bw < w // 4 or bh < h // 4:
        return image
    left, right, top, bottom = params.margins
    wide, high = round(bw / max(1e-6, 1.0 - left - right)), round(bh / max(1e-6, 1.0 - top - bottom))
    if params.aspect is not None:
        wide = max(wide, round(high * params.aspect))
    content = image[y0:y1, x0:x1]
    if wide * high > params.budget:
        scale = sqrt(params.budget / (wide * high))
        bw, bh, wide, high = (max(1, round(n * scale)) for n in (bw, bh, wide, high))
        content = R.resized(content, bw, bh)
    x, y = max(0, min(round((wide - bw) / 2.0), wide - bw)), max(0, min(round(high * top), high - bh))
    canvas = np.full((high, wide, image.shape[2]), 255, np.uint8)
    canvas[y : y + bh, x : x + bw] = content
    return canvas


def finished(image: np.ndarray, params: ScanParams = ScanParams()) -> np.ndarray:
    """A level page without what enhancement showed above it, reframed with half the margins and, where the edges are
    margins, cleaned; sharpened, at its final size. A step that fails is left out."""
    half = replace(params, margins=tuple(m / 2 for m in params.margins))

    def top_trimmed(page: np.ndarray) -> np.ndarray:
        x0, y0, x1, y1 = R.ink_free(R.gray(page), params.ink, (0.0, 0.0, TOP_TRIM, 0.0))
        return page[y0:y1, x0:x1]

    def framed(page: np.ndarray) -> np.ndarray:
        return reframed(page, half)

    def clean_border(page: np.ndarray) -> np.ndarray:
        return page if params.preserve_borders else R.whiten_border(page, params.ink, params.border_depth)

    def sharp(page: np.ndarray) -> np.ndarray:
        if abs(params.output_scale - 1.0) <= 1e-6:
            return R.unsharp(page)
        h, w = page.shape[:2]
        return R.unsharp(R.resized(page, max(1, round(w * params.output_scale)), max(1, round(h * params.output_scale))), 1.6, R.gaussian(7, 1.0))

    def sized(page: np.ndarray) -> np.ndarray:
        h, w = page.shape[:2]
        target = w if params.aspect is None else max(1, round(h * params.aspect))
        return page if target == w else R.resized(page, target, h)

    return R.in_turn(image, top_trimmed, framed, R.whiten_corners, clean_border, sharp, sized)


def on_template(image: np.ndarray, kind: str | None, numbers: list[float] | None, params: ScanParams = ScanParams()) -> np.ndarray:
    """A page moved onto its template, with the look of a scan, sharper than others, and without what shows of the page
    beside it at the left."""
    out = R.unsharp(R.reference_look(move(image, kind, numbers), params.kernel, params.saturation, params.white, params.blacks), 1.9)
    out[:, : int(out.shape[1] * (params.margins[0] + 0.01))] = 255
    return out


def scan_images(images: DataFrame, params: ScanParams = ScanParams(), strokes: dict = STROKES, template: np.ndarray | None = None) -> DataFrame:
    """page_id, width, height, channels, data and error of every page, scanned. With a template (an image), pages that
    match it are brought onto it, and all get its size."""

    def enhanced(image: np.ndarray, kind: str | None, numbers: list[float] | None) -> np.ndarray:
        def moved(page: np.ndarray) -> np.ndarray:
            return move(page, kind, numbers)

        def framed(page: np.ndarray) -> np.ndarray:
            return reframed(page, params)

        page = R.in_turn(image, moved)
        if kind != "quad" and not params.preserve_borders:  # what has an outline has no rims
            page = trimmed(page)
        look = R.reference_look(page, params.kernel, params.saturation, params.white, params.blacks)
        return look if params.preserve_borders else R.in_turn(look, framed, without_rings)

    size = T.template_size(template)

    def last(image: np.ndarray) -> np.ndarray:
        page = finished(image, params)
        return page if size in (None, (page.shape[1], page.shape[0])) else R.resized(page, *size)

    def aligned(image: np.ndarray, kind: str | None, numbers: list[float] | None) -> np.ndarray:
        return on_template(image, kind, numbers, params)

    pages = durable(images.select(*R.NAMES))
    onto = None
    if template is not None:
        found = durable(T.alignment(pages, template))
        onto = _moved(pages, found, "inner", aligned)
        few = F.broadcast(found) if found.count() <= BROADCAST_ROWS else found
        pages = durable(pages.join(few.select("page_id"), "page_id", "left_anti").select(*R.NAMES))
    level = durable(_moved(pages, level_moves(pages, strokes), step=enhanced))
    done = R.each_page(settle(level, strokes), last)
    return done if onto is None else onto.unionByName(done)


def scan_auto(images: DataFrame, params: ScanParams = ScanParams(), strokes: dict = STROKES) -> DataFrame:
    """scan_images, but pages on which it fails are only flattened and stretched. Pages that cannot be read keep their
    error."""
    done = durable(scan_images(images, params, strokes))
    failed = done.where("error is not null").select("page_id")
    plain = R.each_page(images.join(failed, "page_id", "left_semi"), R.legacy_gray)
    return done.where("error is null").unionByName(plain)
