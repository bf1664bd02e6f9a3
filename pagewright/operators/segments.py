"""Operators on ruling segments: rows of page_id, seg_id, x1, y1, x2, y2 (x2 > x1) with their page's w and h."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagewright import params as P

TANGENT = math.tan(math.radians(P.MAX_TILT))


def rulings(segments: DataFrame) -> DataFrame:
    """Nearly horizontal segments away from the page's edges."""
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    cx, cy = (F.col("x1") + F.col("x2")) / 2.0, (F.col("y1") + F.col("y2")) / 2.0
    level = (F.abs(dx) >= 2 * F.abs(dy)) & (F.abs(dy) <= TANGENT * F.abs(dx))
    return segments.where(level & cy.between(0.10 * F.col("h"), 0.98 * F.col("h")) & cx.between(0.03 * F.col("w"), 0.97 * F.col("w")))


def angles(segments: DataFrame) -> DataFrame:
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    return segments.withColumns({"angle": F.degrees(F.atan2(dy, dx)), "length": F.hypot(dx, dy)})


def weighted_median_angle(segments: DataFrame, least: int = 5) -> DataFrame:
    """page_id and tilt: the first angle at which half of the summed length is reached; pages with few segments are left out."""
    page, up = Window.partitionBy("page_id"), Window.partitionBy("page_id").orderBy("angle", "seg_id").rowsBetween(Window.unboundedPreceding, 0)
    rows = angles(segments).withColumns({"reached": F.sum("length").over(up), "total": F.sum("length").over(page), "n": F.count("*").over(page)})
    return rows.where((F.col("n") >= least) & (F.col("reached") >= F.col("total") / 2)).groupBy("page_id").agg(F.min("angle").alias("tilt"))


def skew(segments: DataFrame, most: float = 15.0) -> DataFrame:
    """The tilt to undo: 0 if it is too small or too large to trust."""
    tilt = F.col("tilt")
    return weighted_median_angle(segments).select("page_id", F.when(F.abs(tilt).between(0.3, most), tilt).otherwise(0.0).alias("angle"))


def endpoints(segments: DataFrame, *keys: str) -> DataFrame:
    ends = F.inline(F.array(F.struct(F.col("x1").alias("px"), F.col("y1").alias("py")), F.struct(F.col("x2").alias("px"), F.col("y2").alias("py"))))
    return segments.select(*keys, "seg_id", ends)


def fitted_lines(segments: DataFrame, *keys: str) -> DataFrame:
    """Least squares through both ends of all segments of a key: slope, intercept, segments and span."""
    return endpoints(segments, *keys).groupBy(*keys).agg(F.regr_slope("py", "px").alias("slope"), F.regr_intercept("py", "px").alias("intercept"), (F.count("*") / 2).cast("long").alias("segments"), (F.max("px") - F.min("px")).alias("span"))


def bands(pages: DataFrame, n: int = P.BANDS) -> DataFrame:
    """page_id, band, lo, hi, centre of each page (page_id, h): n bands that overlap by a quarter on either side."""
    low, high = P.BAND_RANGE
    step = F.col("h") * ((high - low) / n)
    edge = F.col("h") * low + F.col("band") * step
    rows = pages.select("page_id", "w", "h", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("band"))
    return rows.select("page_id", "w", "h", "band", (edge - P.BAND_OVERLAP * step).alias("lo"), (edge + (1 + P.BAND_OVERLAP) * step).alias("hi"), (edge + 0.5 * step).alias("centre"))


def in_bands(segments: DataFrame, n: int = P.BANDS) -> DataFrame:
    """Each segment in every band that holds its middle. The bands of a page follow from its height, so a segment
    works out its own: no range join."""
    low, high = P.BAND_RANGE
    step = F.col("h") * ((high - low) / n)
    at = ((F.col("y1") + F.col("y2")) / 2.0 - F.col("h") * low) / step
    rows = segments.withColumn("at", at).select("*", F.explode(F.sequence(F.floor(at).cast("int") - 1, F.floor(at).cast("int") + 1)).alias("band"))
    return rows.where(F.col("band").between(0, n - 1) & (F.col("at") >= F.col("band") - P.BAND_OVERLAP) & (F.col("at") < F.col("band") + 1 + P.BAND_OVERLAP)).drop("at")


def band_slopes(segments: DataFrame, n: int = P.BANDS) -> DataFrame:
    """page_id, w, h, band, centre, slope (null without evidence) of every band of every page with segments."""
    pages = segments.groupBy("page_id").agg(F.max("w").alias("w"), F.max("h").alias("h"))
    fits = fitted_lines(in_bands(segments, n), "page_id", "band")
    rows = bands(pages, n).join(fits, ["page_id", "band"], "left")
    good = (F.col("segments") >= 2) & (F.col("span") >= 0.4 * F.col("w")) & (F.abs("slope") <= TANGENT)
    return rows.select("page_id", "w", "h", "band", "centre", F.when(good, F.col("slope")).alias("slope"))


def filled(rows: DataFrame, value: str = "slope", key: str = "page_id", order: str = "band") -> DataFrame:
    """rows with missing values set to the mean of the nearest known before and after, or to the one there is."""
    line = Window.partitionBy(key).orderBy(order)
    last = F.last(value, ignorenulls=True).over(line.rowsBetween(Window.unboundedPreceding, -1))
    following = F.first(value, ignorenulls=True).over(line.rowsBetween(1, Window.unboundedFollowing))
    return rows.withColumn(value, F.coalesce(F.col(value), (last + following) / 2.0, last, following))


def smoothed(rows: DataFrame, value: str = "slope", key: str = "page_id", order: str = "band") -> DataFrame:
    """A quarter, a half, a quarter; the ends count twice."""
    line = Window.partitionBy(key).orderBy(order)
    v = F.col(value)
    return rows.withColumn(value, 0.25 * F.coalesce(F.lag(v).over(line), v) + 0.5 * v + 0.25 * F.coalesce(F.lead(v).over(line), v))


def interpolated(rows: DataFrame, ys: DataFrame, value: str = "slope", key: str = "page_id", at: str = "centre") -> DataFrame:
    """ys (key, y) with the value between the two known places around y, and the end values beyond them. Places and ys
    are put in one order, so nothing is joined by range."""
    known = rows.select(key, F.col(at).cast("double").alias("y"), F.col(value).alias("known"), F.lit(0).alias("asked"))
    both = known.unionByName(ys.select(key, F.col("y").cast("double").alias("y"), F.lit(None).cast("double").alias("known"), F.lit(1).alias("asked")))
    line = Window.partitionBy(key).orderBy("y", "asked")
    place = F.when(F.col("asked") == 0, F.struct("y", "known"))
    before = F.last(place, ignorenulls=True).over(line.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first(place, ignorenulls=True).over(line.rowsBetween(0, Window.unboundedFollowing))
    both = both.withColumns({"p": before, "q": after}).where("asked = 1")
    share = (F.col("y") - F.col("p.y")) / (F.col("q.y") - F.col("p.y"))
    between = F.col("p.known") + (F.col("q.known") - F.col("p.known")) * share
    return both.select(key, "y", F.when(F.col("p").isNull(), F.col("q.known")).when(F.col("q").isNull(), F.col("p.known")).otherwise(between).alias(value))


def row_slopes(segments: DataFrame, ys: DataFrame, n: int = P.BANDS, least: int = 3) -> DataFrame:
    """page_id, y, slope: how every row of a page is bent, for pages with evidence in at least so many bands."""
    slopes = band_slopes(segments, n).withColumn("good", F.count("slope").over(Window.partitionBy("page_id"))).where(F.col("good") >= least)
    return interpolated(smoothed(filled(slopes)), ys.join(slopes.select("page_id").distinct(), "page_id", "left_semi"))


def keystone(segments: DataFrame) -> DataFrame:
    """page_id, top and bottom slopes and heights at mid width, where the two disagree within bounds."""
    cy = (F.col("y1") + F.col("y2")) / 2.0
    sides = segments.withColumn("side", F.when(cy < 0.45 * F.col("h"), "top").when(cy > 0.55 * F.col("h"), "bottom")).where("side is not null")
    fits = fitted_lines(sides, "page_id", "w", "h", "side").where((F.col("segments") >= 2) & (F.col("span") >= 0.5 * F.col("w")) & (F.abs("slope") <= TANGENT))
    fits = fits.withColumn("mid", F.col("slope") * F.col("w") / 2.0 + F.col("intercept"))
    pick = lambda side, c: F.max(F.when(F.col("side") == side, F.col(c)))
    both = fits.groupBy("page_id", "h").agg(pick("top", "slope").alias("top"), pick("bottom", "slope").alias("bottom"), pick("top", "mid").alias("y_top"), pick("bottom", "mid").alias("y_bottom"))
    return both.where((F.abs(F.col("top") - F.col("bottom")) <= math.tan(math.radians(15.0))) & (F.col("y_bottom") - F.col("y_top") >= 0.25 * F.col("h"))).drop("h")


def angle_mode(segments: DataFrame, width: int = 5, least: int = 5) -> DataFrame:
    """page_id, bin, n: the fullest bin of angles; of equal ones that seen first."""
    bins = angles(segments).groupBy("page_id", (F.floor(F.col("angle") / width) * width).alias("bin")).agg(F.count("*").alias("n"), F.min("seg_id").alias("seen"))
    best = bins.groupBy("page_id").agg(F.sum("n").alias("total"), F.max_by(F.struct("bin", "n"), F.struct("n", -F.col("seen"))).alias("best"))
    return best.where(F.col("total") >= least).select("page_id", "best.bin", "best.n")


def ordered_corners(points: DataFrame) -> DataFrame:
    """page_id, top_left, top_right, bottom_right, bottom_left of each page's points (idx, px, py); ties to the lower idx."""
    total, gap, point = F.col("px") + F.col("py"), F.col("px") - F.col("py"), F.struct("px", "py")
    least, most = (lambda k: F.min_by(point, F.struct(k, "idx"))), (lambda k: F.max_by(point, F.struct(k, -F.col("idx"))))
    return points.groupBy("page_id").agg(least(total).alias("top_left"), most(gap).alias("top_right"), most(total).alias("bottom_right"), least(gap).alias("bottom_left"))


def largest_contours(contours: DataFrame, n: int = 7) -> DataFrame:
    """Contours (page_id, idx, area, w, h) that cover between a quarter and nearly all of the page, the n largest first."""
    share = F.col("area") / (F.col("w") * F.col("h"))
    rank = F.row_number().over(Window.partitionBy("page_id").orderBy(F.desc("area"), "idx"))
    return contours.where(share.between(0.25, 0.995)).withColumn("rank", rank).where(F.col("rank") <= n)


def best_candidates(candidates: DataFrame) -> DataFrame:
    """page_id, name, tilt: the candidate (order 0: the page as it is) of least absolute tilt; ties keep the earlier."""
    return candidates.groupBy("page_id").agg(F.min_by(F.struct("name", "tilt"), F.struct(F.abs("tilt"), "order")).alias("best")).select("page_id", "best.*")
