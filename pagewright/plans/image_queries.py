"""Queries on whole page images, with SQL for each, at the parameters that pages are scanned with.

208 vectors in a row make a page of 128 x 104 pixels, so boxes of 101 x 101 pixels and the margins of a scan have room;
where a page of 8 x 8 pixels will do, the SQL of the query on pixels holds for the one on images too.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.operators import images as I
from pagewright.operators import rasters as R
from pagewright.operators import votes as V
from pagewright.params import ScanParams
from pagewright.plans import pages as P
from pagewright.plans.queries import CLIP, ORACLE, PX, QUERIES, _tones_sql, query, table

__all__ = ["ORACLE", "QUERIES"]

WIDE, HIGH = 128, 104
TILES = (WIDE // 8) * (HIGH // 8)

WIDE_PX = f"""wide AS (
    SELECT vec_id // {TILES} AS page_id, CAST(vec_id % {TILES} // {WIDE // 8} * 8 + (i - 1) // 8 AS INT) AS y, CAST(vec_id % {TILES} % {WIDE // 8} * 8 + (i - 1) % 8 AS INT) AS x,
        CAST(least(255, greatest(0, floor(CAST(embedding[i] AS DOUBLE) * 240 + 128))) AS INT) AS v
    FROM embeddings, range(1, 65) t(i)
    WHERE vec_id // {TILES} IN (SELECT vec_id // {TILES} FROM embeddings GROUP BY 1 HAVING count(*) = {TILES})
), wide_rgb AS (SELECT page_id, y, x, v AS b, v * 3 % 256 AS g, (v * 7 + 40) % 256 AS r FROM wide)"""


def wide_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gray pixels of the wide pages; vectors that fill no whole page are left out."""
    rows = table(spark, sf_dir, "embeddings").withColumn("wide", F.floor(F.col("vec_id") / TILES))
    whole = rows.groupBy("wide").count().where(F.col("count") == TILES).select("wide")
    small = I.from_vectors(rows.join(whole, "wide", "left_semi"))
    tile = F.col("page_id") % TILES
    y, x = F.floor(tile / (WIDE // 8)) * 8 + F.col("y"), tile % (WIDE // 8) * 8 + F.col("x")
    return small.select(F.floor(F.col("page_id") / TILES).alias("page_id"), y.cast("int").alias("y"), x.cast("int").alias("x"), "v")


def wide_colours(pixels: DataFrame) -> DataFrame:
    v = F.col("v")
    return pixels.select("page_id", "y", "x", v.alias("b"), (v * 3 % 256).alias("g"), ((v * 7 + 40) % 256).alias("r"))


def small_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.from_pixels(I.from_vectors(table(spark, sf_dir, "embeddings")))


def _gray(images: DataFrame) -> DataFrame:
    return R.to_pixels(images).select("page_id", "y", "x", F.col("b").alias("v"))


def _sliding(rel: str, value: str, r: int) -> str:
    """A subquery with the sums over boxes of 2 r + 1 pixels, mirrored at the borders: along x, then along y."""
    near = lambda n: f"CASE WHEN k < 0 THEN -k WHEN k > {n - 1} THEN {2 * (n - 1)} - k ELSE k END"
    span = f"ROWS BETWEEN {r} PRECEDING AND {r} FOLLOWING"
    along = f"SELECT page_id, y, k AS x, sum({value}) OVER (PARTITION BY page_id, y ORDER BY k {span}) AS s FROM {rel} p JOIN (SELECT k, {near(WIDE)} AS src FROM range({-r}, {WIDE + r}) t(k)) m ON p.x = m.src"
    down = f"SELECT page_id, x, k AS y, sum(s) OVER (PARTITION BY page_id, x ORDER BY k {span}) AS s FROM (SELECT * FROM ({along}) WHERE x BETWEEN 0 AND {WIDE - 1}) p JOIN (SELECT k, {near(HIGH)} AS src FROM range({-r}, {HIGH + r}) t(k)) m ON p.y = m.src"
    return f"(SELECT page_id, CAST(y AS INT) AS y, CAST(x AS INT) AS x, s FROM ({down}) WHERE y BETWEEN 0 AND {HIGH - 1})"


@query(f"WITH {WIDE_PX} SELECT p.page_id, p.y, p.x, v, CAST(round_even(s / 10201.0::DOUBLE, 0) AS INT) AS mean FROM wide p JOIN {_sliding('wide', 'v', 50)} b USING (page_id, y, x)")
def wide_box_mean(spark, sf_dir):
    """The local mean on pixel rows, at the size that pages are flattened with."""
    return I.box_mean(I.by_page(wide_pixels(spark, sf_dir)))


_FLAT = ", ".join(CLIP.format(f"{c} - round_even(b{c}.s / 10201.0::DOUBLE, 0) + 127.0::DOUBLE") + f" AS {c}" for c in "bgr")
_LOOK = f"""WITH {WIDE_PX}, flat AS (SELECT p.page_id, p.y, p.x, {_FLAT} FROM wide_rgb p {' '.join(f'JOIN {_sliding("wide_rgb", c, 50)} b{c} USING (page_id, y, x)' for c in 'bgr')}),
lum AS (SELECT *, (r + g + b) / 3.0::DOUBLE AS l FROM flat)
SELECT page_id, y, x, {', '.join(_tones_sql(f'(l + ({c} - l) * 1.25::DOUBLE)') + f' AS {c}' for c in 'bgr')} FROM lum"""


@query(_LOOK)
def image_look(spark, sf_dir):
    """The reference look of whole images."""
    return R.to_pixels(R.each_page(R.from_pixels(wide_colours(wide_pixels(spark, sf_dir))), R.reference_look))


@query(_LOOK)
def wide_reference_look(spark, sf_dir):
    """The same on pixel rows."""
    return I.reference_look(I.by_page(wide_colours(wide_pixels(spark, sf_dir))))


#: The seven weights of a Gaussian with a deviation of 0.8, as SQL.
_WEIGHTS = "gauss AS (SELECT d, exp(-d * d / 1.28::DOUBLE) / (SELECT sum(exp(-e * e / 1.28::DOUBLE)) FROM range(-3, 4) u(e)) AS k FROM range(-3, 4) t(d))"
_NEAR = "CASE WHEN {a} < 0 THEN -({a}) WHEN {a} > {n} - 1 THEN 2 * ({n} - 1) - ({a}) ELSE {a} END"


@query(f"""WITH {WIDE_PX}, {_WEIGHTS}, along AS (SELECT p.page_id, p.y, p.x, sum(k * q.v) AS s FROM wide p, gauss, wide q WHERE q.page_id = p.page_id AND q.y = p.y AND q.x = {_NEAR.format(a='p.x + d', n=WIDE)} GROUP BY 1, 2, 3),
blur AS (SELECT p.page_id, p.y, p.x, sum(k * q.s) AS s FROM along p, gauss, along q WHERE q.page_id = p.page_id AND q.x = p.x AND q.y = {_NEAR.format(a='p.y + d', n=HIGH)} GROUP BY 1, 2, 3)
SELECT p.page_id, p.y, p.x, CAST(least(255, greatest(0, round_even(v * 1.3::DOUBLE + round_even(round(s, 9), 0) * (1.0::DOUBLE - 1.3::DOUBLE), 0))) AS INT) AS v FROM wide p JOIN blur USING (page_id, y, x)""")
def image_unsharp(spark, sf_dir):
    return _gray(R.each_page(R.from_pixels(wide_pixels(spark, sf_dir)), R.unsharp))


_TRIMS = f"""WITH {WIDE_PX}, cols AS (SELECT page_id, x, min(v) AS m FROM wide GROUP BY 1, 2), rows AS (SELECT page_id, y, min(v) AS m FROM wide GROUP BY 1, 2),
bx AS (SELECT page_id, least(coalesce(min(x) FILTER (WHERE m <= 60), {WIDE}), 11) AS x0, greatest(coalesce(max(x) FILTER (WHERE m <= 60) + 1, 0), {WIDE} - 10) AS x1 FROM cols GROUP BY 1),
by_ AS (SELECT page_id, least(coalesce(min(y) FILTER (WHERE m <= 60), {HIGH}), 9) AS y0, greatest(coalesce(max(y) FILTER (WHERE m <= 60) + 1, 0), {HIGH} - 8) AS y1 FROM rows GROUP BY 1),
grad AS (SELECT a.page_id, a.y, a.x, b.v - c.v AS d FROM wide a JOIN wide b ON b.page_id = a.page_id AND b.y = a.y AND b.x = {_NEAR.format(a='a.x + 1', n=WIDE)} JOIN wide c ON c.page_id = a.page_id AND c.y = a.y AND c.x = abs(a.x - 1)),
energy AS (SELECT a.page_id, a.y, avg(abs(b.d + 2 * a.d + c.d)) AS e FROM grad a JOIN grad b ON b.page_id = a.page_id AND b.x = a.x AND b.y = {_NEAR.format(a='a.y + 1', n=HIGH)} JOIN grad c ON c.page_id = a.page_id AND c.x = a.x AND c.y = abs(a.y - 1) GROUP BY 1, 2),
base AS (SELECT page_id, median(e) AS base FROM energy GROUP BY 1),
top AS (SELECT page_id, CASE WHEN base > 0 THEN least(coalesce(min(y) FILTER (WHERE e >= 0.97::DOUBLE * base), {HIGH}), 10) ELSE 0 END AS top FROM energy JOIN base USING (page_id) GROUP BY page_id, base),
share AS (SELECT page_id, x, y0, avg(CAST(v < 100 AS INT)) AS s FROM wide, range(0, 79, 13) t(y0) WHERE y >= y0 AND y < y0 + 26 GROUP BY 1, 2, 3),
peak AS (SELECT page_id, x, max(s) AS s FROM share GROUP BY 1, 2),
dark AS (SELECT a.page_id, a.x, sum(b.s) / 15 AS d FROM peak a JOIN peak b ON a.page_id = b.page_id AND abs(a.x - b.x) <= 7 GROUP BY 1, 2),
cut AS (SELECT page_id, least(coalesce(min(x) FILTER (WHERE round(d, 9) <= 0.25::DOUBLE), {WIDE}), 8) AS cut FROM dark GROUP BY 1), clean AS (SELECT page_id, avg(v) AS m FROM wide GROUP BY 1)
SELECT page_id, x0, y0, x1, y1, CAST(top AS BIGINT) AS top, CAST(CASE WHEN m > 200 OR {WIDE} - cut < {WIDE // 2} THEN 0 ELSE cut END AS BIGINT) AS left_cut FROM bx JOIN by_ USING (page_id) JOIN top USING (page_id) JOIN cut USING (page_id) JOIN clean USING (page_id)"""


@query(_TRIMS)
def image_trims(spark, sf_dir):
    """What the trims of a raw page would cut off, with their own shares; ink is darker here, so that some lines have none."""

    def measure(image: np.ndarray) -> list[tuple]:
        g = R.gray(image)
        return [(*R.ink_free(g, 60), R.smeared_top(g, share=0.97), R.dark_left(g))]

    return R.measured(R.from_pixels(wide_pixels(spark, sf_dir)), measure, "x0 long, y0 long, x1 long, y1 long, top long, left_cut long")


@query(ORACLE["ink_box"])
def image_ink_box(spark, sf_dir):
    def measure(image: np.ndarray) -> list[tuple]:
        box = R.ink_box(R.gray(image), 118, 6)
        return [] if box is None else [box]

    found = R.measured(small_images(spark, sf_dir), measure, "x0 long, y0 long, x1 long, y1 long")
    return found.select("page_id", *[F.col(c).cast("int").alias(c) for c in ("x0", "y0", "x1", "y1")])


@query(ORACLE["whiten_border"])
def image_border(spark, sf_dir):
    def clean(image: np.ndarray) -> np.ndarray:
        return R.whiten_border(image, 118, 0.5)

    return _gray(R.each_page(small_images(spark, sf_dir), clean))


@query(ORACLE["deskew"])
def image_deskew(spark, sf_dir):
    angle = (F.col("page_id") % 7 * 5 - 15).cast("double")
    return _gray(R.each_page(small_images(spark, sf_dir).withColumns({"kind": F.lit("turn"), "numbers": F.array(angle)}), P.move, "kind", "numbers"))


@query(ORACLE["resized"])
def image_resized(spark, sf_dir):
    def step(image: np.ndarray) -> np.ndarray:
        return R.resized(image, 11, 5, "linear")

    return _gray(R.each_page(small_images(spark, sf_dir), step))


_FRINGE = """b AS (SELECT page_id, min(x) AS a0, max(x) + 1 AS a1, min(y) AS c0, max(y) + 1 AS c1 FROM px WHERE v < 100 GROUP BY 1),
u AS (SELECT page_id, a0, a1, coalesce(min(y) FILTER (WHERE v < 130 AND x >= a0 AND x < a1 AND y < c0 AND y >= c0 - 2), any_value(c0)) AS u0, coalesce(max(y) FILTER (WHERE v < 130 AND x >= a0 AND x < a1 AND y >= c1 AND y < c1 + 2) + 1, any_value(c1)) AS u1
    FROM b JOIN px USING (page_id) GROUP BY page_id, a0, a1),
fringe AS (SELECT page_id, coalesce(min(x) FILTER (WHERE v < 130 AND y >= u0 AND y < u1 AND x < a0 AND x >= a0 - 2), any_value(a0)) AS x0, u0 AS y0, coalesce(max(x) FILTER (WHERE v < 130 AND y >= u0 AND y < u1 AND x >= a1 AND x < a1 + 2) + 1, any_value(a1)) AS x1, u1 AS y1
    FROM u JOIN px USING (page_id) GROUP BY page_id, u0, u1)"""


@query(f"WITH {PX}, {_FRINGE} SELECT page_id, CAST(x0 AS BIGINT) AS x0, CAST(y0 AS BIGINT) AS y0, CAST(x1 AS BIGINT) AS x1, CAST(y1 AS BIGINT) AS y1 FROM fringe")
def fringe_box(spark, sf_dir):
    """The ink box grown over faint pixels, a quarter of the page at most."""

    def measure(image: np.ndarray) -> list[tuple]:
        g = R.gray(image)
        box = R.ink_box(g, 100, 1)
        return [] if box is None else [R.fringed(g, box, 130, 0.25)]

    return R.measured(small_images(spark, sf_dir), measure, "x0 long, y0 long, x1 long, y1 long")


_SIZED = """e AS (SELECT page_id, CAST(round_even((x1 - x0) / (1.0::DOUBLE - 0.14), 0) AS BIGINT) AS w0, CAST(round_even((y1 - y0) / (1.0::DOUBLE - 0.11), 0) AS BIGINT) AS h0, x1 - x0 < 2 OR y1 - y0 < 2 AS bare FROM f),
c AS (SELECT *, greatest(w0, CAST(round_even(h0 * (893.0::DOUBLE / 1263), 0) AS BIGINT)) AS w1 FROM e), s AS (SELECT *, CASE WHEN w1 * h0 > 40 THEN sqrt(40.0::DOUBLE / (w1 * h0)) END AS k FROM c)"""


@query(f"""WITH {PX}, {_FRINGE.replace('130', '200').replace('- 2', '- 1').replace('+ 2', '+ 1')}, f AS (SELECT * FROM fringe), {_SIZED}
SELECT p.page_id, CASE WHEN bare OR bare IS NULL THEN 8 WHEN k IS NULL THEN w1 ELSE greatest(1, CAST(round_even(w1 * k, 0) AS BIGINT)) END AS width,
    CASE WHEN bare OR bare IS NULL THEN 8 WHEN k IS NULL THEN h0 ELSE greatest(1, CAST(round_even(h0 * k, 0) AS BIGINT)) END AS height FROM (SELECT DISTINCT page_id FROM px) p LEFT JOIN s USING (page_id)""")
def image_reframe_sizes(spark, sf_dir):
    """The sizes of reframed pages whose canvases mostly exceed a budget of 40 pixels."""
    params = ScanParams(ink=100, noise_area=1, budget=40)

    def step(image: np.ndarray) -> np.ndarray:
        return P.reframed(image, params)

    return R.each_page(small_images(spark, sf_dir), step).where("error is null").select("page_id", F.col("width").cast("long").alias("width"), F.col("height").cast("long").alias("height"))


#: Strokes that pages of 128 x 104 pixels can have.
SHORT = {"block": 21, "run": 6, "length": 12, "smooth": 5}


_VOTES = """vote AS (SELECT page_id, step, CAST(floor(round(y * cos(radians(step / {fine}.0::DOUBLE)) - x * sin(radians(step / {fine}.0::DOUBLE)) + 0.5::DOUBLE, 9)) AS BIGINT) AS rho, count(*) AS votes
    FROM {points}, range(-{most}, {most} + 1) t(step) GROUP BY 1, 2, 3)"""
_POINTS = """ink AS (SELECT page_id, y, x, x - row_number() OVER (PARTITION BY page_id, y ORDER BY x) AS run FROM wide WHERE v < 105),
long AS (SELECT page_id, y, min(x) AS x0, max(x) + 1 AS x1 FROM ink GROUP BY page_id, y, run HAVING count(*) >= 3),
gone AS (SELECT *, lag(x1) OVER (PARTITION BY page_id, y ORDER BY x0) AS before FROM long),
shut AS (SELECT page_id, y, unnest(range(CASE WHEN x0 - before < 4 THEN before ELSE x0 END, x1)) AS x FROM gone),
col AS (SELECT DISTINCT page_id, y, x FROM shut), down AS (SELECT *, y - row_number() OVER (PARTITION BY page_id, x ORDER BY y) AS run FROM col),
pts AS (SELECT page_id, (min(y) + max(y)) // 2 AS y, x FROM down GROUP BY page_id, x, run)"""
_BEATS = "(b.votes, -abs(b.step), -b.step, -b.rho) > (a.votes, -abs(a.step), -a.step, -a.rho)"


@query(f"WITH {PX}, dark AS (SELECT page_id, y, x FROM px WHERE v < 100), {_VOTES.format(fine=1, most=13, points='dark')} SELECT page_id, CAST(step AS INT) AS step, rho, votes FROM vote")
def ruling_votes(spark, sf_dir):
    """The votes of dark pixels for lines, on pixel rows."""
    return V.line_votes(I.from_vectors(table(spark, sf_dir, "embeddings")).where("v < 100"), fine=1)


@query(f"WITH {PX}, dark AS (SELECT page_id, y, x FROM px WHERE v < 100), {_VOTES.format(fine=1, most=13, points='dark')} SELECT page_id, CAST(step AS INT) AS step, rho, votes FROM vote")
def image_votes(spark, sf_dir):
    """The same of whole images."""

    def measure(image: np.ndarray) -> list[tuple]:
        y, x = np.nonzero(image[:, :, 0] < 100)
        counts, least = V.vote_table(y, x, 1)
        rows, columns = np.nonzero(counts)
        return [(int(V.angle_steps(1)[r]), int(c) + least, int(counts[r, c])) for r, c in zip(rows, columns, strict=True)]

    found = R.measured(small_images(spark, sf_dir), measure, "step long, rho long, votes long")
    return found.select("page_id", F.col("step").cast("int").alias("step"), "rho", "votes")


@query(f"""WITH {WIDE_PX}, {_POINTS}, {_VOTES.format(fine=V.FINE, most=V.FINE * V.WIDEST, points='pts')}
SELECT page_id, CAST(step AS INT) AS step, rho, votes FROM vote a WHERE votes >= 24 AND NOT EXISTS (
    SELECT 1 FROM vote b WHERE b.page_id = a.page_id AND abs(b.step - a.step) <= {V.AROUND[0]} AND abs(b.rho - a.rho) <= {V.AROUND[1]} AND {_BEATS})""")
def image_rulings(spark, sf_dir):
    """The lines that the long dark strokes of whole pages vote for and no neighbour beats."""

    def measure(image: np.ndarray) -> list[tuple]:
        y, x = V.middles(V.closed(V.opened(R.gray(image) < 105, 3), 4))
        counts, least = V.vote_table(y, x)
        return [(int(V.angle_steps()[r]), c + least, int(counts[r, c])) for r, c in V.peaks(counts, 24)]

    found = R.measured(R.from_pixels(wide_pixels(spark, sf_dir)), measure, "step long, rho long, votes long")
    return found.select("page_id", F.col("step").cast("int").alias("step"), "rho", "votes")


@query()
def scan_images(spark, sf_dir):
    """The whole plan over whole colour pages."""
    done = P.scan_images(R.from_pixels(wide_colours(wide_pixels(spark, sf_dir))), ScanParams(), SHORT)
    return done.select("page_id", "width", "height", "channels", F.sha2("data", 256).alias("sha256"), "error")
