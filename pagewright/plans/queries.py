"""The page queries by name, and SQL for each on the same tables.

The tables stand in for pages: a vector is a gray page of 8 x 8 pixels, three in a row are a colour page; line items are
ruling segments, parts are page sizes, events are job events, conversations are documents with pages.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.functions import scalars as S
from pagewright.functions import tones as T
from pagewright.operators import batches as B
from pagewright.operators import images as I
from pagewright.operators import segments as G
from pagewright.operators import template as M
from pagewright.operators import warp as W
from pagewright.plans import scan
from pagewright.session import shared_dir
from pagewright.streaming import job_states as JS
from pagewright.streaming import jobs as J

K = 5
QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str | None = None):
    """Register a query under its name, with SQL that gives the same rows."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


# ---------------------------------------------------------------------------------------------------------- pixels

PX = """px AS (
    SELECT vec_id AS page_id, CAST((i - 1) // 8 AS INT) AS y, CAST((i - 1) % 8 AS INT) AS x,
        CAST(least(255, greatest(0, floor(CAST(embedding[i] AS DOUBLE) * 240 + 128))) AS INT) AS v
    FROM embeddings, range(1, 65) t(i)
)"""
RGB = f"""{PX}, rgb AS (
    SELECT page_id // 3 AS page_id, y, x, max(v) FILTER (WHERE page_id % 3 = 0) AS b, max(v) FILTER (WHERE page_id % 3 = 1) AS g,
        max(v) FILTER (WHERE page_id % 3 = 2) AS r
    FROM px GROUP BY 1, 2, 3 HAVING count(*) = 3
)"""
CLIP = "least(255.0::DOUBLE, greatest(0.0::DOUBLE, {}))"


def _box(rel: str, value: str, k: int = K) -> str:
    """A subquery with the k x k sums around each pixel, mirrored at the borders."""
    r = k // 2
    near = lambda a, d: f"CASE WHEN {a} + {d} < 0 THEN -({a} + {d}) WHEN {a} + {d} > 7 THEN 14 - ({a} + {d}) ELSE {a} + {d} END"
    return f"""(SELECT p.page_id, p.y, p.x, sum(q.{value}) AS s FROM {rel} p, range(-{r}, {r + 1}) dy(dy), range(-{r}, {r + 1}) dx(dx), {rel} q
        WHERE q.page_id = p.page_id AND q.y = {near("p.y", "dy")} AND q.x = {near("p.x", "dx")} GROUP BY 1, 2, 3)"""


def _pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.by_page(I.from_vectors(table(spark, sf_dir, "embeddings")))


def _colours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.by_page(I.colour_from_vectors(table(spark, sf_dir, "embeddings")))


@query(f"WITH {PX} SELECT page_id, y, x, v FROM px")
def pixels_from_vectors(spark, sf_dir):
    return I.from_vectors(table(spark, sf_dir, "embeddings"))


@query(f"WITH {RGB} SELECT page_id, y, x, b, g, r FROM rgb")
def colour_pixels(spark, sf_dir):
    return I.colour_from_vectors(table(spark, sf_dir, "embeddings"))


@query(f"WITH {RGB} SELECT page_id, y, x, CAST(round_even(r * 0.299::DOUBLE + g * 0.587::DOUBLE + b * 0.114::DOUBLE, 0) AS INT) AS v FROM rgb")
def gray_pixels(spark, sf_dir):
    return I.gray(_colours(spark, sf_dir))


@query(f"WITH {PX} SELECT p.page_id, p.y, p.x, v, CAST(round_even(s / {K * K}.0::DOUBLE, 0) AS INT) AS mean FROM px p JOIN {_box('px', 'v')} b USING (page_id, y, x)")
def box_mean(spark, sf_dir):
    return I.box_mean(_pixels(spark, sf_dir), K)


@query(f"WITH {PX} SELECT p.page_id, p.y, p.x, CAST(floor({CLIP.format(f'v - round_even(s / {K * K}.0::DOUBLE, 0) + 127.0')}) AS INT) AS v FROM px p JOIN {_box('px', 'v')} b USING (page_id, y, x)")
def high_pass(spark, sf_dir):
    return I.high_pass(_pixels(spark, sf_dir), K)


def _tones_sql(v: str) -> str:
    """White 127, black 66, black 20, one truncation."""
    v = CLIP.format(f"least({v}, 127) * 255.0::DOUBLE / 127")
    for black in (66, 20):
        v = CLIP.format(f"({v} - {black}.0::DOUBLE) * 255.0::DOUBLE / {255 - black}.0::DOUBLE")
    return f"CAST(floor({v}) AS INT)"


@query(f"WITH {PX} SELECT page_id, y, x, {_tones_sql('v')} AS v FROM px")
def tone_curve(spark, sf_dir):
    return I.from_vectors(table(spark, sf_dir, "embeddings")).select("page_id", "y", "x", T.reference_tones(F.col("v")).alias("v"))


@query(f"WITH {PX} SELECT page_id, y, x, CAST(floor({CLIP.format('least(v, 127) * 255.0::DOUBLE / 127')}) AS INT) AS white, CAST(floor({CLIP.format('(v - 66.0::DOUBLE) * 255.0::DOUBLE / 189.0::DOUBLE')}) AS INT) AS black FROM px")
def stretches(spark, sf_dir):
    v = F.col("v")
    return I.from_vectors(table(spark, sf_dir, "embeddings")).select("page_id", "y", "x", T.truncated(T.white_stretch(v)).alias("white"), T.truncated(T.black_stretch(v)).alias("black"))


_LEGACY = f"CAST(floor({CLIP.format('(v - 66.0::DOUBLE) * 255.0::DOUBLE / 189.0::DOUBLE')}) AS INT)"


@query(f"WITH {PX} SELECT page_id, y, x, CAST(floor({CLIP.format(f'least({_LEGACY}, 160) * 255.0::DOUBLE / 160')}) AS INT) AS v FROM px")
def legacy_tones(spark, sf_dir):
    return I.from_vectors(table(spark, sf_dir, "embeddings")).select("page_id", "y", "x", T.legacy_tones(F.col("v")).alias("v"))


@query(f"""WITH {PX}, flat AS (SELECT p.page_id, p.y, p.x, CAST(floor({CLIP.format(f'v - round_even(s / {K * K}.0::DOUBLE, 0) + 127.0')}) AS INT) AS f FROM px p JOIN {_box('px', 'v')} b USING (page_id, y, x)),
white AS (SELECT page_id, y, x, CAST(floor({CLIP.format('least(f, 127) * 255.0::DOUBLE / 127')}) AS INT) AS v FROM flat) SELECT page_id, y, x, {_LEGACY} AS v FROM white""")
def legacy_gray(spark, sf_dir):
    return I.box_mean(_pixels(spark, sf_dir), K).select("page_id", "y", "x", T.legacy_gray(F.col("v"), F.col("mean")).alias("v"))


def _light_sql(c: str) -> str:
    mixed = f"{c} * (1.0::DOUBLE - amount) + least(255.0::DOUBLE, paper * 0.9::DOUBLE + ink * 0.1::DOUBLE) * amount"
    return f"CAST(floor({CLIP.format(mixed)} + 0.5::DOUBLE) AS INT) AS {c}"


@query(f"""WITH {RGB}, lum AS (SELECT *, r * 0.299::DOUBLE + g * 0.587::DOUBLE + b * 0.114::DOUBLE AS l FROM rgb),
parts AS (SELECT *, {CLIP.format('(l - 35.0::DOUBLE) * 1.18::DOUBLE + 255.0::DOUBLE')} AS paper, {CLIP.format('l * 1.12::DOUBLE - 18.0::DOUBLE')} AS ink,
    least(1.0::DOUBLE, greatest(0.0::DOUBLE, (220.0::DOUBLE - l) / 150.0::DOUBLE)) AS amount FROM lum)
SELECT page_id, y, x, {_light_sql('b')}, {_light_sql('g')}, {_light_sql('r')} FROM parts""")
def light_enhancer(spark, sf_dir):
    b, g, r = F.col("b"), F.col("g"), F.col("r")
    return I.colour_from_vectors(table(spark, sf_dir, "embeddings")).select("page_id", "y", "x", *[T.light_enhanced(c, b, g, r).alias(n) for c, n in ((b, "b"), (g, "g"), (r, "r"))])


_FLAT = ", ".join(CLIP.format(f"{c} - round_even(b{c}.s / {K * K}.0::DOUBLE, 0) + 127.0::DOUBLE") + f" AS {c}" for c in "bgr")


@query(f"""WITH {RGB}, flat AS (SELECT p.page_id, p.y, p.x, {_FLAT} FROM rgb p {' '.join(f'JOIN {_box("rgb", c)} b{c} USING (page_id, y, x)' for c in 'bgr')}),
lum AS (SELECT *, (r + g + b) / 3.0::DOUBLE AS l FROM flat)
SELECT page_id, y, x, {', '.join(_tones_sql(f'(l + ({c} - l) * 1.25::DOUBLE)') + f' AS {c}' for c in 'bgr')} FROM lum""")
def reference_look(spark, sf_dir):
    return I.reference_look(_colours(spark, sf_dir), K)


_AT = "px {a} ON {a}.page_id = p.page_id AND {a}.y = {y} AND {a}.x = {x}"
_LAP = "".join(f" JOIN {_AT.format(a=a, y=y, x=x)}" for a, y, x in (("n", "abs(p.y - 1)", "p.x"), ("s", "7 - abs(7 - p.y - 1)", "p.x"), ("w", "p.y", "abs(p.x - 1)"), ("e", "p.y", "7 - abs(7 - p.x - 1)")))


@query(f"WITH {PX} SELECT p.page_id, round(var_pop(n.v + s.v + w.v + e.v - 4 * p.v), 6) AS sharpness FROM px p{_LAP} GROUP BY 1")
def laplacian_sharpness(spark, sf_dir):
    return I.sharpness(_pixels(spark, sf_dir)).select("page_id", F.round("sharpness", 6).alias("sharpness"))


_GRAD = " + ".join(f"{m} * ({e}.v - {w}.v)" for m, e, w in ((1, "a", "b"), (2, "c", "d"), (1, "e", "f")))
_SOBEL = "".join(f" JOIN {_AT.format(a=a, y=y, x=x)}" for a, y, x in [(n, y, x) for (n, x), y in zip([("a", "7 - abs(7 - p.x - 1)"), ("b", "abs(p.x - 1)"), ("c", "7 - abs(7 - p.x - 1)"), ("d", "abs(p.x - 1)"), ("e", "7 - abs(7 - p.x - 1)"), ("f", "abs(p.x - 1)")], ["abs(p.y - 1)"] * 2 + ["p.y"] * 2 + ["7 - abs(7 - p.y - 1)"] * 2)])
_ENERGY = f"energy AS (SELECT p.page_id, p.y, avg(abs({_GRAD})) AS energy FROM px p{_SOBEL} GROUP BY 1, 2)"


@query(f"WITH {PX}, {_ENERGY} SELECT page_id, y, round(energy, 6) AS energy FROM energy")
def row_energy(spark, sf_dir):
    return I.row_energy(_pixels(spark, sf_dir)).select("page_id", "y", F.round("energy", 6).alias("energy"))


@query(f"""WITH {PX}, {_ENERGY}, base AS (SELECT page_id, median(energy) AS base FROM energy GROUP BY 1)
SELECT page_id, CAST(CASE WHEN base > 0 THEN least(coalesce(min(y) FILTER (WHERE energy >= 0.9::DOUBLE * base), 8), 4) ELSE 0 END AS INT) AS cut FROM energy JOIN base USING (page_id) GROUP BY page_id, base""")
def smeared_top(spark, sf_dir):
    return I.smeared_top(_pixels(spark, sf_dir), 0.5, 0.9)


@query(f"""WITH {PX}, cols AS (SELECT page_id, x, min(v) AS m FROM px GROUP BY 1, 2), rows AS (SELECT page_id, y, min(v) AS m FROM px GROUP BY 1, 2),
bx AS (SELECT page_id, least(coalesce(min(x) FILTER (WHERE m <= 100), 8), 3) AS x0, greatest(coalesce(max(x) FILTER (WHERE m <= 100) + 1, 0), 6) AS x1 FROM cols GROUP BY 1),
by_ AS (SELECT page_id, least(coalesce(min(y) FILTER (WHERE m <= 100), 8), 3) AS y0, greatest(coalesce(max(y) FILTER (WHERE m <= 100) + 1, 0), 6) AS y1 FROM rows GROUP BY 1),
b AS (SELECT *, x1 - x0 < 4 OR y1 - y0 < 4 AS whole FROM bx JOIN by_ USING (page_id))
SELECT page_id, CAST(CASE WHEN whole THEN 0 ELSE x0 END AS INT) AS x0, CAST(CASE WHEN whole THEN 0 ELSE y0 END AS INT) AS y0, CAST(CASE WHEN whole THEN 8 ELSE x1 END AS INT) AS x1, CAST(CASE WHEN whole THEN 8 ELSE y1 END AS INT) AS y1 FROM b""")
def white_bands(spark, sf_dir):
    return I.white_bands(_pixels(spark, sf_dir), 100, 0.25)


_DARK = """share AS (SELECT page_id, x, y0, avg(CAST(v < 110 AS INT)) AS s FROM px, range(0, 7) t(y0) WHERE y >= y0 AND y < y0 + 2 GROUP BY 1, 2, 3),
top AS (SELECT page_id, x, max(s) AS s FROM share GROUP BY 1, 2),
dark AS (SELECT a.page_id, a.x, sum(b.s) / 3 AS darkness FROM top a JOIN top b ON a.page_id = b.page_id AND abs(a.x - b.x) <= 1 GROUP BY 1, 2)"""


@query(f"WITH {PX}, {_DARK} SELECT page_id, x, round(darkness, 6) AS darkness FROM dark")
def edge_darkness(spark, sf_dir):
    return I.edge_darkness(_pixels(spark, sf_dir), 110, 3).select("page_id", "x", F.round("darkness", 6).alias("darkness"))


@query(f"""WITH {PX}, {_DARK.replace('110', '100')}, clean AS (SELECT page_id, avg(v) AS m FROM px GROUP BY 1),
cut AS (SELECT page_id, least(coalesce(min(x) FILTER (WHERE darkness <= 0.45::DOUBLE), 8), 4) AS cut FROM dark GROUP BY 1)
SELECT page_id, CAST(CASE WHEN m > 200 OR 8 - cut < 4 THEN 0 ELSE cut END AS INT) AS cut FROM clean JOIN cut USING (page_id)""")
def dark_left(spark, sf_dir):
    return I.dark_left(_pixels(spark, sf_dir), 0.45, 0.4, 3)


@query(f"""WITH {PX} SELECT page_id, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std, round(avg(v) FILTER (WHERE v < 200), 6) AS ink_mean,
round(100.0::DOUBLE * avg(CAST(v < 90 AS INT)), 6) AS below_90, round(100.0::DOUBLE * avg(CAST(v < 128 AS INT)), 6) AS below_128 FROM px GROUP BY 1""")
def image_stats(spark, sf_dir):
    stats = I.page_stats(_pixels(spark, sf_dir))
    return stats.select("page_id", *[F.round(c, 6).alias(c) for c in stats.columns[1:]])


@query(f"WITH {RGB} SELECT page_id, round(quantile_cont(abs(r - b) + abs(g - b) + abs(r - g), 0.99), 6) AS chroma FROM rgb GROUP BY 1")
def chroma(spark, sf_dir):
    return I.chroma(_colours(spark, sf_dir)).select("page_id", F.round("chroma", 6).alias("chroma"))


@query(f"WITH {PX} SELECT page_id, round(least(120.0::DOUBLE, greatest(10.0::DOUBLE, quantile_cont(v, 0.08))), 6) AS black FROM px GROUP BY 1")
def auto_black_point(spark, sf_dir):
    return I.auto_black_point(_pixels(spark, sf_dir)).select("page_id", F.round("black", 6).alias("black"))


_PAIR = """pair AS (SELECT p.page_id, p.y, p.x, p.v AS a, q.v AS b FROM px p JOIN px q ON q.page_id = p.page_id + 1 AND q.y = p.y AND q.x = p.x),
region AS (SELECT page_id, greatest(0, greatest(0, min(y) - 1) - 1) AS y0, least(8, least(7, max(y) + 1) + 2) AS y1, greatest(0, greatest(0, min(x) - 1) - 1) AS x0, least(8, least(7, max(x) + 1) + 2) AS x1
    FROM pair WHERE a < 90 OR b < 90 GROUP BY 1 HAVING count(*) > 2),
roi AS (SELECT page_id, y - y0 AS y, x - x0 AS x, y1 - y0 AS h, x1 - x0 AS w, a, b FROM pair JOIN region USING (page_id) WHERE y >= y0 AND y < y1 AND x >= x0 AND x < x1)"""
REGION = {"ink": 90, "grown": 1, "pad": 1, "least": 2}


@query(f"WITH {PX}, {_PAIR} SELECT page_id, round(avg(abs(a - b)), 6) AS mad, round(10 * log10(65025.0::DOUBLE / greatest(avg((a - b) * (a - b)), 1e-9::DOUBLE)), 6) AS psnr FROM roi GROUP BY 1")
def psnr_mad(spark, sf_dir):
    a = _pixels(spark, sf_dir)
    return I.difference(a, a.withColumn("page_id", F.col("page_id") - 1), **REGION).select("page_id", F.round("mad", 6).alias("mad"), F.round("psnr", 6).alias("psnr"))


_FOLD = "least((({a}) % greatest(1, 2 * ({n} - 1)) + greatest(1, 2 * ({n} - 1))) % greatest(1, 2 * ({n} - 1)), greatest(1, 2 * ({n} - 1)) - (({a}) % greatest(1, 2 * ({n} - 1)) + greatest(1, 2 * ({n} - 1))) % greatest(1, 2 * ({n} - 1)))"
_SSIM = "(2 * ma * mb + 6.5025::DOUBLE) * (2 * (mab - ma * mb) + 58.5225::DOUBLE) / ((ma * ma + mb * mb + 6.5025::DOUBLE) * ((maa - ma * ma) + (mbb - mb * mb) + 58.5225::DOUBLE))"


@query(f"""WITH {PX}, {_PAIR}, g AS (SELECT d, exp(-d * d / 4.5::DOUBLE) / (SELECT sum(exp(-e * e / 4.5::DOUBLE)) FROM range(-5, 6) u(e)) AS k FROM range(-5, 6) t(d)),
m AS (SELECT p.page_id, p.y, p.x, sum(gy.k * gx.k * q.a) AS ma, sum(gy.k * gx.k * q.b) AS mb, sum(gy.k * gx.k * q.a * q.a) AS maa, sum(gy.k * gx.k * q.b * q.b) AS mbb, sum(gy.k * gx.k * q.a * q.b) AS mab
    FROM roi p, g gy, g gx, roi q WHERE q.page_id = p.page_id AND q.y = {_FOLD.format(a="p.y + gy.d", n="p.h")} AND q.x = {_FOLD.format(a="p.x + gx.d", n="p.w")} GROUP BY 1, 2, 3)
SELECT page_id, round(avg({_SSIM}), 6) AS ssim FROM m GROUP BY 1""")
def ssim(spark, sf_dir):
    a = _pixels(spark, sf_dir)
    return I.structure_likeness(a, a.withColumn("page_id", F.col("page_id") - 1), **REGION).select("page_id", F.round("ssim", 6).alias("ssim"))


@query(f"WITH {PX} SELECT page_id, min(y) / 8.0::DOUBLE AS top, max(y) / 8.0::DOUBLE AS bottom, min(x) / 8.0::DOUBLE AS left, max(x) / 8.0::DOUBLE AS right FROM px WHERE v < 100 GROUP BY 1")
def normal_ink_box(spark, sf_dir):
    return I.normal_ink_box(_pixels(spark, sf_dir))


_LINEAR = ", ".join(f"CASE WHEN {c} / 255.0::DOUBLE > 0.04045::DOUBLE THEN pow(({c} / 255.0::DOUBLE + 0.055::DOUBLE) / 1.055::DOUBLE, 2.4::DOUBLE) ELSE {c} / 255.0::DOUBLE / 12.92::DOUBLE END AS l{c}" for c in "bgr")
_CURVE = "CASE WHEN {x} > 216.0::DOUBLE / 24389 THEN cbrt({x}) ELSE {x} * (24389.0::DOUBLE / 27 / 116) + 16.0::DOUBLE / 116 END"
_BYTE = "CAST(round_even(round(least(255.0::DOUBLE, greatest(0.0::DOUBLE, {})), 6), 0) AS INT)"


@query(f"""WITH {RGB}, toned AS (SELECT page_id, y, x, {", ".join(f"CAST(floor({CLIP.format(f'least({_LEGACY.replace(chr(118), c)}, 160) * 255.0::DOUBLE / 160')}) AS INT) AS {c}" for c in "bgr")} FROM rgb),
lin AS (SELECT page_id, y, x, {_LINEAR} FROM toned),
xyz AS (SELECT page_id, y, x, (lr * 0.412453::DOUBLE + lg * 0.357580::DOUBLE + lb * 0.180423::DOUBLE) / 0.950456::DOUBLE AS cx, lr * 0.212671::DOUBLE + lg * 0.715160::DOUBLE + lb * 0.072169::DOUBLE AS cy, (lr * 0.019334::DOUBLE + lg * 0.119193::DOUBLE + lb * 0.950227::DOUBLE) / 1.088754::DOUBLE AS cz FROM lin),
f AS (SELECT page_id, y, x, {_CURVE.format(x='cx')} AS fx, {_CURVE.format(x='cy')} AS fy, {_CURVE.format(x='cz')} AS fz, CASE WHEN cy > 216.0::DOUBLE / 24389 THEN 116 * cbrt(cy) - 16 ELSE cy * (24389.0::DOUBLE / 27) END AS l FROM xyz),
lab AS (SELECT page_id, y, x, {_BYTE.format('l * 2.55::DOUBLE')} AS l, {_BYTE.format('(fx - fy) * 500 + 128')} AS a, {_BYTE.format('(fy - fz) * 200 + 128')} AS b FROM f)
SELECT page_id, y, x, least(255, greatest(0, l - b) + greatest(0, l - a)) AS v FROM lab""")
def legacy_black_white(spark, sf_dir):
    return I.colour_from_vectors(table(spark, sf_dir, "embeddings")).select("page_id", "y", "x", T.legacy_black_white(F.col("b"), F.col("g"), F.col("r")).alias("v"))


_REACH = """RECURSIVE {PX}, ink AS (SELECT page_id, y, x, y * 8 + x AS pos FROM px WHERE v < {ink}),
near AS (SELECT a.page_id, a.pos, b.pos AS dst FROM ink a JOIN ink b ON a.page_id = b.page_id AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1),
reach AS (SELECT page_id, pos, dst FROM near UNION SELECT r.page_id, r.pos, n.dst FROM reach r JOIN near n ON r.page_id = n.page_id AND r.dst = n.pos),
part AS (SELECT page_id, pos, min(dst) AS label FROM reach GROUP BY 1, 2),
labelled AS (SELECT i.page_id, i.y, i.x, p.label FROM ink i JOIN part p USING (page_id, pos)),
stats AS (SELECT page_id, CAST(label AS BIGINT) AS label, min(x) AS x, min(y) AS y, max(x) - min(x) + 1 AS w, max(y) - min(y) + 1 AS h, count(*) AS area FROM labelled GROUP BY 1, 2)"""


@query(f"WITH {_REACH.format(PX=PX, ink=118)} SELECT page_id, label, x, y, w, h, area FROM stats")
def components(spark, sf_dir):
    return I.component_stats(I.components(I.ink_mask(_pixels(spark, sf_dir), 118)))


@query(f"""WITH {_REACH.format(PX=PX, ink=118)}, big AS (SELECT l.*, s.area >= 6 AS big, max(CAST(s.area >= 6 AS INT)) OVER (PARTITION BY l.page_id) AS any_big FROM labelled l JOIN stats s ON l.page_id = s.page_id AND l.label = s.label)
SELECT page_id, min(x) AS x0, min(y) AS y0, max(x) + 1 AS x1, max(y) + 1 AS y1 FROM big WHERE CAST(big AS INT) = any_big GROUP BY 1""")
def ink_box(spark, sf_dir):
    return I.ink_box(_pixels(spark, sf_dir), 118, 6)


@query(f"""WITH {_REACH.format(PX=PX, ink=119)}, specks AS (SELECT page_id, label FROM (SELECT *, greatest(CASE WHEN x <= 1 THEN x + w ELSE 0 END, CASE WHEN x + w >= 6 THEN 8 - x ELSE 0 END, CASE WHEN y <= 1 THEN y + h ELSE 0 END, CASE WHEN y + h >= 6 THEN 8 - y ELSE 0 END) AS reach FROM stats) WHERE reach > 0 AND reach < 4)
SELECT p.page_id, p.y, p.x, CASE WHEN s.label IS NULL THEN p.v ELSE 252 END AS v FROM px p LEFT JOIN labelled l ON p.page_id = l.page_id AND p.y = l.y AND p.x = l.x LEFT JOIN specks s ON s.page_id = l.page_id AND s.label = l.label""")
def whiten_border(spark, sf_dir):
    return I.whiten_border(_pixels(spark, sf_dir), 118, 0.5)


@query(f"WITH {PX} SELECT page_id, y, x FROM px WHERE v < 100 UNION SELECT page_id, y, x FROM px WHERE v > 150")
def mask_union(spark, sf_dir):
    px = _pixels(spark, sf_dir)
    return I.mask_union(px.where("v < 100"), px.where("v > 150"))


@query(f"WITH {PX} SELECT page_id, y, x FROM px WHERE v < 128 EXCEPT SELECT page_id, y, x FROM px WHERE v < 100 OR y = 3")
def mask_except(spark, sf_dir):
    px = _pixels(spark, sf_dir)
    return I.mask_except(px.where("v < 128"), px.where("v < 100 or y = 3"))


def _blur(rel: str, size: int, sigma: float, value: str = "v") -> str:
    """A subquery with a Gaussian of so many taps around each pixel, mirrored at the borders."""
    r, spread = size // 2, f"{2 * sigma * sigma!r}::DOUBLE"
    near = lambda a: f"CASE WHEN {a} < 0 THEN -({a}) WHEN {a} > 7 THEN 14 - ({a}) ELSE {a} END"
    weights = f"(SELECT d, exp(-d * d / {spread}) / (SELECT sum(exp(-e * e / {spread})) FROM range({-r}, {r + 1}) u(e)) AS w FROM range({-r}, {r + 1}) t(d))"
    return f"""(SELECT p.page_id, p.y, p.x, round(sum(ky.w * kx.w * q.{value}), 9) AS blur FROM {rel} p, {weights} ky, {weights} kx, {rel} q
        WHERE q.page_id = p.page_id AND q.y = {near("p.y + ky.d")} AND q.x = {near("p.x + kx.d")} GROUP BY 1, 2, 3)"""


@query(f"WITH {PX} SELECT p.page_id, p.y, p.x, CAST(least(255, greatest(0, round_even(v * 1.3::DOUBLE + round_even(blur, 0) * (1.0::DOUBLE - 1.3::DOUBLE), 0))) AS INT) AS v FROM px p JOIN {_blur('px', 7, 0.8)} b USING (page_id, y, x)")
def unsharp(spark, sf_dir):
    return I.unsharp(_pixels(spark, sf_dir))


@query(f"WITH {PX} SELECT p.page_id, p.y, p.x FROM px p JOIN {_blur('px', 7, 1.4)} b USING (page_id, y, x) WHERE v <= round_even(blur, 0) - 7")
def adaptive_ink(spark, sf_dir):
    return I.adaptive_ink(_pixels(spark, sf_dir), 7)


@query(f"""WITH {PX}, ink AS (SELECT page_id, y, x, x - row_number() OVER (PARTITION BY page_id, y ORDER BY x) AS run FROM px WHERE v < 120),
n AS (SELECT *, count(*) OVER (PARTITION BY page_id, y, run) AS n FROM ink) SELECT page_id, y, x FROM n WHERE n >= 3""")
def horizontal_runs(spark, sf_dir):
    return I.horizontal_runs(I.ink_mask(_pixels(spark, sf_dir), 120), "3").select("page_id", "y", "x")


@query("""WITH pts AS (SELECT vec_id // 50 AS page_id, vec_id % 50 AS point, [CAST(v AS DOUBLE) FOR v IN embedding] AS d FROM embeddings WHERE embedding IS NOT NULL),
t AS (SELECT point AS match, d AS td FROM pts WHERE page_id = 0), far AS (
    SELECT page_id, point, match, sqrt(sum((a - b) * (a - b))) AS dist FROM (SELECT page_id, point, match, unnest(d) AS a, unnest(td) AS b FROM pts, t) GROUP BY 1, 2, 3
), r AS (SELECT *, row_number() OVER (PARTITION BY page_id, point ORDER BY dist, match) AS nth FROM far)
SELECT page_id, point, arg_min(match, nth) AS match, round(min(dist), 6) AS near, round(max(dist), 6) AS second, min(dist) < 0.7::DOUBLE * max(dist) AS good FROM r WHERE nth <= 2 GROUP BY 1, 2""")
def two_nearest(spark, sf_dir):
    """The two nearest of every point among those of a template: vectors are descriptors, fifty in a row are a page's
    points, and the first page is the template."""
    rows = table(spark, sf_dir, "embeddings").where("embedding is not null")
    points = rows.select(F.floor(F.col("vec_id") / 50).alias("page_id"), (F.col("vec_id") % 50).alias("point"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.col("embedding").cast("array<double>").alias("descriptor"))
    found = M.two_nearest(points, M.template_points(points.where("page_id = 0")))
    good = F.col("near") < M.RATIO * F.col("second")
    return found.select("page_id", "point", "match", F.round("near", 6).alias("near"), F.round("second", 6).alias("second"), good.alias("good"))


@query()
def ruling_segments(spark, sf_dir):
    """Long strokes of the pages with the lines through them."""
    return I.ruling_segments(_pixels(spark, sf_dir), 7, "3", "3")


_WEIGHTS = """w AS (SELECT *, CASE k WHEN -1 THEN ((-0.75::DOUBLE * (t + 1) + 3.75::DOUBLE) * (t + 1) - 6.0::DOUBLE) * (t + 1) + 3.0::DOUBLE WHEN 0 THEN (1.25::DOUBLE * t - 2.25::DOUBLE) * t * t + 1
    WHEN 1 THEN (1.25::DOUBLE * (1 - t) - 2.25::DOUBLE) * (1 - t) * (1 - t) + 1 ELSE ((-0.75::DOUBLE * (2 - t) + 3.75::DOUBLE) * (2 - t) - 6.0::DOUBLE) * (2 - t) + 3.0::DOUBLE END AS w FROM taps)"""


@query(f"""WITH {PX}, turn AS (SELECT page_id, y, x, 4 + sin(radians(page_id % 7 * 5 - 15)) * (x - 4) + cos(radians(page_id % 7 * 5 - 15)) * (y - 4) AS sy, 4 + cos(radians(page_id % 7 * 5 - 15)) * (x - 4) - sin(radians(page_id % 7 * 5 - 15)) * (y - 4) AS sx FROM px),
taps AS (SELECT 'y' AS axis, page_id, y, x, CAST(floor(sy) AS INT) + k AS src, k, sy - floor(sy) AS t FROM turn, range(-1, 3) r(k) UNION ALL SELECT 'x', page_id, y, x, CAST(floor(sx) AS INT) + k, k, sx - floor(sx) FROM turn, range(-1, 3) r(k)), {_WEIGHTS}
SELECT a.page_id, a.y, a.x, CAST(least(255, greatest(0, round_even(round(sum(a.w * b.w * coalesce(p.v, 255)), 9), 0))) AS INT) AS v FROM w a JOIN w b ON a.axis = 'y' AND b.axis = 'x' AND a.page_id = b.page_id AND a.y = b.y AND a.x = b.x
LEFT JOIN px p ON p.page_id = a.page_id AND p.y = a.src AND p.x = b.src GROUP BY 1, 2, 3""")
def deskew(spark, sf_dir):
    px = _pixels(spark, sf_dir)
    angles = I.sizes(px).withColumn("angle", F.col("page_id") % 7 * 5 - 15)
    return W.remap(px, W.rotation(angles))


@query(f"""WITH {PX}, t AS (SELECT DISTINCT page_id, y2 AS y, x2 AS x, (y2 + 0.5::DOUBLE) * 8 / 5 - 0.5::DOUBLE AS sy, (x2 + 0.5::DOUBLE) * 8 / 11 - 0.5::DOUBLE AS sx FROM px, range(0, 5) a(y2), range(0, 11) b(x2)),
c AS (SELECT *, floor(sy) AS fy, floor(sx) AS fx FROM t), taps AS (SELECT page_id, y, x, least(7, greatest(0, fy + a)) AS py, least(7, greatest(0, fx + b)) AS qx, CASE a WHEN 0 THEN 1 - (sy - fy) ELSE sy - fy END * CASE b WHEN 0 THEN 1 - (sx - fx) ELSE sx - fx END AS w FROM c, range(0, 2) m(a), range(0, 2) n(b))
SELECT t.page_id, CAST(t.y AS INT) AS y, CAST(t.x AS INT) AS x, CAST(round_even(round(sum(w * v), 9), 0) AS INT) AS v FROM taps t JOIN px p ON p.page_id = t.page_id AND p.y = py AND p.x = qx GROUP BY 1, 2, 3""")
def resized(spark, sf_dir):
    px = _pixels(spark, sf_dir)
    return W.remap(px, W.resizing(I.sizes(px).withColumns({"new_w": F.lit(11), "new_h": F.lit(5)})), "linear", None)


@query()
def corner_smears(spark, sf_dir):
    """Smears in page corners painted white."""
    return I.whiten_corners(_pixels(spark, sf_dir), 100, 40, 0.5, 3)


@query()
def scan_pages(spark, sf_dir):
    """The whole page plan over colour pages."""
    return scan.scan(_colours(spark, sf_dir), scan.SMALL)


# -------------------------------------------------------------------------------------------------------- segments

SEG = """seg AS (SELECT * FROM (
    SELECT l_suppkey * 10 + l_orderkey % 10 AS page_id, l_orderkey * 10 + l_linenumber AS seg_id, 1000.0::DOUBLE AS w, 1000.0::DOUBLE AS h,
        CAST(l_partkey % 400 AS DOUBLE) AS x1, CAST(l_orderkey % 997 AS DOUBLE) AS y1, l_partkey % 400 + 20 + l_quantity * 10 AS x2, l_orderkey % 997 + (l_discount - 0.05::DOUBLE) * l_quantity * 6 AS y2
    FROM lineitem) WHERE NOT (page_id % 2 = 0 AND y1 BETWEEN 300 AND 620))"""
TAN12 = repr(G.TANGENT)


def _segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = lambda c: F.col(c).cast("double")
    rows = table(spark, sf_dir, "lineitem").select(
        (F.col("l_suppkey") * 10 + F.col("l_orderkey") % 10).alias("page_id"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seg_id"),
        F.lit(1000.0).alias("w"), F.lit(1000.0).alias("h"),
        (d("l_partkey") % 400).alias("x1"), (d("l_orderkey") % 997).alias("y1"),
        (d("l_partkey") % 400 + 20 + F.col("l_quantity") * 10).alias("x2"),
        (d("l_orderkey") % 997 + (F.col("l_discount") - 0.05) * F.col("l_quantity") * 6).alias("y2"),
    )
    return rows.where(~((F.col("page_id") % 2 == 0) & F.col("y1").between(300, 620))).repartition("page_id")


@query(f"WITH {SEG} SELECT page_id, seg_id, round(y2, 6) AS y2 FROM seg WHERE abs(x2 - x1) >= 2 * abs(y2 - y1) AND abs(y2 - y1) <= {TAN12}::DOUBLE * abs(x2 - x1) AND (y1 + y2) / 2 BETWEEN 0.1::DOUBLE * h AND 0.98::DOUBLE * h AND (x1 + x2) / 2 BETWEEN 0.03::DOUBLE * w AND 0.97::DOUBLE * w")
def ruling_filter(spark, sf_dir):
    return G.rulings(_segments(spark, sf_dir)).select("page_id", "seg_id", F.round("y2", 6).alias("y2"))


_ANGLE = "ang AS (SELECT *, degrees(atan2(y2 - y1, x2 - x1)) AS angle, sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)) AS length FROM seg)"


@query(f"""WITH {SEG}, {_ANGLE}, c AS (SELECT page_id, angle, sum(length) OVER (PARTITION BY page_id ORDER BY angle, seg_id ROWS UNBOUNDED PRECEDING) AS reached, sum(length) OVER (PARTITION BY page_id) AS total, count(*) OVER (PARTITION BY page_id) AS n FROM ang)
SELECT page_id, round(min(angle), 6) AS tilt FROM c WHERE n >= 5 AND reached >= total / 2 GROUP BY 1""")
def weighted_median(spark, sf_dir):
    return G.weighted_median_angle(_segments(spark, sf_dir)).select("page_id", F.round("tilt", 6).alias("tilt"))


_ENDS = "ends AS (SELECT page_id, seg_id, w, h, y1, y2, x1 AS px, y1 AS py FROM seg UNION ALL SELECT page_id, seg_id, w, h, y1, y2, x2, y2 FROM seg)"


@query(f"WITH {SEG}, {_ENDS} SELECT page_id, round(regr_slope(py, px), 5) AS slope, round(regr_intercept(py, px), 4) AS intercept, count(*) // 2 AS segments, max(px) - min(px) AS span FROM ends GROUP BY 1")
def line_fit(spark, sf_dir):
    return G.fitted_lines(_segments(spark, sf_dir), "page_id").select("page_id", F.round("slope", 5).alias("slope"), F.round("intercept", 4).alias("intercept"), "segments", "span")


_BANDS = "band AS (SELECT b AS band, 60 + b * 920.0::DOUBLE / 6 AS edge, 920.0::DOUBLE / 6 AS step FROM range(0, 6) t(b))"
_HELD = f"{SEG}, {_BANDS}, held AS (SELECT s.*, b.band, edge + step / 2 AS centre FROM seg s JOIN band b ON (y1 + y2) / 2 >= edge - 0.25::DOUBLE * step AND (y1 + y2) / 2 < edge + 1.25::DOUBLE * step)"


@query(f"WITH {_HELD} SELECT page_id, seg_id, CAST(band AS INT) AS band FROM held")
def band_range_join(spark, sf_dir):
    return G.in_bands(_segments(spark, sf_dir)).select("page_id", "seg_id", "band")


_SLOPES = f"""{_HELD}, pts AS (SELECT page_id, band, x1 AS px, y1 AS py FROM held UNION ALL SELECT page_id, band, x2, y2 FROM held),
fit AS (SELECT page_id, band, regr_slope(py, px) AS slope, count(*) / 2 AS n, max(px) - min(px) AS span FROM pts GROUP BY 1, 2),
slopes AS (SELECT p.page_id, b.band, edge + step / 2 AS centre, CASE WHEN n >= 2 AND span >= 400 AND abs(slope) <= {TAN12}::DOUBLE THEN slope END AS slope FROM (SELECT DISTINCT page_id FROM seg) p CROSS JOIN band b LEFT JOIN fit f ON f.page_id = p.page_id AND f.band = b.band)"""
_FILLED = f"""{_SLOPES}, near AS (SELECT *, last_value(slope IGNORE NULLS) OVER (PARTITION BY page_id ORDER BY band ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p, first_value(slope IGNORE NULLS) OVER (PARTITION BY page_id ORDER BY band ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS q, count(slope) OVER (PARTITION BY page_id) AS good FROM slopes),
filled AS (SELECT page_id, band, centre, coalesce(slope, (p + q) / 2, p, q) AS slope FROM near WHERE good >= 3),
smooth AS (SELECT page_id, band, centre, 0.25::DOUBLE * coalesce(lag(slope) OVER o, slope) + 0.5::DOUBLE * slope + 0.25::DOUBLE * coalesce(lead(slope) OVER o, slope) AS slope FROM filled WINDOW o AS (PARTITION BY page_id ORDER BY band))"""


@query(f"WITH {_SLOPES} SELECT page_id, CAST(band AS INT) AS band, round(slope, 5) AS slope FROM slopes")
def band_slopes(spark, sf_dir):
    return G.band_slopes(_segments(spark, sf_dir)).select("page_id", "band", F.round("slope", 5).alias("slope"))


@query(f"WITH {_FILLED} SELECT page_id, CAST(band AS INT) AS band, round(slope, 5) AS slope FROM smooth")
def filled_bands(spark, sf_dir):
    slopes = G.band_slopes(_segments(spark, sf_dir))
    enough = slopes.groupBy("page_id").agg(F.count("slope").alias("good")).where("good >= 3").select("page_id")
    return G.smoothed(G.filled(slopes.join(enough, "page_id"))).select("page_id", "band", F.round("slope", 5).alias("slope"))


@query(f"""WITH {_FILLED}, ys AS (SELECT CAST(y AS DOUBLE) AS y FROM range(0, 1000, 50) t(y)), ends AS (SELECT page_id, min(centre) AS lo, max(centre) AS hi FROM smooth GROUP BY 1),
pair AS (SELECT page_id, centre AS c0, lead(centre) OVER o AS c1, slope AS s0, lead(slope) OVER o AS s1 FROM smooth WINDOW o AS (PARTITION BY page_id ORDER BY band))
SELECT e.page_id, y, round(CASE WHEN y < lo THEN f.slope WHEN y >= hi THEN l.slope ELSE s0 + (s1 - s0) * ((y - c0) / (c1 - c0)) END, 5) AS slope
FROM ends e CROSS JOIN ys JOIN smooth f ON f.page_id = e.page_id AND f.centre = lo JOIN smooth l ON l.page_id = e.page_id AND l.centre = hi LEFT JOIN pair p ON p.page_id = e.page_id AND y >= c0 AND y < c1""")
def dewarp_rows(spark, sf_dir):
    seg = _segments(spark, sf_dir)
    ys = seg.select("page_id").distinct().select("page_id", F.explode(F.sequence(F.lit(0), F.lit(950), F.lit(50))).alias("y"))
    return G.row_slopes(seg, ys).select("page_id", "y", F.round("slope", 5).alias("slope"))


@query(f"""WITH {SEG}, side AS (SELECT *, CASE WHEN (y1 + y2) / 2 < 0.45::DOUBLE * h THEN 'top' WHEN (y1 + y2) / 2 > 0.55::DOUBLE * h THEN 'bottom' END AS side FROM seg),
pts AS (SELECT page_id, side, x1 AS px, y1 AS py FROM side UNION ALL SELECT page_id, side, x2, y2 FROM side),
fit AS (SELECT page_id, side, regr_slope(py, px) AS m, regr_intercept(py, px) AS c, count(*) / 2 AS n, max(px) - min(px) AS span FROM pts WHERE side IS NOT NULL GROUP BY 1, 2),
good AS (SELECT *, m * 500 + c AS mid FROM fit WHERE n >= 2 AND span >= 500 AND abs(m) <= {TAN12}::DOUBLE)
SELECT t.page_id, round(t.m, 5) AS top, round(b.m, 5) AS bottom FROM good t JOIN good b ON t.page_id = b.page_id AND t.side = 'top' AND b.side = 'bottom' WHERE abs(t.m - b.m) <= tan(radians(15)) AND b.mid - t.mid >= 250""")
def keystone(spark, sf_dir):
    return G.keystone(_segments(spark, sf_dir)).select("page_id", F.round("top", 5).alias("top"), F.round("bottom", 5).alias("bottom"))


@query(f"""WITH {SEG}, {_ANGLE}, bins AS (SELECT page_id, CAST(floor(angle / 5) * 5 AS BIGINT) AS bin, count(*) AS n, min(seg_id) AS seen FROM ang GROUP BY 1, 2)
SELECT page_id, bin, n FROM (SELECT *, sum(n) OVER (PARTITION BY page_id) AS total, row_number() OVER (PARTITION BY page_id ORDER BY n DESC, seen) AS k FROM bins) WHERE k = 1 AND total >= 5""")
def histogram_mode(spark, sf_dir):
    return G.angle_mode(_segments(spark, sf_dir))


_QUAD = "SELECT vec_id AS page_id, i // 2 AS idx, CAST(embedding[i + 1] AS DOUBLE) AS px, CAST(embedding[i + 2] AS DOUBLE) AS py FROM embeddings, range(0, 8, 2) t(i)"


@query(f"WITH p AS ({_QUAD}) SELECT page_id, arg_min(idx, px + py) AS top_left, arg_max(idx, px - py) AS top_right, arg_max(idx, px + py) AS bottom_right, arg_min(idx, px - py) AS bottom_left FROM p GROUP BY 1")
def quad_order(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    at = lambda k: F.col("embedding")[k].cast("double")
    corners = F.inline(F.array(*[F.struct(F.lit(k).cast("long").alias("idx"), at(2 * k).alias("px"), at(2 * k + 1).alias("py")) for k in range(4)]))
    points = e.select(F.col("vec_id").alias("page_id"), corners)
    named = G.ordered_corners(points).select("page_id", *[F.col(c).alias(c) for c in ("top_left", "top_right", "bottom_right", "bottom_left")])
    rows = points.join(named, "page_id")
    is_ = lambda c: F.min(F.when((F.col("px") == F.col(f"{c}.px")) & (F.col("py") == F.col(f"{c}.py")), F.col("idx"))).alias(c)
    return rows.groupBy("page_id").agg(*[is_(c) for c in ("top_left", "top_right", "bottom_right", "bottom_left")])


@query("SELECT page_id, idx, area, k AS rank FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY area DESC, idx) AS k FROM (SELECT o_custkey AS page_id, o_orderkey AS idx, o_totalprice AS area FROM orders) WHERE area / 400000 BETWEEN 0.25::DOUBLE AND 0.995::DOUBLE) WHERE k <= 7")
def contour_top(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("page_id"), F.col("o_orderkey").alias("idx"), F.col("o_totalprice").alias("area"), F.lit(800.0).alias("w"), F.lit(500.0).alias("h"))
    return G.largest_contours(rows).select("page_id", "idx", "area", "rank")


@query("SELECT page_id, name, tilt FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY abs(tilt), ord) AS k FROM (SELECT vec_id AS page_id, i AS ord, CASE i WHEN 1 THEN 'as is' WHEN 2 THEN 'rotated' ELSE 'dewarped' END AS name, CAST(embedding[i] AS DOUBLE) AS tilt FROM embeddings, range(1, 4) t(i))) WHERE k = 1")
def candidate_pick(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("page_id"), F.posexplode(F.slice("embedding", 1, 3)).alias("order", "tilt"))
    names = F.array(*map(F.lit, ("as is", "rotated", "dewarped")))
    return G.best_candidates(rows.select("page_id", "order", F.element_at(names, F.col("order") + 1).alias("name"), F.col("tilt").cast("double").alias("tilt")))


# ---------------------------------------------------------------------------------------------------------- layout

SIZE = "part_size AS (SELECT p_partkey AS page_id, CAST(p_size * 50 + 200 AS BIGINT) AS w, CAST(floor(p_retailprice) AS BIGINT) % 2000 + 300 AS h FROM part)"


def _sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("page_id"), (F.col("p_size") * 50 + 200).cast("long").alias("w"), (F.floor("p_retailprice") % 2000 + 300).cast("long").alias("h"))


_RE = "round_even({}, 0)"


@query(f"""WITH {SIZE}, a AS (SELECT page_id, w * 3 AS bw, h * 3 AS bh, CAST({_RE.format('w * 3 / 0.9::DOUBLE')} AS BIGINT) AS cw0, CAST({_RE.format('h * 3 / 0.9::DOUBLE')} AS BIGINT) AS ch FROM part_size),
b AS (SELECT *, greatest(cw0, CAST({_RE.format('ch * 0.7::DOUBLE')} AS BIGINT)) AS cw FROM a), s AS (SELECT *, CASE WHEN cw * ch > 4000000 THEN sqrt(4000000.0::DOUBLE / (cw * ch)) END AS k FROM b),
f AS (SELECT page_id, {', '.join(f"CASE WHEN k IS NULL THEN {c} ELSE greatest(1, CAST({_RE.format(f'{c} * k')} AS BIGINT)) END AS {n}" for c, n in (('cw', 'canvas_w'), ('ch', 'canvas_h'), ('bw', 'content_w'), ('bh', 'content_h')))} FROM s)
SELECT *, greatest(0, least(CAST({_RE.format('(canvas_w - content_w) / 2.0::DOUBLE')} AS BIGINT), canvas_w - content_w)) AS ox, greatest(0, least(CAST({_RE.format('canvas_h * 0.05::DOUBLE')} AS BIGINT), canvas_h - content_h)) AS oy FROM f""")
def reframe_canvas(spark, sf_dir):
    canvas = S.reframe_canvas(F.col("w") * 3, F.col("h") * 3, (0.05, 0.05, 0.05, 0.05), 0.7, 4_000_000)
    return _sizes(spark, sf_dir).select("page_id", canvas.alias("c")).select("page_id", "c.*")


@query(f"""WITH {SIZE}, p AS (SELECT *, CASE WHEN h >= w THEN 595.0::DOUBLE ELSE 842.0::DOUBLE END AS page_w, CASE WHEN h >= w THEN 842.0::DOUBLE ELSE 595.0::DOUBLE END AS page_h FROM part_size), s AS (SELECT *, least((page_w - 20) / w, (page_h - 20) / h) AS s FROM p)
SELECT page_id, page_w, page_h, round((page_w - w * s) / 2, 6) AS x0, round((page_h - h * s) / 2, 6) AS y0, round((page_w - w * s) / 2 + w * s, 6) AS x1, round((page_h - h * s) / 2 + h * s, 6) AS y1 FROM s""")
def page_layout(spark, sf_dir):
    rows = _sizes(spark, sf_dir).select("page_id", S.page_layout(F.col("w"), F.col("h"), "A4", 10.0).alias("p")).select("page_id", "p.*")
    return rows.select("page_id", *[F.round(c, 6).alias(c) for c in rows.columns[1:]])


@query(f"""WITH {SIZE}, s AS (SELECT *, least(200.0::DOUBLE / 72, 2500.0::DOUBLE / w, sqrt(12000000.0::DOUBLE / (w * h))) AS scale FROM part_size)
SELECT page_id, round(scale, 9) AS scale, round(least(2.0::DOUBLE, 1500.0::DOUBLE / w), 9) AS fallback, CAST(greatest(1, floor(w * scale + 0.5::DOUBLE)) AS INT) AS canvas_w, round(least(1.0::DOUBLE, 960.0::DOUBLE / greatest(w, h)), 9) AS thumbnail,
CAST(greatest(3, round_even(least(w, h) * 0.003::DOUBLE, 0)) AS INT) AS frame, CAST(k + (1 - k % 2) AS INT) AS kernel FROM (SELECT *, least(101, greatest(21, CAST(floor(least(w, h) / 8) AS INT))) AS k FROM s)""")
def page_scales(spark, sf_dir):
    w, h = F.col("w"), F.col("h")
    scale = S.render_scale(w, h)
    return _sizes(spark, sf_dir).select("page_id", F.round(scale, 9).alias("scale"), F.round(S.fallback_render_scale(w), 9).alias("fallback"), S.canvas_side(w, scale).alias("canvas_w"), F.round(S.thumbnail_scale(w, h), 9).alias("thumbnail"), S.frame_thickness(w, h).alias("frame"), S.odd_kernel(F.least(w, h)).alias("kernel"))


_USABLE = "greatest(1, cores - CASE WHEN cores >= 8 THEN 1 ELSE 0 END)"


@query(f"""WITH p AS (SELECT p_partkey AS id, p_size AS pages, p_partkey % 12 + 1 AS cores FROM part), q AS (SELECT *, {_USABLE} AS usable FROM p), r AS (SELECT *, CASE WHEN pages < 2 THEN 1 ELSE greatest(1, least(pages, 6, usable)) END AS workers FROM q)
SELECT id, CAST(workers AS BIGINT) AS workers, CASE WHEN pages < 2 THEN 'a single page' WHEN workers = 1 AND usable = 1 THEN 'a single core' WHEN workers >= pages THEN pages || CASE WHEN pages = 1 THEN ' page' ELSE ' pages' END WHEN workers = usable THEN usable || CASE WHEN usable = 1 THEN ' core' ELSE ' cores' END ELSE 'the cap' END AS reason FROM r""")
def pool_plan(spark, sf_dir):
    pages, cores = F.col("p_size"), F.col("p_partkey") % 12 + 1
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), S.pool_workers(pages, cores).cast("long").alias("workers"), S.pool_reason(pages, cores).alias("reason"))


# --------------------------------------------------------------------------------------------------------- batches


@query("SELECT doc_id, source, n_chars, lang FROM (SELECT *, row_number() OVER (PARTITION BY coalesce(source, ''), coalesce(CAST(n_chars AS VARCHAR), ''), coalesce(lang, '') ORDER BY doc_id) AS k FROM documents) WHERE k = 1")
def dedupe_first(spark, sf_dir):
    return B.first_uploads(table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars", "lang"), ["source", "n_chars", "lang"], "doc_id")


@query("SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations) WHERE k <= 1 + conv_id % 4")
def page_limit(spark, sf_dir):
    return B.page_limit(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role"), 1 + F.col("conv_id") % 4, "conv_id", "turn")


@query("WITH n AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations) SELECT conv_id, CAST((k - 1) // 3 AS BIGINT) AS chunk, min(k) AS first, max(k) AS last, string_agg(CAST(k AS VARCHAR), ',' ORDER BY k) AS pages FROM n GROUP BY 1, 2")
def chunk_plan(spark, sf_dir):
    rows = B.chunks(table(spark, sf_dir, "conversations").select("conv_id", "turn"), 3, "conv_id", "turn")
    return rows.select("conv_id", F.col("chunk").cast("long").alias("chunk"), F.col("first").cast("long").alias("first"), F.col("last").cast("long").alias("last"), "pages")


@query("SELECT conv_id, string_agg(s, '|' ORDER BY s) AS signature FROM (SELECT conv_id, concat_ws(':', role, turn, length(text)) AS s FROM conversations) GROUP BY 1")
def selection_signature(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "role", "turn", F.length("text").alias("size"))
    return B.selection_signature(rows, "conv_id", ["role", "turn", "size"])


_CLEAN = r"nullif(regexp_replace(regexp_replace({}, '[^A-Za-z0-9._-]+', '_', 'g'), '^\.+', ''), '')"


@query(f"SELECT page_id, {_CLEAN.format('url')} AS name, coalesce({_CLEAN.format(chr(39) + '..' + chr(39))}, 'download') AS fallback, lower(regexp_extract(url, '(\\.[^./]+)$', 1)) AS suffix, lower(regexp_extract(url, '(\\.[^./]+)$', 1)) IN ('.jpg', '.jpeg', '.png', '.bmp', '.tif', '.tiff', '.webp') AS image FROM pages")
def artifact_names(spark, sf_dir):
    url = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", S.sanitize_name(url).alias("name"), S.safe_filename(F.lit(".."), F.lit("download")).alias("fallback"), S.suffix(url).alias("suffix"), S.is_image_name(url).alias("image"))


@query("SELECT doc_id, CASE WHEN n < 1024 THEN n || ' B' WHEN n < 1048576 THEN format('{:.1f} KB', floor(n / 1024 * 10 + 0.5::DOUBLE) / 10) ELSE format('{:.1f} MB', floor(n / 1048576 * 10 + 0.5::DOUBLE) / 10) END AS size FROM (SELECT doc_id, n_chars * 37 AS n FROM documents)")
def format_bytes(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", S.format_bytes(F.col("n_chars") * 37).alias("size"))


@query("SELECT page_id, replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), chr(160), '&nbsp;') AS html FROM pages")
def escape_html(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", S.escape_html(F.col("html")).alias("html"))


@query("""SELECT name, CASE WHEN toxic = 1 THEN '{"name":"' || name || '","error":"toxic"}' ELSE '{"name":"' || name || '","id":"' || doc_id || '","width":' || n_chars % 800 || ',"height":' || n_chars % 1100 || '}' END AS json FROM (SELECT d.doc_id, n_chars, toxic, source || '_' || doc_id AS name FROM documents d JOIN labels l USING (doc_id))""")
def error_rows(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    return B.described(rows.select(F.concat_ws("_", "source", F.col("doc_id").cast("string")).alias("name"), F.col("doc_id").cast("string").alias("id"), (F.col("n_chars") % 800).alias("width"), (F.col("n_chars") % 1100).alias("height"), F.when(F.col("toxic") == 1, "toxic").alias("error")))


@query("SELECT page_id, CASE kind WHEN 'upload' THEN 400 WHEN 'job' THEN 404 ELSE 500 END AS status, file FROM (SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'upload' WHEN 1 THEN 'job' ELSE 'other' END AS kind, format('page_{:04d}.jpg', page_id + 1) AS file FROM pages)")
def http_errors(spark, sf_dir):
    kind = F.element_at(F.array(*map(F.lit, ("upload", "job", "other"))), (F.col("page_id") % 3 + 1).cast("int"))
    return table(spark, sf_dir, "pages").select("page_id", S.http_status(kind).alias("status"), S.page_file(F.col("page_id")).alias("file"))


def _picked(values: list[str], key: str) -> str:
    """One of these texts for each row, in turn, as SQL."""
    return f"([{', '.join(repr(v) for v in values)}])[{key} % {len(values)} + 1]"


def _pick(values: list[str], key: str):
    return F.element_at(F.array(*map(F.lit, values)), (F.col(key) % len(values) + 1).cast("int"))


_ENDS_OF_NAMES = [".jpg", ".PNG", ".pdf", "", ".tiff", ".webp", ".txt", ".Jpeg", ".x.bmp"]


@query(f"SELECT doc_id, name FROM (SELECT doc_id, 'scan' || doc_id || {_picked(_ENDS_OF_NAMES, 'doc_id')} AS name FROM documents) WHERE lower(regexp_extract(name, '(\\.[^./]+)$', 1)) IN ('.jpg', '.jpeg', '.png', '.bmp', '.tif', '.tiff', '.webp')")
def accepted_uploads(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("scan"), "doc_id", _pick(_ENDS_OF_NAMES, "doc_id")).alias("name"))
    return B.accepted(rows)


_STARTS = ["scanned_", "../scanned_", ".scanned_", "page ", "other_"]


@query(f"SELECT name FROM (SELECT {_picked(_STARTS, 'doc_id')} || doc_id || {_picked(['.pdf', '.png'], 'doc_id')} AS name FROM documents) WHERE regexp_full_match(name, 'scanned_[A-Za-z0-9._-]*\\.pdf')")
def download_names(spark, sf_dir):
    from pagewright.sinks.documents import downloadable

    return downloadable(table(spark, sf_dir, "documents").select(F.concat(_pick(_STARTS, "doc_id"), "doc_id", _pick([".pdf", ".png"], "doc_id")).alias("name")))


_VALUES = ["1", " TRUE ", "yes", "off", "x12", " 42 ", "", "On", "-7"]


@query(f"SELECT doc_id, lower(trim(v)) IN ('1', 'true', 'yes', 'on') AS flag, coalesce(TRY_CAST(trim(v) AS INT), 7) AS number FROM (SELECT doc_id, {_picked(_VALUES, 'doc_id')} AS v FROM documents)")
def setting_values(spark, sf_dir):
    value = _pick(_VALUES, "doc_id")
    return table(spark, sf_dir, "documents").select("doc_id", S.env_flag(value).alias("flag"), S.env_int(value, 7).alias("number"))


@query("SELECT page_id, substr(sha256(url), 1, 12) AS id FROM pages")
def artifact_ids(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", S.artifact_id(F.col("url")).alias("id"))


@query(f"""WITH {SIZE}, p AS (SELECT *, CASE WHEN h > w THEN 612.0::DOUBLE ELSE 792.0::DOUBLE END AS page_w, CASE WHEN h > w THEN 792.0::DOUBLE ELSE 612.0::DOUBLE END AS page_h FROM part_size), s AS (SELECT *, least(page_w / w, page_h / h) AS s FROM p)
SELECT page_id, page_w, page_h, round((page_w - w * s) / 2, 6) AS x0, round((page_h - h * s) / 2, 6) AS y0, round((page_w - w * s) / 2 + w * s, 6) AS x1, round((page_h - h * s) / 2 + h * s, 6) AS y1 FROM s""")
def letter_layout(spark, sf_dir):
    """The layout of a browser's PDF: squares lie."""
    rows = _sizes(spark, sf_dir).select("page_id", S.page_layout(F.col("w"), F.col("h"), "Letter", 0.0, wide_squares=True).alias("p")).select("page_id", "p.*")
    return rows.select("page_id", *[F.round(c, 6).alias(c) for c in rows.columns[1:]])


# ------------------------------------------------------------------------------------------------------------ jobs

EV = "ev AS (SELECT user_id AS job_id, ts, event_id AS seq, CASE event_type WHEN 'view' THEN 'page_done' WHEN 'click' THEN 'scanning' WHEN 'signup' THEN 'loading' WHEN 'purchase' THEN 'done' ELSE 'error' END AS type FROM events)"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _as_jobs(table(spark, sf_dir, "events"))


def _as_jobs(events: DataFrame) -> DataFrame:
    kinds = F.create_map(*[F.lit(x) for pair in {"view": "page_done", "click": "scanning", "signup": "loading", "purchase": "done"}.items() for x in pair])
    return events.select(F.col("user_id").alias("job_id"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"), F.coalesce(kinds[F.col("event_type")], F.lit("error")).alias("type"))


_OPEN = f"{EV}, marked AS (SELECT *, coalesce(max(CAST(type IN ('done', 'error', '_eof') AS INT)) OVER (PARTITION BY job_id ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS over FROM ev), open AS (SELECT job_id, ts, seq, type FROM marked WHERE over = 0)"


@query(f"WITH {_OPEN} SELECT job_id, seq, type FROM open")
def until_first_terminal(spark, sf_dir):
    return J.until_terminal(_events(spark, sf_dir)).select("job_id", "seq", "type")


@query(f"WITH {EV}, n AS (SELECT job_id, seq, row_number() OVER (PARTITION BY job_id ORDER BY ts, seq) AS page, count(*) OVER (PARTITION BY job_id) AS total FROM ev WHERE type = 'page_done') SELECT job_id, seq, page, total, CAST(floor(CAST(page AS DOUBLE) / total * 100 + 0.5::DOUBLE) AS INT) AS percent FROM n")
def progress_counter(spark, sf_dir):
    return J.progress(_events(spark, sf_dir)).select("job_id", "seq", F.col("page").cast("long").alias("page"), "total", "percent")


@query(f"WITH {EV} SELECT job_id, epoch(timestamp '2024-01-02 12:00:00') - epoch(date_trunc('second', min(ts))) > 600 AS expired FROM ev GROUP BY 1")
def ttl_expired(spark, sf_dir):
    return J.expired(_events(spark, sf_dir), F.lit("2024-01-02 12:00:00").cast("timestamp")).select("job_id", "expired")


@query(f"""WITH {EV} SELECT seq, 'data: {{"job_id":' || job_id || ',"type":"' || type || '"}}' || chr(10) || chr(10) AS frame FROM ev""")
def event_frames(spark, sf_dir):
    return _events(spark, sf_dir).select("seq", J.frame(J.as_json(["job_id", "type"])).alias("frame"))


@query(f"WITH {_OPEN} SELECT job_id, CAST(floor(epoch(min(ts))) AS BIGINT) AS created, arg_max(type, row(ts, seq)) AS type, count(*) AS events, arg_max(type, row(ts, seq)) IN ('done', 'error', '_eof') AS ended, round_even((floor(epoch(max(ts))) - floor(epoch(min(ts)))) / 8.0::DOUBLE, 1) AS elapsed FROM open WHERE job_id % 5 <> 0 GROUP BY 1")
def job_states(spark, sf_dir):
    """The state of every job but deleted ones, and what it took, in units of eight seconds."""
    events = _events(spark, sf_dir)
    left = J.without(events, events.where("job_id % 5 = 0").select("job_id").distinct())
    took = J.until_terminal(left).groupBy("job_id").agg(S.elapsed((F.unix_timestamp(F.max("ts")) - F.unix_timestamp(F.min("ts"))) / 8.0).alias("elapsed"))
    return J.states(left).join(took, "job_id").select("job_id", F.unix_timestamp("created").alias("created"), "type", "events", "ended", "elapsed")


@query(f"""WITH {_OPEN}, n AS (SELECT job_id, ts, lead(ts) OVER (PARTITION BY job_id ORDER BY ts, seq) AS following FROM open),
g AS (SELECT job_id, CAST(floor(epoch(ts)) AS BIGINT) AS second, CAST(floor(epoch(following)) AS BIGINT) - CAST(floor(epoch(ts)) AS BIGINT) AS gap FROM n WHERE following IS NOT NULL),
k AS (SELECT job_id, second, unnest(range(1, CAST(floor((gap - 1) / 3600) AS BIGINT) + 1)) AS nth FROM g WHERE gap > 3600)
SELECT job_id, second + nth * 3600 AS second, ': keepalive' || chr(10) || chr(10) AS frame FROM k""")
def keepalives(spark, sf_dir):
    """Comment frames for every hour without an event."""
    return J.keepalives(_events(spark, sf_dir), 3600).select("job_id", F.unix_timestamp("ts").alias("second"), "frame")


@query("""WITH j AS (SELECT user_id AS job_id, ts, CASE event_type WHEN 'signup' THEN 'created' WHEN 'error' THEN 'deleted' WHEN 'view' THEN 'page_done' WHEN 'click' THEN 'scanning' ELSE 'done' END AS type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
m AS (SELECT job_id, min(n) AS n0, arg_min(ts, n) AS made FROM j WHERE type = 'created' GROUP BY 1), k AS (SELECT j.*, epoch_ms(ts) - epoch_ms(made) <= 259200000 AS young FROM j JOIN m USING (job_id) WHERE n >= n0),
d AS (SELECT job_id, min(n) AS nd, arg_min(young, n) AS early FROM k WHERE type = 'deleted' GROUP BY 1), t AS (SELECT k.* FROM k LEFT JOIN d USING (job_id) WHERE type NOT IN ('created', 'deleted') AND young AND (nd IS NULL OR n < nd)),
e AS (SELECT job_id, min(n) AS ne FROM t WHERE type = 'done' GROUP BY 1), told AS (SELECT t.* FROM t LEFT JOIN e USING (job_id) WHERE ne IS NULL OR n <= ne),
f AS (SELECT job_id, type, row_number() OVER w - 1 AS seq, count(*) FILTER (WHERE type = 'page_done') OVER w AS page FROM told WINDOW w AS (PARTITION BY job_id ORDER BY n ROWS UNBOUNDED PRECEDING))
SELECT job_id, seq, 'data: {"type":"' || type || '"' || CASE WHEN type = 'page_done' THEN ',"page":' || page ELSE '' END || '}' || chr(10) || chr(10) AS frame FROM f
UNION ALL SELECT job_id, (SELECT count(*) FROM told WHERE told.job_id = m.job_id), 'data: {"type":"error","message":"the job took too long"}' || chr(10) || chr(10) FROM m LEFT JOIN e USING (job_id) LEFT JOIN d USING (job_id) WHERE ne IS NULL AND NOT coalesce(early, false)""")
def live_jobs(spark, sf_dir):
    """The frames of jobs that are created, told their progress, deleted or expired after three days."""
    kinds = F.create_map(*[F.lit(x) for pair in {"signup": "created", "error": "deleted", "view": "page_done", "click": "scanning", "purchase": "done"}.items() for x in pair])
    events = table(spark, sf_dir, "events")
    return JS.live(events.select(F.col("user_id").alias("job_id"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"), kinds[F.col("event_type")].alias("type")), 3 * 86_400)


@query(f"WITH {EV}, st AS (SELECT *, CASE type WHEN 'loading' THEN 1 WHEN 'detected' THEN 2 WHEN 'scanning' THEN 3 WHEN 'page_done' THEN 4 WHEN 'assembling' THEN 5 WHEN 'done' THEN 6 END AS stage FROM ev WHERE type <> 'error'), m AS (SELECT *, max(stage) OVER (PARTITION BY job_id ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reached FROM st) SELECT job_id, seq, type FROM m WHERE stage < reached")
def misordered_events(spark, sf_dir):
    return J.misordered(_events(spark, sf_dir)).select("job_id", "seq", "type")


@query(f"WITH {_OPEN}, l AS (SELECT job_id, arg_max(type, seq_key) AS type, count(*) FILTER (WHERE type = 'page_done') AS pages FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY ts, seq) AS seq_key FROM open) GROUP BY 1) SELECT job_id, CASE type WHEN 'loading' THEN 'Loading PDF pages' WHEN 'done' THEN 'Scan complete!' WHEN 'error' THEN 'Scan failed' ELSE 'Scanning' END AS title, pages, type NOT IN ('done', 'error') AS running FROM l")
def client_panels(spark, sf_dir):
    return J.panels(_events(spark, sf_dir))


@query(f"""WITH {_OPEN}, n AS (SELECT job_id, type, row_number() OVER (PARTITION BY job_id ORDER BY ts, seq) - 1 AS seq, count(*) FILTER (WHERE type = 'page_done') OVER (PARTITION BY job_id ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS page FROM open)
SELECT job_id, seq, 'data: {{"type":"' || type || '"' || CASE WHEN type = 'page_done' THEN ',"page":' || page ELSE '' END || '}}' || chr(10) || chr(10) AS frame FROM n""")
def job_stream(spark, sf_dir):
    """The events as a stream with state per job, run until it has caught up; the frames it wrote. An increment takes so
    many files at most, which bounds the events of a job that meet in a task; events are in order within it."""
    kinds = table(spark, sf_dir, "events")
    stream = spark.readStream.schema(kinds.schema).option("maxFilesPerTrigger", 64).parquet(f"{sf_dir}/events.parquet*")  # a glob: the stream takes a file as well as a folder
    events = _as_jobs(stream).withWatermark("ts", "1 hour")
    where = f"{shared_dir(spark)}/job-stream-{uuid.uuid4().hex}"
    run = J.stream_frames(events, ttl=10 * 365 * 86_400).writeStream.format("parquet").option("path", f"{where}/frames").option("checkpointLocation", f"{where}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema("job_id long, seq long, frame string").parquet(f"{where}/frames")
