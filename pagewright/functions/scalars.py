"""Scalar functions as columns: names, sizes, settings, progress, layout arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagewright import params as P

UNSAFE = "[^A-Za-z0-9._-]+"


def sanitize_name(name: Column) -> Column:
    """A flat artifact name: runs of other characters become _, leading dots go; null if nothing is left."""
    return F.nullif(F.regexp_replace(F.regexp_replace(F.coalesce(name, F.lit("")), UNSAFE, "_"), r"^\.+", ""), F.lit(""))


def safe_filename(name: Column, fallback: Column) -> Column:
    return F.coalesce(sanitize_name(name), fallback)


def suffix(name: Column) -> Column:
    """The lower-case suffix with its dot, or an empty string."""
    return F.lower(F.regexp_extract(name, r"(\.[^./]+)$", 1))


def is_image_name(name: Column) -> Column:
    return suffix(name).isin(*P.IMAGE_SUFFIXES)


def format_bytes(n: Column) -> Column:
    """B, KB or MB with one decimal; what is no number counts as 0."""
    n = F.coalesce(n.try_cast("double"), F.lit(0.0))
    return (
        F.when(n < 1024, F.concat(n.cast("long").cast("string"), F.lit(" B")))
        .when(n < 1048576, F.format_string("%.1f KB", n / 1024))
        .otherwise(F.format_string("%.1f MB", n / 1048576))
    )


def escape_html(text: Column) -> Column:
    text = F.coalesce(text, F.lit(""))
    for raw, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("\u00a0", "&nbsp;")):
        text = F.replace(text, F.lit(raw), F.lit(entity))
    return text


def env_flag(value: Column) -> Column:
    return F.coalesce(F.lower(F.trim(value)).isin("1", "true", "yes", "on"), F.lit(False))


def env_int(value: Column, default: int) -> Column:
    return F.coalesce(F.trim(value).try_cast("int"), F.lit(default))


def artifact_id(origin: Column, length: int = 12) -> Column:
    """An id that the origin fixes, so that a retried task names the same artifact."""
    return F.substring(F.sha2(origin, 256), 1, length)


def percent(done: Column, total: Column) -> Column:
    """Rounded half up; 0 without a total."""
    return F.when(total > 0, F.floor(done / total * 100 + 0.5)).otherwise(0).cast("int")


def elapsed(seconds: Column) -> Column:
    return F.bround(seconds, 1)


def odd_kernel(side: Column, divisor: int = 8, least: int = 21, most: int = 101) -> Column:
    k = F.least(F.lit(most), F.greatest(F.lit(least), F.floor(side / divisor).cast("int")))
    return k + (1 - k % 2)


def render_scale(w: Column, h: Column, small_screen: bool = False) -> Column:
    return F.least(F.lit(P.RENDER_DPI / 72), F.lit(float(P.CAP_WIDTHS[small_screen])) / w, F.sqrt(F.lit(float(P.RENDER_PIXELS)) / (w * h)))


def fallback_render_scale(w: Column) -> Column:
    return F.least(F.lit(2.0), F.lit(1500.0) / w)


def canvas_side(side: Column, scale: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(side * scale + 0.5).cast("int"))


def thumbnail_scale(w: Column, h: Column) -> Column:
    """To a long side of at most 960, never up."""
    return F.least(F.lit(1.0), F.lit(float(P.THUMBNAIL)) / F.greatest(w, h))


def usable_cores(cores: Column) -> Column:
    """Of eight cores and more one is kept back."""
    return F.greatest(F.lit(1), cores - F.when(cores >= 8, 1).otherwise(0))


def pool_workers(pages: Column, cores: Column, cap: int = 6) -> Column:
    return F.when(pages < 2, 1).otherwise(F.greatest(F.lit(1), F.least(pages, F.lit(cap), usable_cores(cores))))


def pool_reason(pages: Column, cores: Column, cap: int = 6, small_screen: bool = False) -> Column:
    """Which limit set the number of workers."""
    workers, usable = pool_workers(pages, cores, cap), usable_cores(cores)
    counted = lambda n, noun: F.concat(n.cast("string"), F.lit(noun), F.when(n == 1, "").otherwise("s"))
    return (
        F.when(pages < 2, "a single page")
        .when((workers == 1) & (usable == 1), "a single core")
        .when(workers >= pages, counted(pages, " page"))
        .when(workers == usable, counted(usable, " core"))
        .otherwise("a small device" if small_screen else "the cap")
    )


def frame_thickness(w: Column, h: Column) -> Column:
    return F.greatest(F.lit(3), F.bround(F.least(w, h) * 0.003).cast("int"))


def page_layout(w: Column, h: Column, size: str | None = "A4", margin: float = 0.0, wide_squares: bool = False) -> Column:
    """Page and image box in points: the page turns with the image, the image is fitted and centred."""
    if size is None:
        return F.struct(w.cast("double").alias("page_w"), h.cast("double").alias("page_h"), F.lit(0.0).alias("x0"), F.lit(0.0).alias("y0"), w.cast("double").alias("x1"), h.cast("double").alias("y1"))
    short, long = (float(s) for s in P.PAGE_SIZES.get(size, P.PAGE_SIZES["A4"]))
    upright = h > w if wide_squares else h >= w
    pw, ph = F.when(upright, short).otherwise(long), F.when(upright, long).otherwise(short)
    s = F.least((pw - 2 * margin) / w, (ph - 2 * margin) / h)
    x0, y0 = (pw - w * s) / 2, (ph - h * s) / 2
    return F.struct(pw.alias("page_w"), ph.alias("page_h"), x0.alias("x0"), y0.alias("y0"), (x0 + w * s).alias("x1"), (y0 + h * s).alias("y1"))


def reframe_canvas(bw: Column, bh: Column, margins: tuple[float, float, float, float], aspect: float | None = None, budget: int = P.CANVAS_PIXELS) -> Column:
    """Canvas size, content size and where the content goes, for margins left, right, top, bottom as shares."""
    left, right, top, bottom = margins
    rounded = lambda c: F.bround(c).cast("long")
    cw0, ch = rounded(bw / max(1e-6, 1.0 - left - right)), rounded(bh / max(1e-6, 1.0 - top - bottom))
    cw = cw0 if aspect is None else F.greatest(cw0, rounded(ch * F.lit(aspect)))
    over = cw * ch > budget
    scale = F.when(over, F.sqrt(F.lit(float(budget)) / (cw * ch))).otherwise(1.0)
    fit = lambda c: F.when(over, F.greatest(F.lit(1).cast("long"), rounded(c * scale))).otherwise(c.cast("long"))
    w, h, w2, h2 = fit(cw), fit(ch), fit(bw), fit(bh)
    inside = lambda at, room: F.greatest(F.lit(0).cast("long"), F.least(at, room))
    return F.struct(w.alias("canvas_w"), h.alias("canvas_h"), w2.alias("content_w"), h2.alias("content_h"), inside(rounded((w - w2) / 2.0), w - w2).alias("ox"), inside(rounded(h * F.lit(top)), h - h2).alias("oy"))


#: What each failure answers a request with.
HTTP_STATUS = {"upload": 400, "file_type": 400, "page_limit": 400, "scan": 500, "pdf": 500, "job": 404, "storage": 500, "result": 404}


def http_status(kind: Column) -> Column:
    pairs = F.create_map(*[F.lit(x) for pair in HTTP_STATUS.items() for x in pair])
    return F.coalesce(pairs[kind], F.lit(500))


def page_file(page_no: Column, prefix: str = "page_") -> Column:
    return F.format_string(f"{prefix}%04d.jpg", page_no + 1)
