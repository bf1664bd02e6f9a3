import pytest
from pyspark.sql import functions as F

from pagewright.functions import scalars as S


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def lit(x, kind="string"):
    return F.lit(x).cast(kind)


@pytest.mark.parametrize(
    ("given", "want"),
    [("a b/c.png", "a_b_c.png"), ("..hidden", "hidden"), ("", None), (None, None), ("...", None), ("ü", "_")],
)
def test_sanitize_name(spark, given, want):
    assert value(spark, S.sanitize_name(lit(given))) == want


@pytest.mark.parametrize(("n", "want"), [("0", "0 B"), ("1023", "1023 B"), ("1536", "1.5 KB"), ("5242880", "5.0 MB"), ("junk", "0 B"), (None, "0 B")])
def test_format_bytes(spark, n, want):
    assert value(spark, S.format_bytes(lit(n))) == want


def test_settings_and_progress(spark):
    assert [value(spark, S.env_flag(lit(x))) for x in ("1", " Yes", "off", None)] == [True, True, False, False]
    assert [value(spark, S.env_int(lit(x), 7)) for x in ("3", "x", None)] == [3, 7, 7]
    assert [value(spark, S.percent(lit(a, "int"), lit(b, "int"))) for a, b in ((1, 3), (1, 8), (0, 0))] == [33, 13, 0]
    assert value(spark, S.escape_html(lit("<a & b>"))) == "&lt;a &amp; b&gt;"
    assert value(spark, S.artifact_id(lit("x"))) == value(spark, S.artifact_id(lit("x")))


@pytest.mark.parametrize(("side", "want"), [(100, 21), (400, 51), (5000, 101), (176, 23)])
def test_odd_kernel(spark, side, want):
    assert value(spark, S.odd_kernel(lit(side, "int"))) == want


@pytest.mark.parametrize(
    ("pages", "cores", "workers", "reason"),
    [(1, 8, 1, "a single page"), (10, 1, 1, "a single core"), (3, 8, 3, "3 pages"), (20, 4, 4, "4 cores"), (20, 16, 6, "the cap")],
)
def test_pool_plan(spark, pages, cores, workers, reason):
    p, c = lit(pages, "int"), lit(cores, "int")
    assert (value(spark, S.pool_workers(p, c)), value(spark, S.pool_reason(p, c))) == (workers, reason)


def test_page_layout(spark):
    box = value(spark, S.page_layout(lit(842, "int"), lit(595, "int")))
    assert (box.page_w, box.page_h, box.x0, box.y0) == (842.0, 595.0, 0.0, 0.0)
    square = value(spark, S.page_layout(lit(100, "int"), lit(100, "int"), "Letter", 6.0))
    assert (square.page_w, square.page_h, square.x0) == (612.0, 792.0, 6.0) and abs(square.y0 - 96.0) < 1e-9
    plain = value(spark, S.page_layout(lit(30, "int"), lit(20, "int"), None))
    assert (plain.page_w, plain.y1) == (30.0, 20.0)


def test_canvas_budget(spark):
    c = value(spark, S.reframe_canvas(lit(360, "long"), lit(7900, "long"), (0.05, 0.05, 0.05, 0.05), 0.70704671))
    assert c.canvas_w * c.canvas_h <= 16_050_000 and c.ox + c.content_w <= c.canvas_w and c.oy + c.content_h <= c.canvas_h
    small = value(spark, S.reframe_canvas(lit(90, "long"), lit(90, "long"), (0.05, 0.05, 0.05, 0.05)))
    assert (small.canvas_w, small.canvas_h, small.ox, small.oy) == (100, 100, 5, 5)
