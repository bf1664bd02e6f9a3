"""Parameters of the page operators."""

from __future__ import annotations

from dataclasses import dataclass

# What results are compared with depends on them.
FLATTEN_KERNEL = 101
WHITE_POINT = 127
BLACK_POINTS = (66, 20)
SATURATION = 1.25
LEGACY_WHITE_POINT = 160
INK, FAINT, DARK, CLEAN = 160, 200, 100, 200
WHITE_FILL = 240
SHARED_INK = 180
QUIET = 30
MAX_TILT = 12.0
BANDS = 6
BAND_OVERLAP = 0.25
BAND_RANGE = (0.06, 0.98)
CANVAS_PIXELS = 16_000_000
MARGINS = (0.069, 0.071, 0.070, 0.040)
ASPECT = 893 / 1263
FRINGE = 0.015
CUBIC = -0.75
PROBE_WIDTH = 1000
AUTO_TRIM = (0.008, 0.02, 0.01, 0.02)
TOP_TRIM = 0.12
RING_ZONE = 0.78
PAGE_SIZES = {"A4": (595, 842), "Letter": (612, 792)}
IMAGE_SUFFIXES = (".jpg", ".jpeg", ".png", ".bmp", ".tif", ".tiff", ".webp")
JOB_TTL = 600
RENDER_DPI = 200
RENDER_PIXELS = 12_000_000
CAP_WIDTHS = (2500, 1800)
THUMBNAIL = 960
MAX_DOCUMENT_BYTES, MAX_DOCUMENT_PAGES = 250 * 1024 * 1024, 250


@dataclass(frozen=True)
class ScanParams:
    """What one run of the page plan uses."""

    kernel: int = FLATTEN_KERNEL
    white: int = WHITE_POINT
    blacks: tuple[int, int] = BLACK_POINTS
    saturation: float = SATURATION
    ink: int = INK
    margins: tuple[float, float, float, float] = MARGINS
    aspect: float | None = ASPECT
    budget: int = CANVAS_PIXELS
    border_depth: float = 0.12
    noise_area: int = 15
    output_scale: float = 1.0
    preserve_borders: bool = False
    ink_block: int = 21
    ruling_run: str = "greatest(30, floor(width / 12))"
    ruling_length: str = "greatest(100, floor(w / 4))"
