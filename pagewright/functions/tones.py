"""Tone curves as columns. A pixel value is an integer from 0 to 255 unless it is said to be a double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagewright import params as P


def clipped(x: Column) -> Column:
    return F.least(F.lit(255.0), F.greatest(F.lit(0.0), x))


def truncated(x: Column) -> Column:
    """To a pixel value as an unsigned byte conversion does."""
    return F.floor(clipped(x)).cast("int")


def flattened(v: Column, local_mean: Column) -> Column:
    """High pass against the rounded local mean, around middle gray; a double."""
    return clipped(v - local_mean + 127.0)


def white_stretch(v: Column, white: int = P.WHITE_POINT) -> Column:
    return F.least(v, F.lit(white)) * 255.0 / white


def black_stretch(v: Column, black: int = P.BLACK_POINTS[0]) -> Column:
    return clipped((v - float(black)) * 255.0 / (255.0 - black)) if black > 0 else v * F.lit(1.0)


def reference_tones(v: Column, white: int = P.WHITE_POINT, blacks: tuple[int, ...] = P.BLACK_POINTS) -> Column:
    """The white stretch and the black stretches, truncated once at the end."""
    v = clipped(white_stretch(v, white))
    for black in blacks:
        v = black_stretch(v, black)
    return truncated(v)


def saturated(c: Column, b: Column, g: Column, r: Column, by: float = P.SATURATION) -> Column:
    """A channel moved away from the pixel's mean; a double."""
    mean = (r + g + b) / 3.0
    return mean + (c - mean) * F.lit(by)


def legacy_gray(v: Column, local_mean: Column) -> Column:
    """Flatten, white 127, black 66, truncated between the steps."""
    flat = truncated(flattened(v, local_mean))
    return truncated(black_stretch(truncated(white_stretch(flat, 127)), 66))


def legacy_tones(v: Column, black: int = 66, white: int = P.LEGACY_WHITE_POINT) -> Column:
    """Black stretch, then cut off at the white point and stretched."""
    return truncated(white_stretch(truncated(black_stretch(v, black)), white))


def luminance(b: Column, g: Column, r: Column) -> Column:
    return r * 0.299 + g * 0.587 + b * 0.114


def light_enhanced(c: Column, b: Column, g: Column, r: Column) -> Column:
    """The light enhancer: dark pixels blend towards paper, rounded half up."""
    lum = luminance(b, g, r)
    paper, ink = clipped((lum - 35.0) * 1.18 + 255.0), clipped(lum * 1.12 - 18.0)
    amount = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.lit(220.0) - lum) / 150.0))
    mixed = c * (F.lit(1.0) - amount) + F.least(F.lit(255.0), paper * 0.9 + ink * 0.1) * amount
    return F.floor(clipped(mixed) + 0.5).cast("int")


def _curved(x: Column) -> Column:
    return F.when(x > 216.0 / 24389, F.cbrt(x)).otherwise(x * (24389.0 / 27 / 116) + 16.0 / 116)


def lab(b: Column, g: Column, r: Column) -> tuple[Column, Column, Column]:
    """Lightness and the two colour axes of an sRGB pixel under daylight, each from 0 to 255 as bytes."""
    linear = lambda c: F.when(c / 255.0 > 0.04045, F.pow((c / 255.0 + 0.055) / 1.055, F.lit(2.4))).otherwise(c / 255.0 / 12.92)
    lb, lg, lr = linear(b), linear(g), linear(r)
    fx = _curved((lr * 0.412453 + lg * 0.357580 + lb * 0.180423) / 0.950456)
    y = lr * 0.212671 + lg * 0.715160 + lb * 0.072169
    fz = _curved((lr * 0.019334 + lg * 0.119193 + lb * 0.950227) / 1.088754)
    light = F.when(y > 216.0 / 24389, 116.0 * F.cbrt(y) - 16.0).otherwise(y * (24389.0 / 27))
    byte = lambda x: F.bround(F.round(clipped(x), 6)).cast("int")
    return byte(light * 2.55), byte((fx - _curved(y)) * 500.0 + 128.0), byte((_curved(y) - fz) * 200.0 + 128.0)


def legacy_black_white(b: Column, g: Column, r: Column) -> Column:
    """Gray of a colour page for printing: how much lighter a pixel is than it is coloured, after the legacy tones."""
    light, across, along = lab(*(legacy_tones(c) for c in (b, g, r)))
    over = lambda x: F.greatest(F.lit(0), light - x)
    return F.least(F.lit(255), over(along) + over(across))
