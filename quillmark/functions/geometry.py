"""Geometry expressions: half-open bounds, pixels and points."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def overlaps(a_top: Column, a_bottom: Column, b_top: Column, b_bottom: Column) -> Column:
    """Half-open ranges; touching edges don't overlap."""
    return ~((a_bottom <= b_top) | (b_bottom <= a_top))


def contains(top: Column, bottom: Column, y: Column) -> Column:
    return (top <= y) & (y < bottom)


def is_above(a_bottom: Column, b_top: Column) -> Column:
    return a_bottom <= b_top


def to_pixels(points: Column, scale: float, trim: int = 0, offset: int = 0) -> Column:
    """Half-even rounding of points times scale, minus trim, plus offset."""
    return (F.bround(points * F.lit(scale)) - trim + offset).cast("int")


def pixel_box(x0: Column, y0: Column, x1: Column, y1: Column, scale: float, offset: int = 0) -> list[Column]:
    """A box in pixels that is at least one pixel wide and high."""
    left, top = to_pixels(x0, scale), to_pixels(y0, scale, offset=offset)
    return [left, top, F.greatest(to_pixels(x1, scale), left + 1), F.greatest(to_pixels(y1, scale, offset=offset), top + 1)]


def shifted(x: Column, shift: Column | int) -> Column:
    return F.greatest(F.lit(0), x - shift)


def px_to_pt(px: Column, dpi: int) -> Column:
    return px * 72.0 / dpi


def y_flip(page_height_pt: float, top_px: Column, height_px: Column, dpi: int) -> Column:
    return F.lit(page_height_pt) - px_to_pt(top_px, dpi) - px_to_pt(height_px, dpi)
