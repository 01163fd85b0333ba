"""Boxes on a page, as columns x0, y0, x1, y1."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def width(x0: Column, x1: Column) -> Column:
    return x1 - x0


def centre(a: Column, b: Column) -> Column:
    return (a + b) / 2


def vertical_overlap(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Shared height as a part of the lower box."""
    shared = F.greatest(F.lit(0.0), F.least(a1, b1) - F.greatest(a0, b0))
    return shared / F.greatest(F.lit(1.0), F.least(a1 - a0, b1 - b0))


def normal_box(x0: Column, y0: Column, x1: Column, y1: Column, page_width: Column, page_height: Column) -> list[Column]:
    """x, y, width, height as parts of the page, six decimals, inside the page and never empty."""
    tiny = F.lit(1e-6)
    inside = lambda v: F.least(F.lit(1.0), F.greatest(F.lit(0.0), v))
    left, top = inside(x0 / page_width), inside(y0 / page_height)
    return [
        F.round(left, 6).alias("x"),
        F.round(top, 6).alias("y"),
        F.round(F.greatest(tiny, inside(x1 / page_width) - left), 6).alias("width"),
        F.round(F.greatest(tiny, inside(y1 / page_height) - top), 6).alias("height"),
    ]


def coverage(image_area: Column, page_area: Column) -> Column:
    return F.least(F.lit(1.0), image_area / page_area)
