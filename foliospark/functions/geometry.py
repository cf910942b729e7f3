"""Box geometry as column expressions. Boxes are pixel corners x1, y1, x2, y2."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Share of width and height by which each side of a detected box grows.
EXPAND_X, EXPAND_Y = 0.01, 0.02
MIN_AREA = 16
#: Line merging: centre distance and gap against the larger height, overlap against the smaller width.
MAX_CENTRE, MAX_OVERLAP, MAX_GAP = 0.30, 0.50, 0.25


def as_column(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _corners(box: tuple) -> list[Column]:
    return [as_column(c) for c in box]


def clip_box(box: tuple, width: Column, height: Column) -> dict[str, Column]:
    """Round half to even, clamp into the image, put corners in order."""
    x1, y1, x2, y2 = (F.rint(c).cast("int") for c in _corners(box))
    limit = lambda v, most: F.greatest(F.lit(0), F.least(v, (most).cast("int")))
    a, b, c, d = limit(x1, width - 1), limit(y1, height - 1), limit(x2, width), limit(y2, height)
    return {"x1": F.least(a, c), "y1": F.least(b, d), "x2": F.greatest(a, c), "y2": F.greatest(b, d)}


def expand_box(box: tuple, width: Column, height: Column, share_x: float = EXPAND_X, share_y: float = EXPAND_Y) -> dict[str, Column]:
    """Grow every side by a share of the box, then clip."""
    x1, y1, x2, y2 = _corners(box)
    dx, dy = (x2 - x1) * F.lit(share_x), (y2 - y1) * F.lit(share_y)
    return clip_box((x1 - dx, y1 - dy, x2 + dx, y2 + dy), width, height)


def box_area(box: tuple) -> Column:
    x1, y1, x2, y2 = _corners(box)
    return F.greatest(F.lit(0), x2 - x1) * F.greatest(F.lit(0), y2 - y1)


def _thousandth(v: Column) -> Column:
    return F.least(F.lit(1000), F.greatest(F.lit(0), v.cast("int")))


def normalize_box(box: tuple, width: Column, height: Column) -> dict[str, Column]:
    """Thousandths of the image, truncated towards zero and clamped to 0..1000."""
    sides = (width, height, width, height)
    return {n: _thousandth(F.lit(1000) * c / s) for n, c, s in zip(("nx1", "ny1", "nx2", "ny2"), _corners(box), sides)}


def clamp_box(box: Column) -> Column:
    """Array of four numbers, truncated and clamped to 0..1000."""
    return F.transform(box, _thousandth)


def stored_or_computed(stored: Column, computed: Column) -> Column:
    """The stored normalized boxes where there are some, clamped; else the computed ones."""
    return F.coalesce(F.transform(stored, clamp_box), computed)


def merge_boxes(a: tuple, b: tuple) -> dict[str, Column]:
    """Envelope of two boxes (x1, y1, x2, y2, conf, cls); the class is that of the surer one, a's if equal."""
    ax1, ay1, ax2, ay2, ac, ak = _corners(a)
    bx1, by1, bx2, by2, bc, bk = _corners(b)
    return {"x1": F.least(ax1, bx1), "y1": F.least(ay1, by1), "x2": F.greatest(ax2, bx2), "y2": F.greatest(ay2, by2), "conf": F.greatest(ac, bc), "cls_id": F.when(ac >= bc, ak).otherwise(bk)}


def same_line(a: tuple, b: tuple) -> Column:
    """Whether two boxes belong to one text line: level, hardly overlapping, close."""
    ax1, ay1, ax2, ay2 = _corners(a)
    bx1, by1, bx2, by2 = _corners(b)
    tall = F.greatest(ay2 - ay1, by2 - by1)
    narrow = F.least(ax2 - ax1, bx2 - bx1)
    level = F.abs((ay1 + ay2) / F.lit(2.0) - (by1 + by2) / F.lit(2.0)) <= F.lit(MAX_CENTRE) * tall
    overlap = F.greatest(F.lit(0), F.least(ax2, bx2) - F.greatest(ax1, bx1))
    apart = F.when(narrow > 0, overlap / narrow <= F.lit(MAX_OVERLAP)).otherwise(F.lit(True))
    gap = F.greatest(F.lit(0), F.greatest(ax1, bx1) - F.least(ax2, bx2))
    return (tall > 0) & level & apart & (gap <= F.lit(MAX_GAP) * tall)


def yolo_fields(box: tuple, width: Column, height: Column) -> dict[str, Column]:
    """Centre and size as clamped shares of the image."""
    x1, y1, x2, y2 = _corners(box)
    share = lambda v: F.least(F.lit(1.0), F.greatest(F.lit(0.0), v))
    return {"xc": share((x1 + x2) / F.lit(2.0) / width), "yc": share((y1 + y2) / F.lit(2.0) / height), "w": share((x2 - x1) / width), "h": share((y2 - y1) / height)}


def six_decimals(x: Column) -> Column:
    """A share in 0..1 with six decimals, rounded by its exact binary value, halves to even.

    The value is split in two, so that the part beyond the sixth decimal is
    computed without a rounding that could make or break a half.
    """
    high = F.rint(x * F.lit(2.0**26)) / F.lit(2.0**26)
    whole = F.floor(x * F.lit(1e6))
    rest = (high * F.lit(1e6) - whole) + (x - high) * F.lit(1e6)
    up = (rest > 0.5) | ((rest == 0.5) & (whole % 2 == 1))
    n = whole + up.cast("long")
    return F.concat((F.floor(n / F.lit(1_000_000))).cast("string"), F.lit("."), F.lpad((n % 1_000_000).cast("string"), 6, "0"))


def yolo_line(cls: Column, fields: dict[str, Column]) -> Column:
    """Label text with six decimals."""
    return F.concat_ws(" ", cls.cast("string"), *(six_decimals(fields[k]) for k in ("xc", "yc", "w", "h")))


def yolo_pixels(xc: Column, yc: Column, w: Column, h: Column, width: Column, height: Column) -> dict[str, Column]:
    """Pixel corners of label fields: truncated, clipped to the image."""
    at = lambda v, most: F.greatest(F.lit(0), F.least(most.cast("int"), v.cast("int")))
    return {"x1": at((xc - w / 2) * width, width), "y1": at((yc - h / 2) * height, height), "x2": at((xc + w / 2) * width, width), "y2": at((yc + h / 2) * height, height)}
