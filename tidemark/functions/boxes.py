"""Box algebra: normalised centre boxes, corner boxes, x-y-width-height boxes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numeric import clamp


def to_centre(x: Column, y: Column, w: Column, h: Column, width: Column, height: Column) -> tuple[Column, ...]:
    """Fractions of the image: centre x, centre y, width, height."""
    return (x + w / 2) / width, (y + h / 2) / height, w / width, h / height


def from_centre(cx: Column, cy: Column, w: Column, h: Column, width: Column, height: Column, *, clamped_area: bool = True) -> tuple[Column, ...]:
    """x, y (0 at least), width, height (1 at least) in pixels and the area, of those or of the box before clamping."""
    bw, bh = w * width, h * height
    x, y = F.greatest(F.lit(0.0), cx * width - bw / 2), F.greatest(F.lit(0.0), cy * height - bh / 2)
    cw, ch = F.greatest(F.lit(1.0), bw), F.greatest(F.lit(1.0), bh)
    return x, y, cw, ch, (cw * ch if clamped_area else bw * bh)


def corners(x: Column, y: Column, w: Column, h: Column) -> tuple[Column, ...]:
    return x, y, x + w, y + h


def sides(x1: Column, y1: Column, x2: Column, y2: Column) -> tuple[Column, ...]:
    return x1, y1, x2 - x1, y2 - y1


def clipped(x1: Column, y1: Column, x2: Column, y2: Column, width: Column, height: Column) -> tuple[Column, ...]:
    """Corners moved into [0, width - 1] and [0, height - 1]."""
    return clamp(x1, 0.0, width - 1), clamp(y1, 0.0, height - 1), clamp(x2, 0.0, width - 1), clamp(y2, 0.0, height - 1)


def resized(x1: Column, y1: Column, x2: Column, y2: Column, sx: Column, sy: Column) -> tuple[Column, ...]:
    return x1 * sx, y1 * sy, x2 * sx, y2 * sy


def iou(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """Intersection over union of corner boxes; 0 for empty ones."""
    w = F.greatest(F.lit(0.0), F.least(a[2], b[2]) - F.greatest(a[0], b[0]))
    h = F.greatest(F.lit(0.0), F.least(a[3], b[3]) - F.greatest(a[1], b[1]))
    union = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - w * h
    return F.when(union > 0, w * h / union).otherwise(0.0)
