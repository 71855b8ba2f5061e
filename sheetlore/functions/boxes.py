"""Geometry of axis-aligned boxes as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BOX = ("x1", "y1", "x2", "y2")


def area(prefix: str = "") -> Column:
    side_x = F.col(f"{prefix}x2") - F.col(f"{prefix}x1")
    side_y = F.col(f"{prefix}y2") - F.col(f"{prefix}y1")
    return side_x.cast("bigint") * side_y


def intersection(a: str = "a.", b: str = "b.") -> Column:
    wide = F.least(f"{a}x2", f"{b}x2") - F.greatest(f"{a}x1", f"{b}x1")
    high = F.least(f"{a}y2", f"{b}y2") - F.greatest(f"{a}y1", f"{b}y1")
    return F.greatest(wide, F.lit(0)).cast("bigint") * F.greatest(high, F.lit(0))


def iou(a: str = "a.", b: str = "b.") -> Column:
    """Shared area over joint area; 0 for boxes that do not meet."""
    shared = intersection(a, b)
    joint = area(a) + area(b) - shared
    return F.when((shared > 0) & (joint > 0), shared / joint).otherwise(F.lit(0.0))


def text_key(text: Column) -> Column:
    """Letters and digits of a text in lower case."""
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]", "")
