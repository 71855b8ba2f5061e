"""Adapters from recognition engines' result shapes to detection rows.

Every adapter returns ``text, confidence, x1, y1, x2, y2`` next to the kept key columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheetlore.functions.texts import stripped

# Lowest accepted confidence, and the one assumed where an engine gives none.
MIN_CONFIDENCE = 0.3
ASSUMED_CONFIDENCE = 0.85

ANNOTATION_SCHEMA = """struct<pages: array<struct<blocks: array<struct<paragraphs: array<struct<words: array<struct<
  symbols: array<struct<text: string, confidence: double>>,
  bounding_box: struct<vertices: array<struct<x: int, y: int>>>>>>>>>>>>"""


def _bounds(points: Column, x: str = "x", y: str = "y") -> dict[str, Column]:
    xs, ys = F.transform(points, lambda p: p[x]), F.transform(points, lambda p: p[y])
    return {"x1": F.array_min(xs), "y1": F.array_min(ys), "x2": F.array_max(xs), "y2": F.array_max(ys)}


def _mean(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v) / F.size(values)


def from_annotations(df: DataFrame, payload: str = "payload", minimum: float = MIN_CONFIDENCE) -> DataFrame:
    """Words of nested page → block → paragraph → word → symbol annotations."""
    keep = [c for c in df.columns if c != payload]
    pages = df.select(*keep, F.from_json(payload, ANNOTATION_SCHEMA).alias("doc")).select(*keep, F.inline("doc.pages"))
    blocks = pages.select(*keep, F.inline("blocks"))
    words = blocks.select(*keep, F.inline("paragraphs")).select(*keep, F.inline("words"))
    known = F.filter(F.transform("symbols", lambda s: s["confidence"]), lambda c: c > 0)
    confidence = F.when(F.size(known) > 0, _mean(known)).otherwise(F.lit(ASSUMED_CONFIDENCE))
    text = stripped(F.array_join(F.transform("symbols", lambda s: s["text"]), ""))
    vertices = F.col("bounding_box.vertices")
    rows = words.select(
        *keep, text.alias("text"), confidence.alias("raw"), *[c.alias(n) for n, c in _bounds(vertices).items()], F.size(vertices).alias("n")
    )
    return rows.filter((F.col("text") != "") & (F.col("raw") >= minimum) & (F.col("n") > 0)).select(
        *keep, "text", F.round("raw", 4).alias("confidence"), "x1", "y1", "x2", "y2"
    )


def from_polygons(df: DataFrame, minimum: float = MIN_CONFIDENCE) -> DataFrame:
    """Rows with ``points`` (array of ``[x, y]`` arrays), ``text`` and ``confidence``."""
    keep = [c for c in df.columns if c not in ("points", "text", "confidence")]
    xs, ys = F.transform("points", lambda p: F.get(p, F.lit(0))), F.transform("points", lambda p: F.get(p, F.lit(1)))
    rows = df.filter((F.col("confidence") >= minimum) & (stripped("text") != ""))
    return rows.select(
        *keep, stripped("text").alias("text"), F.round("confidence", 4).alias("confidence"),
        F.array_min(xs).cast("int").alias("x1"), F.array_min(ys).cast("int").alias("y1"),
        F.array_max(xs).cast("int").alias("x2"), F.array_max(ys).cast("int").alias("y2"),
    )


def from_columns(df: DataFrame, minimum: float = MIN_CONFIDENCE) -> DataFrame:
    """Rows with parallel arrays ``text, conf, left, top, width, height``; conf is in percent."""
    arrays = ("text", "conf", "left", "top", "width", "height")
    keep = [c for c in df.columns if c not in arrays]
    rows = df.select(*keep, F.inline(F.arrays_zip(*arrays)))
    score = F.col("conf") / 100.0
    return rows.filter((stripped("text") != "") & (F.col("conf") != -1) & (score >= minimum)).select(
        *keep, stripped("text").alias("text"), F.round(score, 4).alias("confidence"), F.col("left").alias("x1"), F.col("top").alias("y1"),
        (F.col("left") + F.col("width")).alias("x2"), (F.col("top") + F.col("height")).alias("y2"),
    )
