"""Plan of symbol crops and reports on the symbol set."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheetlore.functions.texts import stripped

# Symbol classes and crop sizes.
SYMBOL_CLASSES = ("settlement", "landmark", "road", "river", "forest", "mountain")
PADDING = 32
SMALLEST_SIDE = 16
ENOUGH_IMAGES = 100


def candidates(df: DataFrame, minimum: float = 0.7) -> DataFrame:
    return df.filter(
        F.col("feature_type").isin(*SYMBOL_CLASSES)
        & (F.col("confidence") >= minimum) & (F.col("bbox_x1") > 0) & (F.col("bbox_y1") > 0)
    )


def safe_file_name(name: Column) -> Column:
    cleaned = F.regexp_replace(name, r"[^\p{L}\p{N} _-]", "_")
    return F.substring(stripped(cleaned), 1, 50)


def crop_plan(df: DataFrame, width: int | Column, height: int | Column) -> DataFrame:
    """Padded rectangle inside the picture for each row, whether it is large enough, and its path."""
    w = F.lit(width) if isinstance(width, int) else width
    h = F.lit(height) if isinstance(height, int) else height
    rect = df.withColumns(
        {
            "crop_x1": F.greatest(F.lit(0), F.col("bbox_x1") - PADDING),
            "crop_y1": F.greatest(F.lit(0), F.col("bbox_y1") - PADDING),
            "crop_x2": F.least(w, F.col("bbox_x2") + PADDING),
            "crop_y2": F.least(h, F.col("bbox_y2") + PADDING),
        }
    )
    large = (F.col("crop_x2") - F.col("crop_x1") >= SMALLEST_SIDE) & (F.col("crop_y2") - F.col("crop_y1") >= SMALLEST_SIDE)
    path = F.concat(
        F.col("feature_type"), F.lit("/"), F.col("id").cast("string"), F.lit("_"), safe_file_name(F.col("feature_name")), F.lit(".jpg")
    )
    return rect.withColumns({"cropped": large, "path": path})


def crop_counts(plan: DataFrame) -> DataFrame:
    return plan.agg(F.count_if("cropped").alias("cropped"), F.count_if(~F.col("cropped")).alias("skipped"))


def class_distribution(df: DataFrame, label: str = "label") -> DataFrame:
    """Images per class and whether they suffice; ``rejected`` is listed but never suffices."""
    counts = df.groupBy(F.col(label).alias("label")).agg(F.count("*").alias("n"))
    return counts.withColumns(
        {
            "rejected": F.col("label") == "rejected",
            "enough": (F.col("label") != "rejected") & (F.col("n") >= ENOUGH_IMAGES),
        }
    )


def set_totals(df: DataFrame, label: str = "label") -> DataFrame:
    return df.agg(
        F.count_if(F.col(label) != "rejected").alias("total"), F.count_if(F.col(label) == "rejected").alias("rejected")
    )
