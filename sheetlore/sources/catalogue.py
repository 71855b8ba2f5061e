"""Map catalogue, stage artifacts and review files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheetlore.functions.names import file_stem
from sheetlore.functions.texts import stripped

# Picture suffixes of the full run, and those the incremental run adds.
PICTURE_SUFFIXES = ("jpg", "jpeg", "png")
EXTRA_SUFFIXES = ("tif", "tiff")

REVIEW_SCHEMA = (
    "id string, map_name string, original_text string, feature_name string, feature_type string, grid_reference string, "
    "confidence string, verified_correct string, verified_name string, verified_type string, notes string"
)
CORRECTION_SCHEMA = (
    "id bigint, map_name string, original_text string, old_name string, new_name string, old_type string, new_type string, "
    "verified_correct boolean, logged_at timestamp"
)
BOX_SCHEMA = "text string, confidence double, bbox array<int>"
MANIFEST_SCHEMA = (
    "map<string, struct<file: string, width: int, height: int, tiles: array<struct<x: int, y: int, x2: int, y2: int>>>>"
)


def scan_pictures(spark: SparkSession, folder: str, suffixes: tuple[str, ...] = PICTURE_SUFFIXES) -> DataFrame:
    """Picture files of a folder; only names and sizes are read, never the content."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    suffix = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    return files.filter(suffix.isin(*suffixes)).select("path", "length", "modificationTime")


def first_of_each_stem(files: DataFrame) -> DataFrame:
    """One file per stem without regard to case: the first path in sort order."""
    keyed = files.withColumn("map_key", F.lower(file_stem(F.col("path"))))
    return keyed.groupBy("map_key").agg(F.min("path").alias("path"))


def artifact_rows(texts: DataFrame, item_schema: str, payload: str = "value") -> DataFrame:
    """``(map_name, seq, item)`` from JSON objects that list items per map.

    One text row holds one object; large artifacts are written as one object per line, so
    that no single task has to parse all maps.
    """
    parsed = F.from_json(payload, f"map<string, array<struct<{_as_fields(item_schema)}>>>")
    maps = texts.select(F.explode(parsed).alias("map_name", "items"))
    return maps.select("map_name", F.posexplode("items").alias("seq", "item"))


def _as_fields(schema: str) -> str:
    return ", ".join(f"{part.strip().split(' ', 1)[0]}: {part.strip().split(' ', 1)[1]}" for part in schema.split(","))


def read_artifact(spark: SparkSession, path: str, item_schema: str = BOX_SCHEMA) -> DataFrame:
    return artifact_rows(spark.read.text(path), item_schema)


def manifest_tiles(texts: DataFrame, payload: str = "value") -> DataFrame:
    """``(map_name, width, height, x, y, x2, y2)`` from tile manifests."""
    maps = texts.select(F.explode(F.from_json(payload, MANIFEST_SCHEMA)).alias("map_name", "info"))
    return maps.select("map_name", "info.width", "info.height", F.inline("info.tiles"))


def box_columns(rows: DataFrame) -> DataFrame:
    """Box arrays as four columns; an empty box becomes NULL."""
    boxes = {name: F.get("item.bbox", F.lit(i)) for i, name in enumerate(("x1", "y1", "x2", "y2"))}
    return rows.select("map_name", "seq", "item.text", "item.confidence", *[c.alias(n) for n, c in boxes.items()])


def read_review(spark: SparkSession, path: str) -> DataFrame:
    """Review sheet; ids become numbers and rows without a number keep NULL."""
    rows = spark.read.schema(REVIEW_SCHEMA).option("header", True).csv(path)
    blank = {c: F.coalesce(c, F.lit("")) for c in rows.columns if c != "id"}
    return rows.withColumns(blank).withColumns(
        {"id": stripped("id").try_cast("bigint"), "row_no": F.monotonically_increasing_id()}
    )


def read_corrections(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CORRECTION_SCHEMA).json(path)


def read_features(spark: SparkSession, path: str, session_id: str | None = None) -> DataFrame:
    """Feature table; a session filter prunes the folders of other sessions."""
    rows = spark.read.option("mergeSchema", True).parquet(path)
    return rows.filter(F.col("session_id") == session_id) if session_id else rows
