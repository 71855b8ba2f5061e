"""Export shapes and writers.

Every ``*_rows`` function returns the rows of an export; the writers only add format and
mode. Sorted exports end in a unique key, so that Spark's range partitioning can cut a map
that holds a large share of all rows into many sorted files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheetlore.functions.names import split_map_name
from sheetlore.operators.filters import confidence_colour, not_noise, search_text
from sheetlore.session import small_side

FEATURE_COLUMNS = {
    "id": "bigint", "map_name": "string", "feature_name": "string", "original_text": "string",
    "feature_type": "string", "grid_reference": "string", "sheet_ref": "string", "district": "string",
    "survey_year": "string", "confidence": "double", "tile_x": "int", "tile_y": "int",
    "bbox_x1": "int", "bbox_y1": "int", "bbox_x2": "int", "bbox_y2": "int",
    "lat_min": "double", "lat_max": "double", "lon_min": "double", "lon_max": "double",
    "map_scale": "int", "verified": "int",
}
_TEXT_DEFAULTS = ("original_text", "feature_type", "grid_reference", "feature_name", "map_name")
_ZERO_DEFAULTS = ("confidence", "tile_x", "tile_y", "bbox_x1", "bbox_y1", "bbox_x2", "bbox_y2", "verified")


def feature_rows(df: DataFrame) -> DataFrame:
    """Typed feature rows; columns that are absent or empty take the table's defaults."""
    columns = []
    for name, data_type in FEATURE_COLUMNS.items():
        value = F.col(name) if name in df.columns else F.lit(None)
        value = value.cast(data_type)
        if name in _TEXT_DEFAULTS:
            value = F.coalesce(value, F.lit(""))
        elif name in _ZERO_DEFAULTS:
            value = F.coalesce(value, F.lit(0).cast(data_type))
        columns.append(value.alias(name))
    extra = [F.col("session_id")] if "session_id" in df.columns else []
    return df.select(*columns, *extra)


def write_feature_table(df: DataFrame, path: str) -> None:
    """Rebuild the feature table, one folder per session, files sorted by map.

    Rows are dealt out by ranges of session and map, so a session has few files and each holds
    maps that follow one another.
    """
    rows = feature_rows(df)
    if "session_id" in rows.columns:
        ranged = rows.repartitionByRange("session_id", "map_name", "id").sortWithinPartitions("session_id", "map_name", "id")
        ranged.write.mode("overwrite").partitionBy("session_id").parquet(path)
    else:
        rows.repartitionByRange("map_name", "id").sortWithinPartitions("map_name", "id").write.mode("overwrite").parquet(path)


def flat_rows(df: DataFrame) -> DataFrame:
    return not_noise(df).select(
        F.col("map_name").alias("Map_Name"),
        F.col("feature_name").alias("Feature_Name"),
        F.col("feature_type").alias("Feature_Type"),
        F.col("grid_reference").alias("Grid_Reference"),
        F.col("confidence").alias("Confidence"),
        F.col("original_text").alias("Original_OCR"),
    )


def write_flat_csv(df: DataFrame, path: str) -> None:
    ordered = not_noise(df).orderBy("map_name", "feature_type", "feature_name", "id")
    flat_rows(ordered).write.mode("overwrite").option("header", True).csv(path)


def nested_records(df: DataFrame, records_per_list: int) -> DataFrame:
    """``(map_name, feature_type, part, features)`` with about ``records_per_list`` entries each.

    The caller chooses how long a list may get; a map with more entries of a type has several. A map's object is the union of its parts. The number of parts follows from the count of a
    map's type and entries are dealt out by id, so no map or type, however large, is gathered
    into one row. Entries of a part are sorted by name.
    """
    keys = ["map_name", "feature_type"]
    entries = not_noise(df).select(
        "id", "map_name", F.coalesce(F.nullif("feature_type", F.lit("")), F.lit("unknown")).alias("feature_type"),
        F.struct(
            F.col("feature_name").alias("name"), "original_text", F.col("grid_reference").alias("grid"), "confidence"
        ).alias("entry"),
    )
    parts = entries.groupBy(*keys).agg(F.ceil(F.count("*") / records_per_list).alias("parts"))
    dealt = entries.join(small_side(parts), keys).withColumn("part", F.pmod("id", "parts"))
    lists = dealt.groupBy(*keys, "part").agg(
        F.array_sort(F.collect_list(F.struct(F.col("entry.name").alias("name"), "id", "entry"))).alias("items")
    )
    return lists.select("map_name", "feature_type", "part", F.col("items.entry").alias("features"))


def write_nested_json(df: DataFrame, path: str, records_per_list: int) -> None:
    """One folder per map; ranges of maps keep the number of folders that a task writes small."""
    lists = nested_records(df, records_per_list).repartitionByRange("map_name", "feature_type", "part")
    lists.sortWithinPartitions("map_name", "feature_type", "part").write.mode("overwrite").partitionBy("map_name").option(
        "ignoreNullFields", False
    ).json(path)


def _with_name_parts(df: DataFrame) -> DataFrame:
    parts = split_map_name(F.col("map_name"))
    return df.withColumns(
        {
            "map_number": F.coalesce(F.nullif("sheet_ref", F.lit("")), parts["map_number"]),
            "sheet_name": parts["sheet_name"],
            "year": F.coalesce(F.nullif("survey_year", F.lit("")), parts["year"]),
            "confidence_text": F.when(F.col("confidence").isNotNull(), F.printf(F.lit("%.2f"), "confidence")),
        }
    )


def analyst_rows(df: DataFrame) -> DataFrame:
    """Eight columns for analysts; a value read from the sheet wins over one in its name."""
    rows = _with_name_parts(df)
    return rows.select(
        F.coalesce(F.nullif("original_text", F.lit("")), "feature_name").alias("As Written on Map"),
        F.col("feature_name").alias("Normalised Name"),
        F.col("grid_reference").alias("Grid Number"),
        F.col("map_number").alias("Map Number"),
        F.col("sheet_name").alias("Map Name"),
        F.col("year").alias("Year"),
        F.col("feature_type").alias("Feature Type"),
        F.col("confidence_text").alias("Confidence"),
    )


def viewer_rows(df: DataFrame) -> DataFrame:
    """Row feed of the table viewer."""
    return _with_name_parts(df).select(
        "map_name", "feature_type", F.lower("feature_name").alias("name_key"), search_text().alias("search_text"),
        "feature_name", F.coalesce(F.nullif("grid_reference", F.lit("")), F.lit("-")).alias("grid"),
        "map_number", "sheet_name", "year", "confidence_text", confidence_colour().alias("colour"),
    )


REVIEW_COLUMNS = (
    "id", "map_name", "original_text", "feature_name", "feature_type", "grid_reference", "confidence",
)
VERDICT_COLUMNS = ("verified_correct", "verified_name", "verified_type", "notes")


def review_sheet(df: DataFrame) -> DataFrame:
    return df.select(*REVIEW_COLUMNS).withColumns({c: F.lit("") for c in VERDICT_COLUMNS})


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def chat_records(df: DataFrame, system_text: str) -> DataFrame:
    """One training conversation per row of ``(original_text, new_name, new_type)`` as JSON text."""
    answer = F.to_json(
        F.array(
            F.struct(
                F.col("original_text").alias("original"), F.col("new_name").alias("cleaned"),
                F.col("new_type").alias("feature_type"), F.lit(1.0).alias("confidence"),
            )
        )
    )
    # Fixed value: the opening line of a labelling request.
    question = F.concat(F.lit("Clean and classify these OCR-extracted map labels:\n\n1. "), F.col("original_text"))

    def message(role: str, content):
        return F.struct(F.lit(role).alias("role"), content.alias("content"))

    turns = F.array(message("system", F.lit(system_text)), message("user", question), message("model", answer))
    return df.select(F.to_json(F.struct(turns.alias("messages"))).alias("value"))


def append_lines(df: DataFrame, path: str) -> None:
    df.select("value").write.mode("append").text(path)


def append_corrections(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def split_manifest(df: DataFrame) -> DataFrame:
    return df.select("set", "path", "label")


def search_result_rows(df: DataFrame) -> DataFrame:
    return df.select("map_name", "feature_name", "feature_type", "grid_reference", "confidence")


def write_after_review(df: DataFrame, folder: str) -> None:
    """Flat and JSON copies of the whole table after corrections were applied."""
    ordered = df.orderBy("map_name", "feature_name", "id")
    ordered.write.mode("overwrite").option("header", True).csv(f"{folder}/csv")
    ordered.write.mode("overwrite").option("ignoreNullFields", False).json(f"{folder}/json")
