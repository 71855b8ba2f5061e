"""Joins, anti-joins and merges between detections, results, maps and sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheetlore.functions.texts import stripped

DETECTION_ORDER = ("y1", "x1", "det_id")


def first_detection(detections: DataFrame) -> DataFrame:
    """First detection of each text on a map, by reading order, as one aggregate."""
    payload = F.struct(*DETECTION_ORDER, "x2", "y2", *[c for c in ("grid_reference",) if c in detections.columns])
    return detections.groupBy("map_name", "text").agg(F.min(payload).alias("first")).select("map_name", "text", "first.*")


def attach_detection(cleaned: DataFrame, detections: DataFrame) -> DataFrame:
    """Cleaned items with the box of the first detection of their text; unmatched items stay."""
    first = first_detection(detections).withColumnRenamed("text", "original")
    return cleaned.join(first, ["map_name", "original"], "left")


def attach_cells(features: DataFrame, cells: DataFrame) -> DataFrame:
    """Coordinates of the feature's grid cell by ``(map_name, row_no, col_no)``."""
    return features.join(cells, ["map_name", "row_no", "col_no"], "left")


def attach_map_facts(features: DataFrame, maps: DataFrame) -> DataFrame:
    """Sheet number, year, district and scale as read from the sheet; blank when unread."""
    facts = maps.select(
        "map_name", F.col("ocr_map_number").alias("sheet_ref"), F.col("ocr_survey_year").alias("survey_year"),
        "district", "map_scale",
    )
    joined = features.join(facts, "map_name", "left")
    return joined.withColumns({c: F.coalesce(c, F.lit("")) for c in ("sheet_ref", "survey_year", "district")})


def without_keys(df: DataFrame, done: DataFrame, key: str = "map_name") -> DataFrame:
    """Rows whose key is not in ``done``: new maps, or maps a resumed run still has to do."""
    return df.join(done.select(key), key, "left_anti")


def merge_sessions(global_rows: DataFrame, session_rows: DataFrame) -> DataFrame:
    """Global rows plus all rows of session maps the global table does not have yet."""
    return global_rows.unionByName(without_keys(session_rows, global_rows.select("map_name").distinct()))


def decisions(review: DataFrame, order: str = "row_no") -> DataFrame:
    """What reviewers decided on each id: ``fix`` (name, type) of its last ``N`` by the column ``order``, and how many ``Y`` (``confirmed``)."""
    verdict = F.upper(stripped("verified_correct"))

    def filled(new: str, old: str) -> Column:
        return F.coalesce(F.nullif(stripped(new), F.lit("")), stripped(old))

    return (
        review.select(
            "id", order, verdict.alias("verdict"),
            F.struct(filled("verified_name", "feature_name").alias("name"), filled("verified_type", "feature_type").alias("type")).alias("fix"),
        )
        .filter(F.col("verdict").isin("Y", "N") & F.col("id").isNotNull())
        .groupBy("id")
        .agg(
            F.max_by("fix", F.when(F.col("verdict") == "N", F.col(order))).alias("fix"),
            F.count_if(F.col("verdict") == "Y").alias("confirmed"),
        )
    )


def with_decisions(joined: DataFrame, mark_verified: bool = False) -> DataFrame:
    """Features changed by the ``fix`` and ``confirmed`` beside them; these columns stay."""
    raised = F.col("confidence") + 0.15 * F.col("confirmed")
    confidence = (
        F.when(F.col("fix").isNotNull(), F.lit(1.0))
        .when(F.col("confirmed") > 0, F.when(raised > 1.0, F.lit(1.0)).otherwise(raised))
        .otherwise(F.col("confidence"))
    )
    changed = {
        "feature_name": F.coalesce("fix.name", "feature_name"),
        "feature_type": F.coalesce("fix.type", "feature_type"),
        "confidence": confidence,
    }
    if mark_verified:
        changed["verified"] = F.when(F.col("fix").isNotNull() | (F.col("confirmed") > 0), 1).otherwise(F.col("verified"))
    return joined.withColumns(changed)


def apply_verdicts(features: DataFrame, review: DataFrame, mark_verified: bool = False, order: str = "row_no") -> DataFrame:
    """Write reviewers' verdicts into the table.

    ``N`` sets name and type and a confidence of 1; ``Y`` raises the confidence by 0.15 up to 1.
    Of several ``N`` for one id the last row of the review counts, by its column ``order``.
    """
    joined = features.join(decisions(review, order), "id", "left")
    return with_decisions(joined, mark_verified).select(*features.columns)


def rename_maps(features: DataFrame, renames: DataFrame) -> DataFrame:
    """Replace map names by ``renames(old_name, new_name)``."""
    joined = features.join(renames, features["map_name"] == renames["old_name"], "left")
    return joined.withColumn("map_name", F.coalesce("new_name", "map_name")).select(*features.columns)


def delete_maps(features: DataFrame, doomed: DataFrame, session_id: str | None = None) -> DataFrame:
    """Rows that remain after the maps in ``doomed`` are deleted, in one session or everywhere."""
    if session_id is None:
        return without_keys(features, doomed)
    marked = doomed.select("map_name", F.lit(session_id).alias("session_id"))
    return features.join(marked, ["map_name", "session_id"], "left_anti")


def deletion_counts(features: DataFrame, doomed: DataFrame) -> DataFrame:
    hit = features.join(doomed.select("map_name"), "map_name", "left_semi")
    return hit.groupBy("map_name").agg(F.count("*").alias("deleted"))


def patch_column(features: DataFrame, map_pattern: str, column: str, value) -> DataFrame:
    """Set ``column`` on the maps whose name is like ``map_pattern``, ignoring case."""
    return features.withColumn(
        column, F.when(F.col("map_name").ilike(map_pattern), F.lit(value)).otherwise(F.col(column))
    )


def choose_result(primary: DataFrame, fallback: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Primary result per key unless it failed; an empty result is a result."""
    second = fallback.select(*keys, F.col(value).alias("_second"))
    joined = primary.join(second, keys, "left")
    return joined.withColumns(
        {
            value: F.when(F.col("failed"), F.col("_second")).otherwise(F.col(value)),
            "source": F.when(F.col("failed"), F.lit("retry")).otherwise(F.lit("batch")),
        }
    ).select(*keys, value, "source")
