"""Review reports, corrections log and training rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheetlore.functions.texts import stripped


def verdict() -> Column:
    return F.upper(stripped("verified_correct"))


def _filled(new: str, old: Column) -> Column:
    return F.coalesce(F.nullif(stripped(new), F.lit("")), old)


def accuracy_report(review: DataFrame) -> DataFrame:
    """Reviewed, correct and incorrect rows and the share of correct ones in percent."""
    counts = review.agg(F.count_if(verdict() == "Y").alias("correct"), F.count_if(verdict() == "N").alias("incorrect"))
    reviewed = F.col("correct") + F.col("incorrect")
    return counts.select(
        reviewed.alias("reviewed"), "correct", "incorrect",
        F.when(reviewed > 0, F.round(F.col("correct") / reviewed * 100, 1)).alias("accuracy"),
    )


def errors_by_type(review: DataFrame) -> DataFrame:
    wrong = review.filter(verdict() == "N")
    kind = F.coalesce(F.nullif("feature_type", F.lit("")), F.lit("unknown"))
    return wrong.groupBy(kind.alias("feature_type")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "feature_type")


def error_sample(review: DataFrame, k: int = 10) -> DataFrame:
    same = F.lit("(same)")
    wrong = review.filter(verdict() == "N").orderBy("id", "row_no").limit(k)
    return wrong.select(
        "id", F.col("feature_name").alias("old_name"), F.coalesce(F.nullif("verified_name", F.lit("")), same).alias("new_name"),
        F.col("feature_type").alias("old_type"), F.coalesce(F.nullif("verified_type", F.lit("")), same).alias("new_type"),
    )


def training_rows_from_review(review: DataFrame) -> DataFrame:
    wrong = review.filter((verdict() == "N") & (stripped("original_text") != ""))
    rows = wrong.select(
        "id", "original_text",
        _filled("verified_name", stripped("feature_name")).alias("new_name"),
        _filled("verified_type", stripped("feature_type")).alias("new_type"),
    )
    return rows.filter(F.col("new_name") != "")


def log_entries(review: DataFrame, logged_at: str) -> DataFrame:
    """Entries for corrections (old and new values) and for confirmations."""
    stamp = F.lit(logged_at).cast("timestamp").alias("logged_at")
    known = review.filter(F.col("id").isNotNull())
    fixes = known.filter(verdict() == "N").select(
        "id", "map_name", "original_text", F.col("feature_name").alias("old_name"),
        _filled("verified_name", F.col("feature_name")).alias("new_name"), F.col("feature_type").alias("old_type"),
        _filled("verified_type", F.col("feature_type")).alias("new_type"), stamp,
    )
    confirmed = known.filter(verdict() == "Y").select("id", F.lit(True).alias("verified_correct"), stamp)
    return fixes.unionByName(confirmed, allowMissingColumns=True)


def training_rows_from_log(log: DataFrame, exported: DataFrame | None = None) -> DataFrame:
    """Logged corrections that changed the name, without rows an earlier run exported."""
    rows = log.filter((F.col("new_name") != "") & ~F.col("old_name").eqNullSafe(F.col("new_name")))
    if exported is not None:
        rows = rows.join(exported.select("id"), "id", "left_anti")
    return rows.select("id", "original_text", "new_name", "new_type")


def loop_summary(log: DataFrame) -> DataFrame:
    """Applied and confirmed counts, and applied corrections per new type."""
    applied = F.col("new_name").isNotNull()
    kind = F.when(applied, F.coalesce(F.nullif("new_type", F.lit("")), F.lit("unknown")))
    counts = log.groupBy(kind.alias("kind"), F.coalesce("verified_correct", F.lit(False)).alias("ok")).agg(F.count("*").alias("n"))
    sections = F.array(
        F.struct(F.when(F.col("kind").isNotNull(), "applied").alias("section"), F.lit("").alias("item")),
        F.struct(F.when(F.col("ok"), "confirmed").alias("section"), F.lit("").alias("item")),
        F.struct(F.when(F.col("kind").isNotNull(), "type").alias("section"), F.col("kind").alias("item")),
    )
    exploded = counts.select(F.inline(sections), "n").filter(F.col("section").isNotNull())
    return exploded.groupBy("section", "item").agg(F.sum("n").alias("n"))
