"""Comparison of the names on a chosen set of maps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def map_names(df: DataFrame, maps: DataFrame) -> DataFrame:
    """Distinct case-folded names per chosen map. Repeats vanish before the shuffle."""
    chosen = df.join(maps.select("map_name"), "map_name", "left_semi")
    return (
        chosen.select("map_name", F.lower("feature_name").alias("name"))
        .filter(F.col("name") != "")
        .distinct()
    )


def with_map_counts(names: DataFrame, n_maps: int) -> DataFrame:
    """``(map_name, name, common)``: ``common`` when the name is on all ``n_maps`` maps."""
    spread = names.groupBy("name").agg(F.count("*").alias("on_maps"))
    return names.join(spread, "name").select("map_name", "name", (F.col("on_maps") == n_maps).alias("common"))


def common_names(names: DataFrame, n_maps: int) -> DataFrame:
    return names.groupBy("name").agg(F.count("*").alias("on_maps")).filter(F.col("on_maps") == n_maps).select("name")


def names_not_common(names: DataFrame, n_maps: int) -> DataFrame:
    """Names that at least one other chosen map lacks."""
    return names.join(common_names(names, n_maps), "name", "left_anti").select("map_name", "name")


def comparison_summary(names: DataFrame, n_maps: int) -> DataFrame:
    """Number of common names, and of the others for each map."""
    common = common_names(names, n_maps).agg(F.count("*").alias("n")).select(F.lit("(common)").alias("map_name"), "n")
    per_map = names.join(common_names(names, n_maps).withColumn("hit", F.lit(1)), "name", "left").groupBy("map_name").agg(
        F.count_if(F.col("hit").isNull()).alias("n")
    )
    return common.unionByName(per_map)


def common_table(names: DataFrame, n_maps: int) -> DataFrame:
    """``(section, item)``: every chosen map once, and every name that is on all of them."""
    chosen = names.select(F.lit("map").alias("section"), F.col("map_name").alias("item")).distinct()
    return chosen.unionByName(common_names(names, n_maps).select(F.lit("name").alias("section"), F.col("name").alias("item")))


def unique_rows(df: DataFrame, names: DataFrame, n_maps: int) -> DataFrame:
    """Feature rows of the chosen maps whose name is not common."""
    only = names_not_common(names, n_maps)
    keyed = df.withColumn("name", F.lower("feature_name"))
    return keyed.join(only, ["map_name", "name"], "left_semi").drop("name")


def union_keeping_existing(existing: DataFrame, incoming: DataFrame, key: str = "map_name") -> DataFrame:
    """Add the rows of new keys; keys already stored stay as they are."""
    return existing.unionByName(incoming.join(existing.select(key).distinct(), key, "left_anti"))
