"""Counts and summaries over the feature table, each in one pass with partial aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheetlore.operators.filters import not_noise


def count_by(df: DataFrame, column: str) -> DataFrame:
    return not_noise(df).groupBy(column).agg(F.count("*").alias("n"))


def exact_mean(column: str, places: int = 3) -> Column:
    """Mean of a 4-decimal value through whole units, so that the order of rows has no effect."""
    units = F.sum(F.round(F.col(column) * 10000).cast("bigint"))
    return F.coalesce(F.round(units / F.count(column) / 10000, places), F.lit(0.0))


def confidence_bands(df: DataFrame) -> DataFrame:
    """High, middle and low confidence counts and the mean, one scan for all four."""
    return not_noise(df).agg(
        F.count_if(F.col("confidence") >= 0.8).alias("high"),
        F.count_if((F.col("confidence") >= 0.5) & (F.col("confidence") < 0.8)).alias("medium"),
        F.count_if(F.col("confidence") < 0.5).alias("low"),
        exact_mean("confidence").alias("mean_confidence"),
    )


def top_names(df: DataFrame, k: int = 10) -> DataFrame:
    """Most frequent names without regard to case, names of one or two letters left out."""
    return (
        not_noise(df)
        .filter(F.length("feature_name") > 2)
        .groupBy(F.lower("feature_name").alias("name_key"))
        .agg(F.min("feature_name").alias("feature_name"), F.count("*").alias("n"))
        .orderBy(F.desc("n"), "name_key")
        .limit(k)
        .select("feature_name", "n")
    )


def statistics_bundle(df: DataFrame) -> DataFrame:
    """Total, per type, per map and per confidence band as ``(section, item, n)`` rows."""
    band = (
        F.when(F.col("confidence") >= 0.8, "high")
        .when(F.col("confidence") >= 0.5, "medium")
        .when(F.col("confidence") < 0.5, "low")
        .otherwise("none")
    )
    cells = (
        not_noise(df)
        .withColumn("band", band)
        .groupBy("feature_type", "map_name", "band")
        .agg(F.count("*").alias("n"))
    )
    sections = F.array(
        F.struct(F.lit("total").alias("section"), F.lit("").alias("item")),
        F.struct(F.lit("type").alias("section"), F.col("feature_type").alias("item")),
        F.struct(F.lit("map").alias("section"), F.col("map_name").alias("item")),
        F.struct(F.lit("band").alias("section"), F.col("band").alias("item")),
    )
    return cells.select(F.inline(sections), "n").groupBy("section", "item").agg(F.sum("n").alias("n"))


def located_per_map(df: DataFrame) -> DataFrame:
    return df.groupBy("map_name").agg(F.count("lat_min").alias("located"), F.count("*").alias("n"))


def regression_report(runs: DataFrame) -> DataFrame:
    """Old against new value per map: found, lost, changed, unchanged or blank.

    ``runs(map_name, run, value)`` may list a map several times; a non-empty value is preferred.
    """
    best = runs.groupBy("map_name").agg(
        F.max(F.when(F.col("run") == "old", F.coalesce("value", F.lit("")))).alias("old"),
        F.max(F.when(F.col("run") == "new", F.coalesce("value", F.lit("")))).alias("new"),
    )
    old, new = F.coalesce("old", F.lit("")), F.coalesce("new", F.lit(""))
    outcome = (
        F.when((old == "") & (new == ""), "blank")
        .when(old == "", "found")
        .when(new == "", "lost")
        .when(old == new, "unchanged")
        .otherwise("changed")
    )
    return best.groupBy(outcome.alias("outcome")).agg(F.count("*").alias("maps"))


def feed_quality(feed: DataFrame, columns: list[str], key: str = "map_name") -> DataFrame:
    """Row count, NULL cells and distinct map keys of an exported row feed."""
    nulls = sum((F.count_if(F.col(c).isNull()) for c in columns), F.lit(0))
    return feed.agg(F.count("*").alias("n_rows"), nulls.alias("null_cells"), F.countDistinct(key).alias("maps"))


def key_differences(feed: DataFrame, catalogue: DataFrame, key: str = "map_name") -> DataFrame:
    """Keys present on one side only."""
    sides = (
        feed.select(key, F.lit(1).alias("in_feed"), F.lit(0).alias("in_catalogue"))
        .unionByName(catalogue.select(key, F.lit(0).alias("in_feed"), F.lit(1).alias("in_catalogue")))
        .groupBy(key)
        .agg(F.max("in_feed").alias("in_feed"), F.max("in_catalogue").alias("in_catalogue"))
    )
    return sides.filter(F.col("in_feed") != F.col("in_catalogue"))
