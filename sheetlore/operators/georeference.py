"""Degrees in margin texts and the coordinate bounds of a sheet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheetlore.functions.texts import stripped
from sheetlore.operators.numbering import number_rows

# Fixed value: degrees with optional minutes, seconds and hemisphere.
DEGREES = r"""(?i)(\d{1,3})\s*[°o]\s*(?:(\d{1,2})\s*['’′`]\s*(?:(\d{1,2}(?:\.\d+)?)\s*["”″]\s*)?)?([NSEW])?"""
HEMISPHERE = r"(?i)^[NSEW]$"


def degree_parts(text: Column) -> dict[str, Column]:
    """Parts of the first degree notation in a text; missing parts are NULL."""
    trimmed = stripped(text)

    def part(group: int) -> Column:
        return F.nullif(F.regexp_extract(trimmed, DEGREES, group), F.lit(""))

    return {
        "deg": part(1).cast("double"), "minutes": part(2).cast("double"), "seconds": part(3).cast("double"), "hemi": F.upper(part(4)),
    }


def decimal_degrees(deg: Column, minutes: Column, seconds: Column, hemi: Column) -> Column:
    value = deg + F.coalesce(minutes, F.lit(0.0)) / 60.0 + F.coalesce(seconds, F.lit(0.0)) / 3600.0
    return F.round(F.when(hemi.isin("S", "W"), -value).otherwise(value), 6)


def in_token_order(tokens: DataFrame) -> DataFrame:
    """``row_no`` counts the tokens of a map by ``seq``, which may have gaps."""
    return number_rows(tokens, ["map_name"], F.floor(F.col("seq") / 256), ["seq"])


def with_hemisphere(tokens: DataFrame) -> DataFrame:
    """Degree tokens with their hemisphere, taken from the next token where theirs is missing.

    Tokens are counted first, so the next one is found by an equi-join with the few tokens that
    are a lone N, S, E or W, whatever tokens were left out before.
    """
    numbered = in_token_order(tokens.select("map_name", "seq", "text"))
    degrees = numbered.select("map_name", "seq", "row_no", *[c.alias(n) for n, c in degree_parts(F.col("text")).items()]).filter(
        F.col("deg").isNotNull()
    )
    lone = numbered.filter(stripped("text").rlike(HEMISPHERE)).select(
        "map_name", (F.col("row_no") - 1).alias("row_no"), F.upper(stripped("text")).alias("next_hemi")
    )
    joined = degrees.join(lone, ["map_name", "row_no"], "left")
    return joined.withColumn("hemi", F.coalesce("hemi", "next_hemi")).drop("next_hemi", "row_no").filter(F.col("hemi").isNotNull())


def coordinate_bounds(tokens: DataFrame) -> DataFrame:
    """Least and greatest latitude and longitude per map; NULL with fewer than two of either."""
    value = decimal_degrees(F.col("deg"), F.col("minutes"), F.col("seconds"), F.col("hemi"))
    lat = F.when(F.col("hemi").isin("N", "S"), F.col("value"))
    lon = F.when(F.col("hemi").isin("E", "W"), F.col("value"))
    bounds = with_hemisphere(tokens).withColumn("value", value).groupBy("map_name").agg(
        F.min(lat).alias("lat_min"), F.max(lat).alias("lat_max"), F.min(lon).alias("lon_min"), F.max(lon).alias("lon_max"),
        ((F.count(lat) >= 2) & (F.count(lon) >= 2)).alias("found"),
    )
    return bounds.select(
        "map_name", "found", *[F.when(F.col("found"), F.col(c)).alias(c) for c in ("lat_min", "lat_max", "lon_min", "lon_max")]
    )
