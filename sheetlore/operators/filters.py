"""Predicates and projections on the feature table.

All of them are plain column expressions, so they reach the Parquet scan as pushed filters
or fold into the scan's code-generated stage.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEARCH_COLUMNS = (
    "map_name", "original_text", "feature_name", "feature_type", "grid_reference", "confidence",
)

# Plural search words and the feature type each one stands for.
PLURAL_ALIASES = {
    "rivers": "river",
    "settlements": "settlement",
    "mountains": "mountain",
    "lakes": "lake",
    "forests": "forest",
    "roads": "road",
    "landmarks": "landmark",
}

# Colour of a row by confidence.
HIGH_COLOUR, MIDDLE_COLOUR, LOW_COLOUR = "#2d6a2d", "#b8860b", "#8b0000"


def not_noise(df: DataFrame) -> DataFrame:
    """Rows whose type is known and is not noise (a NULL type is dropped as in SQL)."""
    return df.filter(F.col("feature_type") != "noise")


def contains_ignoring_case(column: str, text: str, wildcards: bool = False) -> Column:
    """Substring test; with ``wildcards`` the characters % and _ keep their LIKE meaning."""
    if wildcards:
        return F.col(column).ilike(f"%{text}%")
    return F.lower(column).contains(text.lower())


def equals_ignoring_case(column: str, text: str) -> Column:
    return F.lower(column) == text.lower()


def search_features(
    df: DataFrame,
    map_name: str | None = None,
    feature_type: str | None = None,
    grid_reference: str | None = None,
    min_confidence: float = 0.0,
    name: str | None = None,
) -> DataFrame:
    """Conjunction of the given predicates over the non-noise rows."""
    result = not_noise(df)
    if map_name:
        result = result.filter(contains_ignoring_case("map_name", map_name))
    if feature_type:
        wanted = PLURAL_ALIASES.get(feature_type.lower(), feature_type)
        result = result.filter(equals_ignoring_case("feature_type", wanted))
    if grid_reference:
        result = result.filter(equals_ignoring_case("grid_reference", grid_reference))
    if min_confidence > 0:
        result = result.filter(F.col("confidence") >= min_confidence)
    if name:
        result = result.filter(contains_ignoring_case("feature_name", name))
    return result.select(*SEARCH_COLUMNS)


def confident_view(df: DataFrame, feature_type: str | None = None, floor: float = 0.8) -> DataFrame:
    return search_features(df, feature_type=feature_type, min_confidence=floor)


def fetch_rows(df: DataFrame, map_filter: str = "", type_filter: str = "") -> DataFrame:
    """Export selection: keeps noise rows, matches the type exactly, adds absent columns as NULL."""
    result = df
    if map_filter:
        result = result.filter(contains_ignoring_case("map_name", map_filter))
    if type_filter:
        result = result.filter(F.col("feature_type") == type_filter)
    return with_optional_columns(result, ("sheet_ref", "survey_year")).select(
        "map_name", "feature_name", "original_text", "grid_reference", "feature_type",
        "confidence", "sheet_ref", "survey_year",
    )


def with_optional_columns(df: DataFrame, names: tuple[str, ...], data_type: str = "string") -> DataFrame:
    """Add the columns of ``names`` an older table lacks, filled with NULL."""
    missing = [n for n in names if n not in df.columns]
    return df.withColumns({n: F.lit(None).cast(data_type) for n in missing}) if missing else df


def in_selection(df: DataFrame, selection: DataFrame, key: str = "map_name") -> DataFrame:
    """Rows whose key occurs in ``selection`` (the sheets a user ticked)."""
    return df.join(selection.select(key), key, "left_semi")


def search_text() -> Column:
    """Lower-cased text a free-text box is matched against."""
    parts = [
        F.col("feature_name"), F.coalesce("grid_reference", F.lit("")), F.coalesce("map_number", F.lit("")),
        F.coalesce("sheet_name", F.lit("")), F.coalesce("year", F.lit("")), F.coalesce("feature_type", F.lit("")),
    ]
    return F.lower(F.concat_ws(" ", *parts))


def display_name() -> Column:
    """``raw → cleaned`` when the two differ beyond letter case, otherwise the cleaned name."""
    raw = F.coalesce(F.nullif(F.col("original_text"), F.lit("")), F.col("feature_name"))
    return F.when(
        F.lower(raw) != F.lower("feature_name"), F.concat(raw, F.lit(" → "), F.col("feature_name"))
    ).otherwise(F.col("feature_name"))


def confidence_colour() -> Column:
    return (
        F.when(F.col("confidence") >= 0.85, HIGH_COLOUR)
        .when(F.col("confidence") >= 0.70, MIDDLE_COLOUR)
        .otherwise(LOW_COLOUR)
    )


def low_confidence(df: DataFrame, corrected: DataFrame | None = None, threshold: float = 0.70) -> DataFrame:
    """Rows a reviewer should look at, least confident first, without those already corrected.

    Noise and untyped rows are among them, so a label misjudged as noise reaches a reviewer.
    """
    flagged = df.filter(F.col("confidence") < threshold)
    if corrected is not None:
        flagged = flagged.join(corrected.select("id"), "id", "left_anti")
    return flagged.orderBy("confidence", "id")


def covers_box(lat_min: float, lat_max: float, lon_min: float, lon_max: float) -> Column:
    """Cell box of the row overlaps the given box."""
    return (
        (F.col("lat_min") <= lat_max) & (F.col("lat_max") >= lat_min)
        & (F.col("lon_min") <= lon_max) & (F.col("lon_max") >= lon_min)
    )


def place_filter(
    df: DataFrame, district: str | None = None, year: str | None = None, sheet: str | None = None,
    box: tuple[float, float, float, float] | None = None,
) -> DataFrame:
    """District, survey year, sheet number and coordinate box in one conjunction."""
    result = not_noise(df)
    if district:
        result = result.filter(equals_ignoring_case("district", district))
    if year:
        result = result.filter(F.col("survey_year") == year)
    if sheet:
        result = result.filter(equals_ignoring_case("sheet_ref", sheet))
    if box:
        result = result.filter(covers_box(*box))
    return result


def score_filter(df: DataFrame, minimum: float = 0.5) -> DataFrame:
    """Explode per-tile classifier output and keep scores from ``minimum``, rounded to 3 places."""
    return (
        df.select("map_name", "tile_x", "tile_y", F.inline("predictions"))
        .filter(F.col("score") >= minimum)
        .select("map_name", F.col("label").alias("feature_type"), F.round("score", 3).alias("confidence"), "tile_x", "tile_y")
    )
