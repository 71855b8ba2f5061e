"""Filters, predicates and projections on the feature table (FLT, WIN-01, SRT)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from sheetlore.functions.names import split_map_name
from sheetlore.functions.texts import stripped
from sheetlore.operators import filters as op
from sheetlore.plans.registry import query
from sheetlore.session import ensure_checkpoint_dir
from sheetlore.sinks.feature_store import PlaceTable

_COLS = "map_name, original_text, feature_name, feature_type, grid_reference, confidence"
_NAME_PARTS = r"""
, parts AS (SELECT *,
    CASE WHEN regexp_matches(trim(map_name), '^(\d+)-([A-Z]+)-(\d+)-(.+?)-(\d{4})-')
      THEN regexp_extract(trim(map_name), '^(\d+)-([A-Z]+)-(\d+)-(.+?)-(\d{4})-', 5)
      ELSE regexp_extract(map_name, '\((\d{4})\)', 1) END AS year_in_name,
    trim(replace(regexp_extract(trim(map_name), '^(\d+\s+[A-Z]+(?:[/\]]\d+)?)', 1), ']', '/')) AS number_in_name
  FROM features)"""


@query("flt01_not_noise", f"SELECT id, {_COLS} FROM features WHERE feature_type <> 'noise'", ("features",))
def _(t):
    return op.not_noise(t.features).select("id", *op.SEARCH_COLUMNS)


@query(
    "flt02_search_features",
    f"""SELECT {_COLS} FROM features WHERE feature_type <> 'noise' AND lower(map_name) LIKE '%map_1%'
        AND lower(feature_type) = 'river' AND lower(grid_reference) = '2b' AND confidence >= 0.5
        AND lower(feature_name) LIKE '%ring%'""",
    ("features",),
)
def _(t):
    return op.search_features(t.features, "map_1", "RIVER", "2b", 0.5, "Ring")


@query("flt03_map_contains", f"SELECT {_COLS} FROM features WHERE feature_type <> 'noise' AND contains(lower(map_name), 'p_2')", ("features",))
def _(t):
    return op.search_features(t.features, map_name="P_2")


@query("flt03_map_like_wildcards", f"SELECT {_COLS} FROM features WHERE lower(map_name) LIKE '%p__2%'", ("features",))
def _(t):
    return t.features.filter(op.contains_ignoring_case("map_name", "p__2", wildcards=True)).select(*op.SEARCH_COLUMNS)


@query("flt04_type_equals", f"SELECT {_COLS} FROM features WHERE feature_type <> 'noise' AND lower(feature_type) = 'lake'", ("features",))
def _(t):
    return op.search_features(t.features, feature_type="Lake")


@query("flt05_cell_equals", f"SELECT {_COLS} FROM features WHERE feature_type <> 'noise' AND lower(grid_reference) = '3c'", ("features",))
def _(t):
    return op.search_features(t.features, grid_reference="3c")


@query("flt06_min_confidence", f"SELECT {_COLS} FROM features WHERE feature_type <> 'noise' AND confidence >= 0.65", ("features",))
def _(t):
    return op.search_features(t.features, min_confidence=0.65)


@query("flt06_zero_confidence_keeps_null", f"SELECT {_COLS} FROM features WHERE feature_type <> 'noise' AND lower(feature_type) = 'road'", ("features",))
def _(t):
    return op.search_features(t.features, feature_type="road", min_confidence=0.0)


@query("flt07_name_contains", f"SELECT {_COLS} FROM features WHERE feature_type <> 'noise' AND contains(lower(feature_name), 'anvil')", ("features",))
def _(t):
    return op.search_features(t.features, name="ANVIL")


@query("flt08_plural_alias", f"SELECT {_COLS} FROM features WHERE feature_type <> 'noise' AND feature_type = 'mountain'", ("features",))
def _(t):
    return op.search_features(t.features, feature_type="Mountains")


@query("flt09_confident_view", f"SELECT {_COLS} FROM features WHERE feature_type = 'settlement' AND confidence >= 0.8", ("features",))
def _(t):
    return op.confident_view(t.features, "settlements")


@query("flt09_menu_view", f"SELECT {_COLS} FROM features WHERE feature_type = 'lake' AND confidence >= 0.3", ("features",))
def _(t):
    return op.confident_view(t.features, "lake", floor=0.3)


@query(
    "flt10_fetch_rows",
    """SELECT map_name, feature_name, original_text, grid_reference, feature_type, confidence, sheet_ref, survey_year
       FROM features WHERE lower(map_name) LIKE '%map_3%' AND feature_type = 'noise'""",
    ("features",),
)
def _(t):
    return op.fetch_rows(t.features, "Map_3", "noise")


@query("flt11_map_selection", f"SELECT {_COLS} FROM features WHERE map_name IN (SELECT map_name FROM map_info WHERE s_acctbal > 5000)", ("features", "map_info"))
def _(t):
    return op.in_selection(t.features, t.map_info.filter("s_acctbal > 5000")).select(*op.SEARCH_COLUMNS)


@query(
    "flt12_search_text",
    _NAME_PARTS + """ SELECT id, lower(feature_name || ' ' || coalesce(grid_reference, '') || ' ' ||
         coalesce(nullif(sheet_ref, ''), number_in_name) || ' ' || map_name || ' ' ||
         coalesce(nullif(survey_year, ''), year_in_name, '') || ' ' || coalesce(feature_type, '')) AS search_text
       FROM parts WHERE contains(lower(feature_name || ' ' || coalesce(grid_reference, '') || ' ' ||
         coalesce(nullif(sheet_ref, ''), number_in_name) || ' ' || map_name || ' ' ||
         coalesce(nullif(survey_year, ''), year_in_name, '') || ' ' || coalesce(feature_type, '')), 'ring 2a')""",
    ("features",),
)
def _(t):
    parts = split_map_name(F.col("map_name"))
    return (
        t.features.withColumns(
            {
                "map_number": F.coalesce(F.nullif("sheet_ref", F.lit("")), parts["map_number"]),
                "sheet_name": parts["sheet_name"],
                "year": F.coalesce(F.nullif("survey_year", F.lit("")), parts["year"]),
            }
        )
        .select("id", op.search_text().alias("search_text"))
        .filter(F.col("search_text").contains("ring 2a"))
    )


@query("flt13_detection_threshold", "SELECT map_name, det_id, text, confidence FROM detections WHERE confidence >= 0.3", ("detections",))
def _(t):
    return t.detections.filter(F.col("confidence") >= 0.3).select("map_name", "det_id", "text", "confidence")


@query(
    "flt14_display_name",
    """SELECT id, CASE WHEN lower(coalesce(nullif(original_text, ''), feature_name)) <> lower(feature_name)
         THEN coalesce(nullif(original_text, ''), feature_name) || ' → ' || feature_name ELSE feature_name END AS display_name
       FROM (SELECT id, feature_name, CASE WHEN session_id = 'S1' THEN feature_name || '.' ELSE original_text END AS original_text
             FROM features)""",
    ("features",),
)
def _(t):
    rows = t.features.withColumn(
        "original_text",
        F.when(F.col("session_id") == "S1", F.concat("feature_name", F.lit("."))).otherwise(F.col("original_text")),
    )
    return rows.select("id", op.display_name().alias("display_name"))


@query(
    "flt15_confidence_colour",
    """SELECT id, CASE WHEN confidence >= 0.85 THEN '#2d6a2d' WHEN confidence >= 0.70 THEN '#b8860b' ELSE '#8b0000' END AS colour
       FROM features""",
    ("features",),
)
def _(t):
    return t.features.select("id", op.confidence_colour().alias("colour"))


@query(
    "flt16_low_confidence",
    """SELECT id, map_name, feature_name, confidence FROM features f WHERE confidence < 0.7
       AND NOT EXISTS (SELECT 1 FROM review r WHERE r.id = f.id AND upper(trim(verified_correct, ' ' || chr(9) || chr(13) || chr(160))) = 'N')""",
    ("features", "review"),
)
def _(t):
    corrected = t.review.filter(F.upper(stripped("verified_correct")) == "N")
    return op.low_confidence(t.features, corrected).select("id", "map_name", "feature_name", "confidence")


@query(
    "flt18_score_filter",
    """SELECT map_name, label AS feature_type, round(score, 3) AS confidence, tile_x, tile_y FROM (
         SELECT map_name, x1 // 974 * 974 AS tile_x, y1 // 974 * 974 AS tile_y, feature_type AS label, confidence AS score FROM boxes
         UNION ALL SELECT map_name, x1 // 974 * 974, y1 // 974 * 974, 'other', 1 - confidence FROM boxes) WHERE score >= 0.5""",
    ("boxes",),
)
def _(t):
    tiles = t.boxes.select(
        "map_name", F.expr("CAST(x1 div 974 * 974 AS INT)").alias("tile_x"), F.expr("CAST(y1 div 974 * 974 AS INT)").alias("tile_y"),
        F.array(
            F.struct(F.col("feature_type").alias("label"), F.col("confidence").alias("score")),
            F.struct(F.lit("other").alias("label"), (1 - F.col("confidence")).alias("score")),
        ).alias("predictions"),
    )
    return op.score_filter(tiles)


_PLACE = """SELECT id, map_name, district, survey_year, sheet_ref, lat_min, lon_min FROM features WHERE feature_type <> 'noise'
       AND lower(district) = 'brand#13' AND survey_year = '1998' AND lat_min <= 28 AND lat_max >= 22 AND lon_min <= 85 AND lon_max >= 71"""


@query("flt19_place_filter", _PLACE, ("features",))
def _(t):
    return op.place_filter(t.features, district="BRAND#13", year="1998", box=(22, 28, 71, 85)).select(
        "id", "map_name", "district", "survey_year", "sheet_ref", "lat_min", "lon_min"
    )


@query("flt19_place_in_store", _PLACE, ("features",))
def _(t):
    table = PlaceTable(t.spark, f"{ensure_checkpoint_dir(t.spark)}/places-{uuid.uuid4().hex}", per_folder=20_000).create(t.features)
    return op.place_filter(table.near(22, 28, 71, 85), district="BRAND#13", year="1998", box=(22, 28, 71, 85)).select(
        "id", "map_name", "district", "survey_year", "sheet_ref", "lat_min", "lon_min"
    )


@query("flt19_sheet_filter", "SELECT id, map_name, sheet_ref FROM features WHERE feature_type <> 'noise' AND lower(sheet_ref) = '52 h/8'", ("features",))
def _(t):
    return op.place_filter(t.features, sheet="52 H/8").select("id", "map_name", "sheet_ref")


@query("srt01_by_name", f"SELECT {_COLS} FROM features WHERE feature_type <> 'noise' ORDER BY feature_name", ("features",))
def _(t):
    return op.search_features(t.features).orderBy("feature_name")


@query(
    "srt02_first_page",
    """SELECT id, map_name, grid_reference, feature_name, (SELECT count(*) FROM features WHERE feature_type = 'river') AS total
       FROM features WHERE feature_type = 'river' ORDER BY map_name, grid_reference NULLS FIRST, feature_name, id LIMIT 2000""",
    ("features",),
)
def _(t):
    rivers = t.features.filter(F.col("feature_type") == "river")
    total = rivers.agg(F.count("*")).scalar()
    page = rivers.select("id", "map_name", "grid_reference", "feature_name").orderBy(
        "map_name", F.asc_nulls_first("grid_reference"), "feature_name", "id"
    ).limit(2000)
    return page.withColumn("total", total)


@query(
    "srt03_top_hits",
    "SELECT id, feature_name, confidence FROM features WHERE feature_type <> 'noise' ORDER BY confidence DESC NULLS LAST, id LIMIT 50",
    ("features",),
)
def _(t):
    return op.not_noise(t.features).select("id", "feature_name", "confidence").orderBy(F.desc_nulls_last("confidence"), "id").limit(50)


@query(
    "win01_first_per_key",
    """SELECT map_name, text, det_id FROM (SELECT map_name, text, det_id, row_number() OVER
         (PARTITION BY map_name, text ORDER BY y1, x1, det_id) AS rn FROM detections) WHERE rn = 1""",
    ("detections",),
)
def _(t):
    return (
        t.detections.groupBy("map_name", "text")
        .agg(F.min(F.struct("y1", "x1", "det_id")).alias("first"))
        .select("map_name", "text", "first.det_id")
    )
