"""Export shapes (SNK). The writers themselves are exercised in the tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from sheetlore.operators import review as rev
from sheetlore.operators import sampling
from sheetlore.operators.filters import low_confidence, search_features
from sheetlore.plans.registry import query
from sheetlore.sinks import exports as op

SYSTEM_TEXT = "You label text read from map sheets."

_PARTS = r"""
, parts AS (SELECT *,
    regexp_extract(map_name, '\((\d{4})\)', 1) AS year_in_name,
    coalesce(nullif(sheet_ref, ''), '') AS number, printf('%.2f', confidence) AS confidence_text FROM features)"""


@query(
    "snk01_feature_rows",
    """SELECT id, map_name, feature_name, coalesce(original_text, '') AS original_text, coalesce(feature_type, '') AS feature_type,
         coalesce(grid_reference, '') AS grid_reference, coalesce(confidence, 0.0) AS confidence, sheet_ref, survey_year, verified,
         lat_min, session_id FROM features""",
    ("features",),
)
def _(t):
    rows = op.feature_rows(t.features.drop("verified"))
    return rows.select(
        "id", "map_name", "feature_name", "original_text", "feature_type", "grid_reference", "confidence", "sheet_ref",
        "survey_year", "verified", "lat_min", "session_id",
    )


@query(
    "snk02_flat_rows",
    """SELECT map_name AS Map_Name, feature_name AS Feature_Name, feature_type AS Feature_Type, grid_reference AS Grid_Reference,
         confidence AS Confidence, original_text AS Original_OCR FROM features WHERE feature_type <> 'noise'
       ORDER BY map_name, feature_type, feature_name""",
    ("features",),
)
def _(t):
    return op.flat_rows(t.features.orderBy("map_name", "feature_type", "feature_name", "id"))


@query(
    "snk03_nested_records",
    """, n AS (SELECT *, CAST(ceil(count(*) OVER (PARTITION BY map_name, feature_type) / 50) AS BIGINT) AS parts FROM features WHERE feature_type <> 'noise')
       SELECT map_name, feature_type, id % parts AS part, CAST(to_json(list(struct_pack("name" := feature_name, original_text := original_text,
         grid := grid_reference, confidence := confidence) ORDER BY feature_name, id)) AS VARCHAR) AS features FROM n GROUP BY 1, 2, 3""",
    ("features",),
)
def _(t):
    lists = op.nested_records(t.features, records_per_list=50)
    return lists.withColumn("features", F.to_json("features", {"ignoreNullFields": "false"}))


@query(
    "snk04_analyst_rows",
    _PARTS + """ SELECT coalesce(nullif(original_text, ''), feature_name) AS "As Written on Map", feature_name AS "Normalised Name",
      grid_reference AS "Grid Number", number AS "Map Number", map_name AS "Map Name",
      coalesce(nullif(survey_year, ''), year_in_name) AS "Year", feature_type AS "Feature Type", confidence_text AS "Confidence" FROM parts""",
    ("features",),
)
def _(t):
    return op.analyst_rows(t.features)


@query(
    "snk05_viewer_rows",
    _PARTS + """ SELECT map_name, feature_type, lower(feature_name) AS name_key,
      lower(feature_name || ' ' || coalesce(grid_reference, '') || ' ' || number || ' ' || map_name || ' '
        || coalesce(nullif(survey_year, ''), year_in_name) || ' ' || coalesce(feature_type, '')) AS search_text, feature_name,
      coalesce(nullif(grid_reference, ''), '-') AS grid, number AS map_number, map_name AS sheet_name,
      coalesce(nullif(survey_year, ''), year_in_name) AS year, confidence_text,
      CASE WHEN confidence >= 0.85 THEN '#2d6a2d' WHEN confidence >= 0.70 THEN '#b8860b' ELSE '#8b0000' END AS colour FROM parts""",
    ("features",),
)
def _(t):
    return op.viewer_rows(t.features)


@query(
    "snk06_review_sheet",
    """SELECT id, map_name, original_text, feature_name, feature_type, grid_reference, confidence, '' AS verified_correct, '' AS verified_name,
         '' AS verified_type, '' AS notes FROM features WHERE confidence < 0.7""",
    ("features",),
)
def _(t):
    return op.review_sheet(low_confidence(t.features))


@query(
    "snk07_chat_records",
    """SELECT '{"messages":[{"role":"system","content":"You label text read from map sheets."},{"role":"user","content":'
         || to_json('Clean and classify these OCR-extracted map labels:' || chr(10) || chr(10) || '1. ' || original_text)
         || '},{"role":"model","content":' || to_json('[{"original":' || to_json(original_text) || ',"cleaned":' || to_json(new_name)
         || ',"feature_type":' || to_json(new_type) || ',"confidence":1.0}]') || '}]}' AS value
       FROM (SELECT original_text, coalesce(nullif(trim(verified_name), ''), trim(feature_name)) AS new_name,
               coalesce(nullif(trim(verified_type), ''), trim(feature_type)) AS new_type
             FROM review WHERE upper(trim(verified_correct, ' ' || chr(9) || chr(13) || chr(160))) = 'N' AND trim(original_text) <> '') WHERE new_name <> ''""",
    ("review",),
)
def _(t):
    return op.chat_records(rev.training_rows_from_review(t.review), SYSTEM_TEXT)


@query(
    "snk08_split_manifest",
    """SELECT CASE WHEN share < 0.8 THEN 'TRAIN' WHEN share < 0.9 THEN 'VALIDATE' ELSE 'TEST' END AS set, path, label
       FROM (SELECT path, label, CAST('0x' || substr(md5('split#' || id), 1, 7) AS BIGINT) / 268435456.0::DOUBLE AS share FROM split_rows)""",
    ("split_rows",),
)
def _(t):
    return op.split_manifest(sampling.hashed_split(t.split_rows))


@query(
    "snk09_correction_lines",
    """SELECT id, map_name, original_text, feature_name AS old_name, coalesce(nullif(trim(verified_name), ''), feature_name) AS new_name,
         feature_type AS old_type, coalesce(nullif(trim(verified_type), ''), feature_type) AS new_type, '2024-05-01 12:00:00' AS logged_at,
         NULL::BOOLEAN AS verified_correct FROM review WHERE upper(trim(verified_correct, ' ' || chr(9) || chr(13) || chr(160))) = 'N'
       UNION ALL SELECT id, NULL, NULL, NULL, NULL, NULL, NULL, '2024-05-01 12:00:00', true FROM review
       WHERE upper(trim(verified_correct, ' ' || chr(9) || chr(13) || chr(160))) = 'Y'""",
    ("review",),
)
def _(t):
    entries = rev.log_entries(t.review, "2024-05-01 12:00:00")
    return entries.withColumn("logged_at", F.col("logged_at").cast("string"))


@query(
    "snk10_search_result",
    """SELECT map_name, feature_name, feature_type, grid_reference, confidence FROM features
       WHERE feature_type <> 'noise' AND lower(feature_name) LIKE '%gear%'""",
    ("features",),
)
def _(t):
    return op.search_result_rows(search_features(t.features, name="gear"))


@query(
    "snk11_after_review",
    "SELECT id, map_name, feature_name, feature_type, confidence FROM features ORDER BY map_name, feature_name, id",
    ("features",),
)
def _(t):
    return t.features.select("id", "map_name", "feature_name", "feature_type", "confidence").orderBy("map_name", "feature_name", "id")
