"""Set operations between maps (SET)."""

from __future__ import annotations

from pyspark.sql import functions as F

from sheetlore.operators import comparison as op
from sheetlore.plans.registry import query

_CHOSEN = """, chosen AS (SELECT map_name FROM map_info WHERE map_name IN ('MAP_1', 'MAP_3', 'MAP_7')),
  names AS (SELECT DISTINCT map_name, lower(feature_name) AS name FROM features WHERE map_name IN (SELECT * FROM chosen) AND feature_name <> ''),
  common AS (SELECT name FROM names GROUP BY 1 HAVING count(DISTINCT map_name) = 3)
"""


def _names(t):
    maps = t.map_info.filter(F.col("map_name").isin("MAP_1", "MAP_3", "MAP_7"))
    return op.map_names(t.features, maps)


@query("set01_common_names", _CHOSEN + "SELECT name FROM common", ("features", "map_info"))
def _(t):
    return op.common_names(_names(t), 3)


@query("set02_names_not_common", _CHOSEN + "SELECT map_name, name FROM names WHERE name NOT IN (SELECT name FROM common)", ("features", "map_info"))
def _(t):
    return op.names_not_common(_names(t), 3)


@query(
    "set03_comparison_summary",
    _CHOSEN + """SELECT '(common)' AS map_name, count(*) AS n FROM common UNION ALL
      SELECT map_name, count(*) FILTER (name NOT IN (SELECT name FROM common)) FROM names GROUP BY 1""",
    ("features", "map_info"),
)
def _(t):
    return op.comparison_summary(_names(t), 3)


@query(
    "set04_common_table",
    _CHOSEN + """SELECT DISTINCT 'map' AS section, map_name AS item FROM names UNION ALL SELECT DISTINCT 'name', name FROM common""",
    ("features", "map_info"),
)
def _(t):
    return op.common_table(_names(t), 3)


@query(
    "set04_unique_rows",
    _CHOSEN + """SELECT id, map_name, feature_name, grid_reference, feature_type, confidence FROM features
      WHERE map_name IN (SELECT * FROM chosen) AND lower(feature_name) NOT IN (SELECT name FROM common)""",
    ("features", "map_info"),
)
def _(t):
    return op.unique_rows(t.features, _names(t), 3).select("id", "map_name", "feature_name", "grid_reference", "feature_type", "confidence")


@query(
    "set05_union_keeping_existing",
    """SELECT map_name, det_id FROM detections WHERE map_name LIKE '%5' UNION ALL
       SELECT map_name, det_id FROM detections WHERE confidence > 0.9 AND map_name NOT LIKE '%5'""",
    ("detections",),
)
def _(t):
    stored = t.detections.filter(F.col("map_name").endswith("5")).select("map_name", "det_id")
    incoming = t.detections.filter(F.col("confidence") > 0.9).select("map_name", "det_id")
    return op.union_keeping_existing(stored, incoming)
