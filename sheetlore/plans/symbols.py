"""Symbol crops (SYM, FLT-17)."""

from __future__ import annotations

from pyspark.sql import functions as F

from sheetlore.operators import symbols as op
from sheetlore.plans.registry import query

_CANDIDATES = """(SELECT * FROM features WHERE feature_type IN ('settlement', 'landmark', 'road', 'river', 'forest', 'mountain')
   AND confidence >= 0.7 AND bbox_x1 > 0 AND bbox_y1 > 0)"""


@query(
    "flt17_symbol_candidates",
    f"SELECT id, feature_type, confidence FROM {_CANDIDATES} ORDER BY feature_type, confidence DESC",
    ("features",),
)
def _(t):
    return op.candidates(t.features).select("id", "feature_type", "confidence").orderBy("feature_type", F.desc("confidence"), "id")


_PLAN = f""", plan AS (SELECT id, feature_type, feature_name, greatest(0, bbox_x1 - 32) AS crop_x1, greatest(0, bbox_y1 - 32) AS crop_y1,
   least(4950, bbox_x2 + 32) AS crop_x2, least(6800, bbox_y2 + 32) AS crop_y2 FROM {_CANDIDATES})"""


@query(
    "sym01_crop_plan",
    _PLAN + """ SELECT id, crop_x1, crop_y1, crop_x2, crop_y2 FROM plan WHERE crop_x2 - crop_x1 >= 16 AND crop_y2 - crop_y1 >= 16""",
    ("features",),
)
def _(t):
    plan = op.crop_plan(op.candidates(t.features), 4950, 6800)
    return plan.filter("cropped").select("id", "crop_x1", "crop_y1", "crop_x2", "crop_y2")


@query(
    "sym02_file_paths",
    _PLAN + r""" SELECT id, feature_type || '/' || id || '_' || substr(trim(regexp_replace(feature_name, '[^\p{L}\p{N} _-]', '_', 'g')), 1, 50)
       || '.jpg' AS path FROM plan""",
    ("features",),
)
def _(t):
    return op.crop_plan(op.candidates(t.features), 4950, 6800).select("id", "path")


@query(
    "sym03_class_distribution",
    """SELECT label, n, label = 'rejected' AS rejected, label <> 'rejected' AND n >= 100 AS enough FROM (
         SELECT CASE WHEN confidence < 0.5 THEN 'rejected' ELSE feature_type END AS label, count(*) AS n FROM features
         WHERE feature_type IS NOT NULL GROUP BY 1)""",
    ("features",),
)
def _(t):
    label = F.when(F.col("confidence") < 0.5, "rejected").otherwise(F.col("feature_type"))
    return op.class_distribution(t.features.filter("feature_type IS NOT NULL").withColumn("label", label))


@query(
    "sym03_set_totals",
    """SELECT count(*) FILTER (confidence >= 0.5 OR confidence IS NULL) AS total, count(*) FILTER (confidence < 0.5) AS rejected
       FROM features WHERE feature_type IS NOT NULL""",
    ("features",),
)
def _(t):
    label = F.when(F.col("confidence") < 0.5, "rejected").otherwise(F.col("feature_type"))
    return op.set_totals(t.features.filter("feature_type IS NOT NULL").withColumn("label", label))


@query(
    "sym04_crop_counts",
    _PLAN + """ SELECT count(*) FILTER (crop_x2 - crop_x1 >= 16 AND crop_y2 - crop_y1 >= 16) AS cropped,
       count(*) FILTER (NOT (crop_x2 - crop_x1 >= 16 AND crop_y2 - crop_y1 >= 16)) AS skipped FROM plan""",
    ("features",),
)
def _(t):
    return op.crop_counts(op.crop_plan(op.candidates(t.features), 4950, 6800))
