"""Joins, anti-joins and merges (JON, except the spatial and rule joins)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from sheetlore.operators import cleaning
from sheetlore.operators import merging as op
from sheetlore.plans.registry import query
from sheetlore.session import ensure_checkpoint_dir
from sheetlore.sinks.feature_store import FeatureStore


def _store(t) -> FeatureStore:
    """The feature table written by session, in a folder of its own."""
    return FeatureStore(t.spark, f"{ensure_checkpoint_dir(t.spark)}/features-{uuid.uuid4().hex}").create(t.features)


@query(
    "jon01_attach_first_detection",
    """, d AS (SELECT map_name, text, det_id, x1, y1, x2, y2, row_number() OVER (PARTITION BY map_name, text ORDER BY y1, x1, det_id) AS rn FROM detections)
       SELECT p.map_name, p.original, p.provider, d.det_id, d.x1, d.y1, d.x2, d.y2
       FROM (SELECT map_name, provider, upper(substr(cleaned, 1, 1)) || substr(cleaned, 2) AS original FROM provider_items) p
       LEFT JOIN d ON d.map_name = p.map_name AND d.text = p.original AND d.rn = 1""",
    ("detections", "provider_items"),
)
def _(t):
    items = t.provider_items.select(
        "map_name", "provider", F.expr("upper(substr(cleaned, 1, 1)) || substr(cleaned, 2)").alias("original")
    )
    return op.attach_detection(items, t.detections).select("map_name", "original", "provider", "det_id", "x1", "y1", "x2", "y2")


@query(
    "jon02_attach_cells",
    """, c AS (SELECT map_name, r AS row_no, k AS col_no,
         round(lat_max - (r) * ((lat_max - lat_min) / n_rows), 6) AS cell_lat_min, round(lon_min + (k - 1) * ((lon_max - lon_min) / n_cols), 6) AS cell_lon_min
         FROM map_info, unnest(range(1, n_rows + 1)) AS a(r), unnest(range(1, n_cols + 1)) AS b(k) WHERE lat_min IS NOT NULL)
       SELECT f.id, c.cell_lat_min, c.cell_lon_min FROM features f LEFT JOIN c ON c.map_name = f.map_name
         AND c.row_no = CAST(substr(f.grid_reference, 1, 1) AS INT) AND c.col_no = ascii(substr(f.grid_reference, 2, 1)) - 64""",
    ("features", "map_info"),
)
def _(t):
    from sheetlore.operators import grid

    cells = grid.cells_of_maps(t.map_info).select(
        "map_name", "row_no", "col_no", F.col("lat_min").alias("cell_lat_min"), F.col("lon_min").alias("cell_lon_min")
    )
    located = t.features.select("id", "map_name", *grid.parse_cell_key(F.col("grid_reference"), "2B"))
    return op.attach_cells(located, cells).select("id", "cell_lat_min", "cell_lon_min")


@query(
    "jon03_attach_map_facts",
    """SELECT f.id, f.map_name, coalesce(m.ocr_map_number, '') AS sheet_ref, coalesce(m.ocr_survey_year, '') AS survey_year,
         coalesce(m.district, '') AS district, m.map_scale FROM features f
       LEFT JOIN map_info m ON m.map_name = f.map_name""",
    ("features", "map_info"),
)
def _(t):
    return op.attach_map_facts(t.features.select("id", "map_name"), t.map_info)


# In this query and in jon05, jon15, jon16 one side is cut so that some keys have no partner: that is their subject.
@query(
    "jon04_new_maps",
    """SELECT DISTINCT map_name FROM detections WHERE map_name NOT IN (SELECT map_name FROM map_info WHERE s_acctbal > 2000)""",
    ("detections", "map_info"),
)
def _(t):
    known = t.map_info.filter("s_acctbal > 2000")
    return op.without_keys(t.detections.select("map_name").distinct(), known)


@query(
    "jon05_resume",
    """SELECT m.map_name, m.width, m.height FROM map_info m WHERE NOT EXISTS (SELECT 1 FROM features f WHERE f.map_name = m.map_name AND f.confidence > 0.95 AND f.district = 'Brand#13')""",
    ("features", "map_info"),
)
def _(t):
    return op.without_keys(t.map_info.select("map_name", "width", "height"), t.features.filter("confidence > 0.95 AND district = 'Brand#13'"))


@query(
    "jon06_merge_sessions",
    """, g AS (SELECT * FROM features WHERE session_id = 'S1' AND map_name NOT LIKE '%7')
       SELECT id, map_name, session_id FROM g UNION ALL
       SELECT id, map_name, session_id FROM features WHERE session_id = 'S2' AND map_name NOT IN (SELECT map_name FROM g)""",
    ("features",),
)
def _(t):
    rows = t.features.select("id", "map_name", "session_id")
    stored = rows.filter((F.col("session_id") == "S1") & ~F.col("map_name").endswith("7"))
    return op.merge_sessions(stored, rows.filter(F.col("session_id") == "S2"))


@query(
    "jon08_dictionary_lookup",
    """, d AS (SELECT lower(replace(p_name, 'i', 'y')) AS variant, max(p_name) AS canonical FROM part GROUP BY 1)
       SELECT f.id, f.feature_name, d.canonical FROM features f JOIN d ON d.variant = lower(f.feature_name)""",
    ("features",),
)
def _(t):
    dictionary = t.part.groupBy(F.lower(F.replace("p_name", F.lit("i"), F.lit("y"))).alias("variant")).agg(F.max("p_name").alias("canonical"))
    return cleaning.lookup(t.features.select("id", "feature_name"), "feature_name", dictionary).filter(
        F.col("canonical").isNotNull()
    )


_VERDICTS = """, d AS (SELECT id, max(upper(trim(verified_correct, ' ' || chr(9) || chr(13) || chr(160))) = 'N') AS fixed, max(upper(trim(verified_correct, ' ' || chr(9) || chr(13) || chr(160))) = 'Y') AS ok,
           arg_max(coalesce(nullif(trim(verified_name), ''), trim(feature_name)), row_no) FILTER (wrong) AS new_name,
           arg_max(coalesce(nullif(trim(verified_type), ''), trim(feature_type)), row_no) FILTER (wrong) AS new_type
         FROM (SELECT *, upper(trim(verified_correct, ' ' || chr(9) || chr(13) || chr(160))) = 'N' AS wrong FROM review)
         WHERE upper(trim(verified_correct, ' ' || chr(9) || chr(13) || chr(160))) IN ('Y', 'N') GROUP BY 1)
       SELECT f.id, CASE WHEN d.fixed THEN d.new_name ELSE f.feature_name END AS feature_name,
         CASE WHEN d.fixed THEN d.new_type ELSE f.feature_type END AS feature_type,
         CASE WHEN d.fixed THEN 1.0 WHEN d.ok THEN CASE WHEN confidence + 0.15::DOUBLE > 1.0 THEN 1.0 ELSE confidence + 0.15::DOUBLE END ELSE confidence END AS confidence
       FROM features f LEFT JOIN d ON d.id = f.id"""


@query("jon14_apply_verdicts", _VERDICTS, ("features", "review"))
def _(t):
    return op.apply_verdicts(t.features, t.review).select("id", "feature_name", "feature_type", "confidence")


@query("jon14_verdicts_in_store", _VERDICTS, ("features", "review"))
def _(t):
    store = _store(t)
    store.apply_verdicts("review", t.review)
    return store.read().select("id", "feature_name", "feature_type", "confidence")


_RENAMED = """SELECT f.id, coalesce(m.map_name || ' renamed', f.map_name) AS map_name FROM features f
       LEFT JOIN map_info m ON m.map_name = f.map_name AND m.s_acctbal < 1000"""


@query("jon15_rename_maps", _RENAMED, ("features", "map_info"))
def _(t):
    renames = t.map_info.filter("s_acctbal < 1000").select(
        F.col("map_name").alias("old_name"), F.concat("map_name", F.lit(" renamed")).alias("new_name")
    )
    return op.rename_maps(t.features.select("id", "map_name"), renames)


@query("jon15_renamed_in_store", _RENAMED, ("features", "map_info"))
def _(t):
    renames = t.map_info.filter("s_acctbal < 1000").select(F.col("map_name").alias("old_name"), F.concat("map_name", F.lit(" renamed")).alias("new_name"))
    store = _store(t)
    store.rename_maps("rename", renames)
    return store.read().select("id", "map_name")


@query(
    "agg10_rows_after_rename",
    """SELECT coalesce(m.map_name || ' renamed', f.map_name) AS map_name, count(*) AS n FROM features f
       LEFT JOIN map_info m ON m.map_name = f.map_name AND m.s_acctbal < 1000 GROUP BY 1""",
    ("features", "map_info"),
)
def _(t):
    renames = t.map_info.filter("s_acctbal < 1000").select(
        F.col("map_name").alias("old_name"), F.concat("map_name", F.lit(" renamed")).alias("new_name")
    )
    return op.rename_maps(t.features.select("map_name"), renames).groupBy("map_name").agg(F.count("*").alias("n"))


@query(
    "jon16_delete_maps",
    "SELECT id, map_name FROM features WHERE map_name NOT IN (SELECT map_name FROM map_info WHERE s_acctbal < 3000)",
    ("features", "map_info"),
)
def _(t):
    return op.delete_maps(t.features.select("id", "map_name"), t.map_info.filter("s_acctbal < 3000"))


@query(
    "jon16_delete_in_session",
    """SELECT id, map_name, session_id FROM features WHERE NOT (session_id = 'S2' AND map_name IN (SELECT map_name FROM map_info WHERE s_acctbal < 3000))""",
    ("features", "map_info"),
)
def _(t):
    return op.delete_maps(t.features.select("id", "map_name", "session_id"), t.map_info.filter("s_acctbal < 3000"), "S2").select(
        "id", "map_name", "session_id"
    )


@query(
    "jon16_deleted_in_store",
    """SELECT 'left' AS what, map_name, count(*) AS n FROM features WHERE map_name NOT IN (SELECT map_name FROM map_info WHERE s_acctbal < 3000) GROUP BY 2
       UNION ALL SELECT 'deleted', map_name, count(*) FROM features WHERE map_name IN (SELECT map_name FROM map_info WHERE s_acctbal < 3000) GROUP BY 2""",
    ("features", "map_info"),
)
def _(t):
    store = _store(t)
    deleted = store.delete_maps("delete", t.map_info.filter("s_acctbal < 3000"))
    left = store.read().groupBy("map_name").agg(F.count("*").alias("n"))
    return left.select(F.lit("left").alias("what"), "map_name", "n").unionByName(deleted.select(F.lit("deleted").alias("what"), "map_name", F.col("deleted").alias("n")))


@query(
    "jon16_deletion_counts",
    "SELECT map_name, count(*) AS deleted FROM features WHERE map_name IN (SELECT map_name FROM map_info WHERE s_acctbal < 3000) GROUP BY 1",
    ("features", "map_info"),
)
def _(t):
    return op.deletion_counts(t.features, t.map_info.filter("s_acctbal < 3000"))


_PATCHED = "SELECT id, CASE WHEN map_name ILIKE '%map_4%' THEN '1936' ELSE survey_year END AS survey_year FROM features"


@query("jon17_patched_in_store", _PATCHED, ("features",))
def _(t):
    store = _store(t)
    store.patch_column("patch", "%map_4%", "survey_year", "1936")
    return store.read().select("id", "survey_year")


@query("jon17_patch_year", _PATCHED, ("features",))
def _(t):
    return op.patch_column(t.features, "%map_4%", "survey_year", "1936").select("id", "survey_year")


@query(
    "jon18_choose_result",
    """, t AS (SELECT map_name, x1 // 974 AS tile_x, y1 // 974 AS tile_y, count(*) FILTER (l_linenumber > 2) AS n, count(*) AS m FROM boxes GROUP BY 1, 2, 3)
       SELECT map_name, tile_x, tile_y, CASE WHEN (tile_x + tile_y) % 5 = 0 THEN m ELSE n END AS n,
         CASE WHEN (tile_x + tile_y) % 5 = 0 THEN 'retry' ELSE 'batch' END AS source FROM t""",
    ("boxes",),
)
def _(t):
    tiles = t.boxes.select(
        "map_name", F.expr("CAST(x1 div 974 AS INT)").alias("tile_x"), F.expr("CAST(y1 div 974 AS INT)").alias("tile_y"), "l_linenumber"
    )
    keys = ["map_name", "tile_x", "tile_y"]
    primary = tiles.groupBy(*keys).agg(F.count_if(F.col("l_linenumber") > 2).alias("n")).withColumn(
        "failed", (F.col("tile_x") + F.col("tile_y")) % 5 == 0
    )
    retry = tiles.groupBy(*keys).agg(F.count("*").alias("n"))
    return op.choose_result(primary, retry, keys, "n")
