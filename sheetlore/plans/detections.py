"""Tiles and duplicate removal (DET, JON-09)."""

from __future__ import annotations

from pyspark.sql import functions as F

from sheetlore.functions.boxes import text_key
from sheetlore.operators import detections as op
from sheetlore.plans.registry import query

_SIZED = "(SELECT map_name, CAST(1000 + abs(CAST(floor(s_acctbal) AS BIGINT)) % 7000 AS INT) AS width, CAST(974 + abs(CAST(floor(s_acctbal * 3) AS BIGINT)) % 9000 AS INT) AS height FROM map_info)"


def _sized(t):
    return t.map_info.select(
        "map_name",
        F.expr("CAST(1000 + abs(CAST(floor(s_acctbal) AS BIGINT)) % 7000 AS INT)").alias("width"),
        F.expr("CAST(974 + abs(CAST(floor(s_acctbal * 3) AS BIGINT)) % 9000 AS INT)").alias("height"),
    )


@query(
    "det01_tile_plan",
    f"""SELECT map_name, CAST(x AS INT) AS x, CAST(y AS INT) AS y, CAST(least(x + 1024, width) AS INT) AS x2, CAST(least(y + 1024, height) AS INT) AS y2
        FROM {_SIZED} m, unnest(range(0, height, 974)) AS a(y), unnest(range(0, width, 974)) AS b(x)
        WHERE least(x + 1024, width) - x >= 32 AND least(y + 1024, height) - y >= 32""",
    ("map_info",),
)
def _(t):
    return op.plan_tiles(_sized(t))


@query(
    "det02_tile_count",
    f"SELECT map_name, CAST(ceil(width / 974) * ceil(height / 974) AS BIGINT) AS tiles, round(CAST(width AS BIGINT) * height / 1e6, 2) AS megapixels FROM {_SIZED}",
    ("map_info",),
)
def _(t):
    return _sized(t).select("map_name", op.tile_count().alias("tiles"), op.megapixels().alias("megapixels"))


@query(
    "det03_image_facts",
    "SELECT path, width, height, round(CAST(width AS BIGINT) * height / 1e6, 2) AS megapixels FROM map_files",
    ("map_files",),
)
def _(t):
    return t.map_files.select("path", "width", "height", op.megapixels().alias("megapixels"))


@query(
    "det04_sheet_coordinates",
    """SELECT map_name, det_id, x1 % 974 + det_id % 5 * 974 AS x1, y1 % 974 + det_id % 7 * 974 AS y1,
         x1 % 974 + x2 - x1 + det_id % 5 * 974 AS x2, y1 % 974 + y2 - y1 + det_id % 7 * 974 AS y2 FROM detections""",
    ("detections",),
)
def _(t):
    # Boxes as a recogniser returns them, measured from the corner of the tile that was looked at.
    local = t.detections.selectExpr(
        "map_name", "det_id", "x1 % 974 AS x1", "y1 % 974 AS y1", "x1 % 974 + x2 - x1 AS x2", "y1 % 974 + y2 - y1 AS y2",
        "CAST(det_id % 5 * 974 AS INT) AS tile_x", "CAST(det_id % 7 * 974 AS INT) AS tile_y",
    )
    return op.to_sheet_coordinates(local).select("map_name", "det_id", "x1", "y1", "x2", "y2")


@query(
    "det05_batches",
    """SELECT map_name, det_id, (rn - 1) // 40 AS batch, (rn - 1) % 40 + 1 AS item FROM (
         SELECT map_name, det_id, row_number() OVER (PARTITION BY map_name ORDER BY y1, x1, det_id) AS rn FROM detections)""",
    ("detections",),
)
def _(t):
    return op.batches(t.detections, 40).select("map_name", "det_id", "batch", "item")


@query(
    "win05_tile_batches",
    """SELECT map_name, x, y, (rn - 1) // 16 AS batch FROM (
         SELECT map_name, x, y, row_number() OVER (PARTITION BY map_name ORDER BY y, x) AS rn FROM
         (SELECT DISTINCT map_name, x1 // 974 * 974 AS x, y1 // 974 * 974 AS y FROM detections))""",
    ("detections",),
)
def _(t):
    tiles = t.detections.select(
        "map_name", F.expr("CAST(x1 div 974 * 974 AS INT)").alias("x"), F.expr("CAST(y1 div 974 * 974 AS INT)").alias("y")
    ).distinct()
    return op.batches(tiles, op.TILES_PER_REQUEST, ("y", "x")).select("map_name", "x", "y", "batch")


_PAIRS = r""", d AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY map_name ORDER BY confidence DESC, y1, x1, det_id) AS pri,
    regexp_replace(lower(text), '[^\p{L}\p{N}]', '', 'g') AS text_key FROM detections),
  meets AS (SELECT a.map_name, a.det_id AS hi, b.det_id AS lo, a.text_key = b.text_key AS same,
      CAST((least(a.x2, b.x2) - greatest(a.x1, b.x1)) * (least(a.y2, b.y2) - greatest(a.y1, b.y1)) AS DOUBLE) AS shared,
      CAST((a.x2 - a.x1) * (a.y2 - a.y1) + (b.x2 - b.x1) * (b.y2 - b.y1) AS DOUBLE) AS both_areas
    FROM d a JOIN d b ON a.map_name = b.map_name AND a.pri < b.pri AND a.x1 < b.x2 AND b.x1 < a.x2 AND a.y1 < b.y2 AND b.y1 < a.y2),
  lapped AS MATERIALIZED (SELECT *, shared / (both_areas - shared) AS iou FROM meets),
  e0 AS MATERIALIZED (SELECT map_name, hi, lo FROM lapped WHERE iou > 0.4 OR (iou > 0.2 AND same))
"""

#: Longest chain of boxes that drop and free one another; the last round checks that none is left.
_MOST_ROUNDS = 10

_ROUNDS = _PAIRS + "".join(
    f""", r{i} AS MATERIALIZED (SELECT DISTINCT map_name, lo AS hi FROM e{i - 1}),
  d{i} AS MATERIALIZED (SELECT DISTINCT e.map_name, e.lo FROM e{i - 1} e ANTI JOIN r{i} r ON r.map_name = e.map_name AND r.hi = e.hi),
  e{i} AS MATERIALIZED (SELECT e.* FROM e{i - 1} e ANTI JOIN d{i} d ON d.map_name = e.map_name AND d.lo = e.lo
         ANTI JOIN d{i} g ON g.map_name = e.map_name AND g.lo = e.hi)
"""
    for i in range(1, _MOST_ROUNDS + 1)
) + ", gone AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT map_name, lo FROM d{i}" for i in range(1, _MOST_ROUNDS + 1)) + """),
  unsettled AS MATERIALIZED (SELECT CASE WHEN count(*) > 0 THEN error('more rounds are needed') END AS none FROM e""" + str(_MOST_ROUNDS) + """)
"""


@query("jon09_better_neighbours", _PAIRS + "SELECT DISTINCT map_name, lo AS det_id FROM lapped", ("detections",))
def _(t):
    return op.better_neighbours(t.detections)


@query(
    "det06_overlap_ratio",
    """, p AS (SELECT map_name, det_id, x1, y1, x2, y2, x1 + det_id % 61 AS u1, y1 + det_id % 13 AS v1, x2 + det_id % 61 AS u2, y2 + det_id % 7 AS v2 FROM detections),
      s AS (SELECT *, CAST(greatest(least(x2, u2) - greatest(x1, u1), 0) * greatest(least(y2, v2) - greatest(y1, v1), 0) AS DOUBLE) AS shared,
        CAST((x2 - x1) * (y2 - y1) + (u2 - u1) * (v2 - v1) AS DOUBLE) AS both_areas FROM p)
      SELECT map_name, det_id, CASE WHEN shared = 0 THEN 0.0::DOUBLE ELSE round(shared / (both_areas - shared), 6) END AS iou FROM s""",
    ("detections",),
)
def _(t):
    def shifted(by):
        return [(F.col(c) + F.col("det_id") % m).alias(c) for c, m in by.items()]

    boxes = t.detections.select(
        "map_name", "det_id", F.struct("x1", "y1", "x2", "y2").alias("a"), F.struct(*shifted({"x1": 61, "y1": 13, "x2": 61, "y2": 7})).alias("b")
    )
    return boxes.select("map_name", "det_id", F.round(op.iou("a.", "b."), 6).alias("iou"))


@query(
    "det07_text_key",
    r"SELECT map_name, det_id, regexp_replace(lower(text), '[^\p{L}\p{N}]', '', 'g') AS text_key FROM detections",
    ("detections",),
)
def _(t):
    return t.detections.select("map_name", "det_id", text_key(F.col("text")).alias("text_key"))


@query(
    "det08_duplicate_pairs",
    _ROUNDS + """SELECT map_name, hi AS keeper, lo AS duplicate, overlap FROM (SELECT l.map_name, l.hi, l.lo, round(l.iou, 6) AS overlap,
        row_number() OVER (PARTITION BY l.map_name, l.lo ORDER BY d.pri) AS rn FROM lapped l JOIN d ON d.map_name = l.map_name AND d.det_id = l.hi
        WHERE (l.iou > 0.4 OR (l.iou > 0.2 AND l.same)) AND (l.map_name, l.hi) NOT IN (SELECT (map_name, lo) FROM gone)
          AND (l.map_name, l.lo) IN (SELECT (map_name, lo) FROM gone)) WHERE rn = 1""",
    ("detections",),
)
def _(t):
    return op.duplicate_pairs(t.detections)


@query(
    "det09_deduplicate",
    _ROUNDS + """SELECT d.map_name, det_id, text, confidence, x1, y1, x2, y2 FROM detections d CROSS JOIN unsettled
      ANTI JOIN gone g ON g.map_name = d.map_name AND g.lo = d.det_id WHERE unsettled.none IS NULL""",
    ("detections",),
)
def _(t):
    return op.deduplicate(t.detections).select("map_name", "det_id", "text", "confidence", "x1", "y1", "x2", "y2")


@query(
    "det10_dedupe_report",
    _ROUNDS + """SELECT map_name, count(*) AS raw, count(*) FILTER ((map_name, det_id) NOT IN (SELECT (map_name, lo) FROM gone)) AS kept,
      count(*) FILTER ((map_name, det_id) IN (SELECT (map_name, lo) FROM gone)) AS removed FROM detections GROUP BY 1""",
    ("detections",),
)
def _(t):
    return op.dedupe_report(t.detections, op.dropped_boxes(t.detections))


_LEGEND = """, lines AS (SELECT s.map_name, min(y1) AS line_y FROM segments s WHERE degrees(atan2(abs(y2 - y1), abs(x2 - x1))) < 5 AND y1 >= 4900 GROUP BY 1),
  legend AS (SELECT m.map_name, CAST(CASE WHEN line_y IS NULL THEN 6160 ELSE greatest(line_y, 5250) END AS INT) AS legend_top
    FROM map_info m LEFT JOIN lines l ON l.map_name = m.map_name)"""


@query("det11_legend_top", _LEGEND + " SELECT map_name, legend_top FROM legend", ("segments", "map_info"))
def _(t):
    return op.legend_top(t.segments, t.map_info)


@query(
    "det12_map_body",
    _LEGEND + " SELECT d.map_name, d.det_id, d.y2 FROM detections d JOIN legend l ON l.map_name = d.map_name WHERE d.y2 <= l.legend_top",
    ("segments", "map_info", "detections"),
)
def _(t):
    return op.map_body(t.detections.select("map_name", "det_id", "y2"), op.legend_top(t.segments, t.map_info))
