"""Grid lines, references and cells (GRD, JON-10, JON-12, WIN-03, WIN-04)."""

from __future__ import annotations

from pyspark.sql import functions as F

from sheetlore.operators import grid as op
from sheetlore.plans.registry import query

_CENTRE = "(x1 + x2) / 2.0::DOUBLE AS cx, (y1 + y2) / 2.0::DOUBLE AS cy"


@query("grd01_centres", f"SELECT map_name, det_id, {_CENTRE} FROM detections", ("detections",))
def _(t):
    return t.detections.select("map_name", "det_id", op.centre("x1", "x2").alias("cx"), op.centre("y1", "y2").alias("cy"))


_LABELS = f""", l0 AS (SELECT l.*, {_CENTRE}, m.width, m.height,
    upper(CASE trim(text) WHEN '0' THEN 'O' ELSE trim(text) END) AS letter,
    upper(CASE trim(text) WHEN 'l' THEN '1' WHEN 'I' THEN '1' WHEN 'S' THEN '5' WHEN 'G' THEN '6' ELSE trim(text) END) AS digits
    FROM margin_labels l JOIN map_info m ON m.map_name = l.map_name),
  fitting AS (SELECT * FROM l0 WHERE abs(y2 - y1) <= height * 0.04::DOUBLE AND coalesce(red_share >= 0.04, true)),
  l1 AS (SELECT *, 'col' AS axis, letter AS label FROM fitting
      WHERE regexp_full_match(letter, '[A-Z]') AND (cy < height * 0.15::DOUBLE OR cy > height - height * 0.15::DOUBLE)
    UNION ALL SELECT *, 'row', digits FROM fitting
      WHERE regexp_full_match(digits, '[0-9]{{1,2}}') AND (cx < width * 0.15::DOUBLE OR cx > width - width * 0.15::DOUBLE)),
  candidates AS (SELECT map_name, axis, label, CASE axis WHEN 'col' THEN ascii(label) - 64 ELSE CAST(label AS INT) END AS ord,
      CASE axis WHEN 'col' THEN cx ELSE cy END AS pos, CASE axis WHEN 'col' THEN abs(cy - height / 2.0::DOUBLE) ELSE abs(cx - width / 2.0::DOUBLE) END AS away
    FROM l1),
  positions AS (SELECT map_name, axis, label, ord, pos FROM (SELECT *, row_number() OVER (PARTITION BY map_name, axis, label ORDER BY away, pos) AS rn
    FROM candidates) WHERE rn = 1),
  islands AS (SELECT *, ord - row_number() OVER (PARTITION BY map_name, axis ORDER BY ord) AS island FROM (
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY map_name, axis, ord ORDER BY label, pos) AS nth FROM positions) WHERE nth = 1)),
  run AS (SELECT map_name, axis, ord, label, pos FROM (SELECT *, first_value(island) OVER (PARTITION BY map_name, axis ORDER BY ord) AS fi FROM islands)
    WHERE island = fi)
"""


def _clusters(source: str, gap: str, name: str = "clustered") -> str:
    return f""", {name} AS (SELECT map_name, axis, list(line ORDER BY line) AS lines FROM (
    SELECT map_name, axis, cluster, sum(pos) / count(*) AS line FROM (
      SELECT *, sum(starts) OVER (PARTITION BY map_name, axis ORDER BY pos) AS cluster FROM (
        SELECT map_name, axis, pos, CASE WHEN pos - lag(pos) OVER (PARTITION BY map_name, axis ORDER BY pos) < {gap} THEN 0 ELSE 1 END AS starts
        FROM (SELECT DISTINCT map_name, axis, pos FROM {source})))
    GROUP BY 1, 2, 3) GROUP BY 1, 2)
"""


@query("grd02_label_repair", _LABELS + "SELECT text, letter, digits, count(*) AS n FROM l0 GROUP BY 1, 2, 3", ("margin_labels", "map_info"))
def _(t):
    rows = t.margin_labels.groupBy("text").agg(F.count("*").alias("n"))
    letter, digits = (op.repaired_label(F.col("text"), r) for r in (op.LETTER_REPAIRS, op.DIGIT_REPAIRS))
    return rows.select("text", letter.alias("letter"), digits.alias("digits"), "n")


@query("grd03_margin_labels", _LABELS + "SELECT map_name, axis, label, CAST(ord AS INT) AS ord, pos FROM candidates", ("margin_labels", "map_info"))
def _(t):
    return op.margin_labels(t.margin_labels, t.map_info).select("map_name", "axis", "label", "ord", "pos")


@query("grd04_label_positions", _LABELS + "SELECT map_name, axis, label, pos FROM positions", ("margin_labels", "map_info"))
def _(t):
    return op.label_positions(op.margin_labels(t.margin_labels, t.map_info)).select("map_name", "axis", "label", "pos")


@query("grd05_first_run", _LABELS + "SELECT map_name, axis, label, pos FROM run", ("margin_labels", "map_info"))
def _(t):
    positions = op.label_positions(op.margin_labels(t.margin_labels, t.map_info))
    return op.first_run(positions).select("map_name", "axis", "label", "pos")


@query(
    "win04_label_islands",
    _LABELS + "SELECT map_name, axis, CAST(island AS BIGINT) AS island, count(*) AS labels, min(ord)::INT AS first_ord FROM islands GROUP BY 1, 2, 3",
    ("margin_labels", "map_info"),
)
def _(t):
    from pyspark.sql import Window

    positions = op.one_label_per_number(op.label_positions(op.margin_labels(t.margin_labels, t.map_info)))
    along = Window.partitionBy("map_name", "axis").orderBy("ord")
    islands = positions.withColumn("island", (F.col("ord") - F.row_number().over(along)).cast("bigint"))
    return islands.groupBy("map_name", "axis", "island").agg(F.count("*").alias("labels"), F.min("ord").alias("first_ord"))


_EXPLODED = "SELECT map_name, axis, round(unnest(lines), 6) AS line FROM clustered"


def _exploded(lines):
    return lines.select("map_name", "axis", F.explode("lines").alias("line")).withColumn("line", F.round("line", 6))


@query("grd06_cluster_positions", _clusters("line_positions", "50").lstrip() + _EXPLODED, ("line_positions",))
def _(t):
    return _exploded(op.cluster_positions(t.line_positions, 50))


_GAPS = """, ordered AS (SELECT map_name, axis, unnest(lines) AS line, len(lines) AS n FROM clustered),
  gaps AS (SELECT map_name, axis, lead(line) OVER (PARTITION BY map_name, axis ORDER BY line) - line AS gap FROM ordered),
  scores AS (SELECT c.map_name, c.axis, CASE WHEN len(c.lines) < 2 THEN 0.0::DOUBLE ELSE
     (SELECT CASE WHEN avg(gap) = 0 THEN 0.0::DOUBLE ELSE greatest(0.0::DOUBLE, 1.0 - stddev_pop(gap) / avg(gap)) END FROM gaps g
      WHERE g.map_name = c.map_name AND g.axis = c.axis) END AS score FROM clustered c)
"""


@query(
    "grd07_regularity",
    _clusters("line_positions", "50") + _GAPS + "SELECT map_name, axis, round(score, 6) AS score FROM scores",
    ("line_positions",),
)
def _(t):
    lines = op.cluster_positions(t.line_positions, 50)
    return lines.select("map_name", "axis", F.round(op.regularity(F.col("lines")), 6).alias("score"))


@query(
    "win03_position_gaps",
    _clusters("line_positions", "50") + _GAPS + "SELECT map_name, axis, round(gap, 6) AS gap FROM gaps WHERE gap IS NOT NULL",
    ("line_positions",),
)
def _(t):
    lines = op.cluster_positions(t.line_positions, 50)
    return lines.select("map_name", "axis", F.explode(op.line_gaps(F.col("lines"))).alias("gap")).withColumn("gap", F.round("gap", 6))


def _grown(extent: str, name: str = "grown", source: str = "clustered", parts: int = 5) -> str:
    return f""", sized_{name} AS (SELECT *, len(lines) AS n, {extent} AS extent,
      list_sort(list_transform(range(1, len(lines)), lambda i: lines[i + 1] - lines[i])) AS gaps FROM {source}),
  stepped_{name} AS (SELECT *, gaps[CAST(floor(len(gaps) / 2) AS BIGINT) + 1] AS step FROM sized_{name}),
  {name} AS (SELECT map_name, axis, extent, CASE WHEN n >= 2 AND n < {parts} THEN
      list_filter(list_concat(
        list_reverse(list_transform(range(1, greatest(0, CAST(ceil(lines[1] / step) AS BIGINT) - 1) + 1), lambda k: lines[1] - k * step)), lines,
        list_transform(range(1, greatest(0, CAST(ceil((extent - lines[n]) / step) AS BIGINT) - 1) + 1), lambda k: lines[n] + k * step)),
        lambda p: p >= 0 AND p <= extent)
      ELSE lines END AS lines, n FROM stepped_{name})
"""


_EXTENT = "CAST(CASE axis WHEN 'col' THEN 5000 ELSE 7000 END AS DOUBLE)"


@query(
    "grd08_extrapolated_lines",
    _clusters("line_positions", "50") + _grown(_EXTENT) + "SELECT map_name, axis, round(unnest(lines), 6) AS line FROM grown",
    ("line_positions",),
)
def _(t):
    lines = op.cluster_positions(t.line_positions, 50)
    extent = F.when(F.col("axis") == "col", 5000).otherwise(7000).cast("double")
    return _exploded(lines.withColumn("lines", op.extrapolated(F.col("lines"), extent, F.lit(5))))


_ALL_AXES = """, axes AS (SELECT m.map_name, a.axis, coalesce(c.lines, []) AS lines FROM map_info m CROSS JOIN (VALUES ('col'), ('row')) a(axis)
   LEFT JOIN clustered c ON c.map_name = m.map_name AND c.axis = a.axis)
"""
_FINAL = _ALL_AXES + _grown(_EXTENT, source="axes") + """, completed AS (SELECT map_name, axis, CASE WHEN n >= 2 THEN lines
   ELSE list_transform(range(1, 4), lambda i: extent * i / 4.0::DOUBLE) END AS lines FROM grown)
"""


def _line_grid(t):
    empty = F.array().cast("array<double>")
    lines = op.pivot_axes(op.cluster_positions(t.line_positions, 50))
    chosen = t.map_info.select("map_name", "width", "height").join(lines, "map_name", "left")
    chosen = chosen.withColumns(
        {"col_lines": F.coalesce("col_lines", empty), "row_lines": F.coalesce("row_lines", empty), "method": F.lit("margin-labels")}
    )
    return op.final_grid(chosen)


@query(
    "grd09_equal_division_fallback",
    _clusters("line_positions", "50") + _FINAL + "SELECT map_name, axis, round(unnest(lines), 6) AS line FROM completed",
    ("line_positions", "map_info"),
)
def _(t):
    grid = _line_grid(t)
    both = F.array(
        F.struct(F.lit("col").alias("axis"), F.col("col_lines").alias("lines")),
        F.struct(F.lit("row").alias("axis"), F.col("row_lines").alias("lines")),
    )
    return _exploded(grid.select("map_name", F.inline(both)))


_SCORED = """, ordered AS (SELECT map_name, axis, unnest(lines) AS line FROM completed),
  gaps AS (SELECT map_name, axis, lead(line) OVER (PARTITION BY map_name, axis ORDER BY line) - line AS gap FROM ordered),
  scores AS (SELECT map_name, axis, greatest(0.0::DOUBLE, 1.0 - stddev_pop(gap) / avg(gap)) AS score FROM gaps WHERE gap IS NOT NULL GROUP BY 1, 2),
  graded AS (SELECT map_name, round(sum(coalesce(score, 0)) / 2, 3) AS grid_confidence FROM scores GROUP BY 1)
"""


@query(
    "grd10_grid_confidence",
    _clusters("line_positions", "50") + _FINAL + _SCORED + """SELECT map_name, grid_confidence,
      CASE WHEN grid_confidence < 0.4 THEN 'margin-labels (equal division)' ELSE 'margin-labels' END AS method FROM graded""",
    ("line_positions", "map_info"),
)
def _(t):
    return _line_grid(t).select("map_name", "grid_confidence", "method")


_SEGMENT = """, oriented AS (SELECT *, degrees(atan2(abs(y2 - y1), abs(x2 - x1))) AS angle FROM segments),
  seg AS (SELECT map_name, CASE WHEN angle < {a} THEN 'row' ELSE 'col' END AS axis,
    CASE WHEN angle < {a} THEN (y1 + y2) / 2.0::DOUBLE ELSE (x1 + x2) / 2.0::DOUBLE END AS pos FROM oriented WHERE angle < {a} OR angle > {b})
"""


@query("grd11_segment_positions", _SEGMENT.format(a=3, b=87) + "SELECT map_name, axis, pos FROM seg", ("segments",))
def _(t):
    return op.segment_positions(t.segments)


@query("grd11_segment_positions_wide", _SEGMENT.format(a=5, b=85) + "SELECT map_name, axis, pos FROM seg", ("segments",))
def _(t):
    return op.segment_positions(t.segments, 5.0, 85.0)


_CHOICE = (
    _LABELS + _clusters("run", "50", "label_lines") + _SEGMENT.format(a=3, b=87) + _clusters("seg", "50", "image_lines") + """
, sides AS (SELECT m.map_name, coalesce(lc.lines, []) AS lc, coalesce(lr.lines, []) AS lr, coalesce(ic.lines, []) AS ic, coalesce(ir.lines, []) AS ir
   FROM map_info m LEFT JOIN label_lines lc ON lc.map_name = m.map_name AND lc.axis = 'col'
   LEFT JOIN label_lines lr ON lr.map_name = m.map_name AND lr.axis = 'row'
   LEFT JOIN image_lines ic ON ic.map_name = m.map_name AND ic.axis = 'col'
   LEFT JOIN image_lines ir ON ir.map_name = m.map_name AND ir.axis = 'row'),
  picked AS (SELECT map_name, (len(lc) < 2 OR len(lr) < 2) AND len(ic) > len(lc) AS use_c, (len(lc) < 2 OR len(lr) < 2) AND len(ir) > len(lr) AS use_r,
    lc, lr, ic, ir FROM sides),
  chosen AS (SELECT map_name, CASE WHEN use_c THEN ic ELSE lc END AS col_lines, CASE WHEN use_r THEN ir ELSE lr END AS row_lines,
    CASE WHEN use_c OR use_r THEN 'image-lines' ELSE 'margin-labels' END AS method FROM picked)
"""
)


def _chosen(t):
    run = op.first_run(op.label_positions(op.margin_labels(t.margin_labels, t.map_info)))
    return op.choose_lines(t.map_info, op.cluster_positions(run), op.cluster_positions(op.segment_positions(t.segments)))


@query(
    "grd12_line_choice",
    _CHOICE + "SELECT map_name, len(col_lines) AS n_cols, len(row_lines) AS n_rows, method, round(list_sum(col_lines), 3) AS col_sum FROM chosen",
    ("margin_labels", "map_info", "segments"),
)
def _(t):
    total = F.aggregate("col_lines", F.lit(0.0), lambda a, v: a + v)
    return _chosen(t).select(
        "map_name", F.size("col_lines").cast("bigint").alias("n_cols"), F.size("row_lines").cast("bigint").alias("n_rows"), "method",
        F.when(F.size("col_lines") > 0, F.round(total, 3)).alias("col_sum"),
    )


@query(
    "grd13_legacy_labels",
    f""", l AS (SELECT map_name, upper(trim(text)) AS label, {_CENTRE} FROM margin_labels),
      hits AS (SELECT map_name, CASE WHEN regexp_full_match(label, '[A-Z]') THEN 'row' ELSE 'col' END AS axis,
        CASE WHEN regexp_full_match(label, '[A-Z]') THEN cy ELSE cx END AS line FROM l
        WHERE (regexp_full_match(label, '[A-Z]') AND (cx < 80 OR cx > 4920)) OR (regexp_full_match(label, '[0-9]{{1,2}}') AND (cy < 80 OR cy > 6920)))
      SELECT DISTINCT map_name, axis, line FROM hits""",
    ("margin_labels",),
)
def _(t):
    grids = op.legacy_labels(t.margin_labels, t.map_info)
    both = F.array(
        F.struct(F.lit("col").alias("axis"), F.col("col_lines").alias("lines")),
        F.struct(F.lit("row").alias("axis"), F.col("row_lines").alias("lines")),
    )
    return grids.select("map_name", F.inline(both)).select("map_name", "axis", F.explode("lines").alias("line"))


_FINAL_PIVOT = _FINAL + """, g AS (SELECT map_name, max(CASE WHEN axis = 'col' THEN lines END) AS col_lines, max(CASE WHEN axis = 'row' THEN lines END) AS row_lines
  FROM completed GROUP BY 1)
"""
_REFERENCE = """, placed AS (SELECT d.map_name, d.det_id, len(list_filter(col_lines, lambda p: p < (x1 + x2) / 2.0::DOUBLE)) AS c,
   len(list_filter(row_lines, lambda p: p < (y1 + y2) / 2.0::DOUBLE)) AS r FROM detections d JOIN g ON g.map_name = d.map_name),
  referenced AS (SELECT map_name, det_id, (r + 1) || CASE WHEN c < 26 THEN chr(CAST(65 + c AS INT)) ELSE 'C' || c END AS grid_reference FROM placed)
"""


@query(
    "jon10_lines_before_centre",
    _clusters("line_positions", "50") + _FINAL_PIVOT + _REFERENCE + "SELECT map_name, det_id, c AS lines_left, r AS lines_above FROM placed",
    ("line_positions", "map_info", "detections"),
)
def _(t):
    joined = t.detections.select("map_name", "det_id", "x1", "y1", "x2", "y2").join(
        _line_grid(t).select("map_name", "col_lines", "row_lines"), "map_name"
    )
    return joined.select(
        "map_name", "det_id", op.lines_before(F.col("col_lines"), op.centre("x1", "x2")).cast("bigint").alias("lines_left"),
        op.lines_before(F.col("row_lines"), op.centre("y1", "y2")).cast("bigint").alias("lines_above"),
    )


@query(
    "grd14_grid_reference",
    _clusters("line_positions", "50") + _FINAL_PIVOT + _REFERENCE + "SELECT map_name, det_id, grid_reference FROM referenced",
    ("line_positions", "map_info", "detections"),
)
def _(t):
    return op.grid_reference(t.detections.select("map_name", "det_id", "x1", "y1", "x2", "y2"), _line_grid(t)).select(
        "map_name", "det_id", "grid_reference"
    )


@query(
    "grd18_cells_occupied",
    _clusters("line_positions", "50") + _FINAL_PIVOT + _REFERENCE + "SELECT map_name, count(DISTINCT grid_reference) AS cells FROM referenced GROUP BY 1",
    ("line_positions", "map_info", "detections"),
)
def _(t):
    placed = op.grid_reference(t.detections.select("map_name", "x1", "y1", "x2", "y2"), _line_grid(t))
    return op.cells_occupied(placed)


@query(
    "grd15_row_first_reference",
    _clusters("line_positions", "50") + """, raw AS (SELECT m.map_name, c.lines AS col_lines, r.lines AS row_lines FROM map_info m
       LEFT JOIN clustered c ON c.map_name = m.map_name AND c.axis = 'col' LEFT JOIN clustered r ON r.map_name = m.map_name AND r.axis = 'row'),
     placed AS (SELECT d.map_name, d.det_id,
       CASE WHEN col_lines IS NULL THEN least(CAST(floor((x1 + x2) / 2.0::DOUBLE / 5000 * 4) AS INT), 3)
         ELSE len(list_filter(col_lines, lambda p: p < (x1 + x2) / 2.0::DOUBLE)) END AS c,
       CASE WHEN row_lines IS NULL THEN least(CAST(floor((y1 + y2) / 2.0::DOUBLE / 7000 * 4) AS INT), 3)
         ELSE len(list_filter(row_lines, lambda p: p < (y1 + y2) / 2.0::DOUBLE)) END AS r FROM detections d JOIN raw g ON g.map_name = d.map_name)
     SELECT map_name, det_id, CASE WHEN r < 26 THEN chr(CAST(65 + r AS INT)) ELSE 'R' || r END || '-' || (c + 1) AS grid_reference FROM placed""",
    ("line_positions", "map_info", "detections"),
)
def _(t):
    lines = op.pivot_axes(op.cluster_positions(t.line_positions, 50))
    grids = t.map_info.select("map_name", "width", "height").join(lines, "map_name", "left")
    boxes = t.detections.select("map_name", "det_id", "x1", "y1", "x2", "y2")
    return op.grid_reference_row_first(boxes, grids).select("map_name", "det_id", "grid_reference")


_CELLS = """SELECT map_name, CAST(r AS INT) AS row_no, CAST(k AS INT) AS col_no,
   round(lat_max - r * ((lat_max - lat_min) / n_rows), 6) AS lat_min, round(lat_max - (r - 1) * ((lat_max - lat_min) / n_rows), 6) AS lat_max,
   round(lon_min + (k - 1) * ((lon_max - lon_min) / n_cols), 6) AS lon_min, round(lon_min + k * ((lon_max - lon_min) / n_cols), 6) AS lon_max
   FROM map_info, unnest(range(1, n_rows + 1)) AS a(r), unnest(range(1, n_cols + 1)) AS b(k) WHERE lat_min IS NOT NULL"""


@query("grd16_cell_coordinates", _CELLS, ("map_info",))
def _(t):
    return op.cells_of_maps(t.map_info)


_LINE_CELLS = """, sized AS (SELECT m.map_name, m.lat_min, m.lat_max, m.lon_min, m.lon_max, greatest(len(row_lines) + 1, 4) AS n_rows,
    greatest(len(col_lines) + 1, 4) AS n_cols FROM map_info m JOIN g ON g.map_name = m.map_name)
"""


@query(
    "grd16_cells_of_lines",
    _clusters("line_positions", "50") + _FINAL_PIVOT + _LINE_CELLS + _CELLS.replace("FROM map_info", "FROM sized"),
    ("line_positions", "map_info"),
)
def _(t):
    bounds = t.map_info.select("map_name", "lat_min", "lat_max", "lon_min", "lon_max")
    return op.cells_of_maps(bounds.join(op.cell_counts(_line_grid(t)), "map_name"))


@query(
    "jon12_label_product",
    "SELECT map_name, chr(CAST(64 + k AS INT)) || '-' || r AS cell_key FROM map_info, unnest(range(1, n_rows + 1)) AS a(r), unnest(range(1, n_cols + 1)) AS b(k) WHERE lat_min IS NOT NULL",
    ("map_info",),
)
def _(t):
    return op.cells_of_maps(t.map_info).select("map_name", op.cell_key(F.col("row_no"), F.col("col_no")).alias("cell_key"))


@query(
    "grd17_cell_keys",
    """, k AS (SELECT id, CAST(id % 40 + 1 AS INT) AS col_no, CAST(id // 64 % 35 + 1 AS INT) AS row_no FROM features)
       SELECT id, CAST(substr(grid_reference, 1, 1) AS INT) AS a_row, ascii(substr(grid_reference, 2, 1)) - 64 AS a_col,
         row_no AS b_row, col_no AS b_col, row_no AS c_row, col_no AS c_col, row_no AS d_row, col_no AS d_col
       FROM features JOIN k USING (id)""",
    ("features",),
)
def _(t):
    col_no, row_no = (F.col("id") % 40 + 1).cast("int"), (F.shiftright("id", 6) % 35 + 1).cast("int")
    wide = F.when(col_no <= 26, F.chr(col_no + 64)).otherwise(F.concat(F.lit("C"), (col_no - 1).cast("string")))
    tall = F.when(row_no <= 26, F.chr(row_no + 64)).otherwise(F.concat(F.lit("R"), (row_no - 1).cast("string")))
    keys = {
        "a": op.parse_cell_key(F.col("grid_reference"), "2B"),
        "b": op.parse_cell_key(F.concat(row_no.cast("string"), wide), "2B"),
        "c": op.parse_cell_key(F.concat(F.lower(tall), F.lit("-"), col_no.cast("string"), F.lit("\t")), "row-col"),
        "d": op.parse_cell_key(op.cell_key(row_no, col_no), "col-row"),
    }
    return t.features.select("id", *[c.alias(f"{k}_{n}") for k, pair in keys.items() for c, n in zip(pair, ("row", "col"), strict=True)])
