"""Detections to located features in one plan: deduplicate, classify, place, locate, count."""

from __future__ import annotations

from pyspark.sql import functions as F

from sheetlore.operators import cleaning, detections, grid, merging
from sheetlore.operators.filters import not_noise
from sheetlore.operators.statistics import exact_mean
from sheetlore.plans import cleaning as cleaning_sql
from sheetlore.plans import detections as detection_sql
from sheetlore.plans import grid as grid_sql
from sheetlore.plans.registry import query

_SQL = (
    detection_sql._ROUNDS
    + cleaning_sql._CLASSES
    + grid_sql._clusters("line_positions", "50")
    + grid_sql._FINAL_PIVOT
    + grid_sql._REFERENCE
    + grid_sql._LINE_CELLS
    + """, cells AS (SELECT map_name, r AS row_no, k AS col_no FROM sized, unnest(range(1, n_rows + 1)) AS a(r), unnest(range(1, n_cols + 1)) AS b(k)
        WHERE lat_min IS NOT NULL)
   SELECT f.feature_type, p.grid_reference, count(*) AS n, count(cells.map_name) AS located,
     coalesce(round(CAST(sum(CAST(round(f.confidence * 10000) AS BIGINT)) AS BIGINT) / count(f.confidence) / 10000, 3), 0.0) AS mean_confidence
   FROM classified f JOIN referenced p ON p.map_name = f.map_name AND p.det_id = f.det_id
   JOIN placed q ON q.map_name = f.map_name AND q.det_id = f.det_id
   LEFT JOIN cells ON cells.map_name = f.map_name AND cells.row_no = q.r + 1 AND cells.col_no = q.c + 1
   WHERE f.feature_type <> 'noise' AND (f.map_name, f.det_id) NOT IN (SELECT (map_name, lo) FROM gone) GROUP BY 1, 2"""
)


def located_features(boxes, line_positions, maps):
    """Deduplicated, classified features with grid reference and cell coordinates."""
    kept = detections.deduplicate(boxes)
    features = not_noise(cleaning.classify(kept))
    lines = grid.pivot_axes(grid.cluster_positions(line_positions))
    empty = F.array().cast("array<double>")
    chosen = maps.select("map_name", "width", "height").join(lines, "map_name", "left").withColumns(
        {"col_lines": F.coalesce("col_lines", empty), "row_lines": F.coalesce("row_lines", empty), "method": F.lit("margin-labels")}
    )
    final = grid.final_grid(chosen)
    placed = grid.grid_reference(features, final)
    keyed = placed.select("*", *grid.parse_cell_key(F.col("grid_reference"), "2B"))
    bounds = maps.select("map_name", "lat_min", "lat_max", "lon_min", "lon_max")
    return merging.attach_cells(keyed, grid.cells_of_maps(bounds.join(grid.cell_counts(final), "map_name")))


@query("flagship_located_features", _SQL, ("detections", "line_positions", "map_info"))
def _(t):
    rows = located_features(t.detections, t.line_positions, t.map_info)
    return rows.groupBy("feature_type", "grid_reference").agg(
        F.count("*").alias("n"), F.count("lat_min").alias("located"), exact_mean("confidence").alias("mean_confidence")
    )
