"""Facts in map names (MET) and the deduplicated catalogue (SRC-02)."""

from __future__ import annotations

from pyspark.sql import functions as F

from sheetlore.functions.names import split_map_name
from sheetlore.operators import sheet_metadata as op
from sheetlore.plans.registry import query
from sheetlore.sources import catalogue

_FILE = r"(?i)^(\d{1,3})\s+([A-HJ-P])\](\d{1,2})\s+([^(]+?)\s*\((\d{4})\)(.*)"
_BLOCKS = ", ".join(f"('{b}', {lat}, {lon})" for b, (lat, lon) in op.BLOCK_CORNERS.items())
_FACTS = f""", stems AS (SELECT path, width, height, regexp_replace(regexp_extract(path, '([^/]*)$', 1), '\\.[^.]*$', '') AS raw_name FROM map_files),
  groups AS (SELECT *, regexp_matches(raw_name, '{_FILE}') AS ok, regexp_extract(raw_name, '{_FILE}', 1) AS g1, upper(regexp_extract(raw_name, '{_FILE}', 2)) AS g2,
    TRY_CAST(regexp_extract(raw_name, '{_FILE}', 3) AS INT) AS g3, trim(regexp_extract(raw_name, '{_FILE}', 4)) AS g4,
    TRY_CAST(regexp_extract(raw_name, '{_FILE}', 5) AS INT) AS g5, trim(regexp_extract(raw_name, '{_FILE}', 6)) AS g6 FROM stems),
  corners AS (SELECT * FROM (VALUES {_BLOCKS}) v(b, lat, lon)),
  facts AS (SELECT path, raw_name, CASE WHEN ok THEN g1 END AS block, CASE WHEN ok THEN g2 END AS sheet_letter, CASE WHEN ok THEN g3 END AS sheet_num,
    CASE WHEN ok THEN g1 || g2 || '/' || lpad(CAST(g3 AS VARCHAR), 2, '0') ELSE raw_name END AS sheet_ref,
    CASE WHEN ok THEN trim(rtrim(rtrim(trim(regexp_replace(g4, '(?i)\\s+(Districts?|Dist\\.?|Pargana|Parganas)$', '')), '&'), ',')) ELSE '' END AS district,
    CASE WHEN ok THEN g5 END AS year, CASE WHEN ok AND g5 < 1960 THEN 63360 ELSE 50000 END AS scale_guess,
    CASE WHEN ok THEN array_to_string(list_filter([CASE WHEN regexp_matches(g6, '(?i)\\bBW\\b') THEN 'Black & White scan' END,
      CASE WHEN regexp_matches(g6, '(?i)Prelim') THEN 'Preliminary edition' END, CASE WHEN contains(g6, '@') THEN 'Partial/damaged sheet' END,
      CASE WHEN regexp_matches(g6, '35\\s*[Mm][Mm]') THEN '35mm film scan' END], lambda x: x IS NOT NULL), '; ') ELSE '' END AS notes,
    CASE WHEN ok THEN lat END AS approx_lat, CASE WHEN ok THEN lon END AS approx_lon FROM groups LEFT JOIN corners ON b = g1)
"""


@query("met01_file_facts", _FACTS + "SELECT path, raw_name, block, sheet_letter, sheet_num, year FROM facts", ("map_files",))
def _(t):
    return op.file_facts(t.map_files).select("path", "raw_name", "block", "sheet_letter", "sheet_num", "year")


@query("met02_districts", _FACTS + "SELECT path, district FROM facts", ("map_files",))
def _(t):
    return op.file_facts(t.map_files).select("path", "district")


@query("met03_quality_notes", _FACTS + "SELECT path, notes FROM facts", ("map_files",))
def _(t):
    return op.file_facts(t.map_files).select("path", "notes")


@query("met04_reference_and_scale", _FACTS + "SELECT path, sheet_ref, scale_guess FROM facts", ("map_files",))
def _(t):
    return op.file_facts(t.map_files).select("path", "sheet_ref", "scale_guess")


@query("met05_block_corners", _FACTS + "SELECT path, approx_lat, approx_lon FROM facts", ("map_files",))
def _(t):
    return op.file_facts(t.map_files).select("path", "approx_lat", "approx_lon")


@query(
    "met06_sheet_boxes",
    _FACTS + """, k AS (SELECT *, strpos('ABCDEFGHJKLMNOP', sheet_letter) - 1 AS l, sheet_num - 1 AS s FROM facts),
      q AS (SELECT *, (l % 4) * 4 + s % 4 AS e, (l // 4) * 4 + s // 4 AS d FROM k)
      SELECT path, round((approx_lat + 1) - d * 0.25::DOUBLE - 0.25::DOUBLE, 4) AS lat_min, round((approx_lat + 1) - d * 0.25::DOUBLE, 4) AS lat_max,
        round(approx_lon + e * 0.25::DOUBLE, 4) AS lon_min, round(approx_lon + e * 0.25::DOUBLE + 0.25::DOUBLE, 4) AS lon_max FROM q""",
    ("map_files",),
)
def _(t):
    return op.sheet_box(op.file_facts(t.map_files)).select("path", "lat_min", "lat_max", "lon_min", "lon_max")


@query(
    "met07_short_names",
    _FACTS + "SELECT path, CASE WHEN year IS NOT NULL AND sheet_ref <> raw_name THEN replace(sheet_ref, '/', '_') || '_' || year ELSE raw_name END AS short_name FROM facts",
    ("map_files",),
)
def _(t):
    return op.short_name(op.file_facts(t.map_files)).select("path", "short_name")


_DASHED = r"^(\d+)-([A-Z]+)-(\d+)-(.+?)-(\d{4})-"
_NUMBERED = r"^(\d+\s+[A-Z]+(?:[/\]]\d+)?)"


@query(
    "met08_split_map_names",
    _FACTS + f"""SELECT path, CASE WHEN regexp_matches(raw_name, '{_DASHED}') THEN regexp_extract(raw_name, '{_DASHED}', 1) || ' ' || regexp_extract(raw_name, '{_DASHED}', 2)
         || '/' || regexp_extract(raw_name, '{_DASHED}', 3) ELSE trim(replace(regexp_extract(trim(raw_name), '{_NUMBERED}', 1), ']', '/')) END AS map_number,
       CASE WHEN regexp_matches(raw_name, '{_DASHED}') THEN regexp_extract(raw_name, '{_DASHED}', 4)
         ELSE trim(regexp_replace(trim(regexp_replace(trim(regexp_replace(raw_name, '^\\s*\\d+\\s+[A-Z]+(?:[/\\]]\\d+)?', '')), '\\s*\\(\\d{{4}}\\).*$', '')), '\\s*\\(\\d+\\)\\s*$', '')) END AS sheet_name,
       CASE WHEN regexp_matches(raw_name, '{_DASHED}') THEN regexp_extract(raw_name, '{_DASHED}', 5) ELSE regexp_extract(raw_name, '\\((\\d{{4}})\\)', 1) END AS year FROM facts""",
    ("map_files",),
)
def _(t):
    from sheetlore.functions.names import file_stem

    stems = t.map_files.select("path", file_stem(F.col("path")).alias("raw_name"))
    return stems.select("path", *[c.alias(n) for n, c in split_map_name(F.col("raw_name")).items()])


@query(
    "src02_catalogue_dedupe",
    _FACTS + "SELECT lower(raw_name) AS map_key, min(path) AS path FROM facts GROUP BY 1",
    ("map_files",),
)
def _(t):
    return catalogue.first_of_each_stem(t.map_files).select("map_key", "path")
