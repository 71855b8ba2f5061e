"""Map-sheet tables expressed as column mappings over the warehouse tables.

Each mapping is a SELECT that Spark and the reference database read alike, so that both
start from the same rows. Every mapped table grows with the table it is mapped from.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sheetlore.session import keep_stages_compiled, spread

IMAGE_WIDTH = 5000
IMAGE_HEIGHT = 7000

BASE_TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)

_PLACE_NAME = """
  CASE WHEN p_partkey % 19 = 0 THEN CAST(p_size AS STRING)
       ELSE CASE WHEN p_partkey % 2 = 0 THEN upper(substr(p_name, 1, 1)) || substr(p_name, 2)
                 ELSE p_name END
            || CASE p_partkey % 17 WHEN 0 THEN ' Nadi' WHEN 1 THEN ' Lake' WHEN 2 THEN ' Pahar'
                 WHEN 3 THEN ' RF' WHEN 4 THEN ' Road' WHEN 5 THEN 'pur' WHEN 6 THEN ', (old)' ELSE '' END
  END"""

_FEATURE_TYPE = """
  CASE WHEN p_size = 1 THEN NULL
       WHEN p_type = 'PROMO' THEN 'noise' WHEN p_type = 'ECONOMY' THEN 'settlement'
       WHEN p_type = 'MEDIUM' THEN 'river' WHEN p_type = 'SMALL' THEN 'mountain'
       WHEN p_type = 'LARGE' THEN 'lake' WHEN p_type = 'STANDARD' THEN 'road' ELSE 'unknown' END"""

# One row per line item, before the second copy a tile seam produces.
_BOXES = f"""
SELECT 'MAP_' || CAST(l_suppkey AS STRING) AS map_name, l_suppkey AS map_no,
  concat_ws('|', l_orderkey, l_partkey, l_suppkey, l_linenumber, CAST(l_quantity AS BIGINT),
            CAST(round(l_extendedprice * 100) AS BIGINT), l_returnflag, l_linestatus,
            CAST(round(l_discount * 100) AS BIGINT), CAST(round(l_tax * 100) AS BIGINT),
            CAST(l_shipdate AS DATE)) AS row_key,
  {_PLACE_NAME} AS text,
  {_FEATURE_TYPE} AS feature_type,
  round(0.3 + l_discount * 7, 4) AS confidence,
  CAST((l_orderkey * 37 + l_partkey * 11) % 4900 AS INT) AS x1,
  CAST((l_orderkey * 53 + l_partkey * 29 + l_linenumber * 7) % 6900 AS INT) AS y1,
  CAST((l_orderkey * 37 + l_partkey * 11) % 4900 + 20 + l_quantity AS INT) AS x2,
  CAST((l_orderkey * 53 + l_partkey * 29 + l_linenumber * 7) % 6900 + 12 + l_linenumber AS INT) AS y2,
  l_linenumber, l_linestatus, l_returnflag, l_shipdate, p_size, p_brand
FROM {{lineitem}} JOIN {{part}} ON l_partkey = p_partkey"""

MAPPED: dict[str, str] = {
    "boxes": _BOXES,
    "detections": """
SELECT map_name, {hash60} AS det_id, text, confidence, x1, y1, x2, y2 FROM (
  SELECT map_name, row_key || '|' || copy AS key, text,
    CASE WHEN copy = 1 THEN round(confidence - 0.05, 4) ELSE confidence END AS confidence,
    x1 + copy AS x1, y1 + copy AS y1, x2 + copy AS x2, y2 + copy AS y2
  FROM {boxes} {seam}) q""",
    "features": """
SELECT {hash60} AS id, map_name, feature_name, original_text, feature_type, grid_reference,
  sheet_ref, district, survey_year, confidence, tile_x, tile_y, bbox_x1, bbox_y1, bbox_x2, bbox_y2,
  lat_min, lat_max, lon_min, lon_max, map_scale, verified, session_id
FROM (
  SELECT row_key AS key, map_name, text AS feature_name,
    CASE WHEN l_linenumber % 2 = 0 THEN upper(text) WHEN l_linenumber = 5 THEN '' ELSE text END AS original_text,
    feature_type,
    CASE WHEN l_linenumber = 7 AND p_size = 2 THEN NULL ELSE
      CAST(CAST(floor((y1 + y2) / 2.0 / 1750) AS INT) + 1 AS STRING)
      || chr(CAST(65 + floor((x1 + x2) / 2.0 / 1250) AS INT)) END AS grid_reference,
    CASE WHEN l_linestatus = 'F' THEN '' ELSE
      CAST(45 + map_no % 45 AS STRING) || ' ' || chr(CAST(65 + map_no % 8 AS INT)) || '/'
      || CAST(1 + map_no % 16 AS STRING) END AS sheet_ref,
    p_brand AS district,
    CASE WHEN l_linenumber = 3 THEN NULL ELSE CAST(year(l_shipdate) AS STRING) END AS survey_year,
    CASE WHEN p_size = 3 AND l_linenumber = 4 THEN NULL ELSE confidence END AS confidence,
    0 AS tile_x, 0 AS tile_y, x1 AS bbox_x1, y1 AS bbox_y1, x2 AS bbox_x2, y2 AS bbox_y2,
    CASE WHEN map_no % 3 > 0 THEN CAST(20 + map_no % 10 + floor(y1 / 1750) * 0.25 AS DOUBLE) END AS lat_min,
    CASE WHEN map_no % 3 > 0 THEN CAST(20.25 + map_no % 10 + floor(y1 / 1750) * 0.25 AS DOUBLE) END AS lat_max,
    CASE WHEN map_no % 3 > 0 THEN CAST(70 + map_no % 20 + floor(x1 / 1250) * 0.25 AS DOUBLE) END AS lon_min,
    CASE WHEN map_no % 3 > 0 THEN CAST(70.25 + map_no % 20 + floor(x1 / 1250) * 0.25 AS DOUBLE) END AS lon_max,
    CASE WHEN map_no % 2 = 0 THEN 63360 ELSE 50000 END AS map_scale,
    0 AS verified, 'S' || CAST(l_linenumber AS STRING) AS session_id
  FROM {boxes}) q""",
    "review": """
SELECT {hash60} AS id, map_name, original_text, feature_name, feature_type, grid_reference, confidence,
  CASE WHEN again = 1 THEN 'N' ELSE verified_correct END AS verified_correct,
  CASE WHEN again = 1 THEN ' Again ' || feature_name ELSE verified_name END AS verified_name,
  CASE WHEN again = 1 THEN 'area' ELSE verified_type END AS verified_type, notes, {hash60} * 2 + again AS row_no
FROM (
  SELECT row_key AS key, map_name,
    CASE WHEN l_linenumber % 2 = 0 THEN upper(text) WHEN l_linenumber = 5 THEN '' ELSE text END AS original_text,
    text AS feature_name, coalesce(feature_type, '') AS feature_type, '1A' AS grid_reference,
    CAST(confidence AS STRING) AS confidence,
    CASE WHEN l_returnflag = 'N' AND l_linenumber = 2 THEN 'N' || chr(13) WHEN l_returnflag = 'N' THEN 'N'
      WHEN l_returnflag = 'R' AND l_linenumber = 3 THEN chr(9) || 'y' || chr(160) WHEN l_returnflag = 'R' THEN ' y ' WHEN p_size % 2 = 0 THEN 'SKIP' ELSE '' END
      AS verified_correct,
    CASE WHEN l_linenumber % 2 = 1 THEN ' ' || reverse(text) ELSE '' END AS verified_name,
    CASE WHEN p_size % 2 = 0 THEN 'landmark' ELSE '' END AS verified_type, '' AS notes, again
  FROM {boxes} {again}) q""",
    "map_info": """
SELECT 'MAP_' || CAST(s_suppkey AS STRING) AS map_name, CAST(5000 AS INT) AS width, CAST(7000 AS INT) AS height,
  CASE WHEN s_suppkey % 4 = 0 THEN '' ELSE CAST(45 + s_suppkey % 45 AS STRING) || ' '
    || chr(CAST(65 + s_suppkey % 8 AS INT)) || '/' || CAST(1 + s_suppkey % 16 AS STRING) END AS ocr_map_number,
  CASE WHEN s_suppkey % 5 = 0 THEN '' WHEN s_suppkey % 5 = 1 THEN '1934-35'
    ELSE CAST(1900 + s_suppkey % 80 AS STRING) END AS ocr_survey_year,
  CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE 'NATION_' || CAST(s_nationkey AS STRING) END AS district,
  CASE WHEN s_suppkey % 2 = 0 THEN 63360 ELSE 50000 END AS map_scale,
  CASE WHEN s_suppkey % 6 > 0 THEN CAST(20 + s_suppkey % 10 AS DOUBLE) END AS lat_min,
  CASE WHEN s_suppkey % 6 > 0 THEN CAST(21 + s_suppkey % 10 AS DOUBLE) END AS lat_max,
  CASE WHEN s_suppkey % 6 > 0 THEN CAST(70 + s_suppkey % 20 AS DOUBLE) END AS lon_min,
  CASE WHEN s_suppkey % 6 > 0 THEN CAST(71 + s_suppkey % 20 AS DOUBLE) END AS lon_max,
  CAST(4 + s_suppkey % 3 AS INT) AS n_cols, CAST(4 + s_suppkey % 2 AS INT) AS n_rows,
  s_acctbal
FROM {supplier}""",
    "provider_items": """
SELECT map_name, provider, provider_no, item_no, original, cleaned, feature_type, confidence FROM (
  SELECT 'MAP_' || CAST(p_partkey % 50 AS STRING) AS map_name, item_no, original, provider, provider_no,
    CASE WHEN provider = 'B' AND p_size % 3 = 0 THEN upper(p_name) ELSE p_name END AS cleaned,
    CASE WHEN provider = 'B' AND p_size % 5 = 0 THEN 'river' WHEN provider = 'C' AND p_size % 7 = 0 THEN 'lake'
         ELSE feature_type END AS feature_type,
    CAST(CASE provider WHEN 'A' THEN 0.9 WHEN 'B' THEN 0.8 ELSE 0.7 END AS DOUBLE) AS confidence,
    provider = 'C' AND p_size % 11 = 0 AS missing, provider = 'C' AND p_brand = 'Brand#13' AS failed
  FROM (
    SELECT p_partkey, p_partkey AS item_no, p_name, p_size, p_brand, provider_no, chr(64 + provider_no) AS provider,
      CASE WHEN p_partkey % 3 = 0 THEN ' ' || p_name ELSE p_name || ' ' || CAST(p_partkey AS STRING) END AS original,
      """ + _FEATURE_TYPE + """ AS feature_type FROM {part} {providers}) p) q
WHERE NOT missing AND NOT failed""",
    "map_files": """
SELECT folder || '/' || CASE WHEN file_no % 2 = 1 AND file_no % 10 = 3 THEN upper(stem) ELSE stem END
    || extension AS path, file_no, width, height
FROM (
  SELECT o_orderkey AS file_no, CASE WHEN o_custkey % 2 = 0 THEN '/maps/a' ELSE '/maps/b' END AS folder,
    CASE pair % 7
      WHEN 0 THEN block || '-' || letter || '-' || num || '-' || town || '-' || yr || '-Preliminary-1'
      WHEN 1 THEN 'scan ' || CAST(pair AS STRING)
      ELSE block || ' ' || letter || ']' || num || ' ' || town || district_word || ' (' || yr || ')' || suffix END AS stem,
    CASE o_orderkey % 5 WHEN 0 THEN '.png' WHEN 1 THEN '.JPG' WHEN 2 THEN '.tif' ELSE '.jpg' END AS extension,
    CASE o_custkey % 4 WHEN 0 THEN 5000 WHEN 1 THEN 7500 WHEN 2 THEN 1005 ELSE 6211 END AS width,
    CASE o_custkey % 4 WHEN 0 THEN 7000 WHEN 1 THEN 10000 WHEN 2 THEN 974 ELSE 8033 END AS height
  FROM (
    SELECT o_orderkey, o_custkey, CAST(floor(o_orderkey / 2) AS BIGINT) AS pair,
      CAST(45 + CAST(floor(o_orderkey / 2) AS BIGINT) % 50 AS STRING) AS block,
      substr('ABCDEFGHJKLMNOP', CAST(1 + CAST(floor(o_orderkey / 2) AS BIGINT) % 15 AS INT), 1) AS letter,
      lpad(CAST(1 + CAST(floor(o_orderkey / 2) AS BIGINT) % 16 AS STRING),
           CASE WHEN CAST(floor(o_orderkey / 2) AS BIGINT) % 16 > 8 THEN 2 ELSE 1 END, '0') AS num,
      CAST(1900 + CAST(floor(o_orderkey / 2) AS BIGINT) % 90 AS STRING) AS yr,
      CASE CAST(floor(o_orderkey / 2) AS BIGINT) % 6 WHEN 0 THEN 'Birbhum' WHEN 1 THEN 'Birbhum & Murshidabad'
        WHEN 2 THEN 'Siwan' WHEN 3 THEN 'Palamau' WHEN 4 THEN 'Purnea &' ELSE 'Ganjam,' END AS town,
      CASE CAST(floor(o_orderkey / 2) AS BIGINT) % 5 WHEN 0 THEN ' District' WHEN 1 THEN ' Districts'
        WHEN 2 THEN ' Dist.' WHEN 3 THEN ' Pargana' ELSE '' END AS district_word,
      CASE CAST(floor(o_orderkey / 2) AS BIGINT) % 8 WHEN 0 THEN ' BW@' WHEN 1 THEN ' 35MM-FILMED'
        WHEN 2 THEN ' Preliminary (1)' WHEN 3 THEN ' BW 35 mm' WHEN 4 THEN ' (2)' ELSE '' END AS suffix
    FROM {orders}) k) f""",
    "margin_labels": """
SELECT 'MAP_' || CAST(l_suppkey AS STRING) AS map_name, text, x1, y1,
  CAST(x1 + 24 AS INT) AS x2, CAST(y1 + CASE WHEN l_partkey % 13 = 0 THEN 400 ELSE 40 END AS INT) AS y2,
  CASE WHEN l_partkey % 5 = 0 THEN NULL WHEN l_partkey % 17 = 0 THEN 0.01 ELSE 0.2 END + 0.0 * l_quantity AS red_share
FROM (
  SELECT l_suppkey, l_partkey, l_quantity,
    CASE WHEN l_orderkey % 4 < 2 THEN
           CASE WHEN l_linenumber = 5 AND l_suppkey % 3 = 0 THEN 'ab' WHEN l_linenumber = 6 AND l_partkey % 7 = 0 THEN 'G'
                WHEN l_partkey % 10 = 1 THEN lower(chr(64 + l_linenumber)) ELSE chr(64 + l_linenumber) END
         ELSE CASE WHEN l_linenumber = 1 AND l_partkey % 7 = 0 THEN 'l' WHEN l_linenumber = 1 AND l_partkey % 7 = 1 THEN 'I'
                WHEN l_linenumber = 5 AND l_partkey % 7 = 2 THEN 'S' WHEN l_linenumber = 4 AND l_suppkey % 4 = 1 THEN 'x4'
                WHEN l_partkey % 11 = 3 THEN ' ' || CAST(l_linenumber AS STRING)
                WHEN l_partkey % 11 = 4 THEN '0' || CAST(l_linenumber AS STRING)
                ELSE CAST(l_linenumber AS STRING) END END AS text,
    CAST(CASE l_orderkey % 4 WHEN 2 THEN l_orderkey % 700 WHEN 3 THEN 4950 - l_orderkey % 700
         ELSE l_linenumber * 600 + l_partkey % 9 END AS INT) AS x1,
    CAST(CASE l_orderkey % 4 WHEN 0 THEN l_orderkey % 1000 WHEN 1 THEN 6900 - l_orderkey % 1000
         ELSE l_linenumber * 900 + l_partkey % 9 END AS INT) AS y1
  FROM {lineitem}) q""",
    "coord_tokens": """
SELECT 'MAP_' || CAST(CAST(floor(event_id / 40) AS BIGINT) AS STRING) AS map_name, event_id % 40 * 2 AS seq,
  CASE WHEN CAST(floor(event_id / 40) AS BIGINT) % 6 = 0 AND event_id % 40 > 4 AND event_id % 8 IN (2, 3) THEN 'ridge'
    ELSE CASE event_id % 8
      WHEN 0 THEN CAST(70 + user_id % 20 AS STRING) || '°' || CAST(user_id % 60 AS STRING) || chr(39) || 'E'
      WHEN 1 THEN 'hill ' || CAST(user_id AS STRING)
      WHEN 2 THEN ' ' || CAST(20 + user_id % 10 AS STRING) || '°N'
      WHEN 3 THEN CAST(20 + user_id % 10 AS STRING) || '°' || CAST(event_id % 60 AS STRING) || chr(39)
      WHEN 4 THEN CASE WHEN user_id % 3 = 0 THEN 'n' WHEN user_id % 3 = 1 THEN 'N' ELSE 'NE' END
      WHEN 5 THEN CAST(70 + user_id % 20 AS STRING) || 'o' || CAST(user_id % 60 AS STRING) || '` ' ||
                  CAST(event_id % 60 AS STRING) || '.5" e'
      WHEN 6 THEN CASE WHEN user_id % 2 = 0 THEN '5° 10' || chr(39) || ' w' ELSE '12' END
      ELSE 'tank' END END AS text
FROM {events}""",
    "line_positions": """
SELECT 'MAP_' || CAST(l_suppkey AS STRING) AS map_name,
  CASE WHEN l_linenumber % 2 = 0 THEN 'row' ELSE 'col' END AS axis,
  CAST(CASE l_suppkey % 5
    WHEN 0 THEN (1 + l_orderkey % 3) * 1000 + l_partkey % 23
    WHEN 1 THEN (1 + l_orderkey % 4) * (1 + l_orderkey % 4) * 250 + (l_partkey % 7) * 4
    WHEN 2 THEN (2 + l_orderkey % 2) * 900 + (l_partkey % 2) * 49
    WHEN 3 THEN 2500 + l_orderkey % 40
    ELSE (1 + l_orderkey % 6) * 700 END AS DOUBLE) + 0.5 AS pos
FROM {lineitem}""",
    "segments": """
SELECT 'MAP_' || CAST(l_suppkey AS STRING) AS map_name, x1, y1,
  CAST(x1 + CASE l_partkey % 6 WHEN 0 THEN 1000 WHEN 1 THEN 1000 WHEN 2 THEN 1000 WHEN 3 THEN 1000 WHEN 4 THEN 35 ELSE 0 END AS INT) AS x2,
  CAST(y1 + CASE l_partkey % 6 WHEN 0 THEN 0 WHEN 1 THEN 35 WHEN 2 THEN -70 WHEN 3 THEN 1000 ELSE 1000 END AS INT) AS y2
FROM (
  SELECT l_suppkey, l_partkey,
    CAST((1 + l_orderkey % 3) * 1000 + l_linenumber AS INT) AS x1,
    CAST(CASE WHEN l_suppkey % 4 = 0 THEN (1 + l_orderkey % 3) * 1500 + l_linenumber ELSE 500 + l_orderkey % 6000 END AS INT) AS y1
  FROM {lineitem}) q""",
    "year_tokens": """
SELECT 'MAP_' || CAST(o_custkey AS STRING) AS map_name, o_orderkey AS token_no, text,
  x1, y1, CAST(x1 + 10 * length(text) AS INT) AS x2, CAST(y1 + 20 + o_orderkey % 9 AS INT) AS y2
FROM (
  SELECT o_custkey, o_orderkey,
    CASE o_orderkey % 11
      WHEN 0 THEN 'Surveyed 1934-35.' WHEN 1 THEN 'Surveyed' WHEN 2 THEN CAST(1880 + o_orderkey % 90 AS STRING) || '.'
      WHEN 3 THEN 'Revised ' || CAST(1900 + o_orderkey % 80 AS STRING) || '.'
      WHEN 4 THEN 'Surveyed 1928-29, published ' || CAST(1930 + o_orderkey % 20 AS STRING) || '.'
      WHEN 5 THEN 'Scale 1 inch to 1 mile 1760 yards' WHEN 6 THEN CAST(1400 + o_orderkey % 100 AS STRING)
      WHEN 7 THEN '1999-2030 edition' WHEN 8 THEN 'Contour ' || CAST(1500 + o_orderkey % 400 AS STRING) || ' feet'
      WHEN 9 THEN 'Map sheet ' || CAST(1850 + o_orderkey % 99 AS STRING) ELSE 'Ranchi' END AS text,
    CAST(o_orderkey * 7 % 4000 AS INT) AS x1,
    CAST((o_orderkey % 5) * 1600 + (o_orderkey * 13) % 60 AS INT) AS y1
  FROM {orders}) q""",
    "text_lines": """
SELECT 'MAP_' || CAST(o_custkey AS STRING) AS map_name, o_orderkey % 4 AS line_no,
  CAST(o_orderkey AS BIGINT) AS token_no,
  CASE o_orderkey % 9
    WHEN 0 THEN 'Surveyed 1934-35.' WHEN 1 THEN 'Surveyed' WHEN 2 THEN CAST(1880 + o_orderkey % 90 AS STRING) || '.'
    WHEN 3 THEN 'Revised ' || CAST(1900 + o_orderkey % 80 AS STRING) || '.' WHEN 4 THEN 'Surveyed 1928-29, published 1935.'
    WHEN 5 THEN 'Scale 1 inch to 1 mile' WHEN 6 THEN CAST(1400 + o_orderkey % 100 AS STRING)
    WHEN 7 THEN '1999-2030 edition' ELSE 'Ranchi' END AS text,
  CAST((o_orderkey * 7) % 4000 AS INT) AS x1,
  CAST((o_orderkey % 4) * 2000 + 100 AS INT) AS y1, CAST((o_orderkey % 4) * 2000 + 130 AS INT) AS y2
FROM {orders}""",
    "sheet_tokens": """
SELECT map_name, seq, text, CAST(x1 AS INT) AS x1, CAST(y1 AS INT) AS y1, CAST(x1 + w AS INT) AS x2, CAST(y1 + h AS INT) AS y2
FROM (
  SELECT 'MAP_' || CAST(c_custkey AS STRING) AS map_name, seq, w, h,
    x + c_custkey % 50 AS x1, y + c_custkey % 30 AS y1, kind, c_custkey % 9 AS form,
    CASE kind WHEN 'no' THEN 'No.' WHEN 'block' THEN block WHEN 'letter' THEN letter WHEN 'sub' THEN sub
      WHEN 'full' THEN 'No. ' || block || ' ' || letter || '/' || sub
      WHEN 'bare' THEN block || ' ' || lower(letter) || '/' || sub
      WHEN 'head' THEN 'No ' || block || ' ' || letter
      WHEN 'word' THEN 'RANCHI' WHEN 'stray' THEN CAST(c_custkey % 97 + 3 AS STRING) ELSE 'I' END AS text
  FROM (SELECT c_custkey, CAST(45 + c_custkey % 45 AS STRING) AS block,
          substr('ABCDEFGHJKLMNOP', CAST(1 + c_custkey % 15 AS INT), 1) AS letter,
          CAST(1 + c_custkey % 16 AS STRING) AS sub, seq,
          CASE seq WHEN 1 THEN 'word' WHEN 2 THEN 'full' WHEN 3 THEN 'bare' WHEN 4 THEN 'head' WHEN 5 THEN 'no'
            WHEN 6 THEN 'block' WHEN 7 THEN 'letter' WHEN 8 THEN 'sub' WHEN 9 THEN 'stray' WHEN 10 THEN 'eye'
            WHEN 11 THEN 'block' ELSE 'full' END AS kind,
          CASE seq WHEN 1 THEN 3000 WHEN 2 THEN 4200 WHEN 3 THEN 4100 WHEN 4 THEN 4150 WHEN 5 THEN 4000 WHEN 6 THEN 4100
            WHEN 7 THEN 4200 WHEN 8 THEN 4205 WHEN 9 THEN 3500 WHEN 10 THEN 4260 WHEN 11 THEN 4100 ELSE 400 END AS x,
          CASE seq WHEN 1 THEN 300 WHEN 2 THEN 200 WHEN 3 THEN 210 WHEN 4 THEN 205 WHEN 5 THEN 220 WHEN 6 THEN 222
            WHEN 7 THEN 218 WHEN 8 THEN 290 WHEN 9 THEN 1500 WHEN 10 THEN 219 WHEN 11 THEN 3000 ELSE 200 END AS y,
          CASE seq WHEN 1 THEN 200 WHEN 2 THEN 220 WHEN 3 THEN 200 WHEN 4 THEN 160 WHEN 5 THEN 60 WHEN 6 THEN 50
            WHEN 7 THEN 30 WHEN 8 THEN 30 WHEN 9 THEN 40 WHEN 10 THEN 20 WHEN 11 THEN 50 ELSE 220 END AS w,
          CASE seq WHEN 7 THEN 38 WHEN 8 THEN 36 WHEN 9 THEN 30 ELSE 40 END AS h
        FROM {customer} {slots}) c) q
WHERE CASE form WHEN 0 THEN kind IN ('word', 'full') WHEN 1 THEN kind IN ('bare', 'stray')
  WHEN 2 THEN kind IN ('head', 'sub') WHEN 3 THEN kind IN ('no', 'block', 'letter', 'sub', 'stray')
  WHEN 4 THEN kind IN ('block', 'letter', 'sub') WHEN 5 THEN kind IN ('no', 'block', 'eye')
  WHEN 6 THEN kind = 'word' OR seq IN (11, 12) WHEN 7 THEN kind IN ('no', 'block', 'letter')
  ELSE kind IN ('stray', 'word', 'letter') END
  AND (seq < 11 OR form = 6)""",
    "country_texts": """
SELECT 'SHEET_' || CAST(CAST(floor(doc_id / 40) AS BIGINT) AS STRING) AS map_name, doc_id % 40 AS seq,
  CASE CAST(floor(doc_id / 40) AS BIGINT) % 11 * 10 + CASE doc_id % 40 WHEN 31 THEN 0 WHEN 32 THEN 1 ELSE doc_id % 8 END
    WHEN 0 THEN text || ' Survey' WHEN 1 THEN 'of India ' || text
    WHEN 12 THEN text || ' Ordnance Survey, Scotland' WHEN 23 THEN 'USGS quadrangle ' || text
    WHEN 34 THEN text || ' Topographische Karte' WHEN 45 THEN 'Institut Géographique ' || text
    WHEN 56 THEN text || ' near Lahore' WHEN 57 THEN 'Multan ' || text WHEN 61 THEN text || ' Kanpur'
    WHEN 72 THEN text || ' 72 C/01' WHEN 83 THEN text || ' near the district of Kerala' ELSE text END AS text
FROM {documents}""",
    "image_verdicts": """
SELECT 'SHEET_' || CAST(sheet AS STRING) AS map_name,
  CASE sheet % 5 WHEN 0 THEN 'uk' WHEN 1 THEN 'india' WHEN 2 THEN 'france' ELSE 'usa' END AS image_country,
  CAST(CASE (sheet + longest) % 4 WHEN 0 THEN 0.9 WHEN 1 THEN 0.5 WHEN 2 THEN 0.1 ELSE 0.7 END AS DOUBLE) AS image_confidence
FROM (SELECT CAST(floor(doc_id / 40) AS BIGINT) AS sheet, max(length(text)) AS longest FROM {documents} GROUP BY 1) q""",
    "spelling_files": """
SELECT p_partkey AS file_no,
  '{{"meta": {{"version": "' || p_brand || '"}}, "' || p_brand || '": {{"' || replace(p_name, 'i', 'y') || '": "' || p_name
  || ' ' || CAST(p_size AS STRING) || '"}}, "words": {{"' || CASE WHEN p_size % 2 = 0 THEN 'Anvyl' ELSE 'ryng' END || '": "'
  || CASE WHEN p_size % 2 = 0 THEN 'anvil' ELSE 'Ring' END || '"}}}}' AS payload
FROM {part}""",
    "spelling_texts": """
SELECT p_partkey AS text_no,
  CASE p_partkey % 5 WHEN 0 THEN replace(p_name, 'i', 'y') WHEN 1 THEN upper(substr(p_name, 1, 1)) || replace(substr(p_name, 2), 'i', 'y')
    WHEN 2 THEN 'Old Anvyl, near a ryng (' || p_name || ')' WHEN 3 THEN p_name ELSE ' Ryng-anvyl ' || CAST(p_size AS STRING) END AS text
FROM {part}""",
    "split_rows": """
SELECT {hash60} AS id, label, '/crops/' || label || '/' || key || '.jpg' AS path FROM (
  SELECT row_key AS key, coalesce(feature_type, 'unknown') AS label FROM {boxes}) q""",
}

# Spark and the reference database differ only in these fragments.
_SPARK_FRAGMENTS = {
    "hash60": "CAST(conv(substr(md5(key), 1, 15), 16, 10) AS BIGINT)",
    "providers": "LATERAL VIEW explode(array(1, 2, 3)) v AS provider_no",
    "slots": "LATERAL VIEW explode(sequence(1, 12)) s AS seq",
    "again": "LATERAL VIEW explode(CASE WHEN p_size % 6 = 1 THEN array(0, 1) ELSE array(0) END) a AS again",
    "seam": "LATERAL VIEW explode(CASE WHEN l_linenumber = 1 THEN array(0, 1) ELSE array(0) END) s AS copy",
}
_REFERENCE_FRAGMENTS = {
    "hash60": "CAST('0x' || substr(md5(key), 1, 15) AS BIGINT)",
    "providers": ", unnest([1, 2, 3]) AS v(provider_no)",
    "slots": ", unnest([1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12]) AS s(seq)",
    "again": ", unnest(CASE WHEN p_size % 6 = 1 THEN [0, 1] ELSE [0] END) AS a(again)",
    "seam": ", unnest(CASE WHEN l_linenumber = 1 THEN [0, 1] ELSE [0] END) AS s(copy)",
}


def _needs(name: str) -> list[str]:
    return [other for other in MAPPED if other != name and "{" + other + "}" in MAPPED[name]]


class Tables:
    """Warehouse and mapped tables of one data folder."""

    def __init__(self, spark: SparkSession, folder: str):
        keep_stages_compiled(spark)
        self.spark = spark
        self.folder = folder

    def base(self, name: str) -> DataFrame:
        return spread(self.spark.read.parquet(f"{self.folder}/{name}.parquet"))

    def __getattr__(self, name: str) -> DataFrame:
        if name in MAPPED:
            text = MAPPED[name]
            frames = {n: self.base(n) for n in BASE_TABLES if "{" + n + "}" in text}
            frames.update({n: getattr(self, n) for n in _needs(name)})
            for key, fragment in _SPARK_FRAGMENTS.items():
                text = text.replace("{" + key + "}", fragment)
            return self.spark.sql(text, **frames)
        if name in BASE_TABLES:
            return self.base(name)
        raise AttributeError(name)


def reference_ctes(uses: tuple[str, ...]) -> str:
    """``WITH`` clause that defines the mapped tables ``uses`` for the reference database."""
    if not uses:
        return ""
    ordered: list[str] = []

    def add(name: str) -> None:
        for other in _needs(name):
            add(other)
        if name not in ordered:
            ordered.append(name)

    for name in uses:
        add(name)
    names = {n: n for n in (*BASE_TABLES, *MAPPED)} | _REFERENCE_FRAGMENTS
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS ({MAPPED[n].format(**names)})" for n in ordered) + "\n"
