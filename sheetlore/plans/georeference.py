"""Coordinates, years and sheet numbers from tokens (GEO, YR, NUM, JON-11, WIN-02, SET-06)."""

from __future__ import annotations

from pyspark.sql import functions as F

from sheetlore.operators import georeference as geo
from sheetlore.operators import sheet_numbers as num
from sheetlore.operators import years
from sheetlore.plans.registry import query
from sheetlore.session import cut_lineage

_DMS = r"""(?i)(\d{1,3})\s*[°o]\s*(?:(\d{1,2})\s*[''’′`]\s*(?:(\d{1,2}(?:\.\d+)?)\s*["”″]\s*)?)?([NSEW])?"""
_PARTS = f""", parts AS (SELECT map_name, seq, text,
    nullif(regexp_extract(trim(text), '{_DMS}', 1), '')::DOUBLE AS deg, nullif(regexp_extract(trim(text), '{_DMS}', 2), '')::DOUBLE AS minutes,
    nullif(regexp_extract(trim(text), '{_DMS}', 3), '')::DOUBLE AS seconds, upper(nullif(regexp_extract(trim(text), '{_DMS}', 4), '')) AS own,
    lead(upper(trim(text))) OVER (PARTITION BY map_name ORDER BY seq) AS next_text FROM coord_tokens),
  hemis AS (SELECT *, coalesce(own, CASE WHEN next_text IN ('N', 'S', 'E', 'W') THEN next_text END) AS hemi FROM parts WHERE deg IS NOT NULL),
  vals AS (SELECT *, round((deg + coalesce(minutes, 0) / 60.0::DOUBLE + coalesce(seconds, 0) / 3600.0::DOUBLE) * CASE WHEN hemi IN ('S', 'W') THEN -1 ELSE 1 END, 6) AS value
    FROM hemis WHERE hemi IS NOT NULL)
"""


@query("geo01_degree_parts", _PARTS + "SELECT map_name, seq, deg, minutes, seconds, own AS hemi FROM parts WHERE deg IS NOT NULL", ("coord_tokens",))
def _(t):
    parts = geo.degree_parts(F.col("text"))
    return t.coord_tokens.select("map_name", "seq", *[c.alias(n) for n, c in parts.items()]).filter(F.col("deg").isNotNull())


@query("geo02_decimal_degrees", _PARTS + "SELECT map_name, seq, value FROM vals", ("coord_tokens",))
def _(t):
    rows = geo.with_hemisphere(t.coord_tokens)
    return rows.select("map_name", "seq", geo.decimal_degrees(F.col("deg"), F.col("minutes"), F.col("seconds"), F.col("hemi")).alias("value"))


@query("geo03_hemisphere_look_ahead", _PARTS + "SELECT map_name, seq, hemi FROM hemis WHERE hemi IS NOT NULL", ("coord_tokens",))
def _(t):
    return geo.with_hemisphere(t.coord_tokens).select("map_name", "seq", "hemi")


@query(
    "win02_next_token",
    "SELECT map_name, seq, text, lead(text) OVER (PARTITION BY map_name ORDER BY seq) AS next_text FROM coord_tokens",
    ("coord_tokens",),
)
def _(t):
    numbered = geo.in_token_order(t.coord_tokens)
    following = numbered.select("map_name", (F.col("row_no") - 1).alias("row_no"), F.col("text").alias("next_text"))
    return numbered.join(following, ["map_name", "row_no"], "left").drop("row_no")


_BOUNDS = _PARTS + """, b AS (SELECT map_name, count(*) FILTER (hemi IN ('N', 'S')) >= 2 AND count(*) FILTER (hemi IN ('E', 'W')) >= 2 AS found,
   min(value) FILTER (hemi IN ('N', 'S')) AS a1, max(value) FILTER (hemi IN ('N', 'S')) AS a2,
   min(value) FILTER (hemi IN ('E', 'W')) AS o1, max(value) FILTER (hemi IN ('E', 'W')) AS o2 FROM vals GROUP BY 1)
"""


@query(
    "geo04_coordinate_bounds",
    _BOUNDS + """SELECT map_name, found, CASE WHEN found THEN a1 END AS lat_min, CASE WHEN found THEN a2 END AS lat_max,
       CASE WHEN found THEN o1 END AS lon_min, CASE WHEN found THEN o2 END AS lon_max FROM b""",
    ("coord_tokens",),
)
def _(t):
    return geo.coordinate_bounds(t.coord_tokens)


@query(
    "set06_axis_values",
    _PARTS + """SELECT map_name, CASE WHEN hemi IN ('N', 'S') THEN 'lat' ELSE 'lon' END AS axis, count(*) AS n, count(DISTINCT value) AS n_distinct
      FROM vals GROUP BY 1, 2""",
    ("coord_tokens",),
)
def _(t):
    rows = geo.with_hemisphere(t.coord_tokens)
    value = geo.decimal_degrees(F.col("deg"), F.col("minutes"), F.col("seconds"), F.col("hemi"))
    axis = F.when(F.col("hemi").isin("N", "S"), "lat").otherwise("lon")
    return rows.groupBy("map_name", axis.alias("axis")).agg(F.count("*").alias("n"), F.countDistinct(value).alias("n_distinct"))


# ---- years -------------------------------------------------------------------------------

_FOLD = """, tok AS (SELECT map_name, trim(text) AS text, x1, (y1 + y2) / 2.0::DOUBLE AS cy, CAST(greatest(y2 - y1, 1) AS DOUBLE) AS h,
    row_number() OVER (PARTITION BY map_name ORDER BY (y1 + y2) / 2.0::DOUBLE, x1, token_no) AS rn FROM year_tokens WHERE trim(text) <> ''),
  fold AS (SELECT map_name, rn, 0 AS line, cy AS line_cy, h AS avg_h, 1 AS n FROM tok WHERE rn = 1
    UNION ALL
    SELECT t.map_name, t.rn, CASE WHEN near THEN line ELSE line + 1 END, CASE WHEN near THEN (line_cy * n + t.cy) / (n + 1) ELSE t.cy END,
      CASE WHEN near THEN (avg_h * n + t.h) / (n + 1) ELSE t.h END, CASE WHEN near THEN n + 1 ELSE 1 END
    FROM (SELECT f.line, f.line_cy, f.avg_h, f.n, k.*, abs(k.cy - f.line_cy) <= greatest(f.avg_h, k.h) * 0.8::DOUBLE AS near
          FROM fold f JOIN tok k ON k.map_name = f.map_name AND k.rn = f.rn + 1) t),
  folded AS (SELECT f.map_name, f.line AS line_no, string_agg(k.text, ' ' ORDER BY k.x1, k.rn) AS text, count(*) AS n,
      max_by(f.line_cy, f.rn) AS cy FROM fold f JOIN tok k ON k.map_name = f.map_name AND k.rn = f.rn GROUP BY 1, 2)
"""


@query("yr01_group_lines", _FOLD + "SELECT map_name, text, round(cy, 6) AS cy, n FROM folded", ("year_tokens",))
def _(t):
    return years.group_lines(t.year_tokens).select("map_name", "text", F.round("cy", 6).alias("cy"), "n")


_LINES = """, texts AS (SELECT map_name, line_no, string_agg(text, ' ' ORDER BY x1, token_no) AS text, CAST(sum(y1 + y2) AS DOUBLE) / 2 / count(*) AS cy FROM text_lines GROUP BY 1, 2)
"""


def _candidates(source: str) -> str:
    return f""", spots AS (SELECT map_name, line_no, cy, text, unnest(range(1, length(text) + 1)) AS i FROM {source}),
  starts AS (SELECT *, regexp_extract(substr(text, i), '^([0-9]{{4}}([-–][0-9]{{2,4}})?)($|[^0-9])', 1) AS raw FROM spots
    WHERE regexp_matches(substr(text, i), '^[0-9]{{4}}') AND (i = 1 OR NOT regexp_matches(substr(text, i - 1, 1), '[0-9]'))
      AND NOT (i > 5 AND regexp_full_match(substr(text, i - 5, 5), '[0-9]{{4}}[-–]') AND (i = 6 OR NOT regexp_matches(substr(text, i - 6, 1), '[0-9]')))),
  parsed AS (SELECT *, CAST(substr(raw, 1, 4) AS INT) AS s, CASE WHEN length(raw) > 4 THEN TRY_CAST(CASE WHEN length(raw) = 9 THEN substr(raw, 6) ELSE substr(raw, 1, 2) || substr(raw, 6) END AS INT) END AS e
    FROM starts WHERE raw <> ''),
  valued AS (SELECT *, CASE WHEN length(raw) = 4 AND s BETWEEN 1500 AND 2100 THEN raw
      WHEN length(raw) > 4 AND s BETWEEN 1500 AND 2100 AND e BETWEEN 1500 AND 2100 AND s <= e AND e <= s + 20 THEN s || '-' || substr(CAST(e AS VARCHAR), 3, 2)
      ELSE '' END AS year FROM parsed),
  candidates AS (SELECT map_name, line_no, cy, i, year, substr(text, CAST(greatest(1, i - 30) AS BIGINT), CAST(i - greatest(1, i - 30) + length(raw) + 30 AS BIGINT)) AS context
    FROM valued WHERE year <> ''),
  scored AS (SELECT *, cy <= 7000 * 0.20::DOUBLE OR cy >= 7000 * 0.80::DOUBLE AS edge,
    CASE WHEN regexp_matches(lower(context), '\\b(surv(?:ey(?:ed)?)?|season)\\b') THEN 12 ELSE 0 END
    + CASE WHEN regexp_matches(lower(context), '\\b(revis(?:ed)?|publish(?:ed)?|edition|compiled|drawn|sketch(?:ed)?|prepared)\\b') THEN 10 ELSE 0 END
    + CASE WHEN regexp_matches(lower(context), '\\b(date|dated|year|a\\.?d\\.?)\\b') THEN 8 ELSE 0 END
    + CASE WHEN regexp_matches(lower(context), '\\b(map|plate|plan|copy|title|sheet)\\b') THEN 4 ELSE 0 END
    - CASE WHEN regexp_matches(lower(context), '\\b(scale|miles?|yards?|feet|foot|kilomet(?:er|re)s?|metres?|contours?|elevation|latitude|longitude|north|south|east|west|grid|legend)\\b') THEN 8 ELSE 0 END
    + CASE WHEN contains(year, '-') THEN 2 ELSE 0 END
    + CASE WHEN cy <= 7000 * 0.20::DOUBLE OR cy >= 7000 * 0.80::DOUBLE THEN 3 ELSE 0 END AS score FROM candidates),
  best AS (SELECT map_name, year AS survey_year FROM (SELECT *, row_number() OVER (PARTITION BY map_name ORDER BY score >= 8 DESC, score DESC,
      contains(year, '-') DESC, edge DESC, cy, line_no, i) AS rn FROM scored WHERE score >= 8 OR edge) WHERE rn = 1)
"""


def _lines(t):
    return years.line_texts(t.text_lines)


@query("yr02_line_texts", _LINES + "SELECT map_name, line_no, text, cy FROM texts", ("text_lines",))
def _(t):
    return _lines(t)


@query(
    "yr03_normalised_years",
    """, r AS (SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN CAST(1400 + o_custkey % 900 AS VARCHAR) WHEN 1 THEN (1850 + o_custkey % 200) || '-' || (o_custkey % 90 + 10)
         WHEN 2 THEN (1900 + o_custkey % 90) || '–' || (1900 + o_custkey % 110) || '.' WHEN 3 THEN ' ' || (1900 + o_custkey % 90) || ';' ELSE 'x1900' END AS raw FROM orders),
       c AS (SELECT *, replace(rtrim(trim(raw), '.,;:'), '–', '-') AS v FROM r),
       p AS (SELECT *, CASE WHEN regexp_full_match(v, '[0-9]{4}.*') THEN CAST(substr(v, 1, 4) AS INT) END AS s,
         CASE WHEN regexp_full_match(v, '[0-9]{4}-[0-9]{2,4}') THEN CAST(CASE WHEN length(v) = 9 THEN substr(v, 6) ELSE substr(v, 1, 2) || substr(v, 6) END AS INT) END AS e FROM c)
       SELECT o_orderkey, CASE WHEN regexp_full_match(v, '[0-9]{4}') AND s BETWEEN 1500 AND 2100 THEN v
         WHEN e IS NOT NULL AND s BETWEEN 1500 AND 2100 AND e BETWEEN 1500 AND 2100 AND s <= e AND e <= s + 20 THEN s || '-' || substr(CAST(e AS VARCHAR), 3, 2) ELSE '' END AS year FROM p""".replace(
        ", r AS", "WITH r AS", 1
    ),
)
def _(t):
    raw = F.expr(
        """CASE o_orderkey % 5 WHEN 0 THEN CAST(1400 + o_custkey % 900 AS STRING) WHEN 1 THEN (1850 + o_custkey % 200) || '-' || (o_custkey % 90 + 10)
           WHEN 2 THEN (1900 + o_custkey % 90) || '–' || (1900 + o_custkey % 110) || '.' WHEN 3 THEN ' ' || (1900 + o_custkey % 90) || ';' ELSE 'x1900' END"""
    )
    return t.orders.select("o_orderkey", years.normalised_year(raw).alias("year"))


@query("yr04_year_candidates", _LINES + _candidates("texts") + "SELECT map_name, line_no, year, context FROM candidates", ("text_lines",))
def _(t):
    return years.year_candidates(_lines(t)).select("map_name", "line_no", "year", "context")


@query("yr05_year_scores", _LINES + _candidates("texts") + "SELECT map_name, line_no, year, score, edge FROM scored", ("text_lines",))
def _(t):
    return years.with_year_score(years.year_candidates(_lines(t)), F.lit(7000)).select("map_name", "line_no", "year", "score", "edge")


@query("yr06_best_year", _LINES + _candidates("texts") + "SELECT map_name, survey_year FROM best", ("text_lines",))
def _(t):
    return years.best_year(years.with_year_score(years.year_candidates(_lines(t)), F.lit(7000)))


@query(
    "yr06_survey_years",
    _FOLD + _candidates("folded") + """SELECT 'MAP_' || c_custkey AS map_name, coalesce(survey_year, '') AS survey_year FROM customer
      LEFT JOIN best ON best.map_name = 'MAP_' || c_custkey""",
    ("year_tokens",),
)
def _(t):
    maps = t.customer.select(F.concat(F.lit("MAP_"), F.col("c_custkey").cast("string")).alias("map_name"), F.lit(7000).alias("height"))
    return years.survey_years(t.year_tokens, maps)


# ---- sheet numbers -----------------------------------------------------------------------

_NO = r"(?i)No\.?\s*(\d{1,3})\s+([A-HJ-P])\s*(?:[/\\](\d{1,2}))?"
_BARE = r"(?i)^(\d{1,3})\s+([A-HJ-P])\s*(?:[/\\](\d{1,2}))?$"


def _below(name: str, refs: str) -> str:
    return f""", {name} AS (SELECT map_name, min_by(d_text, d_seq) AS sub FROM (SELECT r.map_name, z.seq AS d_seq, z.text AS d_text FROM {refs} r JOIN zone z
      ON z.map_name = r.map_name AND regexp_full_match(z.text, '[0-9]{{1,2}}') AND z.text <> r.block AND abs(z.cx - r.cx) < r.h * 3
      AND z.cy >= r.y1 + r.h * 0.5::DOUBLE AND z.cy <= r.y2 + r.h * 5) GROUP BY 1)"""


_ZONE = f""", zone AS (SELECT map_name, seq, trim(text) AS text, x1, y1, x2, y2, (x1 + x2) / 2.0::DOUBLE AS cx, (y1 + y2) / 2.0::DOUBLE AS cy, greatest(y2 - y1, 1) AS h
    FROM sheet_tokens WHERE (x1 + x2) / 2.0::DOUBLE >= 5000 * 0.55::DOUBLE AND (y1 + y2) / 2.0::DOUBLE <= 7000 * 0.30::DOUBLE),
  s0 AS (SELECT *, CASE WHEN regexp_matches(text, '{_NO}') THEN '{_NO}' ELSE '{_BARE}' END AS used FROM zone WHERE regexp_matches(text, '{_NO}') OR regexp_matches(text, '{_BARE}')),
  s1 AS (SELECT *, row_number() OVER (PARTITION BY map_name ORDER BY seq) AS rn,
    CASE WHEN regexp_matches(text, '{_NO}') THEN regexp_extract(text, '{_NO}', 1) ELSE regexp_extract(text, '{_BARE}', 1) END AS block,
    upper(CASE WHEN regexp_matches(text, '{_NO}') THEN regexp_extract(text, '{_NO}', 2) ELSE regexp_extract(text, '{_BARE}', 2) END) AS letter,
    CASE WHEN regexp_matches(text, '{_NO}') THEN regexp_extract(text, '{_NO}', 3) ELSE regexp_extract(text, '{_BARE}', 3) END AS own FROM s0),
  single AS (SELECT * FROM s1 WHERE rn = 1)
""" + _below("single_sub", "single") + """, single_number AS (SELECT s.map_name, s.block || ' ' || s.letter || CASE WHEN coalesce(nullif(s.own, ''), b.sub) IS NULL THEN ''
    ELSE '/' || coalesce(nullif(s.own, ''), b.sub) END AS sheet_number FROM single s LEFT JOIN single_sub b ON b.map_name = s.map_name)
, anchor AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY map_name ORDER BY seq) AS rn FROM zone WHERE regexp_matches(text, '(?i)^No\\.?$')) WHERE rn = 1),
  nums AS (SELECT z.* FROM zone z LEFT JOIN anchor a ON a.map_name = z.map_name WHERE regexp_full_match(z.text, '[0-9]{1,3}')
    AND (a.map_name IS NULL OR (z.cx > a.cx AND abs(z.cy - a.cy) < a.h * 1.5::DOUBLE AND z.cx - a.cx < a.h * 15))),
  pairs AS (SELECT n.map_name, n.seq AS n_seq, n.text AS block, n.cx AS n_cx, n.y1 AS n_y1, n.y2 AS n_y2, n.h AS n_h, l.seq AS l_seq, upper(l.text) AS letter,
      l.cx, l.y1, l.y2, l.h FROM nums n JOIN zone l ON l.map_name = n.map_name AND regexp_full_match(l.text, '(?i)[A-HJ-P]')
      AND l.cx > n.cx AND abs(l.cy - n.cy) < n.h * 1.5::DOUBLE AND l.cx - n.cx < n.h * 15),
  many AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY map_name ORDER BY n_cx, n_seq, cx, l_seq) AS rn FROM pairs) WHERE rn = 1),
  many_n AS (SELECT map_name, block, n_y1 AS y1, n_y2 AS y2, n_cx AS cx, n_h AS h FROM many)
""" + _below("many_l_sub", "many") + _below("many_n_sub", "many_n") + """, many_number AS (SELECT m.map_name, m.block || ' ' || m.letter
    || CASE WHEN coalesce(a.sub, b.sub) IS NULL THEN '' ELSE '/' || coalesce(a.sub, b.sub) END AS sheet_number
    FROM many m LEFT JOIN many_l_sub a ON a.map_name = m.map_name LEFT JOIN many_n_sub b ON b.map_name = m.map_name)
"""


def _sheets(t):
    return t.customer.select(
        F.concat(F.lit("MAP_"), F.col("c_custkey").cast("string")).alias("map_name"), F.lit(5000).alias("width"), F.lit(7000).alias("height")
    )


def _corner(t):
    return num.corner_tokens(t.sheet_tokens, _sheets(t))


@query("num01_corner_tokens", _ZONE + "SELECT map_name, seq, text, cx, cy FROM zone", ("sheet_tokens",))
def _(t):
    return _corner(t).select("map_name", "seq", "text", "cx", "cy")


@query("num02_single_token", _ZONE + "SELECT map_name, block, letter, own AS sub FROM single", ("sheet_tokens",))
def _(t):
    return num.single_token(_corner(t)).select("map_name", "block", "letter", "sub")


@query("num03_sub_number_below", _ZONE + "SELECT map_name, sub AS sub_below FROM single_sub", ("sheet_tokens",))
def _(t):
    corner = _corner(t)
    return num.sub_number_below(num.single_token(corner), corner)


@query("jon11_number_letter_pairs", _ZONE + "SELECT map_name, block, letter FROM many", ("sheet_tokens",))
def _(t):
    return num.many_tokens(cut_lineage(_corner(t))).select("map_name", "block", "letter")


@query("num04_many_tokens", _ZONE + "SELECT map_name, sheet_number FROM many_number", ("sheet_tokens",))
def _(t):
    return num.many_token_numbers(cut_lineage(_corner(t)))


@query(
    "num05_sheet_numbers",
    _ZONE + """SELECT 'MAP_' || c_custkey AS map_name, coalesce(s.sheet_number, m.sheet_number, '') AS sheet_number FROM customer
      LEFT JOIN single_number s ON s.map_name = 'MAP_' || c_custkey LEFT JOIN many_number m ON m.map_name = 'MAP_' || c_custkey""",
    ("sheet_tokens",),
)
def _(t):
    return num.sheet_numbers(t.sheet_tokens, _sheets(t))


@query(
    "num06_zone_lines",
    _ZONE + """SELECT map_name, (rn - 1) // 64 AS part, string_agg(text, ' ' ORDER BY rn) AS line
      FROM (SELECT map_name, text, row_number() OVER (PARTITION BY map_name ORDER BY cx, seq) AS rn FROM zone) GROUP BY 1, 2""",
    ("sheet_tokens",),
)
def _(t):
    return num.zone_lines(_corner(t))


@query("num06_zone_listing", _ZONE + "SELECT map_name, seq, text, cx, cy FROM zone ORDER BY map_name, cx, seq", ("sheet_tokens",))
def _(t):
    return num.zone_listing(_corner(t))
