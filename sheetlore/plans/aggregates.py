"""Statistics, samples and splits (AGG, SMP)."""

from __future__ import annotations

from pyspark.sql import functions as F

from sheetlore.functions.names import file_stem
from sheetlore.operators import sampling
from sheetlore.operators import statistics as op
from sheetlore.operators.filters import not_noise
from sheetlore.plans.registry import query

_MEAN = "coalesce(round(CAST(sum(CAST(round(confidence * 10000) AS BIGINT)) AS BIGINT) / count(confidence) / 10000, 3), 0.0)"


@query(
    "agg01_totals",
    "SELECT count(*) FILTER (feature_type <> 'noise') AS features, count(*) AS all_rows FROM features",
    ("features",),
)
def _(t):
    return t.features.agg(F.count_if(F.col("feature_type") != "noise").alias("features"), F.count("*").alias("all_rows"))


@query("agg02_count_by_type", "SELECT feature_type, count(*) AS n FROM features WHERE feature_type <> 'noise' GROUP BY 1", ("features",))
def _(t):
    return op.count_by(t.features, "feature_type").orderBy(F.desc("n"), "feature_type")


@query("agg03_count_by_map", "SELECT map_name, count(*) AS n FROM features WHERE feature_type <> 'noise' GROUP BY 1", ("features",))
def _(t):
    return op.count_by(t.features, "map_name").orderBy(F.desc("n"), "map_name")


@query(
    "agg03_map_feed",
    r"""SELECT map_name, regexp_extract(map_name, '\((\d{4})\)', 1) AS year, count(*) AS n FROM features GROUP BY 1, 2""",
    ("features",),
)
def _(t):
    return t.features.groupBy("map_name").agg(F.count("*").alias("n")).select(
        "map_name", F.regexp_extract("map_name", r"\((\d{4})\)", 1).alias("year"), "n"
    )


@query(
    "agg04_confidence_bands",
    f"""SELECT count(*) FILTER (confidence >= 0.8) AS high, count(*) FILTER (confidence >= 0.5 AND confidence < 0.8) AS medium,
        count(*) FILTER (confidence < 0.5) AS low, {_MEAN} AS mean_confidence FROM features WHERE feature_type <> 'noise'""",
    ("features",),
)
def _(t):
    return op.confidence_bands(t.features)


@query(
    "agg05_top_names",
    """SELECT min(feature_name) AS feature_name, count(*) AS n FROM features WHERE feature_type <> 'noise' AND length(feature_name) > 2
       GROUP BY lower(feature_name) ORDER BY n DESC, lower(feature_name) LIMIT 10""",
    ("features",),
)
def _(t):
    return op.top_names(t.features)


@query(
    "agg06_statistics_bundle",
    """, f AS (SELECT *, CASE WHEN confidence >= 0.8 THEN 'high' WHEN confidence >= 0.5 THEN 'medium'
                 WHEN confidence < 0.5 THEN 'low' ELSE 'none' END AS band FROM features WHERE feature_type <> 'noise')
       SELECT 'total' AS section, '' AS item, count(*) AS n FROM f UNION ALL
       SELECT 'type', feature_type, count(*) FROM f GROUP BY 2 UNION ALL
       SELECT 'map', map_name, count(*) FROM f GROUP BY 2 UNION ALL SELECT 'band', band, count(*) FROM f GROUP BY 2""",
    ("features",),
)
def _(t):
    return op.statistics_bundle(t.features)


@query("agg07_session_maps", "SELECT DISTINCT map_name FROM features WHERE session_id = 'S3'", ("features",))
def _(t):
    return t.features.filter(F.col("session_id") == "S3").select("map_name").distinct()


@query(
    "agg08_file_count",
    r"""SELECT count(*) FILTER (regexp_matches(lower(path), '\.(jpg|jpeg|png)$')) AS images,
        count(*) FILTER (regexp_matches(lower(path), '\.(jpg|jpeg|png|tif|tiff)$')) AS uploads FROM map_files""",
    ("map_files",),
)
def _(t):
    path = F.lower("path")
    return t.map_files.agg(
        F.count_if(path.rlike(r"\.(jpg|jpeg|png)$")).alias("images"),
        F.count_if(path.rlike(r"\.(jpg|jpeg|png|tif|tiff)$")).alias("uploads"),
    )


@query("agg08_session_counts", "SELECT session_id, count(*) AS n FROM features GROUP BY 1", ("features",))
def _(t):
    return t.features.groupBy("session_id").agg(F.count("*").alias("n"))


@query("agg09_located_per_map", "SELECT map_name, count(lat_min) AS located, count(*) AS n FROM features GROUP BY 1", ("features",))
def _(t):
    return op.located_per_map(t.features)


_RUNS = """SELECT map_name, 'old' AS run, CASE WHEN l_linenumber = 1 THEN NULL WHEN map_no % 3 = 0 THEN '' ELSE map_no % 7 || ' A' END AS value FROM boxes
 UNION ALL SELECT map_name, 'new', CASE WHEN l_linenumber < 3 THEN NULL WHEN map_no % 4 = 0 THEN '' WHEN map_no % 5 = 0 THEN 'B' ELSE map_no % 7 || ' A' END FROM boxes"""


@query(
    "agg11_regression_report",
    f""", best AS (SELECT map_name, coalesce(max(value) FILTER (run = 'old'), '') AS o, coalesce(max(value) FILTER (run = 'new'), '') AS n
          FROM ({_RUNS}) GROUP BY 1)
        SELECT CASE WHEN o = '' AND n = '' THEN 'blank' WHEN o = '' THEN 'found' WHEN n = '' THEN 'lost' WHEN o = n THEN 'unchanged'
          ELSE 'changed' END AS outcome, count(*) AS maps FROM best GROUP BY 1""",
    ("boxes",),
)
def _(t):
    value = F.concat((F.col("map_no") % 7).cast("string"), F.lit(" A"))
    old = F.when(F.col("l_linenumber") == 1, None).when(F.col("map_no") % 3 == 0, "").otherwise(value)
    new = (
        F.when(F.col("l_linenumber") < 3, None).when(F.col("map_no") % 4 == 0, "").when(F.col("map_no") % 5 == 0, "B").otherwise(value)
    )
    runs = t.boxes.select(
        "map_name",
        F.inline(
            F.array(
                F.struct(F.lit("old").alias("run"), old.alias("value")), F.struct(F.lit("new").alias("run"), new.alias("value"))
            )
        ),
    )
    return op.regression_report(runs)


@query(
    "agg11_coverage_report",
    "SELECT ocr_survey_year <> '' AS detected, count(*) AS maps FROM map_info GROUP BY 1",
    ("map_info",),
)
def _(t):
    return t.map_info.groupBy((F.col("ocr_survey_year") != "").alias("detected")).agg(F.count("*").alias("maps"))


@query(
    "agg12_feed_quality",
    """SELECT count(*) AS n_rows, CAST(sum((feature_type IS NULL)::INT + (grid_reference IS NULL)::INT + (survey_year IS NULL)::INT
       + (confidence IS NULL)::INT) AS BIGINT) AS null_cells, count(DISTINCT map_name) AS maps FROM features""",
    ("features",),
)
def _(t):
    return op.feed_quality(t.features, ["feature_type", "grid_reference", "survey_year", "confidence"])


@query(
    "agg12_key_differences",
    """SELECT coalesce(f.map_name, c.map_name) AS map_name, (f.map_name IS NOT NULL)::INT AS in_feed, (c.map_name IS NOT NULL)::INT AS in_catalogue
       FROM (SELECT DISTINCT map_name FROM features WHERE confidence > 0.95) f
       FULL JOIN (SELECT map_name FROM map_info WHERE s_acctbal > 0) c ON f.map_name = c.map_name
       WHERE f.map_name IS NULL OR c.map_name IS NULL""",
    ("features", "map_info"),
)
def _(t):
    return op.key_differences(t.features.filter("confidence > 0.95"), t.map_info.filter("s_acctbal > 0"))


@query(
    "smp01_random_sample",
    """SELECT id, map_name, feature_name FROM features ORDER BY md5('sample#' || id), id LIMIT 500""",
    ("features",),
)
def _(t):
    return sampling.random_sample(t.features.select("id", "map_name", "feature_name"))


@query(
    "smp02_exact_split",
    """, n AS (SELECT *, row_number() OVER (ORDER BY md5('split#' || id), id) - 1 AS pos, (SELECT count(*) FROM split_rows) AS total FROM split_rows)
       SELECT id, label, path, CASE WHEN pos < floor(total * 0.8) THEN 'TRAIN' WHEN pos < floor(total * 0.9) THEN 'VALIDATE' ELSE 'TEST' END AS set
       FROM n""",
    ("split_rows",),
)
def _(t):
    return sampling.exact_split(t.split_rows)


@query(
    "smp02_hashed_split",
    """SELECT id, label, CASE WHEN share < 0.8 THEN 'TRAIN' WHEN share < 0.9 THEN 'VALIDATE' ELSE 'TEST' END AS set
       FROM (SELECT id, label, CAST('0x' || substr(md5('split#' || id), 1, 7) AS BIGINT) / 268435456.0::DOUBLE AS share FROM split_rows)""",
    ("split_rows",),
)
def _(t):
    return sampling.hashed_split(t.split_rows.select("id", "label"))
