"""Review reports and training rows (REV)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from sheetlore.functions.texts import stripped
from sheetlore.operators import merging
from sheetlore.operators import review as op
from sheetlore.plans.registry import query
from sheetlore.session import ensure_checkpoint_dir
from sheetlore.streaming import reviews

_N = "upper(trim(verified_correct, ' ' || chr(9) || chr(13) || chr(160))) = 'N'"
_LOG = f""", log AS (SELECT id, original_text, feature_name AS old_name, coalesce(nullif(trim(verified_name), ''), feature_name) AS new_name,
    coalesce(nullif(trim(verified_type), ''), feature_type) AS new_type, NULL::BOOLEAN AS ok FROM review WHERE {_N}
  UNION ALL SELECT id, NULL, NULL, NULL, NULL, true FROM review WHERE upper(trim(verified_correct, ' ' || chr(9) || chr(13) || chr(160))) = 'Y')"""
_STAMP = "2024-05-01 12:00:00"


@query(
    "src07_review_verdicts",
    "SELECT id, upper(trim(verified_correct, ' ' || chr(9) || chr(13) || chr(160))) AS verdict FROM review WHERE upper(trim(verified_correct, ' ' || chr(9) || chr(13) || chr(160))) IN ('Y', 'N', 'SKIP')",
    ("review",),
)
def _(t):
    return t.review.select("id", op.verdict().alias("verdict")).filter(F.col("verdict").isin("Y", "N", "SKIP"))


@query(
    "rev01_accuracy",
    f"""SELECT y + n AS reviewed, y AS correct, n AS incorrect, round(CAST(y AS DOUBLE) / (y + n) * 100, 1) AS accuracy
        FROM (SELECT count(*) FILTER (upper(trim(verified_correct, ' ' || chr(9) || chr(13) || chr(160))) = 'Y') AS y, count(*) FILTER ({_N}) AS n FROM review)""",
    ("review",),
)
def _(t):
    return op.accuracy_report(t.review)


@query(
    "rev02_errors_by_type",
    f"SELECT coalesce(nullif(feature_type, ''), 'unknown') AS feature_type, count(*) AS n FROM review WHERE {_N} GROUP BY 1",
    ("review",),
)
def _(t):
    return op.errors_by_type(t.review)


@query(
    "rev03_error_sample",
    f"""SELECT id, feature_name AS old_name, coalesce(nullif(verified_name, ''), '(same)') AS new_name, feature_type AS old_type,
          coalesce(nullif(verified_type, ''), '(same)') AS new_type FROM review WHERE {_N} ORDER BY id, row_no LIMIT 10""",
    ("review",),
)
def _(t):
    return op.error_sample(t.review)


@query(
    "rev04_training_rows_review",
    f"""SELECT * FROM (SELECT id, original_text, coalesce(nullif(trim(verified_name), ''), trim(feature_name)) AS new_name,
          coalesce(nullif(trim(verified_type), ''), trim(feature_type)) AS new_type FROM review WHERE {_N} AND trim(original_text) <> '')
        WHERE new_name <> ''""",
    ("review",),
)
def _(t):
    return op.training_rows_from_review(t.review)


@query(
    "rev05_apply_review_verified",
    f"""SELECT f.id, f.map_name, CASE WHEN r.id IS NULL THEN f.verified ELSE 1 END AS verified,
          CASE WHEN r.v = 'N' THEN r.new_name ELSE f.feature_name END AS feature_name
        FROM features f LEFT JOIN (SELECT id, min(v) AS v, arg_max(new_name, row_no) FILTER (v = 'N') AS new_name FROM (
            SELECT id, row_no, upper(trim(verified_correct, ' ' || chr(9) || chr(13) || chr(160))) AS v, coalesce(nullif(trim(verified_name), ''), trim(feature_name)) AS new_name
            FROM review) WHERE v IN ('Y', 'N') GROUP BY 1) r ON r.id = f.id""",
    ("features", "review"),
)
def _(t):
    return merging.apply_verdicts(t.features, t.review, mark_verified=True).select("id", "map_name", "verified", "feature_name")


@query(
    "rev06_log_entries",
    _LOG + " SELECT id, original_text, old_name, new_name, new_type, ok AS verified_correct FROM log",
    ("review",),
)
def _(t):
    return op.log_entries(t.review, _STAMP).select("id", "original_text", "old_name", "new_name", "new_type", "verified_correct")


@query(
    "rev07_training_rows_log",
    _LOG + """ SELECT l.id, l.original_text, l.new_name, l.new_type FROM log l
      ANTI JOIN (SELECT id FROM review WHERE trim(verified_type) = 'landmark') x ON x.id = l.id WHERE l.new_name <> '' AND l.old_name <> l.new_name""",
    ("review",),
)
def _(t):
    exported = t.review.filter(stripped("verified_type") == "landmark")
    return op.training_rows_from_log(op.log_entries(t.review, _STAMP), exported)


#: Line items whose reviews one file of the stream holds.
ROWS_PER_FILE = 250_000


def _streamed(t) -> tuple:
    """The review table as a stream of files, taken in by several micro-batches, and a folder for results.

    Files hold a bounded number of rows, so there are more of them in a larger table; two batches take them in.
    """
    home = f"{ensure_checkpoint_dir(t.spark)}/reviews-{uuid.uuid4().hex}"
    files = max(4, -(-t.lineitem.count() // ROWS_PER_FILE))
    t.review.repartition(files, "id").write.parquet(f"{home}/in")
    return reviews.review_stream(t.spark, f"{home}/in", t.review.schema, files_per_batch=-(-files // 2)), home


@query(
    "rev07_streamed_rows",
    _LOG + " SELECT DISTINCT id, original_text, new_name, new_type FROM log WHERE new_name <> '' AND old_name IS DISTINCT FROM new_name",
    ("review",),
)
def _(t):
    stream, home = _streamed(t)
    reviews.append_training_rows(stream, f"{home}/rows", f"{home}/cp", _STAMP)
    return t.spark.read.parquet(f"{home}/rows").select("id", "original_text", "new_name", "new_type")


@query(
    "snk09_streamed_log",
    _LOG + " SELECT id, original_text, old_name, new_name, new_type, ok AS verified_correct FROM log",
    ("review",),
)
def _(t):
    stream, home = _streamed(t)
    reviews.append_log(stream, f"{home}/log", f"{home}/cp", _STAMP)
    return t.spark.read.parquet(f"{home}/log").select("id", "original_text", "old_name", "new_name", "new_type", "verified_correct")


@query(
    "rev08_loop_summary",
    _LOG + """ SELECT 'applied' AS section, '' AS item, count(*) AS n FROM log WHERE new_name IS NOT NULL
      UNION ALL SELECT 'confirmed', '', count(*) FROM log WHERE ok
      UNION ALL SELECT 'type', coalesce(nullif(new_type, ''), 'unknown'), count(*) FROM log WHERE new_name IS NOT NULL GROUP BY 2""",
    ("review",),
)
def _(t):
    return op.loop_summary(op.log_entries(t.review, _STAMP))
