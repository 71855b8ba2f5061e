"""Country by scored rules (CTY, JON-07, SRC-09, CLN-15)."""

from __future__ import annotations

from pyspark.sql import functions as F

from sheetlore.functions.country_rules import COUNTRY_RULES
from sheetlore.operators import cleaning
from sheetlore.operators import country as op
from sheetlore.plans.registry import query


def _test(pattern: str, whole: bool) -> str:
    quoted = pattern.replace("'", "''")
    if whole:
        return rf"regexp_matches(low, '(^|[^\p{{L}}\p{{N}}_]){quoted}($|[^\p{{L}}\p{{N}}_])')"
    return f"regexp_matches(low, '{quoted}')"


_TESTS = ",\n".join(f"CASE WHEN {_test(p, w)} THEN {no} END" for no, (p, _, _, w) in enumerate(COUNTRY_RULES))
_RULES = ", ".join(f"({no}, '{p}', '{c}', {s}, {str(w).lower()})" for no, (p, c, s, w) in enumerate(COUNTRY_RULES))
_HITS = rf""", docs AS MATERIALIZED (SELECT map_name, map_name || ' ' || string_agg(text, ' ' ORDER BY seq) AS document FROM country_texts GROUP BY 1),
  lows AS MATERIALIZED (SELECT map_name, document, lower(document) AS low FROM docs),
  hits AS MATERIALIZED (SELECT map_name, rule_no FROM (SELECT map_name, unnest([{_TESTS},
    CASE WHEN regexp_matches(document, '\b(?:\d{{1,3}}\s*[A-Z](?:/\d{{1,2}})?|[A-Z]{{1,2}}-\d{{2}}-\d{{1,2}})\b') THEN -1 END]) AS rule_no FROM lows) WHERE rule_no IS NOT NULL),
  rules AS (SELECT * FROM (VALUES (-1, '', 'india', 10, false), {_RULES}) v(rule_no, pattern, country, points, whole_word)),
  scores AS (SELECT map_name, country, CAST(sum(points) AS BIGINT) AS score, min(rule_no) AS first_rule FROM hits JOIN rules USING (rule_no) GROUP BY 1, 2),
  winners AS (SELECT d.map_name, coalesce(w.country, 'india') AS country FROM docs d LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER
    (PARTITION BY map_name ORDER BY score DESC, first_rule) AS rn FROM scores) WHERE rn = 1 AND score >= 3) w ON w.map_name = d.map_name)
"""


def _documents(t):
    documents = op.stretches(t.country_texts)
    named = F.concat("map_name", F.lit(" "), "document")
    return documents.withColumn("document", F.when(F.col("stretch") == 0, named).otherwise(F.col("document")))


@query(
    "src09_rule_usage",
    _HITS + "SELECT r.rule_no, r.pattern, r.country, r.points, r.whole_word, count(h.map_name) AS maps FROM rules r LEFT JOIN hits h USING (rule_no) WHERE r.rule_no >= 0 GROUP BY ALL",
    ("country_texts",),
)
def _(t):
    rules = t.spark.createDataFrame(
        [(no, p, c, s, w) for no, (p, c, s, w) in enumerate(COUNTRY_RULES)],
        "rule_no int, pattern string, country string, points int, whole_word boolean",
    )
    used = op.rule_hits(_documents(t)).groupBy("rule_no").agg(F.count("*").alias("maps"))
    return rules.join(used, "rule_no", "left").withColumn("maps", F.coalesce("maps", F.lit(0)))


@query(
    "cty01_documents",
    "SELECT map_name, seq // 32 AS part, length(string_agg(text, ' ' ORDER BY seq)) AS n_chars, md5(lower(string_agg(text, ' ' ORDER BY seq))) AS digest FROM country_texts GROUP BY 1, 2",
    ("country_texts",),
)
def _(t):
    return op.map_documents(t.country_texts).select("map_name", "part", F.length("document").cast("bigint").alias("n_chars"), F.md5(F.lower("document")).alias("digest"))


@query("jon07_rule_matches", _HITS + "SELECT map_name, CAST(rule_no AS INT) AS rule_no FROM hits WHERE rule_no >= 0", ("country_texts",))
def _(t):
    return op.rule_hits(_documents(t)).filter("rule_no >= 0")


@query("cty02_country_scores", _HITS + "SELECT map_name, country, score FROM scores", ("country_texts",))
def _(t):
    return op.country_scores(op.rule_hits(_documents(t))).select("map_name", "country", "score")


@query("cty03_sheet_number_bonus", _HITS + "SELECT map_name FROM hits WHERE rule_no = -1", ("country_texts",))
def _(t):
    return op.rule_hits(_documents(t)).filter("rule_no = -1").select("map_name")


@query("cty04_winners", _HITS + "SELECT map_name, country FROM winners", ("country_texts",))
def _(t):
    return op.detect_countries(t.country_texts)


@query(
    "cty05_fused_verdicts",
    _HITS + """SELECT w.map_name, CASE WHEN coalesce(image_confidence >= 0.7, false) THEN image_country ELSE country END AS country,
      CASE WHEN image_country IS NULL THEN 'text only' WHEN image_confidence >= 0.7 THEN 'image' WHEN image_country = country THEN 'agree'
        WHEN image_confidence >= 0.4 THEN 'conflict' ELSE 'text only' END AS relation
      FROM winners w LEFT JOIN image_verdicts i ON i.map_name = w.map_name""",
    ("country_texts", "image_verdicts"),
)
def _(t):
    return op.fuse_verdicts(op.detect_countries(t.country_texts), t.image_verdicts)


_INSTRUCTIONS = {"india": "Maps of India.", "uk": "Maps of Britain.", "usa": "Maps of the USA."}


@query(
    "cln15_request_texts",
    """, b AS (SELECT map_name, (rn - 1) // 40 AS batch, string_agg(((rn - 1) % 40 + 1) || '. ' || text, chr(10) ORDER BY rn) AS labels FROM (
         SELECT map_name, text, row_number() OVER (PARTITION BY map_name ORDER BY y1, x1, det_id) AS rn FROM detections) GROUP BY 1, 2)
       SELECT b.map_name, b.batch, CASE floor(m.s_acctbal)::BIGINT % 4 WHEN 0 THEN 'Maps of India.' WHEN 1 THEN 'Maps of Britain.' WHEN 2 THEN 'Maps of the USA.' ELSE 'Maps.' END
         || chr(10) || chr(10) || labels AS request FROM b JOIN map_info m ON m.map_name = b.map_name""",
    ("detections", "map_info"),
)
def _(t):
    kind = F.floor("s_acctbal") % 4
    chosen = t.map_info.select(
        "map_name", F.when(kind == 0, "india").when(kind == 1, "uk").when(kind == 2, "usa").otherwise("other").alias("country")
    )
    requests = cleaning.request_batches(t.detections, 40).join(chosen.select("map_name"), "map_name", "left_semi")
    return op.request_texts(requests, chosen, _INSTRUCTIONS, "Maps.").select("map_name", "batch", "request")
