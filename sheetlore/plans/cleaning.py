"""Requests, classification, votes and spelling (CLN, SRC-08)."""

from __future__ import annotations

from pyspark.sql import functions as F

from sheetlore.operators import cleaning as op
from sheetlore.operators import merging
from sheetlore.plans.registry import query


@query(
    "cln01_request_batches",
    """SELECT map_name, (rn - 1) // 40 AS batch, string_agg(((rn - 1) % 40 + 1) || '. ' || text, chr(10) ORDER BY rn) AS labels FROM (
         SELECT map_name, text, row_number() OVER (PARTITION BY map_name ORDER BY y1, x1, det_id) AS rn FROM detections) GROUP BY 1, 2""",
    ("detections",),
)
def _(t):
    return op.request_batches(t.detections, 40)


_RESPONSES = """CASE p_partkey % 6
   WHEN 0 THEN '[{"original": "' || p_name || '", "cleaned": "' || upper(p_name) || '", "feature_type": "river", "confidence": 0.9}]'
   WHEN 1 THEN '```json' || chr(10) || '[{"original": "a' || p_size || '", "cleaned": "A", "feature_type": "lake", "confidence": 0.5}, {"original": "b", "cleaned": "B"}]' || chr(10) || '```'
   WHEN 2 THEN '{"original": "' || p_name || '", "cleaned": "X"}' WHEN 3 THEN 'no list here' WHEN 4 THEN '[]'
   ELSE '  [{"original": "' || p_name || '", "cleaned": "c", "feature_type": "road", "confidence": 1}]  ' END AS payload"""


@query(
    "cln02_response_items",
    """SELECT p_partkey AS id, p_name AS original, upper(p_name) AS cleaned, 'river' AS feature_type, 0.9::DOUBLE AS confidence FROM part WHERE p_partkey % 6 = 0
       UNION ALL SELECT p_partkey, 'a' || p_size, 'A', 'lake', 0.5 FROM part WHERE p_partkey % 6 = 1
       UNION ALL SELECT p_partkey, 'b', 'B', NULL, NULL FROM part WHERE p_partkey % 6 = 1
       UNION ALL SELECT p_partkey, p_name, 'c', 'road', 1.0 FROM part WHERE p_partkey % 6 = 5""",
)
def _(t):
    responses = t.part.selectExpr("p_partkey AS id", _RESPONSES)
    return op.response_items(responses)


_CLASSES = r""", r AS (SELECT map_name, det_id, trim(text) AS cleaned, lower(trim(text)) AS low FROM detections),
  c AS (SELECT map_name, det_id, cleaned, CASE
    WHEN regexp_matches(low, '(?i)(^\d+$|^\d+\.\d+$|^[A-Z]$|^[A-Z]\d+$|^\d+[A-Z]$|^(N|S|E|W|NE|NW|SE|SW)$|^\d+:\d+|^(miles?|feet?|km|metres?|ft|m)$|^[^\p{L}\p{N}]+$)') THEN 'noise/0.95'
    WHEN length(low) <= 1 THEN 'noise/0.9'
    WHEN regexp_matches(low, '\b(nadi|nala|nallah|nullah|river|stream|khad|jharna|torrent|sone|koel)\b|\br\.\b') THEN 'river/0.8'
    WHEN regexp_matches(low, '\b(lake|jheel|jhil|tal|tank|sagar|samudra|dam|reservoir)\b') THEN 'lake/0.8'
    WHEN regexp_matches(low, '\b(hill|hills|peak|mount|pahar|pahad|ghati|ghat|range|ridge|escarpment)\b|\bmt\.\b') THEN 'mountain/0.8'
    WHEN regexp_matches(low, '\b(forest|rf|reserved|jungle|van|wildlife|sanctuary)\b') THEN 'forest/0.8'
    WHEN regexp_matches(low, '\b(road|nh|sh|track|path|railway|station|junction)\b') THEN 'road/0.75'
    WHEN regexp_matches(low, '[a-z0-9 ]{2}(pur|pura|nagar|puram|ganj|gunj|gaon|gon|bad|abad|garh|kot|kota|wara|wali|ward|tola|toli|khurd|kalan|buzurg|dihi|dih|bazar|basti|mohalla|patti|khera|kheri)$') THEN 'settlement/0.72'
    WHEN regexp_matches(cleaned, '^[A-Z]') AND length(cleaned) >= 4 AND regexp_full_match(replace(cleaned, ' ', ''), '[A-Za-z]+') THEN 'settlement/0.55'
    ELSE 'unknown/0.4' END AS rule FROM r),
  classified AS (SELECT map_name, det_id, cleaned, split_part(rule, '/', 1) AS feature_type, CAST(split_part(rule, '/', 2) AS DOUBLE) AS confidence FROM c)
"""


@query("cln03_classify", _CLASSES + "SELECT * FROM classified", ("detections",))
def _(t):
    return op.classify(t.detections.select("map_name", "det_id", "text")).select("map_name", "det_id", "cleaned", "feature_type", "confidence")


@query("cln04_type_histogram", _CLASSES + "SELECT feature_type, count(*) AS n FROM classified GROUP BY 1", ("detections",))
def _(t):
    return op.type_histogram(op.classify(t.detections.select("text")))


@query(
    "cln05_pass_through",
    """SELECT p.p_partkey AS item_no, p.p_name AS original, coalesce(i.cleaned, p.p_name) AS cleaned, coalesce(i.feature_type, 'unknown') AS feature_type,
         coalesce(i.confidence, 0.5) AS confidence FROM part p LEFT JOIN (SELECT * FROM provider_items WHERE provider = 'C') i ON i.item_no = p.p_partkey""",
    ("provider_items",),
)
def _(t):
    texts = t.part.select(F.col("p_partkey").alias("item_no"), F.col("p_name").alias("original"))
    results = t.provider_items.filter("provider = 'C'").select("item_no", "cleaned", "feature_type", "confidence")
    return op.pass_through(texts, results, "item_no")


@query(
    "cln06_union_providers",
    "SELECT provider, item_no, original, cleaned, feature_type, confidence FROM provider_items",
    ("provider_items",),
)
def _(t):
    rows = t.provider_items.select("provider", "item_no", "original", "cleaned", "feature_type", "confidence")
    return op.union_providers([rows.filter(F.col("provider") == p) for p in ("A", "B", "C")])


_VOTED = """, i AS (SELECT *, trim(original) AS o, coalesce(feature_type, 'unknown') AS kind, CAST(round(confidence * 10000) AS BIGINT) AS units FROM provider_items WHERE trim(original) <> ''),
  kinds AS (SELECT o, kind, n, sum(n) OVER (PARTITION BY o) AS total, row_number() OVER (PARTITION BY o ORDER BY n DESC, first_p, first_i) AS rn FROM (
    SELECT o, kind, count(*) AS n, min(provider_no) AS first_p, min(item_no) FILTER (provider_no = mp) AS first_i FROM (
      SELECT *, min(provider_no) OVER (PARTITION BY o, kind) AS mp FROM i) GROUP BY 1, 2)),
  words AS (SELECT o, cleaned, row_number() OVER (PARTITION BY o ORDER BY n DESC, first_p, first_i) AS rn FROM (
    SELECT o, cleaned, count(*) AS n, min(provider_no) AS first_p, min(item_no) FILTER (provider_no = mp) AS first_i FROM (
      SELECT *, min(provider_no) OVER (PARTITION BY o, cleaned) AS mp FROM i) GROUP BY 1, 2)),
  means AS (SELECT o, CAST(sum(units) AS BIGINT) / CAST(count(*) AS BIGINT) / 10000 AS mean FROM i GROUP BY 1),
  voted AS (SELECT k.o AS original, w.cleaned, k.kind AS feature_type,
     round(least(0.99::DOUBLE, mean * (0.70::DOUBLE + 0.30::DOUBLE * (CAST(k.n AS BIGINT) / CAST(k.total AS BIGINT)))), 4) AS confidence,
     CAST(k.total AS BIGINT) AS llm_count, round(CAST(k.n AS BIGINT) / CAST(k.total AS BIGINT), 3) AS agreement
     FROM kinds k JOIN words w ON w.o = k.o AND w.rn = 1 JOIN means m ON m.o = k.o WHERE k.rn = 1)
"""


@query("cln07_vote", _VOTED + "SELECT original, cleaned, feature_type, llm_count FROM voted", ("provider_items",))
def _(t):
    return op.vote(t.provider_items).select("original", "cleaned", "feature_type", "llm_count")


@query("cln08_consensus_confidence", _VOTED + "SELECT original, confidence, agreement FROM voted", ("provider_items",))
def _(t):
    return op.vote(t.provider_items).select("original", "confidence", "agreement")


@query("cln09_feature_counts", _VOTED + "SELECT count(*) FILTER (feature_type <> 'noise') AS features, count(*) FILTER (feature_type = 'noise') AS noise FROM voted", ("provider_items",))
def _(t):
    return op.feature_counts(op.vote(t.provider_items))


@query("cln09_by_confidence", _VOTED + "SELECT original, feature_type, confidence FROM voted ORDER BY confidence DESC, original", ("provider_items",))
def _(t):
    return op.vote(t.provider_items).select("original", "feature_type", "confidence").orderBy(F.desc("confidence"), "original")


@query("cln10_high_agreement", _VOTED + "SELECT count(*) FILTER (agreement >= 0.75) AS agreed, count(*) AS n FROM voted", ("provider_items",))
def _(t):
    return op.high_agreement(op.vote(t.provider_items))


@query(
    "cln14_drop_noise_and_enrich",
    _CLASSES + """, best AS (SELECT map_name, text, min((y1, x1, det_id)) AS k FROM detections GROUP BY 1, 2)
      SELECT DISTINCT c.map_name, b.text AS original, c.cleaned, c.feature_type, d.x1, d.y1 FROM classified c
      JOIN detections s ON s.map_name = c.map_name AND s.det_id = c.det_id JOIN best b ON b.map_name = s.map_name AND b.text = s.text
      JOIN detections d ON d.map_name = b.map_name AND d.det_id = b.k[3] WHERE c.feature_type <> 'noise'""",
    ("detections",),
)
def _(t):
    texts = t.detections.select("map_name", "text").distinct()
    cleaned = op.drop_noise(op.classify(texts)).withColumnRenamed("text", "original")
    return merging.attach_detection(cleaned, t.detections).select("map_name", "original", "cleaned", "feature_type", "x1", "y1")


@query(
    "cln14_kept_and_dropped",
    _CLASSES + "SELECT map_name, count(*) FILTER (feature_type <> 'noise') AS kept, count(*) FILTER (feature_type = 'noise') AS dropped FROM classified GROUP BY 1",
    ("detections",),
)
def _(t):
    noise = F.col("feature_type") == "noise"
    return op.classify(t.detections.select("map_name", "text")).groupBy("map_name").agg(
        F.count_if(~noise).alias("kept"), F.count_if(noise).alias("dropped")
    )


_DICTIONARY = """, sections AS (SELECT file_no, s, unnest(map_keys(s)) AS section FROM (SELECT file_no, CAST(CAST(payload AS JSON) AS MAP(VARCHAR, MAP(VARCHAR, VARCHAR))) AS s FROM spelling_files)),
  entries AS (SELECT file_no, section, unnest(map_entries(s[section])) AS e FROM sections WHERE section <> 'meta'),
  dictionary AS (SELECT variant, canonical FROM (SELECT lower(e.key) AS variant, e.value AS canonical,
    row_number() OVER (PARTITION BY lower(e.key) ORDER BY file_no DESC, section DESC) AS rn FROM entries) WHERE rn = 1)
"""


@query("src08_spelling_dictionary", _DICTIONARY + "SELECT variant, canonical FROM dictionary", ("spelling_files",))
def _(t):
    return op.flatten_spelling(t.spelling_files)


_SPELLED = _DICTIONARY + r""", whole AS (SELECT t.text_no, t.text, d.canonical FROM spelling_texts t LEFT JOIN dictionary d ON d.variant = lower(trim(t.text))),
  runs AS (SELECT text_no, r.run, r.no FROM (SELECT text_no, unnest(list_transform(regexp_extract_all(text, '[A-Za-z'']+|[^A-Za-z'']+'), lambda v, k: struct_pack(run := v, no := k))) AS r
     FROM whole WHERE canonical IS NULL)),
  words AS (SELECT text_no, string_agg(CASE WHEN d.canonical IS NULL THEN run WHEN regexp_matches(run, '^[A-Z]') THEN upper(substr(d.canonical, 1, 1)) || substr(d.canonical, 2)
     ELSE d.canonical END, '' ORDER BY no) AS fixed FROM runs LEFT JOIN dictionary d ON d.variant = lower(run) GROUP BY 1),
  spelled AS (SELECT w.text_no, w.text AS old_text, w.canonical IS NOT NULL AS is_whole, CASE WHEN w.canonical IS NULL THEN f.fixed
     WHEN regexp_matches(w.text, '^[A-Z]') THEN upper(substr(w.canonical, 1, 1)) || substr(w.canonical, 2) ELSE w.canonical END AS text
     FROM whole w LEFT JOIN words f ON f.text_no = w.text_no)
"""


@query("cln11_whole_text_spelling", _SPELLED + "SELECT text_no, text FROM spelled WHERE is_whole", ("spelling_files", "spelling_texts"))
def _(t):
    dictionary = op.flatten_spelling(t.spelling_files)
    hits = op.lookup(t.spelling_texts, "text", dictionary).filter(F.col("canonical").isNotNull())
    return hits.select("text_no", op.like_initial(F.col("text"), F.col("canonical")).alias("text"))


@query("cln12_word_spelling", _SPELLED + "SELECT text_no, text FROM spelled", ("spelling_files", "spelling_texts"))
def _(t):
    fixed = op.normalise_spelling(t.spelling_texts, "text", op.flatten_spelling(t.spelling_files))
    return fixed.select("text_no", "text")


@query(
    "cln13_spelling_source",
    _SPELLED + "SELECT text_no, text, CASE WHEN text <> old_text THEN old_text END AS spelling_source FROM spelled",
    ("spelling_files", "spelling_texts"),
)
def _(t):
    return op.normalise_spelling(t.spelling_texts, "text", op.flatten_spelling(t.spelling_files))
