"""Full-text search over documents and features (FTS, JON-13)."""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import functions as F

from sheetlore.operators import search as op
from sheetlore.operators.stored_index import StoredIndex
from sheetlore.plans.registry import query
from sheetlore.session import ensure_checkpoint_dir, listed

_WORDS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}]+')"
_CORPUS = f"docs AS (SELECT doc_id AS id, text, {_WORDS} AS words FROM documents)"
_FEATURES = rf""", docs AS (SELECT id, {_WORDS} AS words FROM (SELECT id, concat_ws(chr(10), feature_name, original_text, map_name) AS text
   FROM features WHERE feature_type <> 'noise'))"""


def _documents(t):
    return t.documents.select(F.col("doc_id").alias("id"), "text")


def _index(t, kind: str) -> StoredIndex:
    """The stored index over documents or features, in a folder named by the files of the tables as they are now."""
    marks = [(name, *rest, listed(t.spark, f"{t.folder}/{name}")) for name, *rest in listed(t.spark, t.folder)]
    name = hashlib.sha256(repr((t.folder, kind, marks)).encode()).hexdigest()[:24]
    index = StoredIndex(t.spark, f"{ensure_checkpoint_dir(t.spark)}/index-{name}")
    return index if index.segments() else index.create(_documents(t) if kind == "documents" else op.feature_corpus(t.features))


@query(
    "fts01_postings",
    f"WITH {_CORPUS} SELECT w AS term, id, n_words, count(*) AS tf FROM (SELECT id, CAST(len(words) AS INT) AS n_words, unnest(words) AS w FROM docs) GROUP BY ALL",
)
def _(t):
    return op.postings(_documents(t))


@query(
    "fts01_index_update",
    f"""WITH {_CORPUS}, p AS (SELECT w AS term, id, count(*) AS tf FROM (SELECT id, unnest(words) AS w FROM docs WHERE id % 50 > 0) GROUP BY ALL),
        changed AS (SELECT doc_id AS id, {_WORDS.replace('(text)', "(text || ' amended amended')")} AS words FROM documents WHERE doc_id % 50 = 1)
        SELECT term, count(*) AS docs, CAST(sum(tf) AS BIGINT) AS tf FROM (
          SELECT * FROM p WHERE id % 50 <> 1 UNION ALL SELECT w, id, count(*) FROM (SELECT id, unnest(words) AS w FROM changed) GROUP BY ALL) GROUP BY 1""",
)
def _(t):
    corpus = _documents(t)
    changed = corpus.filter("id % 50 = 1").withColumn("text", F.concat("text", F.lit(" amended amended")))
    index = StoredIndex(t.spark, f"{ensure_checkpoint_dir(t.spark)}/index-{uuid.uuid4().hex}").create(corpus)
    index.apply(1, changed, corpus.filter("id % 50 = 0"))
    return index.postings(positions=False).groupBy("term").agg(F.count("*").alias("docs"), F.sum("tf").alias("tf"))


@query("fts02_match_all", f"WITH {_CORPUS} SELECT id FROM docs WHERE list_contains(words, 'this') AND list_contains(words, 'from')")
def _(t):
    return _index(t, "documents").match_all(["this", "from"])


@query(
    "fts03_prefix",
    f"WITH {_CORPUS} SELECT id FROM docs WHERE len(list_filter(words, lambda w: starts_with(w, 'thor'))) > 0 AND len(list_filter(words, lambda w: starts_with(w, 'erin'))) > 0",
)
def _(t):
    return _index(t, "documents").match_prefix(["Thor", "erin"])


@query("fts03_phrase", f"WITH {_CORPUS} SELECT id FROM docs WHERE contains(' ' || array_to_string(words, ' ') || ' ', ' the of ')")
def _(t):
    return _index(t, "documents").match_phrase("The of")


_NEXT_TO = r"contains(' ' || array_to_string(regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}]+'), ' ') || ' ', ' red anvil ')"


@query(
    "fts03_phrase_features",
    "SELECT id FROM features WHERE feature_type <> 'noise' AND (" + " OR ".join(_NEXT_TO.format(c) for c in ("feature_name", "coalesce(original_text, '')", "map_name")) + ")",
    ("features",),
)
def _(t):
    return _index(t, "features").match_phrase("Red anvil")


@query(
    "fts03_mixed_query",
    f"WITH {_CORPUS} SELECT id, 0.0::DOUBLE AS score FROM docs WHERE contains(' ' || array_to_string(words, ' ') || ' ', ' the of ')"
    " AND len(list_filter(words, lambda w: starts_with(w, 'thor'))) > 0 AND list_contains(words, 'that') ORDER BY id LIMIT 50",
)
def _(t):
    return op.search(_documents(t), '"The of" thor* that')


def _bm25(terms: tuple[str, ...], limit: int = 50) -> str:
    listed = ", ".join(f"'{w}'" for w in terms)
    return f""", q AS (SELECT unnest([{listed}]) AS term),
  facts AS (SELECT count(*) AS n_docs, CAST(sum(len(words)) AS BIGINT) AS n_words FROM docs),
  tf AS (SELECT id, term, len(words) AS dl, len(list_filter(words, lambda w: w = term)) AS tf FROM docs, q),
  df AS (SELECT term, count(*) AS df FROM tf WHERE tf > 0 GROUP BY 1)
  SELECT id, score FROM (SELECT id, count(*) AS n, round(sum(ln(1 + (n_docs - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) *
     (tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / (CAST(n_words AS DOUBLE) / n_docs))))), 6) AS score
   FROM tf JOIN df USING (term), facts WHERE tf > 0 GROUP BY 1) WHERE n = {len(terms)} ORDER BY score DESC, id LIMIT {limit}"""


@query("fts04_bm25_documents", f"WITH {_CORPUS}" + _bm25(("with", "that")))
def _(t):
    return _index(t, "documents").search("with, THAT")


@query("fts04_bm25_features", _FEATURES + _bm25(("anvil", "lake")), ("features",))
def _(t):
    return _index(t, "features").search("Anvil lake")


@query(
    "fts04_ranked_mixed",
    f"""WITH {_CORPUS}, facts AS (SELECT count(*) AS n_docs, CAST(sum(len(words)) AS BIGINT) AS n_words FROM docs),
  tf AS (SELECT id, len(words) AS dl, unnest(['that', 'thor*', '"the of"']) AS slot, unnest([len(list_filter(words, lambda w: w = 'that')),
      len(list_filter(words, lambda w: starts_with(w, 'thor'))), len(list_filter(range(1, len(words)), lambda i: words[i] = 'the' AND words[i + 1] = 'of'))]) AS tf FROM docs),
  df AS (SELECT slot, count(*) AS df FROM tf WHERE tf > 0 GROUP BY 1)
  SELECT id, score FROM (SELECT id, count(*) AS n, round(sum(ln(1 + (n_docs - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) *
     (tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / (CAST(n_words AS DOUBLE) / n_docs))))), 6) AS score
   FROM tf JOIN df USING (slot), facts WHERE tf > 0 GROUP BY 1) WHERE n = 3 ORDER BY score DESC, id LIMIT 50""",
)
def _(t):
    return _index(t, "documents").ranked('"The of" thor* that')


@query("jon13_ranked_features", _FEATURES + ", best AS (" + _bm25(("rod",)).lstrip(", ").replace("q AS", "WITH q AS", 1) + """)
  SELECT b.id, b.score, f.feature_name, f.map_name FROM best b JOIN features f ON f.id = b.id""", ("features",))
def _(t):
    best = _index(t, "features").search("rod")
    return t.features.select("id", "feature_name", "map_name").join(F.broadcast(best), "id").select("id", "score", "feature_name", "map_name")


@query(
    "fts05_name_fallback",
    """SELECT id, 0.0::DOUBLE AS score FROM features WHERE feature_type <> 'noise' AND contains(lower(feature_name), ', (')
       ORDER BY map_name, feature_type, feature_name, id LIMIT 50""",
    ("features",),
)
def _(t):
    return op.search_features_text(t.features, ", (").select("id", "score")


@query("fts05_substring_fallback", "SELECT doc_id AS id, 0.0::DOUBLE AS score FROM documents WHERE contains(lower(text), '%%%') ORDER BY doc_id LIMIT 50")
def _(t):
    return op.search(_documents(t), "%%%")


_SPELLINGS = """, pairs AS (SELECT DISTINCT lower(replace(p_name, 'i', 'y')) AS variant, lower(p_name) AS canonical FROM part WHERE p_name NOT LIKE '% %x'),
  d AS (SELECT DISTINCT split_part(variant, ' ', 2) AS variant, split_part(canonical, ' ', 2) AS canonical FROM pairs),
  known AS (SELECT * FROM d UNION SELECT canonical, canonical FROM d)"""


@query(
    "fts06_expanded_search",
    _FEATURES + _SPELLINGS + """, slots AS (SELECT 0 AS slot, 'ryng' AS term UNION SELECT 0, k2.variant FROM known k1 JOIN known k2 ON k2.canonical = k1.canonical WHERE k1.variant = 'ryng'
        UNION SELECT 1, 'red' UNION SELECT 1, k2.variant FROM known k1 JOIN known k2 ON k2.canonical = k1.canonical WHERE k1.variant = 'red')
      SELECT id FROM (SELECT id, unnest(words) AS term FROM docs) JOIN slots USING (term) GROUP BY 1 HAVING count(DISTINCT slot) = 2""",
    ("features",),
)
def _(t):
    def second(column):
        return F.split_part(column, F.lit(" "), F.lit(2))

    dictionary = t.part.select(
        second(F.replace("p_name", F.lit("i"), F.lit("y"))).alias("variant"), second(F.col("p_name")).alias("canonical")
    ).distinct()
    slots = op.expanded_terms(["ryng", "red"], dictionary)
    return op.match_expanded(op.feature_corpus(t.features), slots, 2)
