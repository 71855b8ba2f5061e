"""Full-text search: token index, word, prefix and phrase queries, and BM25 ranking.

A corpus is any frame with ``id`` and ``text``; feature rows become one through
``feature_corpus``. Postings carry the length of their document, so ranking needs the
postings of the query words only and no join with the documents. These functions read the corpus
itself; ``stored_index`` answers the same queries from an index.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sheetlore.session import ship_package, small_side

WORD = r"[\p{L}\p{N}]+"
K1, B = 1.2, 0.75
HITS = 50
#: Stands between the columns of a row in its text; no phrase reaches across it.
COLUMN_END = "\x1f"
#: Texts that a counting task gets at once, and texts whose words it counts together.
TEXTS, TOGETHER = 1024, 64


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def query_words(text: str) -> list[str]:
    """Distinct words of a query, in order."""
    import regex

    return list(dict.fromkeys(regex.findall(WORD, text.lower())))


def feature_corpus(features: DataFrame) -> DataFrame:
    """Indexed columns of non-noise features as one text."""
    return features.filter(F.col("feature_type") != "noise").select(
        "id", F.concat_ws(COLUMN_END, "feature_name", "original_text", "map_name").alias("text")
    )


def postings(corpus: DataFrame) -> DataFrame:
    """``(term, id, tf, n_words)``: how often each word occurs in each document.

    A text is counted where it is read. Only ids that several rows share are shuffled: theirs are added up,
    partially before the shuffle, whose key holds the word and the document.
    """
    words = corpus.select("id", words_of(F.col("text")).alias("words"))
    shared = small_side(corpus.groupBy("id").agg(F.count("*").alias("rows")).filter("rows > 1").select(F.col("id").alias("again")))
    same = F.col("id").eqNullSafe(F.col("again"))
    once = _counted(words.join(shared, same, "left_anti"))
    added = _counted(words.join(shared, same, "left_semi")).groupBy("term", "id", "n_words").agg(F.sum("tf").alias("tf"))
    return once.unionByName(added)


def _counted(words: DataFrame) -> DataFrame:
    """Postings of each row of (id, words)."""
    spark = words.sparkSession
    ship_package(spark)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= TEXTS:
        spark.conf.set(key, TEXTS)
    one = StructType([words.schema["id"]]).simpleString()[len("struct<"):-1]
    return words.mapInArrow(_count, f"term string, {one}, tf long, n_words int")


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for begin in range(0, batch.num_rows, TOGETHER):
            rows = batch.slice(begin, TOGETHER)
            lists = rows.column("words")
            coded = lists.flatten().dictionary_encode()
            if not len(coded):
                continue
            n_words = pa.compute.list_value_length(lists).fill_null(0)
            row = np.repeat(np.arange(rows.num_rows), n_words.to_numpy())
            key, tf = np.unique(row * len(coded.dictionary) + coded.indices.to_numpy(), return_counts=True)
            row, code = (pa.array(part) for part in np.divmod(key, len(coded.dictionary)))
            yield pa.RecordBatch.from_arrays(
                [coded.dictionary.take(code), rows.column("id").take(row), pa.array(tf, pa.int64()), n_words.take(row)],
                ["term", "id", "tf", "n_words"],
            )


def query_postings(corpus: DataFrame, terms: list[str], prefix: bool = False) -> DataFrame:
    """Postings of the query words only, straight from the texts and without a shuffle."""
    counted = corpus.select("id", words_of(F.col("text")).alias("words"))
    wanted = F.array(*[F.lit(t) for t in terms])

    def count(term: Column) -> Column:
        return F.size(F.filter("words", (lambda w: w.startswith(term)) if prefix else (lambda w: w == term)))

    rows = F.transform(wanted, lambda term: F.struct(term.alias("term"), count(term).alias("tf")))
    return counted.select("id", F.size("words").alias("n_words"), F.inline(rows)).filter(F.col("tf") > 0)


def match_all(hits: DataFrame, n_terms: int) -> DataFrame:
    """Documents that hold every query word."""
    return hits.groupBy("id").agg(F.count_distinct("term").alias("n")).filter(F.col("n") == n_terms).select("id")


def match_prefix(corpus: DataFrame, prefixes: list[str]) -> DataFrame:
    """Documents in which every prefix starts some word."""
    wanted = F.array(*[F.lit(p.lower()) for p in prefixes])
    words = corpus.select("id", F.array_distinct(words_of(F.col("text"))).alias("words"))
    return words.filter(F.forall(wanted, lambda p: F.exists("words", lambda w: w.startswith(p)))).select("id")


def match_phrase(corpus: DataFrame, phrase: str) -> DataFrame:
    """Documents that hold the words of the phrase next to each other, in order, within one column."""
    sought = " " + " ".join(query_words_in_order(phrase)) + " "

    def holds(column: Column) -> Column:
        return F.concat(F.lit(" "), F.array_join(words_of(column), " "), F.lit(" ")).contains(sought)

    return corpus.filter(F.exists(F.split("text", COLUMN_END), holds)).select("id")


def query_words_in_order(text: str) -> list[str]:
    import regex

    return regex.findall(WORD, text.lower())


def match_substring(corpus: DataFrame, text: str) -> DataFrame:
    """Plain substring search, for queries that hold no word at all."""
    return corpus.filter(F.lower("text").contains(text.lower())).select("id")


def expanded_terms(terms: list[str], dictionary: DataFrame) -> DataFrame:
    """``(slot, term)``: each query word and all spellings that share its canonical form."""
    spark = dictionary.sparkSession
    asked = spark.createDataFrame([(i, w) for i, w in enumerate(terms)], "slot int, term string")
    forms = dictionary.select(F.lower("variant").alias("variant"), F.lower("canonical").alias("canonical"))
    known = forms.unionByName(forms.select(F.col("canonical").alias("variant"), "canonical")).distinct()
    canonical = known.join(F.broadcast(asked), F.col("term") == F.col("variant")).select("slot", "canonical")
    spellings = known.join(canonical, "canonical").select("slot", F.col("variant").alias("term"))
    return asked.unionByName(spellings).distinct()


def match_expanded(corpus: DataFrame, slots: DataFrame, n_slots: int) -> DataFrame:
    """Documents that hold, for every query word, one of its spellings."""
    words = corpus.select("id", F.explode(F.array_distinct(words_of(F.col("text")))).alias("term"))
    hits = words.join(slots, "term").groupBy("id").agg(F.count_distinct("slot").alias("n"))
    return hits.filter(F.col("n") == n_slots).select("id")


def corpus_facts(corpus: DataFrame) -> DataFrame:
    """Number of documents and their total length in words."""
    return corpus.agg(F.count("*").alias("n_docs"), F.sum(F.size(words_of(F.col("text")))).alias("n_words"))


def rank(hits: DataFrame, facts: DataFrame, n_terms: int, limit: int = HITS) -> DataFrame:
    """Best documents that hold all words, by Okapi BM25; equal scores by id."""
    n_docs, n_words = facts.select("n_docs").scalar(), facts.select("n_words").scalar()
    frequency = hits.groupBy("term").agg(F.count("*").alias("df"))
    sized = hits.join(F.broadcast(frequency), "term").withColumns({"_docs": n_docs, "_words": n_words})
    idf = F.log(1 + (F.col("_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    mean_length = F.col("_words") / F.col("_docs")
    weight = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("n_words") / mean_length))
    scored = sized.groupBy("id").agg(F.count("*").alias("n"), F.round(F.sum(idf * weight), 6).alias("score"))
    return scored.filter(F.col("n") == n_terms).select("id", "score").orderBy(F.desc("score"), "id").limit(limit)


def search(corpus: DataFrame, text: str, limit: int = HITS) -> DataFrame:
    """Search by words, ``prefix*`` and ``"a phrase"``, best first.

    Plain words are ranked over the corpus. With prefixes or phrases the documents that fulfil all
    parts are returned in order of id. A text without a word falls back to substring search.
    """
    import regex

    phrases = [p for p in regex.findall(r'"([^"]*)"', text) if query_words(p)]
    rest = regex.sub(r'"[^"]*"', " ", text)
    prefixes = [w.lower() for w in regex.findall(rf"({WORD})\*", rest)]
    terms = query_words(regex.sub(rf"{WORD}\*", " ", rest))
    if not (phrases or prefixes or terms):
        return match_substring(corpus, text).withColumn("score", F.lit(0.0)).orderBy("id").limit(limit)
    if terms and not (phrases or prefixes):
        return rank(query_postings(corpus, terms), corpus_facts(corpus), len(terms), limit)
    found = corpus
    for phrase in phrases:
        found = found.join(match_phrase(corpus, phrase), "id", "left_semi")
    if prefixes:
        found = found.join(match_prefix(corpus, prefixes), "id", "left_semi")
    if terms:
        found = found.join(match_all(query_postings(corpus, terms), len(terms)), "id", "left_semi")
    return found.select("id", F.lit(0.0).alias("score")).orderBy("id").limit(limit)


def search_features_text(features: DataFrame, text: str, limit: int = HITS) -> DataFrame:
    """Feature rows for a search text; what cannot be read as one is looked for inside feature names."""
    if text.count('"') % 2 or not query_words(text):
        named = features.filter(F.lower("feature_name").contains(text.lower()) & (F.col("feature_type") != "noise"))
        return named.withColumn("score", F.lit(0.0)).orderBy("map_name", "feature_type", "feature_name", "id").limit(limit)
    return features.join(F.broadcast(search(feature_corpus(features), text, limit)), "id")  # at most ``limit`` rows
