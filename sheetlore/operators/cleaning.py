"""Cleaning, classification, votes and spelling of labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheetlore.functions.texts import stripped
from sheetlore.operators.detections import batches
from sheetlore.session import small_side

# ---- requests and responses --------------------------------------------------------------

ITEM_SCHEMA = "array<struct<original:string,cleaned:string,feature_type:string,confidence:double>>"


def request_batches(detections: DataFrame, size: int = 40) -> DataFrame:
    """Numbered label list per map and batch; a list holds at most ``size`` labels."""
    placed = batches(detections, size)
    lines = F.transform(
        F.array_sort(F.collect_list(F.struct("item", "text"))),
        lambda row: F.concat(row["item"].cast("string"), F.lit(". "), row["text"]),
    )
    return placed.groupBy("map_name", "batch").agg(F.array_join(lines, "\n").alias("labels"))


def response_items(responses: DataFrame, payload: str = "payload") -> DataFrame:
    """Items of a JSON list, with or without a code fence; any other payload has no items."""
    text = stripped(F.regexp_replace(F.col(payload), r"^\s+|\s+$", ""))
    unfenced = F.regexp_replace(F.regexp_replace(text, r"^```[^\n]*\n", ""), r"\s*```\s*$", "")
    body = stripped(F.when(text.startswith("```"), unfenced).otherwise(text))
    items = F.when(body.startswith("["), F.from_json(body, ITEM_SCHEMA))
    keep = [c for c in responses.columns if c != payload]
    return responses.select(*keep, F.inline(items))


# ---- rule classifier ---------------------------------------------------------------------

# Label patterns and words of each class, in the order they are tried; all are
# matched against lower-cased labels.
NOISE_PATTERNS = (
    r"^\d+$", r"^\d+\.\d+$", r"^[a-z]$", r"^[a-z]\d+$", r"^\d+[a-z]$", r"^(n|s|e|w|ne|nw|se|sw)$",
    r"^\d+:\d+", r"^(miles?|feet?|km|metres?|ft|m)$", r"^[^\p{L}\p{N}]+$",
)
RIVER_WORDS = (
    "nadi", "nala", "nallah", "nullah", "river", r"r\.", "stream", "khad", "jharna", "torrent", "sone", "koel",
    "north koel", "south koel",
)
LAKE_WORDS = ("lake", "jheel", "jhil", "tal", "tank", "sagar", "samudra", "dam", "reservoir")
MOUNTAIN_WORDS = (
    "hill", "hills", "peak", r"mt\.", "mount", "pahar", "pahad", "ghati", "ghat", "range", "ridge", "escarpment",
)
FOREST_WORDS = ("forest", "rf", "reserved", "jungle", "van", "wildlife", "sanctuary")
ROAD_WORDS = ("road", "nh", "sh", "track", "path", "railway", "station", "junction")
SETTLEMENT_ENDINGS = (
    "pur", "pura", "nagar", "puram", "ganj", "gunj", "gaon", "gon", "bad", "abad", "garh", "kot", "kota", "wara",
    "wali", "ward", "tola", "toli", "khurd", "kalan", "buzurg", "dihi", "dih", "bazar", "basti", "mohalla", "patti",
    "khera", "kheri",
)
RULE_CONFIDENCE = {
    "noise": 0.95, "short": 0.9, "water": 0.80, "road": 0.75, "ending": 0.72, "capital": 0.55, "unknown": 0.40,
}


def _any_word(words: tuple[str, ...]) -> str:
    return rf"(?U)\b(?:{'|'.join(words)})\b"


def classify(df: DataFrame, column: str = "text") -> DataFrame:
    """Add ``cleaned``, ``feature_type`` and ``confidence`` by the first rule that fits.

    Wording and verdict come out of generators: a later filter on them is then not copied into
    the plan below, where it would run all rules once more.
    """
    wording = F.struct(stripped(F.col(column)).alias("_cleaned"), F.lower(stripped(F.col(column))).alias("_low"))
    worded = df.select("*", F.inline(F.array(wording)))
    cleaned, low = F.col("_cleaned"), F.col("_low")
    # The ending must follow at least two characters of the word, leading punctuation aside.
    ending = low.rlike(rf"(?s)^[^\p{{L}}\p{{N}}_]*+.{{2,}}(?:{'|'.join(SETTLEMENT_ENDINGS)})\z")
    capital = cleaned.rlike(r"^\p{Lu}") & (F.length(cleaned) >= 4) & F.replace(cleaned, F.lit(" "), F.lit("")).rlike(r"^\p{L}+$")
    rules = [
        (low.rlike("|".join(NOISE_PATTERNS)), "noise", "noise"),
        (F.length(low) <= 1, "noise", "short"),
        (low.rlike(_any_word(RIVER_WORDS)), "river", "water"),
        (low.rlike(_any_word(LAKE_WORDS)), "lake", "water"),
        (low.rlike(_any_word(MOUNTAIN_WORDS)), "mountain", "water"),
        (low.rlike(_any_word(FOREST_WORDS)), "forest", "water"),
        (low.rlike(_any_word(ROAD_WORDS)), "road", "road"),
        (ending, "settlement", "ending"),
        (capital, "settlement", "capital"),
    ]
    verdict = F.struct(F.lit("unknown").alias("feature_type"), F.lit(RULE_CONFIDENCE["unknown"]).alias("confidence"))
    choice = None
    for test, kind, level in rules:
        value = F.struct(F.lit(kind).alias("feature_type"), F.lit(RULE_CONFIDENCE[level]).alias("confidence"))
        choice = F.when(test, value) if choice is None else choice.when(test, value)
    kept = [c for c in df.columns if c not in ("cleaned", "feature_type", "confidence")]
    return worded.select(*kept, cleaned.alias("cleaned"), F.inline(F.array(choice.otherwise(verdict))))


def type_histogram(df: DataFrame) -> DataFrame:
    return df.groupBy("feature_type").agg(F.count("*").alias("n"))


def pass_through(texts: DataFrame, results: DataFrame, key: str, text: str = "original") -> DataFrame:
    """Results per text; a text without one keeps its wording, unclassified at 0.5."""
    return texts.join(results, key, "left").withColumns(
        {
            "cleaned": F.coalesce("cleaned", text),
            "feature_type": F.coalesce("feature_type", F.lit("unknown")),
            "confidence": F.coalesce("confidence", F.lit(0.5)),
        }
    )


# ---- votes -------------------------------------------------------------------------------


def union_providers(results: list[DataFrame]) -> DataFrame:
    """Result sets of several providers as one table; a failed provider adds nothing."""
    union = results[0]
    for other in results[1:]:
        union = union.unionByName(other)
    return union


def vote(items: DataFrame) -> DataFrame:
    """One row per trimmed original: most frequent wording and type, consensus confidence.

    Ties go to the value named first (by provider, then item). All counting is by partial
    aggregation, so an original that many rows share costs one row per task.
    """
    original = stripped("original")
    votes = (
        items.withColumns({"original": original, "units": F.round(F.coalesce("confidence", F.lit(0.5)) * 10000).cast("bigint")})
        .filter(F.col("original") != "")
        .withColumns({"cleaned": F.coalesce("cleaned", "original"), "feature_type": F.coalesce("feature_type", F.lit("unknown"))})
        .groupBy("original", "cleaned", "feature_type")
        .agg(
            F.count("*").alias("n"), F.sum("units").alias("units"),
            F.min(F.struct("provider_no", "item_no")).alias("first"),
        )
    )

    def ballots(value: str) -> DataFrame:
        counted = votes.groupBy("original", value).agg(F.sum("n").alias("n"), F.min("first").alias("first"), F.sum("units").alias("units"))
        best = F.struct((-F.col("n")).alias("n"), "first", F.col(value).alias("value"))
        return counted.groupBy("original").agg(F.min(best).alias("best"), F.sum("n").alias("total"), F.sum("units").alias("units"))

    wording = ballots("cleaned").select("original", F.col("best.value").alias("cleaned"))
    kinds = ballots("feature_type").select(
        "original", F.col("best.value").alias("feature_type"), (-F.col("best.n")).alias("top"), "total", "units"
    )
    agreement = F.col("top") / F.col("total")
    mean = F.col("units") / F.col("total") / 10000
    return kinds.join(wording, "original").select(
        "original", "cleaned", "feature_type",
        F.round(F.least(F.lit(0.99), mean * (0.70 + 0.30 * agreement)), 4).alias("confidence"),
        F.col("total").alias("llm_count"), F.round(agreement, 3).alias("agreement"),
    )


def feature_counts(voted: DataFrame) -> DataFrame:
    noise = F.col("feature_type") == "noise"
    return voted.agg(F.count_if(~noise).alias("features"), F.count_if(noise).alias("noise"))


def high_agreement(voted: DataFrame, minimum: float = 0.75) -> DataFrame:
    return voted.agg(F.count_if(F.coalesce("agreement", F.lit(1.0)) >= minimum).alias("agreed"), F.count("*").alias("n"))


def drop_noise(voted: DataFrame) -> DataFrame:
    return voted.filter(~F.col("feature_type").eqNullSafe("noise"))


# ---- spelling ----------------------------------------------------------------------------


def flatten_spelling(files: DataFrame, payload: str = "payload", order: str = "file_no") -> DataFrame:
    """``(variant, canonical)`` from nested sections; ``meta`` is skipped and the last entry wins."""
    sections = F.from_json(payload, "map<string,map<string,string>>")
    entries = files.select(order, F.posexplode(sections).alias("section_no", "section", "entries")).filter(F.col("section") != "meta")
    pairs = entries.select(order, "section_no", F.posexplode("entries").alias("entry_no", "variant", "canonical"))
    last = F.max(F.struct(order, "section_no", "entry_no", "canonical")).alias("last")
    return pairs.groupBy(F.lower("variant").alias("variant")).agg(last).select("variant", F.col("last.canonical").alias("canonical"))


def lookup(df: DataFrame, column: str, dictionary: DataFrame) -> DataFrame:
    """Add ``canonical`` for the trimmed, lower-cased text, NULL where the dictionary has none."""
    keyed = df.withColumn("_key", F.lower(stripped(column)))
    return keyed.join(dictionary.withColumnRenamed("variant", "_key"), "_key", "left").drop("_key")


def like_initial(text: Column, replacement: Column) -> Column:
    raised = F.concat(F.upper(F.substring(replacement, 1, 1)), F.substr(replacement, F.lit(2)))
    return F.when(text.rlike(r"^\p{Lu}"), raised).otherwise(replacement)


def normalise_spelling(df: DataFrame, column: str, dictionary: DataFrame) -> DataFrame:
    """Replace historical spellings once, as a whole text or else word by word.

    ``column`` gets the new text and ``spelling_source`` the old one where it changed. The
    text is cut into word and non-word runs; words meet the dictionary in an equi-join, and the
    runs of one text are put together again in their order.
    """
    dictionary = small_side(dictionary)
    whole = lookup(df, column, dictionary)
    whole = whole.withColumn("_whole", F.when(F.col("canonical").isNotNull(), like_initial(F.col(column), F.col("canonical")))).drop("canonical")
    runs = F.regexp_extract_all(F.col(column), F.lit(r"([A-Za-z']+|[^A-Za-z']+)"), F.lit(1))
    pieces = (
        whole.filter(F.col("_whole").isNull())
        .select(column).distinct()
        .select(F.col(column).alias("_text"), F.posexplode(runs).alias("_no", "_run"))
    )
    matched = pieces.join(
        dictionary.select(F.col("variant").alias("_variant"), "canonical"), F.lower("_run") == F.col("_variant"), "left"
    )
    new_run = F.when(F.col("canonical").isNotNull(), like_initial(F.col("_run"), F.col("canonical"))).otherwise(F.col("_run"))
    rebuilt = matched.groupBy("_text").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_no", new_run.alias("run")))), lambda r: r["run"]), "").alias("_words")
    )
    joined = whole.join(rebuilt, F.col(column) == F.col("_text"), "left")
    fixed = F.coalesce("_whole", "_words", column)
    return joined.withColumns(
        {"_fixed": fixed, "spelling_source": F.when(fixed != F.col(column), F.col(column))}
    ).withColumn(column, F.col("_fixed")).select(*df.columns, "spelling_source")
