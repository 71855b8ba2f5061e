"""Country of a sheet by rules over its texts.

Texts of a map are never joined into one string. They are put into short overlapping
stretches, each stretch is tested against all rules, and the hits are combined per map, so a
rule still meets words that run over from one text to the next.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheetlore.functions.country_rules import COUNTRY_RULES, SHEET_NUMBER
from sheetlore.session import ship_package

SHEET_BONUS, SHEET_COUNTRY = 10, "india"
LEAST_SCORE = 3
IMAGE_TRUST, IMAGE_DOUBT = 0.7, 0.4
STRETCH = 32


def words_spanned(rules=COUNTRY_RULES) -> int:
    """Most texts that a match of one of the rules can touch: the words of the longest pattern.

    A pattern that can match text of any length has no such bound and is refused.
    """
    patterns = [pattern for pattern, *_ in rules]
    for pattern in patterns:
        if re.search(r"(?<!\\)[*+]|\{\d+,\}", pattern):
            raise ValueError(f"the rule {pattern!r} may match texts of any length")
    return max([len(re.split(r"\\s|\s", pattern)) for pattern in [*patterns, SHEET_NUMBER]])


def map_documents(texts: DataFrame, size: int = STRETCH) -> DataFrame:
    """``(map_name, part, document)``: the texts of a map in order, ``size`` of them in a row.

    ``seq`` numbers the texts of a map; the parts of a map, one after another, are its document.
    """
    words = F.array_sort(F.collect_list(F.struct("seq", "text")))
    parts = texts.groupBy("map_name", F.floor(F.col("seq") / size).alias("part"))
    return parts.agg(F.array_join(F.transform(words, lambda w: w["text"]), " ").alias("document"))


def stretches(texts: DataFrame, rules=COUNTRY_RULES, size: int = STRETCH) -> DataFrame:
    """``(map_name, stretch, document)`` of ``size`` texts plus the first few of the next.

    ``seq`` numbers the texts of a map without gaps. The overlap is taken from the longest rule,
    so every match lies within one stretch, and no group holds more than ``size + overlap`` texts.
    """
    overlap = words_spanned(rules) - 1
    size = max(size, overlap)
    own = F.floor(F.col("seq") / size)
    also = F.when((F.col("seq") % size < overlap) & (own > 0), F.array(own, own - 1)).otherwise(F.array(own))
    placed = texts.select("map_name", "seq", "text", F.explode(also).alias("stretch"))
    words = F.array_sort(F.collect_list(F.struct("seq", "text")))
    return placed.groupBy("map_name", "stretch").agg(
        F.array_join(F.transform(words, lambda w: w["text"]), " ").alias("document")
    )


def literal_of(pattern: str, whole_word: bool) -> str | None:
    """The plain text that a rule looks for, if it is no regular expression."""
    if whole_word:
        return pattern
    return re.sub(r"\\(.)", r"\1", pattern) if re.fullmatch(r"(?:[^\\.^$*+?()\[\]{}|]|\\.)+", pattern) else None


def _matcher(literals: list[tuple[int, str, bool]]):
    """Rows (map_name, rule_no) of a batch of documents, by one automaton over all plain texts."""

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = ahocorasick.Automaton()
        by_text: dict[str, list[tuple[int, bool]]] = {}
        for no, text, whole in literals:
            by_text.setdefault(text, []).append((no, whole))
        for text, rules in by_text.items():
            automaton.add_word(text, (len(text), rules))
        automaton.make_automaton()
        for batch in batches:
            at, found = [], []
            for row, (low, others) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                hits = set(others)
                for end, (length, rules) in automaton.iter(low) if by_text and low else ():
                    alone = None
                    for no, whole in rules:
                        if no not in hits:
                            if whole and alone is None:
                                alone = not (_in_word(low, end - length) or _in_word(low, end + 1))
                            if not whole or alone:
                                hits.add(no)
                at += [row] * len(hits)
                found += hits
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(found, pa.int32())], ["map_name", "rule_no"])

    return match


def _in_word(text: str, at: int) -> bool:
    return 0 <= at < len(text) and (text[at].isalnum() or text[at] == "_")


def rule_hits(documents: DataFrame, rules=COUNTRY_RULES) -> DataFrame:
    """``(map_name, rule_no)`` for every rule some document of the map fulfils; -1 stands for a sheet number.

    All plain texts are looked for in one pass over a document, by an automaton that each task builds
    from the rules, so the cost of a text does not grow with their number. Only rules that are regular
    expressions are tested one by one.
    """
    ship_package(documents.sparkSession)
    low = documents.withColumn("_low", F.lower("document"))
    literals = [(no, text, whole) for no, (pattern, _, _, whole) in enumerate(rules) if (text := literal_of(pattern, whole)) is not None]
    rest = [F.when(F.col("_low").rlike(pattern), F.lit(no)) for no, (pattern, _, _, whole) in enumerate(rules) if literal_of(pattern, whole) is None]
    bonus = F.when(F.col("document").rlike(SHEET_NUMBER), F.lit(-1))
    tested = low.select("map_name", F.coalesce("_low", F.lit("")).alias("low"), F.array_compact(F.array(bonus, *rest)).alias("others"))
    kind = documents.schema["map_name"].dataType.simpleString()
    return tested.mapInArrow(_matcher(literals), f"map_name {kind}, rule_no int").distinct()


def country_scores(hits: DataFrame, rules=COUNTRY_RULES) -> DataFrame:
    """Points per map and country; a rule counts once, however often it hits."""
    countries = F.create_map(F.lit(-1), F.lit(SHEET_COUNTRY), *[F.lit(x) for no, rule in enumerate(rules) for x in (no, rule[1])])
    points = F.create_map(F.lit(-1), F.lit(SHEET_BONUS), *[F.lit(x) for no, rule in enumerate(rules) for x in (no, rule[2])])
    scored = hits.select("map_name", "rule_no", F.try_element_at(countries, "rule_no").alias("country"), F.try_element_at(points, "rule_no").alias("points"))
    return scored.groupBy("map_name", "country").agg(F.sum("points").alias("score"), F.min("rule_no").alias("first_rule"))


def winners(scores: DataFrame, maps: DataFrame, fallback: str = SHEET_COUNTRY) -> DataFrame:
    """Country with most points per map, from three points; ties go to the earlier rule."""
    best = scores.groupBy("map_name").agg(
        F.min(F.struct((-F.col("score")).alias("s"), "first_rule", "country")).alias("best")
    )
    sure = F.when(-F.col("best.s") >= LEAST_SCORE, F.col("best.country"))
    return maps.select("map_name").join(best, "map_name", "left").select("map_name", F.coalesce(sure, F.lit(fallback)).alias("country"))


def detect_countries(texts: DataFrame, rules=COUNTRY_RULES, fallback: str = SHEET_COUNTRY, with_map_name: bool = True) -> DataFrame:
    """Country of every map from its texts and its name."""
    documents = stretches(texts, rules)
    if with_map_name:
        named = F.concat("map_name", F.lit(" "), "document")
        documents = documents.withColumn("document", F.when(F.col("stretch") == 0, named).otherwise(F.col("document")))
    scores = country_scores(rule_hits(documents, rules), rules)
    return winners(scores, texts.select("map_name").distinct(), fallback)


def fuse_verdicts(text_verdicts: DataFrame, image_verdicts: DataFrame) -> DataFrame:
    """Image verdict from a confidence of 0.7, otherwise the text's; ``relation`` compares both."""
    joined = text_verdicts.join(image_verdicts, "map_name", "left")
    trusted = F.coalesce(F.col("image_confidence") >= IMAGE_TRUST, F.lit(False))
    relation = (
        F.when(F.col("image_country").isNull(), "text only")
        .when(trusted, "image")
        .when(F.col("image_country") == F.col("country"), "agree")
        .when(F.col("image_confidence") >= IMAGE_DOUBT, "conflict")
        .otherwise("text only")
    )
    return joined.select(
        "map_name", F.when(trusted, F.col("image_country")).otherwise(F.col("country")).alias("country"), relation.alias("relation")
    )


def request_texts(batches: DataFrame, map_countries: DataFrame, instructions: dict[str, str], default: str = "") -> DataFrame:
    """Instruction of the map's country put before each batch; one text per country is code-sized."""
    table = F.create_map(*[F.lit(x) for pair in instructions.items() for x in pair])
    joined = batches.join(map_countries, "map_name", "left")
    text = F.coalesce(F.try_element_at(table, "country"), F.lit(default))
    return joined.withColumn("request", F.concat(text, F.lit("\n\n"), "labels")).drop("labels")
