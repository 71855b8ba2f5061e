"""Sheet number from the tokens in the upper right corner.

Each step reduces a map to one row by a partial aggregate before the next join, so that no
join pairs many rows of a map with many others; the one search that could do so (numbers and
the letters beside them) meets in bands of 64 pixels.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheetlore.functions.texts import stripped
from sheetlore.operators.numbering import number_rows
from sheetlore.session import cut_lineage

# Corner zone, patterns and distances.
ZONE_LEFT, ZONE_BOTTOM = 0.55, 0.30
LABELLED_NUMBER = r"(?i)No\.?\s*(\d{1,3})\s+([A-HJ-P])\s*(?:[/\\](\d{1,2}))?"
BARE_NUMBER = r"(?i)^(\d{1,3})\s+([A-HJ-P])\s*(?:[/\\](\d{1,2}))?$"
ANCHOR = r"(?i)^No\.?$"
NUMBER, LETTER, SUB_NUMBER = r"^\d{1,3}$", r"(?i)^[A-HJ-P]$", r"^\d{1,2}$"
SAME_HEIGHT, FARTHEST_RIGHT = 1.5, 15
BAND = 64
#: Tokens of a corner that are joined into one row.
ZONE_TOKENS = 64


def corner_tokens(tokens: DataFrame, maps: DataFrame) -> DataFrame:
    """Tokens whose middle lies in the upper right corner, with middle and height."""
    sized = tokens.join(maps.select("map_name", "width", "height"), "map_name")
    cx, cy = (F.col("x1") + F.col("x2")) / 2, (F.col("y1") + F.col("y2")) / 2
    return sized.filter((cx >= F.col("width") * ZONE_LEFT) & (cy <= F.col("height") * ZONE_BOTTOM)).select(
        "map_name", "seq", stripped("text").alias("text"), "x1", "y1", "x2", "y2", cx.alias("cx"), cy.alias("cy"),
        F.greatest(F.col("y2") - F.col("y1"), F.lit(1)).alias("h"),
    )


def single_token(corner: DataFrame) -> DataFrame:
    """First token of a map that holds block and letter: ``block, letter, sub`` and its box."""
    labelled = F.col("text").rlike(LABELLED_NUMBER)
    bare = F.col("text").rlike(BARE_NUMBER)

    def part(group: int) -> Column:
        return F.when(labelled, F.regexp_extract("text", LABELLED_NUMBER, group)).otherwise(F.regexp_extract("text", BARE_NUMBER, group))

    hits = corner.filter(labelled | bare).select(
        "map_name", "seq", part(1).alias("block"), F.upper(part(2)).alias("letter"), part(3).alias("sub"), "y1", "y2", "cx", "h"
    )
    first = F.min(F.struct("seq", "block", "letter", "sub", "y1", "y2", "cx", "h")).alias("first")
    return hits.groupBy("map_name").agg(first).select("map_name", "first.*")


def sub_number_below(references: DataFrame, corner: DataFrame) -> DataFrame:
    """First one- or two-digit token under the reference token of each map.

    ``references`` has one row per map: ``y1, y2, cx, h`` of the token and ``block`` to skip.
    """
    digits = corner.filter(F.col("text").rlike(SUB_NUMBER)).select(
        "map_name", F.col("seq").alias("d_seq"), F.col("text").alias("d_text"), F.col("cx").alias("d_cx"), F.col("cy").alias("d_cy")
    )
    near = (
        (F.col("d_text") != F.col("block")) & (F.abs(F.col("d_cx") - F.col("cx")) < F.col("h") * 3)
        & (F.col("d_cy") >= F.col("y1") + F.col("h") * 0.5) & (F.col("d_cy") <= F.col("y2") + F.col("h") * 5)
    )
    joined = digits.join(references.select("map_name", "block", "y1", "y2", "cx", "h"), "map_name").filter(near)
    return joined.groupBy("map_name").agg(F.min(F.struct("d_seq", "d_text")).alias("first")).select(
        "map_name", F.col("first.d_text").alias("sub_below")
    )


def _beside(left: str, right: str) -> Column:
    """Middle of ``right`` lies to the right of ``left`` at a similar height, not too far away."""
    return (
        (F.col(f"{right}.cx") > F.col(f"{left}.cx"))
        & (F.abs(F.col(f"{right}.cy") - F.col(f"{left}.cy")) < F.col(f"{left}.h") * SAME_HEIGHT)
        & (F.col(f"{right}.cx") - F.col(f"{left}.cx") < F.col(f"{left}.h") * FARTHEST_RIGHT)
    )


def number_tokens(corner: DataFrame) -> DataFrame:
    """Numbers that may be the block: right of the "No." token where there is one."""
    anchors = corner.filter(F.col("text").rlike(ANCHOR)).groupBy("map_name").agg(
        F.min(F.struct("seq", "cx", "cy", "h")).alias("a")
    ).select("map_name", F.struct("a.cx", "a.cy", "a.h").alias("anchor"))
    numbers = corner.filter(F.col("text").rlike(NUMBER)).alias("n")
    joined = numbers.join(anchors, "map_name", "left")
    beside = (
        (F.col("n.cx") > F.col("anchor.cx")) & (F.abs(F.col("n.cy") - F.col("anchor.cy")) < F.col("anchor.h") * SAME_HEIGHT)
        & (F.col("n.cx") - F.col("anchor.cx") < F.col("anchor.h") * FARTHEST_RIGHT)
    )
    return joined.filter(F.col("anchor").isNull() | beside).select("map_name", "n.seq", "n.text", "n.y1", "n.y2", "n.cx", "n.cy", "n.h")


def many_tokens(corner: DataFrame) -> DataFrame:
    """Block from a number, letter from the nearest letter to its right.

    The corner is used in many places below, so pass a written copy of it (``cut_lineage``).
    """
    letters = corner.filter(F.col("text").rlike(LETTER))
    reach = F.col("h") * SAME_HEIGHT
    banded_numbers = number_tokens(corner).select(
        "*", F.explode(F.sequence(F.floor((F.col("cy") - reach) / BAND), F.floor((F.col("cy") + reach) / BAND))).alias("band")
    )
    banded_letters = letters.select("map_name", "cx", "cy", F.floor(F.col("cy") / BAND).alias("band")).distinct()
    paired = banded_numbers.alias("n").join(
        banded_letters.alias("l"),
        (F.col("n.map_name") == F.col("l.map_name")) & (F.col("n.band") == F.col("l.band")) & _beside("n", "l"),
        "left_semi",
    )
    number = paired.groupBy("map_name").agg(F.min(F.struct("cx", "seq", "cy", "h", "text", "y1", "y2")).alias("pick")).select("map_name", "pick.*")
    nearest = (
        letters.alias("l").join(number.alias("n"), (F.col("n.map_name") == F.col("l.map_name")) & _beside("n", "l"))
        .groupBy(F.col("n.map_name").alias("map_name"))
        .agg(F.min(F.struct("l.cx", "l.seq", F.upper("l.text").alias("letter"), "l.y1", "l.y2", "l.h")).alias("letter_token"))
    )
    pair = number.select("map_name", F.col("text").alias("block"), F.struct("y1", "y2", "cx", "h").alias("number_token")).join(nearest, "map_name")
    below_letter = sub_number_below(pair.select("map_name", "block", "letter_token.y1", "letter_token.y2", "letter_token.cx", "letter_token.h"), corner)
    below_number = sub_number_below(pair.select("map_name", "block", "number_token.y1", "number_token.y2", "number_token.cx", "number_token.h"), corner)
    return (
        pair.join(below_letter, "map_name", "left").join(below_number.withColumnRenamed("sub_below", "sub_number"), "map_name", "left")
        .select("map_name", "block", F.col("letter_token.letter").alias("letter"), F.coalesce("sub_below", "sub_number").alias("sub"))
    )


def _spelled() -> Column:
    sub = F.nullif(F.col("sub"), F.lit(""))
    base = F.concat("block", F.lit(" "), "letter")
    return F.when(sub.isNotNull(), F.concat(base, F.lit("/"), sub)).otherwise(base)


def single_token_numbers(corner: DataFrame) -> DataFrame:
    one = single_token(corner)
    below = sub_number_below(one, corner)
    joined = one.join(below, "map_name", "left").withColumn("sub", F.coalesce(F.nullif("sub", F.lit("")), "sub_below"))
    return joined.select("map_name", _spelled().alias("sheet_number"))


def many_token_numbers(corner: DataFrame) -> DataFrame:
    return many_tokens(corner).select("map_name", _spelled().alias("sheet_number"))


def sheet_numbers(tokens: DataFrame, maps: DataFrame) -> DataFrame:
    """Sheet number of every map in ``maps``: one token, else several tokens, else ''."""
    corner = cut_lineage(corner_tokens(tokens, maps))
    single = single_token_numbers(corner).withColumnRenamed("sheet_number", "single")
    joined = maps.select("map_name").join(single, "map_name", "left").join(many_token_numbers(corner), "map_name", "left")
    return joined.select("map_name", F.coalesce("single", "sheet_number", F.lit("")).alias("sheet_number"))


def zone_listing(corner: DataFrame) -> DataFrame:
    return corner.select("map_name", "seq", "text", "cx", "cy").orderBy("map_name", "cx", "seq")


def zone_lines(corner: DataFrame, size: int = ZONE_TOKENS) -> DataFrame:
    """``(map_name, part, line)``: zone tokens of a map from left to right, ``size`` of them in a row."""
    numbered = number_rows(corner, ["map_name"], F.floor(F.col("cx") / 16), ["cx", "seq"])
    part = F.floor((F.col("row_no") - 1) / size)
    words = F.array_sort(F.collect_list(F.struct("row_no", "text")))
    return numbered.groupBy("map_name", part.alias("part")).agg(F.array_join(F.transform(words, lambda w: w["text"]), " ").alias("line"))
