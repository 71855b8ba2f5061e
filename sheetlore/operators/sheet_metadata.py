"""Facts that a map file's name carries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheetlore.functions.names import file_stem
from sheetlore.functions.texts import stripped

# The catalogue's file name form and the south-west corner of known blocks.
SHEET_FILE = r"(?i)^(\d{1,3})\s+([A-HJ-P])\](\d{1,2})\s+([^(]+?)\s*\((\d{4})\)(.*)"
DISTRICT_WORDS = r"(?i)\s+(Districts?|Dist\.?|Pargana|Parganas)$"
BLOCK_CORNERS = {
    "45": (21, 73), "46": (21, 74), "47": (21, 75), "48": (21, 76), "49": (21, 77), "50": (21, 78), "51": (21, 79),
    "52": (21, 80), "53": (21, 81), "54": (21, 82), "55": (22, 73), "56": (22, 74), "57": (22, 75), "58": (22, 76),
    "63": (23, 73), "64": (23, 74), "65": (23, 75), "66": (23, 76), "72": (23, 86), "73": (23, 87), "74": (23, 88),
    "75": (23, 89), "76": (23, 90), "83": (24, 86), "84": (24, 87), "85": (24, 88), "86": (24, 89), "87": (25, 68),
    "88": (25, 69), "89": (25, 73), "90": (25, 74),
}
SHEET_LETTERS = "ABCDEFGHJKLMNOP"
FIRST_METRIC_YEAR = 1960
ONE_INCH_SCALE, METRIC_SCALE = 63360, 50000
CELL_DEGREES = 0.25
NOTES = (
    (r"(?i)\bBW\b", "Black & White scan"),
    (r"(?i)Prelim", "Preliminary edition"),
    ("@", "Partial/damaged sheet"),
    (r"35\s*[Mm][Mm]", "35mm film scan"),
)


def clean_district(raw: Column) -> Column:
    """District name without the word for it and without a dangling ``&`` or comma."""
    named = stripped(F.regexp_replace(stripped(raw), DISTRICT_WORDS, ""))
    return stripped(F.regexp_replace(F.regexp_replace(named, "&+$", ""), ",+$", ""))


def quality_notes(suffix: Column) -> Column:
    found = F.array_compact(F.array(*[F.when(suffix.rlike(pattern), text) for pattern, text in NOTES]))
    return F.array_join(found, "; ")


def _corner(block: Column, index: int) -> Column:
    table = F.create_map(*[F.lit(x) for key, corner in BLOCK_CORNERS.items() for x in (key, corner[index])])
    return F.try_element_at(table, block)


def file_facts(files: DataFrame, path: str = "path") -> DataFrame:
    """Block, letter, number, district, year, scale and notes of each file name."""
    stem = file_stem(F.col(path))

    def part(group: int) -> Column:
        return F.regexp_extract("raw_name", SHEET_FILE, group)

    parsed = files.withColumn("raw_name", stem).withColumn("matches", F.col("raw_name").rlike(SHEET_FILE))
    year = part(5).try_cast("int")
    ref = F.concat(part(1), F.upper(part(2)), F.lit("/"), F.lpad(part(3).try_cast("int").cast("string"), 2, "0"))

    def known(value: Column) -> Column:
        return F.when(F.col("matches"), value)

    return parsed.withColumns(
        {
            "block": known(part(1)),
            "sheet_letter": known(F.upper(part(2))),
            "sheet_num": known(part(3).try_cast("int")),
            "sheet_ref": F.when(F.col("matches"), ref).otherwise(F.col("raw_name")),
            "district": F.when(F.col("matches"), clean_district(part(4))).otherwise(""),
            "year": known(year),
            "scale_guess": F.when(F.col("matches") & (year < FIRST_METRIC_YEAR), ONE_INCH_SCALE).otherwise(METRIC_SCALE),
            "notes": F.when(F.col("matches"), quality_notes(stripped(part(6)))).otherwise(""),
            "approx_lat": known(_corner(part(1), 0)),
            "approx_lon": known(_corner(part(1), 1)),
        }
    ).drop("matches")


def sheet_box(facts: DataFrame) -> DataFrame:
    """Quarter-degree box of ``(block, sheet_letter, sheet_num)``; NULL for unknown blocks."""
    letter_no = F.instr(F.lit(SHEET_LETTERS), F.col("sheet_letter")) - 1
    lat, lon = _corner(F.col("block"), 0), _corner(F.col("block"), 1)
    sub = F.col("sheet_num") - 1
    east = (letter_no % 4) * 4 + sub % 4
    south = F.floor(letter_no / 4) * 4 + F.floor(sub / 4)
    known = lat.isNotNull() & (letter_no >= 0)
    lat_max = (lat + F.lit(1.0)) - south * F.lit(CELL_DEGREES)
    lon_min = lon + east * F.lit(CELL_DEGREES)
    return facts.withColumns(
        {
            "lat_min": F.when(known, F.round(lat_max - CELL_DEGREES, 4)), "lat_max": F.when(known, F.round(lat_max, 4)),
            "lon_min": F.when(known, F.round(lon_min, 4)), "lon_max": F.when(known, F.round(lon_min + CELL_DEGREES, 4)),
        }
    )


def short_name(facts: DataFrame) -> DataFrame:
    """``72P_16_1924`` for names that could be read, the file stem for others."""
    read = F.col("year").isNotNull() & (F.col("sheet_ref") != F.col("raw_name"))
    name = F.concat(F.replace("sheet_ref", F.lit("/"), F.lit("_")), F.lit("_"), F.col("year").cast("string"))
    return facts.withColumn("short_name", F.when(read, name).otherwise(F.col("raw_name")))
