"""Column expressions that read sheet number, place and year from a map's name."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sheetlore.functions.texts import stripped

# The two spellings of a map name.
DASHED_NAME = r"^(\d+)-([A-Z]+)-(\d+)-(.+?)-(\d{4})-"
NUMBERED_NAME = r"^(\d+\s+[A-Z]+(?:[/\]]\d+)?)"
YEAR_IN_PARENTHESES = r"\((\d{4})\)"


def _group(column: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract(column, pattern, group)


def split_map_name(column: Column) -> dict[str, Column]:
    """Columns ``map_number``, ``sheet_name`` and ``year`` of a map name."""
    name = stripped(column)
    dashed = name.rlike(DASHED_NAME)
    number = _group(name, NUMBERED_NAME, 1)
    rest = stripped(F.regexp_replace(column, r"^\s*\d+\s+[A-Z]+(?:[/\]]\d+)?", ""))
    rest = stripped(F.regexp_replace(rest, r"(?s)\s*\(\d{4}\).*$", ""))
    rest = stripped(F.regexp_replace(rest, r"\s*\(\d+\)\s*$", ""))
    return {
        "map_number": F.when(
            dashed,
            F.concat(
                _group(name, DASHED_NAME, 1), F.lit(" "), _group(name, DASHED_NAME, 2), F.lit("/"),
                _group(name, DASHED_NAME, 3),
            ),
        ).otherwise(stripped(F.replace(number, F.lit("]"), F.lit("/")))),
        "sheet_name": F.when(dashed, _group(name, DASHED_NAME, 4)).otherwise(rest),
        "year": F.when(dashed, _group(name, DASHED_NAME, 5)).otherwise(_group(column, YEAR_IN_PARENTHESES, 1)),
    }


def file_stem(path: Column) -> Column:
    """Last path element without its final extension."""
    return F.regexp_replace(F.regexp_extract(path, r"([^/\\]*)$", 1), r"(?<=.)\.[^.]*$", "")
