"""Text expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: every character that counts as white space at the ends of a text.
WHITE_SPACE = "".join(
    map(chr, (*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))
)


def stripped(text: str | Column) -> Column:
    """Text without white space of any kind at its ends."""
    return F.btrim(F.col(text) if isinstance(text, str) else text, F.lit(WHITE_SPACE))
