"""Numbers and labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gaugework.functions.safe import col_of, nan_to_null

# Fixed value: text that counts as a number.
NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def to_number(value: str | Column) -> Column:
    """Text → double; anything that is not a plain decimal number → null."""
    text = F.trim(col_of(value).cast("string"))
    return nan_to_null(F.when(text.rlike(NUMBER), text.try_cast("double")))


def label(value: str | Column) -> Column:
    """Upper-case display name of a measure."""
    return F.upper(col_of(value))


def display(value: str | Column, digits: int = 2) -> Column:
    """Fixed-point text without thousands separators."""
    return F.format_string(f"%.{int(digits)}f", col_of(value))
