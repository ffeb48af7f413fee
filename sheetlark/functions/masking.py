"""Masking of values: shown short by default, in full only on request."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STARS = "****"


def mask(value: Column) -> Column:
    """First two characters and four stars; values of two characters or fewer are stars alone. Null stays null."""
    return F.when(F.length(value) <= 2, F.lit(STARS)).otherwise(F.concat(F.left(value, F.lit(2)), F.lit(STARS)))


def reveal(findings: DataFrame, raw: bool = False) -> DataFrame:
    """Drop the real values unless they are asked for."""
    return findings if raw else findings.drop("raw")
