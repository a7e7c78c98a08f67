"""Numbers out of loosely typed columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def coerce_numeric(value: Column, digits: int | None = None) -> Column:
    """The value as a double, rounded if ``digits`` is given; null where it is blank, no number, NaN or infinite."""
    number = F.nullif(F.trim(value.cast("string")), F.lit("")).try_cast("double")
    kept = F.when(~F.isnan(number) & (F.abs(number) < float("inf")), number)
    return kept if digits is None else F.round(kept, digits)


def coerce_key(value: Column) -> Column:
    """A key as trimmed text, null where it is blank."""
    return F.nullif(F.trim(value.cast("string")), F.lit(""))
