"""Filters, presets, search, sorting and pages over an enriched office table."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import checkpointed

#: Filter name to column; values are compared as they are, a null of the listed ones reads as a word.
EQUALITY = {
    "municipality": "municipality", "type": "corporation_type_label", "response_status": "response_status", "wage_band": "wage_band_label",
    "capacity_band": "capacity_band_label", "quadrant": "market_position_quadrant", "flag": "wage_outlier_flag", "activity": "primary_activity_type", "work_model": "work_model", "area": "area",
}
READS_AS = {"flag": "none", "activity": "unknown"}
# The fields that are searched, in order.
SEARCHED = (
    "office_no", "municipality", "area", "corporation_name", "representative_name", "representative_raw", "office_name", "corporation_type_label", "remarks", "dir_primary_activity_type",
    "dir_primary_activity_detail", "work_model", "dir_office_address_city", "dir_office_address_line", "dir_office_number", "address",
)
PRESETS = {
    "all": {}, "one city": {"municipality": "NATION_3"}, "high flag": {"flag": "high"}, "high wage, low use": {"quadrant": "high wage x low use"},
    "fix first": {"quadrant": "low wage x low use", "risk": "likely"}, "high wage, high use": {"quadrant": "high wage x high use"}, "shortage": {"risk": "likely"}, "unanswered": {"response_status": "unanswered"},
}


def searched(df: DataFrame) -> tuple[str, ...]:
    """Those of the searched fields that a table has."""
    return tuple(c for c in SEARCHED if c in df.columns)


def search_text(query: str, columns: tuple[str, ...] = SEARCHED) -> Column:
    """Whether the query occurs in the joined fields, whatever the case; nulls are left out."""
    return F.contains(F.lower(F.concat_ws(" ", *columns)), F.lower(F.lit(query.strip())))


def condition(filters: Mapping[str, object], columns: Mapping[str, str] = EQUALITY, search_in: tuple[str, ...] = SEARCHED) -> Column:
    """Conjunction of the given filters: equality by name, ``risk`` (likely / none), ``home_use`` and ``new`` (booleans), ``search``."""
    parts = []
    for name, value in filters.items():
        if value is None or value == "":
            continue
        if name == "search":
            parts.append(search_text(str(value), search_in))
        elif name == "risk":
            parts.append(F.col("shortage_risk") == F.lit(value == "likely"))
        elif name in ("home_use", "new"):
            parts.append(F.col("home_use_active" if name == "home_use" else "is_new_office") == F.lit(value))
        else:
            c = F.col(columns[name])
            parts.append((F.coalesce(c, F.lit(READS_AS[name])) if name in READS_AS else c) == F.lit(value))
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def filter_records(df: DataFrame, filters: Mapping[str, object]) -> DataFrame:
    return df.filter(condition(filters, search_in=searched(df)))


def preset_counts(df: DataFrame, presets: Mapping[str, Mapping] = PRESETS) -> DataFrame:
    """(preset, count) of all presets in one pass."""
    once = df.agg(*[F.count_if(F.coalesce(condition(p), F.lit(False))).alias(n) for n, p in presets.items()])
    return once.unpivot([], list(presets), "preset", "count")


def preset_of(filters: Mapping[str, object], presets: Mapping[str, Mapping] = PRESETS) -> str | None:
    given = {k: v for k, v in filters.items() if v not in (None, "")}
    return next((n for n, p in presets.items() if dict(p) == given), None)


RANKED_WORDS = {"high": 3, "low": 2, "matched": 2, "unmatched": 1}


def sort_keys(df: DataFrame, column: str, descending: bool = False, tie: str = "ordinal", collation: str | None = None) -> list[Column]:
    """Missing values last in both directions; booleans as 1 and 0; flags and match states by rank; text in the collation's order."""
    c, kind = F.col(column), dict(df.dtypes)[column]
    if kind == "boolean":
        c = c.cast("int")
    elif column.endswith(("_flag", "_status")) and kind == "string":
        c = reduce(lambda w, x: w.when(F.col(column) == x[0], x[1]), list(RANKED_WORDS.items())[1:], F.when(F.col(column) == "high", 3))
    elif kind == "string" and collation:
        c = F.collate(c, collation)
    return [c.desc_nulls_last() if descending else c.asc_nulls_last(), F.col(tie).asc()]


def sort_records(df: DataFrame, column: str, descending: bool = False, **how) -> DataFrame:
    return df.orderBy(*sort_keys(df, column, descending, **how))


#: Rows that are sorted together to find a page, about.
PAGE_RANGE_ROWS = 100_000


def page_ranges(df: DataFrame, keys: list[Column], rows: int, range_rows: int) -> tuple[DataFrame, dict[int, int]]:
    """``df`` dealt into ranges of the sort keys of about ``range_rows`` rows as ``_part``, and how many rows each range has."""
    dealt = checkpointed(df.repartitionByRange(-(-rows // range_rows), *keys).withColumn("_part", F.spark_partition_id()))
    return dealt, dict(dealt.groupBy("_part").agg(F.count("*")).orderBy("_part").collect())  # a row a range


def page_rows(df: DataFrame, keys: list[Column], page: int, size: int = 50, range_rows: int = PAGE_RANGE_ROWS) -> DataFrame:
    """A page of the sorted rows; page numbers outside the range mean its nearest end.

    A page far from the start is found by counting ranges of the keys, and only the ranges that it lies in are sorted.
    """
    rows = df.count()
    at = min(max(page, 1), max(1, -(-rows // size)))
    skip = (at - 1) * size
    if skip + size <= range_rows:
        return df.orderBy(*keys).offset(skip).limit(size)
    dealt, counts = page_ranges(df, keys, rows, range_rows)
    before, wanted, start = 0, [], 0
    for part, n in sorted(counts.items()):
        if before < skip + size and before + n > skip:
            start = start if wanted else before
            wanted.append(part)
        before += n
    return dealt.filter(F.col("_part").isin(wanted)).drop("_part").orderBy(*keys).offset(skip - start).limit(size)


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    return df.select(F.col(column).alias("value")).filter(F.col("value").isNotNull() & (F.col("value").cast("string") != "")).distinct().orderBy("value")
