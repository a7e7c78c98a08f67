"""Derived columns and the profile of a table.

The definitions of bands, z-score and market quadrant are this library's own: sample deviation, percentile as the share of strictly smaller
values, band edges as their labels say, medians as thresholds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .stats import constant_fences, constant_median, outlier_class, quadrant_labels, quadrant_vs_median
from .summary import Statistic, Summary, summarize, valid

#: (upper end, label); the last has none.
WAGE_BANDS = ((10_000, "under 10k"), (15_000, "10k-15k"), (20_000, "15k-20k"), (30_000, "20k-30k"), (50_000, "30k-50k"), (None, "50k and more"))
CAPACITY_BANDS = ((11, "up to 10"), (21, "11-20"), (31, "21-30"), (41, "31-40"), (None, "41 and more"))
UTILISATION_BANDS = ((0.6, "under 60%"), (0.8, "60-80%"), (1.0, "80-100%"), (None, "100% and more"))
MARKET_QUADRANTS = ("high wage x high use", "high wage x low use", "low wage x high use", "low wage x low use")


def ratio(a: Column, b: Column) -> Column:
    """Quotient where the divisor is positive, else null."""
    return F.when(b > 0, a / b)


def band(value: Column, bands) -> Column:
    out = F.when(value.isNull(), None)
    for end, label in bands:
        out = out.otherwise(label) if end is None else out.when(value < end, label)
    return out


def column_missing_counts(df: DataFrame) -> DataFrame:
    """(column, missing) of every column, in one pass."""
    once = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    return once.unpivot([], df.columns, "column", "missing")


def dataset_overview(df: DataFrame, key: str, status: str, kind: str, area: str, feature: str, flag: str) -> DataFrame:
    """(block, label, value) rows."""
    one = df.agg(
        F.count("*").alias("rows"), F.count_distinct(area).alias("areas"), (F.count(key) - F.count_distinct(key)).alias("duplicate_keys"),
        F.count_if(feature).alias("with_feature"), F.count_if(F.col(flag) == "high").alias("high"), F.count_if(F.col(flag) == "low").alias("low"),
    )
    out = one.unpivot([], one.columns, "label", "value").withColumn("block", F.lit("total"))
    for block, column in (("status", status), ("type", kind)):
        out = out.unionByName(df.groupBy(F.coalesce(F.col(column), F.lit("unknown")).alias("label")).agg(F.count("*").alias("value")).withColumn("block", F.lit(block)))
    return out.select("block", "label", "value")


def utilisation_columns(df: DataFrame, users: str = "average_daily_users", capacity: str = "capacity", wage: str = "average_wage_yen") -> DataFrame:
    u, c, w = F.col(users), F.col(capacity), F.col(wage)
    return df.withColumns({"daily_user_capacity_ratio": ratio(u, c), "wage_per_daily_user": ratio(w, u), "wage_per_capacity": ratio(w, c)})


def bands(df: DataFrame, wage: str = "average_wage_yen", capacity: str = "capacity", utilisation: str = "daily_user_capacity_ratio") -> DataFrame:
    return df.withColumns({"wage_band_label": band(F.col(wage), WAGE_BANDS), "capacity_band_label": band(F.col(capacity), CAPACITY_BANDS), "utilisation_band_label": band(F.col(utilisation), UTILISATION_BANDS)})


def _number(x: float | None) -> Column:
    return F.lit(x).cast("double")


def _means(df: DataFrame, found: Summary, value: str, overall: str, groups: dict[str, str]) -> DataFrame:
    x, mean = valid(value), _number(found.one(overall).mean)
    made = {"ratio_to_overall_mean": ratio(x, mean), "difference_to_overall_mean": x - mean}
    for name in groups:
        df = found.join_groups(df, name, **{f"_m_{name}": "mean"})
        made[f"ratio_to_{name}_mean"] = ratio(x, F.col(f"_m_{name}"))
    return df.withColumns(made).drop(*[f"_m_{n}" for n in groups])


def reference_means(df: DataFrame, value: str, groups: dict[str, str]) -> DataFrame:
    """Ratio to the overall mean and to the mean of each group (``groups``: output name to column), and the difference to the overall mean.

    All means come from one reading; those of groups are joined back, so that a large group isn't gathered in one task.
    """
    found = summarize(df, {"_all": Statistic(value, (), False)} | {n: Statistic(value, (c,), False) for n, c in groups.items()})
    return _means(df, found, value, "_all", groups)


def _scores(df: DataFrame, found: Summary, name: str, value: str, z: str, percentile: str) -> DataFrame:
    one = found.one(name)
    joined = found.join_ranks(df, name, "_smaller", every="_every")
    return joined.withColumns({z: ratio(valid(value) - _number(one.mean), _number(one.sd)), percentile: F.col("_smaller") / F.col("_every")}).drop("_smaller", "_every")


def zscore_percentile(df: DataFrame, value: str, z: str = "z_score", percentile: str = "percentile") -> DataFrame:
    return _scores(df, summarize(df, {"x": Statistic(value)}), "x", value, z, percentile)


def market_quadrant(df: DataFrame, wage: str = "average_wage_yen", utilisation: str = "daily_user_capacity_ratio") -> DataFrame:
    return quadrant_vs_median(df, wage, utilisation, "market_position_quadrant", MARKET_QUADRANTS)


#: Output name and column of the groups whose mean wages an office is compared with.
REFERENCE_GROUPS = {"municipality": "municipality", "type": "corporation_type_label", "capacity_band": "capacity_band_label"}


def enriched(offices: DataFrame, wage: str = "average_wage_yen") -> DataFrame:
    """All derived columns that reports and filters read, on one row per office.

    The statistics of all of them come from one reading of the offices; means of groups and ranks of wages are looked up in small tables, the rest are constants.
    """
    from . import classify

    use = "daily_user_capacity_ratio"
    out = bands(utilisation_columns(offices))
    found = summarize(out, {"wage": Statistic(wage), "use": Statistic(use)} | {n: Statistic(wage, (c,), False) for n, c in REFERENCE_GROUPS.items()})
    flag, severity = outlier_class(valid(wage), constant_fences(found, "wage"))
    quadrant = quadrant_labels(valid(wage), valid(use), constant_median(found, "wage"), constant_median(found, "use"), MARKET_QUADRANTS)
    out = _scores(_means(out, found, wage, "wage", REFERENCE_GROUPS), found, "wage", wage, "z_score", "percentile")
    return classify.classified(out.withColumns({"wage_outlier_flag": flag, "wage_outlier_severity": severity, "market_position_quadrant": quadrant}))
