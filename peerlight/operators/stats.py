"""Distribution statistics: quartile fences, outlier classes, quadrants, watchlists, role and feature summaries.

Statistics come from one aggregation (``summary``) and go to the rows as constants or as a join on the group, so that flags never
put all rows into one partition.  Medians and quartiles are exact; they come from counts per distinct value, dealt into ranges of the data, so
that no task holds all values of a table or of a large group.  ``approximate`` takes a sketch instead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import checkpointed
from .summary import RANGE_ROWS, Statistic, Summary, at_shares, smaller_counts, summarize, valid


def ranked_values(df: DataFrame, value: str | Column, by: tuple[str, ...] = (), rows: int = RANGE_ROWS) -> DataFrame:
    """(by.., v, n, smaller, all): for each distinct value of each group how many rows have it, have a smaller one, have any."""
    counts = df.select(*by, valid(value).cast("double").alias("v")).filter("v is not null").groupBy(*by, "v").agg(F.count("*").alias("n"))
    return smaller_counts(checkpointed(counts), by, "v", "n", rows)


def exact_quantiles(df: DataFrame, value: str | Column, shares: tuple[float, ...], by: tuple[str, ...] = ()) -> DataFrame:
    """(by.., _q): an array with the interpolated value at each share; without ``by`` one row, of nulls if there is no value."""
    ends, q = at_shares(shares)
    return ranked_values(df, value, by).groupBy(*by).agg(*ends).select(*by, q.alias("_q"))


def with_quantiles(sums: DataFrame, df: DataFrame, value: str | Column, shares: tuple[float, ...], by: tuple[str, ...] = (), out: str = "_q") -> DataFrame:
    """``sums``, one row for each group of ``df`` (or one row), with the group's ``exact_quantiles`` as the array ``out``."""
    found = exact_quantiles(df, value, shares, by).withColumnRenamed("_q", out)
    if not by:
        return sums.crossJoin(F.broadcast(found))  # one row each
    found = found.withColumnsRenamed({c: f"_q_{c}" for c in by})
    same = F.lit(True)
    for c in by:
        same &= sums[c].eqNullSafe(found[f"_q_{c}"])
    return sums.join(found, same, "left").drop(*[f"_q_{c}" for c in by])


_QUARTILES = (0.25, 0.5, 0.75, 0.9)


def fences(q: Column, clamp_zero: bool = True) -> dict[str, Column]:
    """Both pairs of fences (1.5 and 3 IQR) from the array of quartiles; lower fences stop at 0 with ``clamp_zero``."""
    q1, q3 = F.get(q, F.lit(0)), F.get(q, F.lit(2))
    low = (lambda c: F.when(c < 0, 0.0).otherwise(c)) if clamp_zero else (lambda c: c)
    return {"upper_fence": q3 + 1.5 * (q3 - q1), "lower_fence": low(q1 - 1.5 * (q3 - q1)), "upper_extreme": q3 + 3.0 * (q3 - q1), "lower_extreme": low(q1 - 3.0 * (q3 - q1))}


def constant_fences(found: Summary, name: str, clamp_zero: bool = True) -> dict[str, Column]:
    """``fences`` of a statistic without groups, as constants."""
    q = found.one(name).q
    return fences(F.lit(q) if q else F.lit(None).cast("array<double>"), clamp_zero)


def constant_median(found: Summary, name: str) -> Column:
    q = found.one(name).q
    return F.lit(q[1] if q else None).cast("double")


def numeric_stats(df: DataFrame, value: str, by: tuple[str, ...] = (), digits: int | None = 3, clamp_zero: bool = True, approximate: bool = False) -> DataFrame:
    """Count, mean, median, q1, q3, p90, IQR and both pairs of fences; null without values."""
    if approximate:
        x = valid(value)
        each = df.groupBy(*by).agg(F.count(x).alias("count"), F.avg(x).alias("mean"), F.percentile_approx(x, list(_QUARTILES), 10_000).alias("q"))
    else:
        each = _with_row(summarize(df, {"x": Statistic(value, by)}, _QUARTILES).of("x"), by)
    q = lambda i: F.get("q", F.lit(i))
    made = {"mean": F.col("mean"), "median": q(1), "q1": q(0), "q3": q(2), "p90": q(3), "iqr": q(2) - q(0)} | fences(F.col("q"), clamp_zero)
    return each.select(*by, "count", *[(F.round(c, digits) if digits is not None else c).alias(n) for n, c in made.items()])


def _with_row(each: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """Without groups one row, even of an empty table."""
    if by:
        return each
    return each.agg(F.coalesce(F.max("count"), F.lit(0)).alias("count"), *[F.max(c).alias(c) for c in each.columns if c != "count"])


def numeric_stats_min_max(df: DataFrame, value: str, by: tuple[str, ...] = ()) -> DataFrame:
    each = _with_row(summarize(df, {"x": Statistic(value, by)}, (0.1, 0.5, 0.9)).of("x"), by)
    return each.select(*by, "count", F.col("low").alias("min"), F.get("q", F.lit(0)).alias("p10"), "mean", F.get("q", F.lit(1)).alias("median"), F.get("q", F.lit(2)).alias("p90"), F.col("high").alias("max"))


def stddev_sample(df: DataFrame, value: str, by: tuple[str, ...] = ()) -> DataFrame:
    x = valid(value)
    return df.groupBy(*by).agg(F.count(x).alias("count"), F.when(F.count(x) >= 2, F.stddev_samp(x)).alias("stddev"))


def outlier_class(x: Column, at: dict[str, Column]) -> tuple[Column, Column]:
    """(flag, severity) of a value against ``fences``; extremes include their fence."""
    flag = F.when((x >= at["upper_extreme"]) | (x > at["upper_fence"]), "high").when((x <= at["lower_extreme"]) | (x < at["lower_fence"]), "low")
    severity = F.when((x >= at["upper_extreme"]) | ((x <= at["lower_extreme"]) & ~(x > at["upper_fence"])), "extreme").when(flag.isNotNull(), "moderate")
    return flag, severity


def outlier_flags(df: DataFrame, value: str, flag: str = "outlier_flag", severity: str = "outlier_severity", by: tuple[str, ...] = (), population: DataFrame | None = None, clamp_zero: bool = True) -> DataFrame:
    """``df`` with flag and severity against the fences of ``population`` (``df`` itself by default), per group with ``by``."""
    found = summarize(df if population is None else population, {"x": Statistic(value, by)})
    if by:
        f, s = outlier_class(valid(value), fences(F.col("_q"), clamp_zero))
        return found.join_groups(df, "x", _q="q").withColumns({flag: f, severity: s}).drop("_q")
    f, s = outlier_class(valid(value), constant_fences(found, "x", clamp_zero))
    found.discard()
    return df.withColumns({flag: f, severity: s})


def quadrant_labels(first: Column, second: Column, first_median: Column, second_median: Column, labels: tuple[str, str, str, str]) -> Column:
    """Labels for (high, high), (high, low), (low, high), (low, low); at the median counts as high; null if anything is null."""
    known = first.isNotNull() & second.isNotNull() & first_median.isNotNull() & second_median.isNotNull()
    a, b = first >= first_median, second >= second_median
    return F.when(known & a & b, labels[0]).when(known & a, labels[1]).when(known & b, labels[2]).when(known, labels[3])


QUADRANTS = ("high x high", "high x low", "low x high", "low x low")


def quadrant_vs_median(df: DataFrame, first: str, second: str, out: str = "quadrant", labels: tuple[str, str, str, str] = QUADRANTS, population: DataFrame | None = None) -> DataFrame:
    found = summarize(df if population is None else population, {"first": Statistic(first), "second": Statistic(second)})
    label = quadrant_labels(valid(first), valid(second), constant_median(found, "first"), constant_median(found, "second"), labels)
    found.discard()
    return df.withColumn(out, label)


def outlier_watchlist(df: DataFrame, value: str, flag: str = "outlier_flag", tie: str = "ordinal", limit: int = 24) -> DataFrame:
    return df.filter(F.col(flag).isNotNull()).orderBy((F.col(flag) != "high").cast("int"), F.col(value).desc_nulls_last(), tie).limit(limit)


def zero_filled_counts(df: DataFrame, column: str, labels: tuple[str, ...]) -> DataFrame:
    """(position, label, count) in the order of ``labels``, 0 where a label is absent."""
    order = df.sparkSession.createDataFrame([(i, x) for i, x in enumerate(labels)], "position int, label string")
    counts = df.groupBy(F.col(column).alias("label")).agg(F.count("*").alias("n"))
    return order.join(counts, "label", "left").select("position", "label", F.coalesce("n", F.lit(0)).alias("count"))


def role_summary(df: DataFrame, roles: dict[str, tuple[str, str]]) -> DataFrame:
    """``roles``: label to (headcount column, FTE column)."""
    each = df.select(F.explode(F.array(*[F.struct(F.lit(k).alias("role"), valid(a).alias("actual"), valid(f).alias("fte")) for k, (a, f) in roles.items()])).alias("x"))
    return each.groupBy("x.role").agg(F.count("x.fte").alias("office_count"), F.avg("x.actual").alias("average_actual"), F.avg("x.fte").alias("average_fte"), F.count_if(F.col("x.fte") > 0).alias("nonzero_office_count"))


def feature_effects(df: DataFrame, features: dict[str, str], wage: str, staffing: str) -> DataFrame:
    """``features``: label to boolean column; unknown values count on neither side."""
    each = df.select(F.explode(F.array(*[F.struct(F.lit(k).alias("feature"), F.col(c).alias("on")) for k, c in features.items()])).alias("x"), valid(wage).alias("w"), valid(staffing).alias("s"))
    on, off = F.col("x.on"), ~F.col("x.on")
    return each.groupBy("x.feature").agg(
        F.count_if(on).alias("true_count"), F.count_if(off).alias("false_count"),
        F.avg(F.when(on, F.col("w"))).alias("true_average_wage"), F.avg(F.when(off, F.col("w"))).alias("false_average_wage"),
        F.avg(F.when(on, F.col("s"))).alias("true_average_staffing"),
    )


STAFFING_QUADRANTS = ("high wage x ample staff", "high wage x thin staff", "low wage x ample staff", "low wage x thin staff")


def staffing_watchlists(df: DataFrame, quadrant: str, wage: str, staffing: str, tie: str = "ordinal", limit: int = 12) -> DataFrame:
    """Two lists of ``limit`` rows: thin staff with high wages, ample staff with low wages.  Missing (and 0) sort as 0, 999 and 999999."""
    w, s = F.col(wage), F.col(staffing)
    missing = lambda c, x: F.when(c.isNull() | (c == 0), float(x)).otherwise(c)
    lists = []
    for name, label, order in (
        ("lean_high_wage", STAFFING_QUADRANTS[1], [F.coalesce(w, F.lit(0.0)).desc(), missing(s, 999)]),
        ("heavy_low_wage", STAFFING_QUADRANTS[2], [missing(w, 999999), F.coalesce(s, F.lit(0.0)).desc()]),
    ):
        top = df.filter(F.col(quadrant) == label).orderBy(*order, tie).limit(limit)
        lists.append(top.withColumn("place", F.row_number().over(Window.orderBy(*order, tie))).withColumn("list", F.lit(name)))
    return lists[0].unionByName(lists[1])


def staffing_report(df: DataFrame, wage: str, staffing: str, matched: Column, fetched: Column) -> DataFrame:
    """``df`` with the staffing flag, severity and quadrant; statistics come from rows that are matched and fetched, flags go to all."""
    found = summarize(df.filter(matched & fetched), {"staffing": Statistic(staffing), "wage": Statistic(wage)})
    flag, severity = outlier_class(valid(staffing), constant_fences(found, "staffing"))
    quadrant = quadrant_labels(valid(wage), valid(staffing), constant_median(found, "wage"), constant_median(found, "staffing"), STAFFING_QUADRANTS)
    found.discard()
    return df.withColumns({"staffing_outlier_flag": flag, "staffing_outlier_severity": severity, "staffing_quadrant": quadrant})
