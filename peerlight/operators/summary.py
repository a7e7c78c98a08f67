"""Moments, quantiles and ranks of many metrics and groupings of a table, from one reading of it.

Rows are unpivoted to (statistic, group, value) and grouped once.  A ranked statistic keeps a row for each distinct value of a group, with how often it occurs; others keep
one row a group.  That table is written, and everything else comes from it: counts, means, deviations, extremes and interpolated quantiles of each group, and
for each distinct value of a ranked statistic how many rows of its group are smaller.  Both results are written as well, so that tables which look them up don't derive them again.

Ranks: the counts are dealt into ranges of (statistic, group, value) with splitters that Spark samples from them, as many as keep a range at ``RANGE_ROWS`` rows or so, however
narrow the values lie.  A running sum inside each range of a group and one over the few ranges of a group give the number of smaller rows; no task holds a whole large group.

Values that are null, NaN or infinite count nowhere, but their groups exist.  Groups may be null.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from ..sources.tables import checkpointed, discard

#: Distinct values that one task orders, about.
RANGE_ROWS = 1_000_000


def valid(value: str | Column) -> Column:
    """The value, or null where it is NaN or infinite."""
    c = F.col(value) if isinstance(value, str) else value
    d = c.cast("double")
    return F.when(~F.isnan(d) & (F.abs(d) < float("inf")), c)


@dataclass(frozen=True)
class Statistic:
    """``value`` within the groups of ``by``; ``ranked`` asks for quantiles and ranks as well."""

    value: str | Column
    by: tuple[str, ...] = ()
    ranked: bool = True


def group_key(df: DataFrame, by: tuple[str, ...]) -> Column:
    """The group of a row as an array of strings, in which nulls are equal to each other."""
    kinds = dict(df.dtypes)
    text = lambda c: (F.col(c) + 0.0 if kinds[c] in ("double", "float") else F.col(c)).cast("string")  # noqa: E731  no -0.0
    return F.array(*[text(c) for c in by]).cast("array<string>")


def ranges(counts: DataFrame, by: tuple[str, ...], value: str, rows: int) -> DataFrame:
    """``counts`` with the range of each row as ``_part``, in the order of (by.., value): a range has about ``rows`` rows."""
    parts = -(-counts.count() // rows)
    if parts <= 1:
        return counts.withColumn("_part", F.lit(0))
    return checkpointed(counts.repartitionByRange(parts, *by, value).withColumn("_part", F.spark_partition_id()))


def smaller_counts(counts: DataFrame, by: tuple[str, ...], value: str, n: str, rows: int = RANGE_ROWS) -> DataFrame:
    """Adds ``smaller``, the sum of ``n`` over the smaller values of the group, and ``all``, that over all.  ``counts`` has one row a group and value and has been written."""
    dealt = ranges(counts, by, value, rows)
    before = lambda w: F.coalesce(F.sum(n).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = dealt.withColumn("_inside", before(Window.partitionBy("_part", *by).orderBy(value)))
    names = {c: f"_o{i}" for i, c in enumerate(by)}
    totals = dealt.groupBy("_part", *by).agg(F.sum(n).alias(n)).select(F.col("_part").alias("_opart"), *[F.col(c).alias(o) for c, o in names.items()], before(Window.partitionBy(*by).orderBy("_part")).alias("_before"), F.sum(n).over(Window.partitionBy(*by)).alias("all"))
    same = F.col("_part") == F.col("_opart")
    for c, o in names.items():
        same &= F.col(c).eqNullSafe(F.col(o))
    return inside.join(totals, same).select(*counts.columns, (F.col("_before") + F.col("_inside")).alias("smaller"), "all")


def at_shares(shares: tuple[float, ...]) -> tuple[list[Column], Column]:
    """Aggregates over rows of ``smaller_counts`` (v, n) of one group, and the array of interpolated quantiles that they give."""

    def at(place: Column) -> Column:
        return F.min(F.when((F.col("smaller") <= place) & (place < F.col("smaller") + F.col("n")), F.col("v")))

    place = [(F.col("all") - 1) * float(s) for s in shares]
    ends = [x.alias(f"_{k}{i}") for i, p in enumerate(place) for k, x in (("l", at(F.floor(p))), ("h", at(F.ceil(p))), ("p", F.max(p)))]
    l, h, p = ([F.col(f"_{k}{i}") for i in range(len(shares))] for k in "lhp")
    return ends, F.array(*[F.when(a == b, a).otherwise((F.ceil(c) - c) * a + (c - F.floor(c)) * b) for a, b, c in zip(l, h, p, strict=True)])


class Summary:
    """``groups``: (statistic, key, count, mean, sd, low, high, q), one row a group; ``values``: (statistic, key, v, n, smaller, all)."""

    def __init__(self, statistics: dict[str, Statistic], dtypes: dict[str, str], groups: DataFrame, values: DataFrame):
        self.statistics, self.dtypes, self.groups, self.values = statistics, dtypes, groups, values

    @cached_property
    def _ones(self) -> dict[str, Row]:
        """Statistics without groups, a row each."""
        return {r.statistic: r for r in self.groups.filter(F.size("key") == 0).collect()}

    def one(self, name: str) -> Row:
        """The only row of a statistic without groups; without rows a count of 0 and nulls."""
        return self._ones.get(name) or Row(statistic=name, key=[], count=0, mean=None, sd=None, low=None, high=None, q=None)

    def of(self, name: str) -> DataFrame:
        """The groups of a statistic, with the columns that they are grouped by."""
        by = self.statistics[name].by
        return self.groups.filter(F.col("statistic") == name).select(*[F.get("key", i).cast(self.dtypes[c]).alias(c) for i, c in enumerate(by)], "count", "mean", "sd", "low", "high", "q")

    def join_groups(self, df: DataFrame, name: str, **columns: str) -> DataFrame:
        """``df`` with columns (new name = name in ``groups``) of the row's group; null where there is none."""
        side = self.groups.filter(F.col("statistic") == name).select(F.col("key").alias("_key"), *[F.col(c).alias(new) for new, c in columns.items()])
        return df.join(side, group_key(df, self.statistics[name].by) == F.col("_key"), "left").drop("_key")

    def join_ranks(self, df: DataFrame, name: str, smaller: str, larger: str | None = None, every: str | None = None) -> DataFrame:
        """``df`` with how many rows of the row's group have a smaller value, a larger one, any; null without a value."""
        s = self.statistics[name]
        side = self.values.filter(F.col("statistic") == name)
        named = [F.col("smaller").alias(smaller)] + ([(F.col("all") - F.col("smaller") - F.col("n")).alias(larger)] if larger else []) + ([F.col("all").alias(every)] if every else [])
        side = side.select(F.col("key").alias("_key"), F.col("v").alias("_v"), *named)
        same = valid(s.value).cast("double") == F.col("_v")
        return df.join(side, same & (group_key(df, s.by) == F.col("_key")) if s.by else same, "left").drop("_key", "_v")

    def discard(self) -> None:
        """Deletes what has been written, once nothing will read it any more."""
        discard(self.groups, self.values)


def summarize(df: DataFrame, statistics: dict[str, Statistic], shares: tuple[float, ...] = (0.25, 0.5, 0.75), rows: int = RANGE_ROWS) -> Summary:
    """All ``statistics`` of ``df``, which is read once."""
    each = [F.struct(F.lit(name).alias("statistic"), group_key(df, s.by).alias("key"), valid(s.value).cast("double").alias("x"), F.lit(s.ranked).alias("ranked")) for name, s in statistics.items()]
    rows_of = df.select(F.explode(F.array(*each)).alias("r")).select("r.*")
    n, mean = F.col("n"), F.col("mean")
    counts = checkpointed(
        rows_of.groupBy("statistic", "key", F.when(F.col("ranked"), F.col("x")).alias("v"))
        .agg(F.count("x").alias("n"), F.avg("x").alias("mean"), (F.var_pop("x") * F.count("x")).alias("m2"), F.min("x").alias("low"), F.max("x").alias("high"))
    )
    sums = counts.groupBy("statistic", "key").agg(F.sum("n").alias("count"), (F.sum(n * mean) / F.nullif(F.sum("n"), F.lit(0))).alias("mean"), F.min("low").alias("low"), F.max("high").alias("high"))
    # squares of the distance from the group's mean, so that values far from 0 lose no digits
    centre = sums.select(F.col("statistic").alias("_s"), F.col("key").alias("_k"), F.col("mean").alias("_m"))
    spread = counts.join(centre, (F.col("statistic") == F.col("_s")) & (F.col("key") == F.col("_k"))).groupBy("statistic", "key").agg(F.sum(F.col("m2") + n * (mean - F.col("_m")) ** 2).alias("_m2"))
    out = sums.join(spread, ["statistic", "key"]).withColumn("sd", F.when(F.col("count") >= 2, F.sqrt(F.col("_m2") / (F.col("count") - 1))))
    ranked = [name for name, s in statistics.items() if s.ranked]
    values = counts.filter(F.col("v").isNotNull()).select("statistic", "key", "v", "n")
    if ranked:
        values = checkpointed(smaller_counts(values, ("statistic", "key"), "v", "n", rows))
        ends, q = at_shares(shares)
        out = out.join(values.groupBy("statistic", "key").agg(*ends).select("statistic", "key", q.alias("q")), ["statistic", "key"], "left")
    else:
        values = values.withColumns({"smaller": F.lit(None).cast("long"), "all": F.lit(None).cast("long")})
        out = out.withColumn("q", F.lit(None).cast("array<double>"))
    groups = checkpointed(out.select("statistic", "key", "count", "mean", "sd", "low", "high", "q"))
    if ranked:
        discard(counts)
    return Summary(statistics, dict(df.dtypes), groups, values)
