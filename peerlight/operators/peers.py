"""Peer benchmarks: what the rows of the same group say about a row.

Everything is grouped once and joined back.  Ranks and medians come from counts per (group, distinct value) in ranges of the data, so that a large
group isn't gathered in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .stats import exact_quantiles, with_quantiles
from .summary import Statistic, summarize, valid


def peer_ranks(df: DataFrame, groups: dict[str, str], value: str, least: int = 3) -> DataFrame:
    """For each of ``groups`` (prefix to column) adds <prefix>_count, _rank, _median and _mean of the valued rows of the row's group; null with fewer than ``least`` of them, rank null without a value.

    All groups are summarised in one reading of ``df``.
    """
    found = summarize(df, {p: Statistic(value, (g,)) for p, g in groups.items()}, (0.5,))
    for p, g in groups.items():
        out = found.join_ranks(found.join_groups(df, p, _c="count", _q="q", _avg="mean"), p, "_smaller", "_larger")
        enough = (F.col("_c") >= least) & F.col(g).isNotNull()
        df = out.withColumns({f"{p}_count": F.when(enough, F.col("_c")), f"{p}_rank": F.when(enough, F.col("_larger") + 1), f"{p}_median": F.when(enough, F.get("_q", F.lit(0))), f"{p}_mean": F.when(enough, F.col("_avg"))}).drop("_c", "_q", "_avg", "_smaller", "_larger")
    return df


def peer_rank(df: DataFrame, group: str, value: str, prefix: str, least: int = 3) -> DataFrame:
    """``peer_ranks`` of one group."""
    return peer_ranks(df, {prefix: group}, value, least)


def _with_median(sums: DataFrame, df: DataFrame, value: str, by: tuple[str, ...], out: str) -> DataFrame:
    return with_quantiles(sums, df, value, (0.5,), by, out).withColumn(out, F.col(out)[0])


def percentile_rank_strict(df: DataFrame, value: str, out: str = "percentile_rank") -> DataFrame:
    """Rounded percentage of values that are strictly smaller."""
    ranked = summarize(df, {"x": Statistic(value)}).join_ranks(df, "x", "_smaller", every="_every")
    return ranked.withColumn(out, F.floor(F.lit(100.0) * F.col("_smaller") / F.col("_every") + 0.5).cast("long")).drop("_smaller", "_every")


def area_sizes(df: DataFrame, area: str, wage: str, use: str, order: str = "ordinal") -> DataFrame:
    """(area, area_count, area_median_wage, area_mean_use, area_rank, area_count_median): ranks by size, ties by first row."""
    known = df.filter(F.col(area).isNotNull())
    sums = known.groupBy(area).agg(F.count("*").alias("area_count"), F.avg(valid(use)).alias("area_mean_use"), F.min(order).alias("_first"))
    sums = _with_median(sums, known, wage, (area,), "area_median_wage").select(area, "area_count", "area_median_wage", "area_mean_use", "_first")
    # areas are few: the window and the median below run over one row for each
    ranked = sums.withColumn("area_rank", F.row_number().over(Window.orderBy(F.desc("area_count"), "_first")))
    return ranked.crossJoin(F.broadcast(sums.agg(F.percentile("area_count", 0.5).alias("area_count_median")))).drop("_first")


def competition_profile(df: DataFrame, area: str, activity: str, wage: str, use: str) -> DataFrame:
    """Adds the columns of ``area_sizes`` and same_activity_count, the offices of the area with the row's activity, itself included."""
    same = df.groupBy(F.col(area).alias("_a"), F.col(activity).alias("_t")).agg(F.count("*").alias("same_activity_count"))
    out = df.join(area_sizes(df, area, wage, use), area, "left")
    return out.join(same, (out[area] == F.col("_a")) & out[activity].eqNullSafe(F.col("_t")), "left").drop("_a", "_t")


def capacity_profile(df: DataFrame, band: str, area: str, users: str, use: str, least_local: int = 5) -> DataFrame:
    """Adds peer_scope, peer_count and medians of users and utilisation among the rows of the same band: those of the same area if there are ``least_local``."""

    def medians(p: str, by: tuple[str, ...]) -> DataFrame:
        sums = df.groupBy(*by).agg(F.count("*").alias(f"_{p}n"))
        return _with_median(_with_median(sums, df, users, by, f"_{p}u"), df, use, by, f"_{p}r")

    every = medians("e", (band,)).withColumnRenamed(band, "_b")
    local = medians("l", (band, area)).withColumnsRenamed({band: "_lb", area: "_la"})
    out = df.join(every, df[band] == F.col("_b"), "left").join(local, (df[band] == F.col("_lb")) & (df[area] == F.col("_la")), "left")
    near = F.coalesce(F.col("_ln") >= least_local, F.lit(False))
    pick = lambda c: F.when(near, F.col(f"_l{c}")).otherwise(F.col(f"_e{c}"))
    return out.withColumns({"peer_scope": F.when(near, "local").otherwise("all"), "peer_count": pick("n"), "peer_median_users": pick("u"), "peer_median_use": pick("r")}).drop("_b", "_lb", "_la", *[f"_{p}{c}" for p in "el" for c in "nur"])


def activity_profile(df: DataFrame, activity: str, wage: str, use: str) -> DataFrame:
    """Adds activity_count, activity_median_wage, activity_mean_use and activity_rank (null without a wage)."""
    sums = df.groupBy(F.col(activity).alias("_t")).agg(F.count("*").alias("activity_count"), F.avg(valid(use)).alias("activity_mean_use")).filter("_t is not null")
    ranked = peer_ranks(df, {"_act": activity}, wage, 0)
    out = ranked.join(sums, F.col(activity) == F.col("_t"), "left")
    return out.withColumns({"activity_median_wage": F.col("_act_median"), "activity_rank": F.col("_act_rank")}).drop("_t", *[f"_act_{c}" for c in ("count", "rank", "median", "mean")])


def home_use_profile(df: DataFrame, home: str, wage: str, use: str, top: float = 0.8) -> DataFrame:
    """One row: mean wage and utilisation with and without, and the share with among the wages from the ``top`` quantile on."""
    w, u, h = valid(wage), valid(use), F.col(home)
    cut = exact_quantiles(df, wage, (top,)).select(F.col("_q")[0].alias("_cut"))
    return df.crossJoin(F.broadcast(cut)).agg(
        F.avg(F.when(h, w)).alias("home_mean_wage"), F.avg(F.when(~h, w)).alias("other_mean_wage"), F.avg(F.when(h, u)).alias("home_mean_use"), F.avg(F.when(~h, u)).alias("other_mean_use"),
        F.avg(F.when(w >= F.col("_cut"), F.coalesce(h, F.lit(False)).cast("double"))).alias("top_wage_home_share"),
    )


def metric_comparison(df: DataFrame, key: str, metrics: tuple[str, ...], population: Column | None = None) -> DataFrame:
    """(key, metric, value, difference and ratio to mean, difference and ratio to median): rows inside ``population`` are compared with it, others with all."""
    each = df.select(key, F.coalesce(population if population is not None else F.lit(True), F.lit(False)).alias("_in"), F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), valid(m).cast("double").alias("value")) for m in metrics])).alias("_x")).select(key, "_in", "_x.metric", "_x.value")
    stats = lambda rows, p: _with_median(rows.groupBy("metric").agg(F.avg("value").alias(f"_{p}mean")), rows, "value", ("metric",), f"_{p}med").withColumnRenamed("metric", f"_{p}")
    out = each.join(F.broadcast(stats(each.filter("_in"), "i")), F.col("metric") == F.col("_i"), "left").join(F.broadcast(stats(each, "a")), F.col("metric") == F.col("_a"), "left")  # a row per metric
    mean, med = F.when(F.col("_in"), F.col("_imean")).otherwise(F.col("_amean")), F.when(F.col("_in"), F.col("_imed")).otherwise(F.col("_amed"))
    v = F.col("value")
    return out.select(key, "metric", "value", (v - mean).alias("mean_difference"), F.when(mean != 0, v / mean).alias("mean_ratio"), (v - med).alias("median_difference"), F.when(med != 0, v / med).alias("median_ratio"))
