"""Series, ranked lists and summaries of the rows that a filter leaves.

Each takes an enriched office table; lists end in a unique sort key, so that limits are the same on every run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import classify, entities
from .stats import valid, with_quantiles

WAGE, USE = "average_wage_yen", "daily_user_capacity_ratio"


def top_counts(df: DataFrame, column: str, limit: int, order: str = "ordinal") -> DataFrame:
    """Most frequent values; of equally frequent ones that which comes first."""
    counts = df.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("label")).agg(F.count("*").alias("count"), F.min(order).alias("_first"))
    return counts.orderBy(F.desc("count"), "_first").limit(limit).drop("_first")


def top_group_mean(df: DataFrame, group: str, value: str = WAGE, least: int = 5, limit: int = 8) -> DataFrame:
    x = valid(value)
    return df.groupBy(F.col(group).alias("label")).agg(F.count(x).alias("count"), F.avg(x).alias("mean")).filter(F.col("count") >= least).orderBy(F.desc("mean"), "label").limit(limit)


def group_stats(df: DataFrame, group: str, value: str = WAGE, least: int = 1) -> DataFrame:
    known = df.filter(F.col(group).isNotNull()).select(F.col(group).alias("label"), F.col(value).alias("_x"))
    sums = known.groupBy("label").agg(F.count(valid("_x")).alias("count"), F.avg(valid("_x")).alias("mean"), F.min(valid("_x")).alias("min"), F.max(valid("_x")).alias("max")).filter(F.col("count") >= least)
    sums = with_quantiles(sums, known, "_x", (0.5,), ("label",)).select("label", "count", "mean", F.col("_q")[0].alias("median"), "min", "max")
    return sums.orderBy(F.desc("median"), "label")


def _ordered(df: DataFrame, labels: list[str]) -> DataFrame:
    order = df.sparkSession.createDataFrame([(i, x) for i, x in enumerate(labels)], "position int, label string")
    return order.join(df, "label").orderBy("position")


def ordered_counts(df: DataFrame, column: str, labels: list[str]) -> DataFrame:
    """Counts in the order of the labels; empty ones are dropped."""
    return _ordered(df.groupBy(F.col(column).alias("label")).agg(F.count("*").alias("count")), labels)


def ordered_group_mean(df: DataFrame, column: str, labels: list[str], value: str = USE) -> DataFrame:
    x = valid(value)
    return _ordered(df.groupBy(F.col(column).alias("label")).agg(F.avg(x).alias("mean")).filter("mean is not null"), labels)


def outlier_breakdown(df: DataFrame, flag: str = "wage_outlier_flag") -> DataFrame:
    return df.filter(F.col(flag).isin("high", "low")).groupBy(F.col(flag).alias("label")).agg(F.count("*").alias("count"))


def two_group_means(df: DataFrame, column: str, value: str = WAGE) -> DataFrame:
    return df.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("group")).agg(F.avg(valid(value)).alias("mean"))


def scatter_points(df: DataFrame, key: str, x: str, y: str, width: float = 100.0, height: float = 100.0) -> DataFrame:
    """Rows with both metrics, scaled to a box; a metric without spread counts as spread 1."""
    both = df.filter(valid(x).isNotNull() & valid(y).isNotNull())
    ends = both.agg(*[f(c).alias(f"_{n}{p}") for p, c in (("x", x), ("y", y)) for n, f in (("lo", F.min), ("hi", F.max))])
    scaled = lambda c, p, size: (F.col(c) - F.col(f"_lo{p}")) / F.when(F.col(f"_hi{p}") == F.col(f"_lo{p}"), 1.0).otherwise(F.col(f"_hi{p}") - F.col(f"_lo{p}")) * size
    return both.crossJoin(F.broadcast(ends)).select(key, scaled(x, "x", width).alias("px"), scaled(y, "y", height).alias("py"))  # ends: one row


def share_of(df: DataFrame, condition: Column) -> DataFrame:
    return df.agg(F.avg(F.coalesce(condition, F.lit(False)).cast("double")).alias("share"))


def sum_computed(df: DataFrame, value: Column) -> DataFrame:
    return df.agg(F.sum(F.coalesce(value, F.lit(0.0))).alias("total"))


def summary_cards(df: DataFrame, company: str) -> DataFrame:
    """One row of headline numbers."""
    w, home = valid(WAGE), F.col("home_use_active")
    main = df.agg(
        F.count("*").alias("offices"), F.avg(w).alias("mean_wage"), F.when(F.count(w) >= 2, F.stddev_samp(w)).alias("sd_wage"), F.avg(valid(USE)).alias("mean_use"), F.avg(valid("average_daily_users")).alias("mean_users"),
        F.count_if(home).alias("home_count"), F.avg(F.coalesce(home, F.lit(False)).cast("double")).alias("home_rate"), F.avg(valid("home_use_user_ratio_decimal")).alias("mean_home_ratio"), F.count_if("shortage_risk").alias("risk_count"),
    )
    multi = df.groupBy(company).agg(F.count("*").alias("_n")).agg(F.count_if(F.col("_n") >= 2).alias("multi_office_companies"))
    best = group_stats(df, "work_model", least=5).limit(1).agg(F.max("label").alias("best_work_model"))
    main = with_quantiles(main, df, WAGE, (0.1, 0.25, 0.5, 0.75, 0.9))
    named = [F.col("_q")[i].alias(f"{n}_wage") for i, n in enumerate(("p10", "p25", "median", "p75", "p90"))]
    # three frames of one row each
    return main.select("*", *named).drop("_q").crossJoin(F.broadcast(multi)).crossJoin(F.broadcast(best))


def top_performers(df: DataFrame, limit: int = 3, detail: str = "primary_activity_type") -> DataFrame:
    return df.filter((F.col("wage_outlier_flag") == "high") & F.col(detail).isNotNull()).orderBy(F.col(WAGE).desc_nulls_last(), "ordinal").limit(limit)


def low_use_effect(df: DataFrame, below: float = 0.7) -> DataFrame:
    """Offices with low utilisation, and the mean revenue of a point there, a missing one counting as 0."""
    point = classify.revenue_per_point(F.col("capacity"), F.col(WAGE))
    return df.filter(F.col(USE) < below).agg(F.count("*").alias("offices"), F.floor(F.avg(F.coalesce(point, F.lit(0)).cast("double")) + 0.5).alias("revenue_per_point"))


def _rows(block: str, one: DataFrame) -> DataFrame:
    """A frame of one row as (block, metric, value) rows."""
    values = one.select(*[F.col(c).cast("double").alias(c) for c in one.columns])
    return values.unpivot([], values.columns, "metric", "value").select(F.lit(block).alias("block"), "metric", "value")


def insight_summary(df: DataFrame) -> DataFrame:
    """(block, metric, value): the wage's centre, low utilisation, best offices, best work models, home use."""
    w = valid(WAGE)
    out = _rows("wage", with_quantiles(df.agg(F.avg(w).alias("mean")), df, WAGE, (0.5,)).select(F.col("_q")[0].alias("median"), "mean"))
    out = out.unionByName(_rows("use", low_use_effect(df)))
    out = out.unionByName(top_performers(df).select(F.lit("performers").alias("block"), F.col("office_no").alias("metric"), F.col(WAGE).alias("value")))
    out = out.unionByName(group_stats(df, "work_model", least=5).limit(2).select(F.lit("work models").alias("block"), F.col("label").alias("metric"), F.col("median").alias("value")))
    return out.unionByName(two_group_means(df, "home_use_active").select(F.lit("home use").alias("block"), F.when(F.col("group"), "with").otherwise("without").alias("metric"), F.col("mean").alias("value")))


def opportunity_area(df: DataFrame, area: str, least: int = 3) -> DataFrame:
    """The area with few offices, wages and utilisation above those of all, best by median wage + 10000 x utilisation."""
    from .peers import area_sizes

    overall = with_quantiles(df.agg(F.avg(valid(USE)).alias("_use")), df, WAGE, (0.5,)).select(F.col("_q")[0].alias("_wage"), "_use")
    areas = area_sizes(df, area, WAGE, USE).crossJoin(F.broadcast(overall))
    good = (F.col("area_count") >= least) & (F.col("area_count") <= F.col("area_count_median")) & (F.col("area_median_wage") >= F.col("_wage")) & (F.col("area_mean_use") >= F.col("_use"))
    score = F.col("area_median_wage") + 10_000 * F.col("area_mean_use")
    return areas.filter(good).withColumn("score", score).orderBy(F.desc("score"), area).limit(1).select(F.col(area).alias("area"), "area_count", "area_median_wage", "area_mean_use")


def market_summary(df: DataFrame, area: str, company: str) -> DataFrame:
    """Six blocks of (block, metric, value) rows."""
    free, home, risk = F.col("available_capacity"), F.col("home_use_active"), F.col("shortage_risk")
    out = top_counts(df, area, 3).select(F.lit("competition").alias("block"), F.col("label").alias("metric"), F.col("count").cast("double").alias("value"))
    out = out.unionByName(opportunity_area(df, area).select(F.lit("opportunity").alias("block"), F.col("area").alias("metric"), F.col("area_median_wage").alias("value")))
    out = out.unionByName(_rows("capacity", df.agg(F.avg(free).alias("mean_free"), F.count_if(free >= 5).alias("five_free"))))
    out = out.unionByName(group_stats(df, "work_model", least=5).limit(3).select(F.lit("work models").alias("block"), F.col("label").alias("metric"), F.col("median").alias("value")))
    out = out.unionByName(_rows("shortage", df.filter(risk).agg(F.count("*").alias("offices"), F.count_if(F.col("work_model") == classify.LIGHT).alias("light"), F.count_if(F.col("home_use_user_ratio_decimal") >= 0.3).alias("home"), F.sum(F.coalesce(free, F.lit(0.0))).alias("free"))))
    means = df.agg(*[F.avg(F.when(c, valid(v))).alias(f"{n}_{k}") for n, c in (("with", home), ("without", ~home)) for k, v in (("wage", WAGE), ("use", USE))])
    out = out.unionByName(_rows("home use", means))
    sizes = entities.company_profile(df, company, "municipality", WAGE, USE, "corporation_type_label").agg(F.count_if(F.col("office_count") >= 2).alias("multi_office"), F.max("office_count").alias("largest"), F.avg(F.when(F.col("office_count") >= 2, F.col("wage_spread"))).alias("mean_spread"))
    return out.unionByName(_rows("companies", sizes))


def _ratio() -> Column:
    return F.coalesce("ratio_to_municipality_mean", "ratio_to_overall_mean")


def _candidates(df: DataFrame, condition: Column, score: Column, limit: int) -> DataFrame:
    return df.filter(condition).withColumn("score", score).orderBy(F.desc_nulls_last("score"), "ordinal").limit(limit)


def growth_candidates(df: DataFrame, limit: int = 6) -> DataFrame:
    r, u = _ratio(), F.col(USE)
    thin = F.coalesce(F.col("staffing_quadrant") == "high wage x thin staff", F.lit(False)) if "staffing_quadrant" in df.columns else F.lit(False)
    return _candidates(df, (r >= 1.1) & (u < 0.8), 70 * r + 25 * (1 - u) + F.when(thin, 12).otherwise(0), limit)


def fix_candidates(df: DataFrame, limit: int = 6) -> DataFrame:
    r, u, free = _ratio(), F.col(USE), F.col("available_capacity")
    above = lambda c: F.greatest(c, F.lit(0.0))
    light = F.when(F.col("work_model") == classify.LIGHT, 10).otherwise(0)
    home = F.when(F.col("home_use_user_ratio_decimal") >= 0.3, 8).otherwise(0)
    return _candidates(df, (r < 0.9) & (u < 0.75) & F.col("shortage_risk"), 80 * above(1 - r) + 35 * above(0.7 - u) + 2 * above(F.coalesce(free, F.lit(0.0)) - 3) + light + home, limit)


def strong_candidates(df: DataFrame, limit: int = 6) -> DataFrame:
    r, u = _ratio(), F.col(USE)
    return _candidates(df, (r >= 1.1) & (u >= 0.85), 70 * r + 35 * u, limit)


def anomaly_list(df: DataFrame, limit: int = 12) -> DataFrame:
    u = F.col(USE)
    score = 5 * F.abs(F.coalesce("z_score", F.lit(0.0))) + 2 * F.coalesce("ratio_to_overall_mean", F.lit(0.0)) + F.when(u > 1.5, 35).otherwise(0)
    return _candidates(df, F.col("wage_outlier_flag").isNotNull() | (u > 1.5), score, limit)


#: Column to label, in the order of the export.
EXPORT_LABELS = {
    "office_no": "No.", "municipality": "municipality", "corporation_type_label": "company type", "corporation_number": "company number", "corporation_name": "company", "representative_name": "representative",
    "representative_role": "role", "office_name": "office", "area": "area", "average_wage_yen": "mean wage", "ratio_to_overall_mean": "to overall mean", "ratio_to_municipality_mean": "to municipality mean",
    "ratio_to_capacity_band_mean": "to capacity band mean", "daily_user_capacity_ratio": "use", "available_capacity": "free places", "home_use_active": "home use", "home_use_user_ratio_pct": "home share",
    "wage_outlier_flag": "wage level", "shortage_risk": "possible shortage", "work_model": "work model", "area_office_count": "offices in area", "area_activity_count": "offices with the activity in area",
    "company_office_count": "offices of company", "dir_primary_activity_type": "main activity", "dir_office_number": "directory number", "dir_office_url": "directory page", "homepage_url": "homepage",
    "profile_url": "profile", "search_url": "search", "profile_search_url": "profile search", "remarks": "remarks",
}


def export_filtered_table(df: DataFrame, every: DataFrame, area: str, activity: str, company: str, search_base: str = "https://search.example.com/?q=", profile_word: str = "profile") -> DataFrame:
    """The labelled export of the rows ``df``, columns that it lacks as null: counts come from ``every`` row; booleans and flags are words."""
    counts = lambda name, *by: every.groupBy(*[F.col(b).alias(f"_{i}{name}") for i, b in enumerate(by)]).agg(F.count("*").alias(name))
    out = df.join(counts("area_office_count", area), F.col(area) == F.col("_0area_office_count"), "left")
    out = out.join(counts("area_activity_count", area, activity), (F.col(area) == F.col("_0area_activity_count")) & F.col(activity).eqNullSafe(F.col("_1area_activity_count")), "left")
    out = out.join(counts("company_office_count", company), F.col(company) == F.col("_0company_office_count"), "left")
    yes = lambda c: F.when(c, "yes").when(~c, "no")
    query = lambda *more: F.concat(F.lit(search_base), F.replace(F.url_encode(F.concat_ws(" ", F.concat(F.lit('"'), "office_name", F.lit('"')), area, *map(F.lit, more))), F.lit("+"), F.lit("%20")))
    words = {
        "area": F.col(area), "home_use_active": yes(F.col("home_use_active")), "wage_outlier_flag": F.coalesce("wage_outlier_flag", F.lit("none")),
        "shortage_risk": F.when(F.col("shortage_risk"), "yes").otherwise("no"), "search_url": query(), "profile_search_url": query(profile_word),
    }
    return out.select(*[(words[c] if c in words else F.col(c) if c in out.columns else F.lit(None).cast("string")).alias(label) for c, label in EXPORT_LABELS.items()])
