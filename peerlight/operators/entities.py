"""Companies and representatives behind offices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import checkpointed
from .summary import valid


def _only(numbers: DataFrame, keys: list[str], out: str) -> DataFrame:
    """The number of each key that has exactly one."""
    return numbers.groupBy(*keys).agg(F.min("_n").alias(out), F.max("_n").alias("_most")).filter(F.col(out) == F.col("_most")).drop("_most")


def company_identity(df: DataFrame, number: str, name_key: str, base_key: str, representative_key: str, office: str) -> DataFrame:
    """Adds ``company_key``: own number, else the only number of the exact name, else the only one of (representative, base name), else the name, else the office.

    Numbers that the second source infers count among those of an exact name.  Both come from the distinct combinations of number, name and representative, which are
    written once; rows look up their name, base name and representative.
    """
    own = F.nullif(F.trim(F.col(number)), F.lit(""))
    rows = df.withColumns({"_own": own, "_name": F.col(name_key), "_base": F.col(base_key), "_rep": F.col(representative_key)})
    known = checkpointed(rows.select("_own", "_name", "_base", "_rep").distinct())
    pair = _only(known.filter("_own is not null and _rep is not null and _base is not null").select("_rep", "_base", F.col("_own").alias("_n")), ["_rep", "_base"], "_by_pair")
    known = known.join(pair, ["_rep", "_base"], "left")
    exact = _only(known.select("_name", F.coalesce("_own", "_by_pair").alias("_n")).filter("_name is not null and _n is not null"), ["_name"], "_by_name")
    found = known.filter("_own is null").join(exact, "_name", "left").select(*[F.col(c).alias(f"{c}_k") for c in ("_name", "_base", "_rep")], F.coalesce("_by_name", "_by_pair").alias("_inferred"))
    found = checkpointed(found.filter("_inferred is not null").distinct())
    same = F.col("_own").isNull()
    for c in ("_name", "_base", "_rep"):
        same &= F.col(c).eqNullSafe(F.col(f"{c}_k"))
    out = rows.join(found, same, "left")
    key = F.coalesce(F.concat(F.lit("number:"), F.coalesce("_own", "_inferred")), F.concat(F.lit("name:"), F.col("_name")), F.concat(F.lit("office:"), F.col(office)))
    return out.withColumn("company_key", key).select(*df.columns, "company_key")


def company_label(df: DataFrame, key: str, name: str, has_prefix: Column, number: str) -> DataFrame:
    """(key, label): the name with the highest score (100 for a legal prefix, 20 for a number, its length), ties by name descending."""
    score = 100 * has_prefix.cast("int") + 20 * F.coalesce(F.col(number) != "", F.lit(False)).cast("int") + F.length(name)
    return df.filter(F.col(name).isNotNull()).groupBy(key).agg(F.max(F.struct(score.alias("s"), F.col(name).alias("n"))).alias("_x")).select(key, F.col("_x.n").alias("label"))


def company_profile(df: DataFrame, key: str, area: str, wage: str, use: str, kind: str) -> DataFrame:
    """Offices, areas, mean wage and utilisation, wage spread (of two wages or more) and the most frequent type (ties: smaller) of each company."""
    w = valid(wage)
    sums = df.groupBy(key).agg(F.count("*").alias("office_count"), F.count_distinct(area).alias("area_count"), F.avg(w).alias("mean_wage"), F.avg(valid(use)).alias("mean_use"), F.when(F.count(w) >= 2, F.max(w) - F.min(w)).alias("wage_spread"))
    kinds = df.filter(F.col(kind).isNotNull()).groupBy(key, kind).agg(F.count("*").alias("_n")).groupBy(F.col(key).alias("_k")).agg(F.min(F.struct((-F.col("_n")).alias("n"), F.col(kind).alias("kind"))).alias("_x"))
    return sums.join(kinds, F.col(key) == F.col("_k"), "left").select(*sums.columns, F.col("_x.kind").alias("main_type"))


def company_scale_buckets(df: DataFrame, key: str) -> DataFrame:
    sizes = df.groupBy(key).agg(F.count("*").alias("_n"))
    bucket = F.when(F.col("_n") == 1, "1").when(F.col("_n") <= 3, "2-3").otherwise("4 and more")
    return sizes.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("companies"))


def company_visible_offices(df: DataFrame, key: str, visible: Column, focus: Column) -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("office_count"), F.count_if(visible).alias("visible_count"), F.count_if(focus).alias("focus_count"))


def company_office_sort(df: DataFrame, by: str | None, collation: str | None = None, area: str = "municipality", name: str = "office_name", tie: str = "office_no") -> list[Column]:
    """Sort keys of a company's offices: a metric descending with nulls last, if given, then area, name and number in the collation's order."""
    text = (lambda c: F.collate(F.col(c), collation)) if collation else F.col
    return ([F.col(by).desc_nulls_last()] if by else []) + [text(area).asc(), text(name).asc(), F.col(tie).asc()]


def representative_groups(df: DataFrame, representative_key: str, company: str, wage: str, least_companies: int = 1, area: str = "municipality") -> DataFrame:
    """Totals per representative: companies, offices, areas, mean wage."""
    w = valid(wage)
    sums = df.filter(F.col(representative_key).isNotNull()).groupBy(representative_key).agg(F.count_distinct(company).alias("company_count"), F.count("*").alias("office_count"), F.count_distinct(F.nullif(F.col(area), F.lit(""))).alias("area_count"), F.avg(w).alias("mean_wage"))
    return sums.filter(F.col("company_count") >= least_companies)


def representative_companies(df: DataFrame, representative_key: str, company: str, wage: str, name: str, has_prefix: Column, number: str, person: str) -> DataFrame:
    """Companies of each representative: offices, mean wage, the name, number and representative of the company's preferred row (as ``company_label``
    prefers, ties by the larger name, number and representative), and its place by offices, mean wage (missing last) and name.

    The window orders the companies of one representative, one row for each.
    """
    score = 100 * has_prefix.cast("int") + 20 * F.coalesce(F.col(number) != "", F.lit(False)).cast("int") + F.length(name)
    preferred = F.max(F.struct(F.coalesce(score, F.lit(-1)).alias("s"), F.col(name).alias("company_name"), F.col(number).alias("company_number"), F.col(person).alias("representative_name")))
    sums = df.filter(F.col(representative_key).isNotNull()).groupBy(representative_key, company).agg(F.count("*").alias("office_count"), F.avg(valid(wage)).alias("mean_wage"), preferred.alias("_p"))
    out = sums.select(representative_key, company, "office_count", "mean_wage", "_p.company_name", "_p.company_number", "_p.representative_name")
    place = Window.partitionBy(representative_key).orderBy(F.desc("office_count"), F.desc_nulls_last("mean_wage"), "company_name", company)
    return out.withColumn("place", F.row_number().over(place))
