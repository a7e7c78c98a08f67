"""Enrichment: links with sources and confidence, representatives, company roll-ups, and the review of what is missing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def _blank(c: str | Column) -> Column:
    return F.nullif(F.trim(F.col(c) if isinstance(c, str) else c), F.lit(""))


def last_wins(df: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each non-blank key."""
    rest = [c for c in df.columns if c not in (key, order)]
    picked = df.filter(_blank(key).isNotNull()).groupBy(_blank(key).alias("_k")).agg(F.max(F.struct(F.col(order).alias("_place"), *rest)).alias("_x"))
    return picked.select(F.col("_k").alias(key), *[F.col(f"_x.{c}") for c in rest])


def overlay(df: DataFrame, table: DataFrame, key: str, fields: tuple[str, ...]) -> DataFrame:
    """``df`` whose ``fields`` are replaced by the table's non-empty values; ``table`` has one row a key."""
    new = table.select(F.col(key).alias("_k"), *[_blank(f).alias(f"_{f}") for f in fields])
    out = df.join(new, F.col(key) == F.col("_k"), "left")
    return out.withColumns({f: F.coalesce(f"_{f}", f if f in df.columns else F.lit(None)) for f in fields}).drop("_k", *[f"_{f}" for f in fields])


def links_default_and_override(df: DataFrame, key: str, url: str, links: DataFrame, order: str, profile_hosts: tuple[str, ...]) -> DataFrame:
    """Adds homepage_url and profile_url: the directory's URL goes to one of them by its host, then the link table's last row of the key replaces what it fills."""
    canonical = T.canonical_url(F.col(url))
    profile = T.url_host(canonical).isin(*profile_hosts)
    out = df.withColumns({"homepage_url": F.when(~profile, canonical), "profile_url": F.when(profile, canonical)})
    return overlay(out, last_wins(links, key, order), key, ("homepage_url", "profile_url"))


def links_source_cascade(df: DataFrame, sources: list[tuple[str, str, Column]]) -> DataFrame:
    """Adds homepage_url, homepage_source and homepage_confidence from the first source (name, confidence, URL) with a value."""
    out = F.lit(None).cast("struct<url:string,source:string,confidence:string>")
    for name, confidence, url in reversed(sources):
        u = _blank(url)
        out = F.when(u.isNotNull(), F.struct(u.alias("url"), F.lit(name).alias("source"), F.lit(confidence).alias("confidence"))).otherwise(out)
    return df.withColumn("_h", out).withColumns({f"homepage_{f}": F.col(f"_h.{f}") for f in ("url", "source", "confidence")}).drop("_h")


def links_reference_lookup(df: DataFrame, key: str, name: str, listed: DataFrame) -> DataFrame:
    """Adds listed_url from ``listed`` (number, name, url): by number, else by a name that occurs there once."""
    by_number = listed.filter(_blank("number").isNotNull()).groupBy(F.col("number").alias("_n")).agg(F.max("url").alias("_u1"))
    by_name = listed.filter(_blank("name").isNotNull()).groupBy(F.col("name").alias("_m")).agg(F.count("*").alias("_c"), F.max("url").alias("_u2")).filter("_c = 1")
    out = df.join(by_number, F.col(key) == F.col("_n"), "left").join(by_name, F.col(name) == F.col("_m"), "left")
    return out.withColumn("listed_url", F.coalesce("_u1", "_u2")).drop("_n", "_u1", "_m", "_c", "_u2")


def representatives_join(df: DataFrame, number: str, directory_number: str, people: DataFrame, order: str, fields: tuple[str, ...] = ("representative_role", "representative_name")) -> DataFrame:
    """Left join on the record's company number, else the directory's; only non-empty fields overwrite; the last row of a number wins."""
    keyed = df.withColumn("_number", F.coalesce(_blank(number), _blank(directory_number)))
    return overlay(keyed, last_wins(people, "_number", order), "_number", fields).drop("_number")


def company_rollup(df: DataFrame, number: str, company: str, office: str, most: int = 30) -> DataFrame:
    """Per company number: sorted distinct company names, office count, first ``most`` distinct office names.

    Names are deduplicated by grouping first, and only the ``most`` smallest of each company are gathered.
    """
    rows = df.filter(_blank(number).isNotNull())
    sums = rows.groupBy(number).agg(F.count("*").alias("office_count"))
    names = rows.select(number, company).distinct().groupBy(F.col(number).alias("_k")).agg(F.sort_array(F.collect_set(company)).alias("names"))
    first = rows.filter(_blank(office).isNotNull()).select(number, office).distinct()
    place = F.row_number().over(Window.partitionBy(number).orderBy(office))
    offices = first.withColumn("_p", place).filter(F.col("_p") <= most).groupBy(F.col(number).alias("_o")).agg(F.sort_array(F.collect_list(office)).alias("offices"))
    return sums.join(names, F.col(number) == F.col("_k"), "left").join(offices, F.col(number) == F.col("_o"), "left").select(number, "office_count", F.coalesce("names", F.array().cast("array<string>")).alias("names"), F.coalesce("offices", F.array().cast("array<string>")).alias("offices"))


def representative_coverage(df: DataFrame, number: str, name: str) -> DataFrame:
    companies = df.filter(_blank(number).isNotNull()).groupBy(number).agg(F.max(_blank(name).isNotNull()).alias("_has"))
    return companies.agg(F.count("*").alias("companies"), F.count_if("_has").alias("with_representative"))


def search_query_text(office: str, area: str, company: str, topics: tuple[str, ...], legal: tuple[str, ...] = T.LEGAL_SUFFIXES) -> Column:
    """Quoted office name, area, company without its legal word, topic words; blanks are skipped."""
    name = _blank(office)
    return F.concat_ws(" ", F.concat(F.lit('"'), name, F.lit('"')), _blank(area), F.nullif(T.without_legal_suffix(F.col(company), legal), F.lit("")), *[F.lit(t) for t in topics])


def missing_links_review(df: DataFrame, focus: Column, key: str, query: Column, base: str = "https://search.example.com/?q=") -> DataFrame:
    """Focus rows that lack a homepage or a profile, those without both first, then by key; with flags and a search URL."""
    home, profile = _blank("homepage_url").isNull(), _blank("profile_url").isNull()
    url = F.concat(F.lit(base), F.replace(F.url_encode(query), F.lit("+"), F.lit("%20")))
    rows = df.filter(focus & (home | profile)).withColumns({"missing_homepage": home, "missing_profile": profile, "search_url": url})
    return rows.orderBy((home & profile).cast("int").desc(), key)


def links_coverage(df: DataFrame) -> DataFrame:
    return df.agg(F.count_if(_blank("homepage_url").isNotNull()).alias("with_homepage"), F.count_if(_blank("profile_url").isNotNull()).alias("with_profile"), F.count("*").alias("rows"))
