"""Mixing sources to target weights.

Words are counted per document and summed per source; the wanted total is shared out by weight, no source above
``most_repeats`` times its own size, and what it can't take goes to the others by weight.  A document of a source with the rate
``target / size`` is taken ``floor(rate)`` times and once more if a seeded hash of its id and text falls below the fraction.

Cases: null text has size 0 and is taken 0 words.  A null source is a source of its own, after all others.  Rows that
are equal in id and text are taken alike; others draw each for itself, rows without an id by their text.  Sources without words have target 0.  An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, materialize

#: Sources are few (names of crawls, books, code hosts): below this many, their table is broadcast, else joined by shuffle.
BROADCAST_SOURCES = 10_000


def source_targets(sizes: DataFrame, weights: tuple[int, ...], share: float, most_repeats: float) -> DataFrame:
    """(source, source_size, target): ``sizes`` has (source, source_size), one row a source.

    Sources in order of size per weight reach their ceiling first; the level at which the rest is shared
    is the first whose level stays below the next source's ceiling.
    """
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    ranked = sizes.withColumn("weight", weight)
    before = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").isNull(), "source").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    levels = (
        ranked.withColumn("full", F.coalesce(F.sum("source_size").over(before), F.lit(0)))
        .withColumn("open_weight", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
        .withColumn("all_size", F.sum("source_size").over(every))
        .withColumn("level", (share * F.col("all_size") - most_repeats * F.col("full")) / F.col("open_weight"))
        .withColumn("fits", F.col("level") * F.col("weight") <= most_repeats * F.col("source_size"))
    )
    level = F.min(F.when(F.col("fits"), F.struct(F.col("full"), F.col("level")))).over(every)["level"]
    target = F.least(F.lit(float(most_repeats)) * F.col("source_size"), F.coalesce(F.col("level"), F.lit(float("inf"))) * F.col("weight"))
    return levels.withColumn("level", level).select("source", "source_size", target.cast("double").alias("target"))


def unit_hash(key: Column, text: Column, seed: str) -> Column:
    """A number in [0, 1) from the first 32 bits of the MD5 of the seed, the key and the text, so that rows that share an id or have none draw each for itself."""
    digest = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(key.cast("string"), F.lit("")), F.md5(F.coalesce(text, F.lit("")).cast("binary"))).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / float(1 << 32)


def mix(documents: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most_repeats: float = 2.0, seed: str = "mix", extra: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, size, source_size, target, taken, copies) of each row of ``documents``, and the columns named in ``extra``.

    Without ``extra`` the texts are read once, to count their words; only the counts are written and joined.
    """
    spark = documents.sparkSession
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    sized = documents.select("doc_id", "source", *extra, size.alias("size"), unit_hash(F.col("doc_id"), F.col("text"), seed).alias("_draw"))
    if not extra:
        sized = materialize(sized, "mix-sizes")
    per_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    per_source = materialize(per_source, "mix-sources")
    targets = source_targets(per_source, weights, share, most_repeats).withColumnRenamed("source", "_source")
    if per_source.count() <= BROADCAST_SOURCES:
        targets = F.broadcast(targets)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    whole = F.floor(F.col("_rate")).cast("long")
    copies = whole + (F.col("_draw") < F.col("_rate") - whole).cast("long")
    return (
        sized.join(targets, sized.source.eqNullSafe(F.col("_source")))
        .withColumn("_rate", rate)
        .select("doc_id", *extra, "size", "source_size", "target", (F.col("size") * copies).alias("taken"), copies.alias("copies"))
    )


def emit(documents: DataFrame, **how) -> DataFrame:
    """The mix itself: each document as often as it is taken, with the columns of ``documents``."""
    rest = tuple(c for c in documents.columns if c not in ("doc_id", "source"))
    taken = mix(documents.withColumn("_src", F.col("source")), extra=(*rest, "_src"), **how)
    copies = F.sequence(F.lit(1), F.col("copies").cast("int"))
    every = taken.filter(F.col("copies") > 0).withColumn("_copy", F.explode(copies))
    return every.select(*[F.col("_src").alias("source") if c == "source" else F.col(c) for c in documents.columns])
