"""Target-distribution importance resampling: the documents whose features look most like a target's, drawn with Gumbel noise.

Features are hashed into buckets.  A text becomes the array of its buckets once; counts over all texts and over the target give each bucket's gain, an integer, and a
document's weight is the sum of its gains, looked up in one array of all buckets.  Score is the weight and seeded noise, so the highest scores are a sample
without replacement.

The cutoff is found without sorting the corpus.  A quantile sketch of the scores brackets the wanted rank.  Exact counts of what lies above the bracket and inside it show
whether the rank is inside, and move and double the bracket until it is.  Only rows inside are sorted, in a range partitioning, to find the last row that is drawn.  Drawn rows
are then ranked by a range partitioning whose partitions are counted.  No task holds more than its range; equal scores are split by id and by row.

Cases: null and empty texts have no features, weight 0, and are never drawn.  A null id draws as the empty text and ranks after others of its score.  Repeated rows are drawn
each for itself, ties of score and id by the number of features, then as they are stored.  Empty tables give an empty result; without a target all its counts are 0.  Other columns are ignored.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, release

# Fixed values of the contract: characters of a word.
FEATURE = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ORDER = ["_down", "_none", "doc_id", "n_features", "_row"]


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), F.lit(FEATURE), F.lit(0))


def buckets(found: Column, size: int, longest: int = 1) -> Column:
    """The buckets of all runs of 1 to ``longest`` of the words in ``found``, as an array of integers."""
    number = lambda w: (F.crc32(w.cast("binary")) % size).cast("int")
    if longest == 1:
        return F.transform(found, number)

    def runs(n: int) -> Column:
        every = F.transform(found, lambda x, i: F.when(i <= F.size(found) - n, F.array_join(F.slice(found, i + 1, n), " ")))
        return F.transform(F.filter(every, lambda x: x.isNotNull()), number)

    return F.flatten(F.array(*[runs(n) for n in range(1, longest + 1)]))


def counts(features: DataFrame) -> dict[int, int]:
    """How often each bucket occurs: one row a bucket."""
    return dict(features.select(F.explode("_b").alias("b")).groupBy("b").agg(F.count("*")).collect())


def gains(source: DataFrame, target: DataFrame, size: int) -> DataFrame:
    """(b, gain) for every bucket, from features of the source and the target."""
    spark = source.sparkSession
    s, t = counts(source), counts(target)
    all_s, all_t = float(sum(s.values()) + size), float(sum(t.values()) + size)
    rows = spark.createDataFrame([(b, float(s.get(b, 0)), float(t.get(b, 0))) for b in range(size)], "b int, s double, t double")
    return rows.select("b", F.floor(1000 * F.ln((F.col("t") + 1) * all_s / ((F.col("s") + 1) * all_t))).cast("long").alias("gain"))


def noise(doc_id: Column, seed: int) -> Column:
    """Gumbel noise in thousandths, from the first 32 bits of a SHA-256."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.ln(-F.ln((h + 0.5) / 4294967296.0))).cast("long")


def scored(documents: DataFrame, target: DataFrame, size: int, longest: int, seed: int) -> DataFrame:
    """(doc_id, n_features, words, weight, score, _row): written once; ``_row`` names a row."""
    read = lambda df, *keep: df.select(*keep, words(F.col("text")).alias("_w")).select(*keep, F.size("_w").alias("_words"), buckets(F.col("_w"), size, longest).alias("_b"))
    features = materialize(read(documents, "doc_id"), "resample-features")
    gain = [g for _, g in sorted((r.b, r.gain) for r in gains(features, read(target), size).collect())]  # `size` numbers
    table = F.from_json(F.lit(json.dumps(gain)), "array<bigint>")  # a constant: folded once, not built for each row
    weight = F.aggregate("_b", F.lit(0).cast("long"), lambda a, b: a + F.get(table, b))
    n = F.size("_b").cast("long")
    out = features.select("doc_id", n.alias("n_features"), "_words", weight.alias("weight"), (weight + noise(F.col("doc_id"), seed)).alias("score"), F.monotonically_increasing_id().alias("_row"))
    out = materialize(out, "resample-scores")
    release(features)
    return out


def bracket(scores: DataFrame, wanted: int, n: int, accuracy: int = 10_000) -> tuple[int, int, int]:
    """(low, high, above): the ``wanted``-th highest of ``n`` scores lies in low .. high, and ``above`` scores are higher than that.

    The sketch gives a first bracket; counts outside it are exact, so a bracket that misses is seen, moved and widened.
    """
    slack = 2.0 / accuracy
    share = 1 - wanted / n
    low, high, least, most = scores.agg(F.percentile_approx("score", max(share - slack, 0.0), F.lit(accuracy)), F.percentile_approx("score", min(share + slack, 1.0), F.lit(accuracy)), F.min("score"), F.max("score")).first()
    step = max(high - low, 1)
    while True:
        above, inside = scores.agg(F.count_if(F.col("score") > high), F.count_if(F.col("score").between(low, high))).first()
        if above >= wanted and high < most:
            low, high, step = high, min(high + step, most), 2 * step
        elif above + inside < wanted and low > least:
            low, high, step = max(low - step, least), low, 2 * step
        else:
            return low, high, above


def places(rows: DataFrame, tag: str) -> tuple[DataFrame, dict[int, int]]:
    """``rows`` written in ``ORDER``, with ``_at`` (partition and place in it), and how many rows come before each partition."""
    ordered = rows.repartitionByRange(*ORDER).sortWithinPartitions(*ORDER).withColumn("_at", F.monotonically_increasing_id())
    ordered = materialize(ordered, tag)
    parts, before, total = ordered.groupBy(F.shiftright("_at", 33).alias("p")).agg(F.count("*").alias("n")).orderBy("p").collect(), {}, 0  # one row a partition
    for p, n in parts:
        before[p], total = total, total + n
    return ordered, before


def place(before: dict[int, int]) -> Column:
    """Place from 0 over all partitions."""
    start = F.create_map(*[F.lit(x) for pair in before.items() for x in pair])
    return F.element_at(start, F.shiftright("_at", 33)) + F.col("_at").bitwiseAND((1 << 33) - 1)


def resample(documents: DataFrame, target: DataFrame, percent: int = 10, least_words: int = 20, size: int = 10_000, longest: int = 1, seed: int = 2024) -> DataFrame:
    """(doc_id, n_features, weight, score, rank): every document, and the rank of those that are drawn: ``percent`` of the documents with ``least_words`` words or more."""
    rows = scored(documents, target, size, longest, seed)
    rows = rows.withColumns({"_down": -F.col("score"), "_none": F.isnull("doc_id")})
    enough = F.col("_words") >= least_words
    n = rows.filter(enough).count()
    wanted = percent * n // 100
    columns = ["doc_id", "n_features", "weight", "score"]
    if not wanted:
        return rows.select(*columns, F.lit(None).cast("long").alias("rank"))
    low, high, above = bracket(rows.filter(enough), wanted, n)
    inside, before = places(rows.filter(enough & F.col("score").between(low, high)).select(*ORDER, "score", "weight"), "resample-bracket")
    last = inside.filter(place(before) == wanted - above - 1).first()
    release(inside)
    key = lambda of: F.struct(*[of(c).alias(c) for c in ORDER])
    kinds = dict(rows.dtypes)
    # nulls of an id come after others by _none, so comparing structs is the order
    drawn = enough & (key(F.col) <= key(lambda c: F.lit(last[c]).cast(kinds[c])))
    ranked, starts = places(rows.filter(drawn).select(*ORDER, "score", "weight"), "resample-drawn")
    ranks = ranked.select(*columns, (place(starts) + 1).cast("long").alias("rank"))
    return ranks.unionByName(rows.filter(~drawn).select(*columns, F.lit(None).cast("long").alias("rank")))
