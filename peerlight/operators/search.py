"""Search of a text in the fields of a table through an index of pieces of three characters.

A row holds a query as a substring only if it holds every piece of it.  The index has a row for each (piece, key), in folders by a hash of the piece, so that a query reads the folders
of its own pieces, and how many rows each piece has.  Of a query's pieces the rarest few are read and their rows met; what is left is verified on the row itself, so the result
is that of a scan (``filters.search_text``).  Queries shorter than a piece scan.

Cases: null fields are left out of a row's text.  Rows that share a key are found each.  An empty query finds every row, as the scan does.  A very frequent piece is many rows of the index, never one list.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import filters

SIZE, BUCKETS = 3, 64
#: Pieces of a query that are looked up.
MOST_PIECES = 4


def row_text(columns: tuple[str, ...]) -> Column:
    return F.lower(F.concat_ws(" ", *columns))


def pieces(text: Column) -> Column:
    """The distinct pieces of a text, in the order in which they begin."""
    return F.when(F.length(text) >= SIZE, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(text) - SIZE + 1), lambda i: F.substring(text, i, F.lit(SIZE))))).otherwise(F.array().cast("array<string>"))


def _bucket(piece: Column) -> Column:
    return (F.crc32(piece.cast("binary")) % BUCKETS).cast("int")


def _postings(df: DataFrame, key: str, path: str) -> DataFrame:
    return df.sparkSession.read.schema(f"key {dict(df.dtypes)[key]}, piece string, bucket int").parquet(f"{path}/postings")


def write_index(df: DataFrame, key: str, path: str, columns: tuple[str, ...] | None = None) -> None:
    """Writes the postings of ``df`` and how many rows each piece has, in place of what was there."""
    columns = filters.searched(df) if columns is None else columns
    each = df.select(F.col(key).alias("key"), F.explode(pieces(row_text(columns))).alias("piece")).withColumn("bucket", _bucket(F.col("piece")))
    # rows of a piece stand together in their folder; a frequent one is spread over several files
    dealt = each.repartition("bucket", F.pmod(F.xxhash64("key"), F.lit(8))).sortWithinPartitions("bucket", "piece")
    dealt.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings")
    _postings(df, key, path).groupBy("bucket", "piece").agg(F.count("*").alias("n")).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/counts")


def candidates(df: DataFrame, key: str, path: str, query: str) -> DataFrame | None:
    """(key) of the rows that have the rarest pieces of a query; None where the query is shorter than a piece."""
    spark = df.sparkSession
    text = F.lower(F.lit(query.strip()))
    wanted = spark.range(1).select(F.explode(pieces(text)).alias("piece")).select("piece", _bucket(F.col("piece")).alias("bucket")).collect()
    if not wanted:
        return None
    these = lambda part, rows: part.filter(F.col("bucket").isin(sorted({r.bucket for r in rows})) & F.col("piece").isin([r.piece for r in rows]))
    known = {r.piece: r.n for r in these(spark.read.schema("piece string, n long, bucket int").parquet(f"{path}/counts"), wanted).collect()}  # a row a piece of the query
    if len(known) < len(wanted):
        return _postings(df, key, path).select("key").limit(0)
    rarest = sorted(wanted, key=lambda r: (known[r.piece], r.piece))[:MOST_PIECES]
    found = these(_postings(df, key, path), rarest)
    return found.groupBy("key").agg(F.count_distinct("piece").alias("n")).filter(F.col("n") == len(rarest)).select("key")


def search_indexed(df: DataFrame, key: str, path: str, query: str, columns: tuple[str, ...] | None = None) -> DataFrame:
    """The rows of ``df`` that ``filters.search_text`` keeps, by an index that ``write_index`` has written of it."""
    columns = filters.searched(df) if columns is None else columns
    found = candidates(df, key, path, query)
    rows = df if found is None else df.join(found.select(F.col("key").alias("_key")), F.col(key) == F.col("_key"), "left_semi")
    return rows.filter(filters.search_text(query, columns))
