"""What several operators share: intermediate tables, training folds and bounded samples."""

from __future__ import annotations

import tempfile
import uuid
from weakref import WeakKeyDictionary

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space: what separates words in every contract of this package.
SPACES = "\\x20\\x09-\\x0D"
WORD = f"[^{SPACES}]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` as the session has it.

    Only where it is unset (single-machine sessions, as in tests) a temporary folder is made and set.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="peerlight-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, tag: str) -> str:
    """A path in the shared folder that no other call has."""
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder once and read it back: lineage ends there and a lost executor costs nothing."""
    path = new_path(df.sparkSession, tag)
    small_batches(df).write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _PATHS[out] = path
    return out


#: Where the tables that are in use have been written.
_PATHS: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def release(*written: DataFrame) -> None:
    """Delete tables of ``materialize`` that nothing will read any more."""
    for df in written:
        spark, path = df.sparkSession, _PATHS.pop(df)
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


#: Rows of an Arrow batch: texts can be long, so a batch is small.
BATCH_ROWS = 400


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, after the session's Arrow batches have been bounded for rows that hold texts."""
    if int(df.sparkSession.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: Column, parts: int) -> Column:
    """``crc32(doc_id as text) mod parts``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % parts


def bounded_sample(rows: DataFrame, key: Column, group: str, bound: int, seed: int = 17) -> DataFrame:
    """About ``bound`` rows of each value of ``group`` at most, picked by a seeded 62-bit hash of ``key``.

    The share to keep follows from one count per value, so nothing is sorted or gathered.
    """
    steps = 1 << 62
    limit = {g: steps if n <= bound else steps * bound // n for g, n in rows.groupBy(group).count().collect() if g is not None}
    if not limit:
        return rows.limit(0)
    return rows.filter(F.shiftrightunsigned(F.xxhash64(key, F.lit(seed)), 2) < F.create_map(*[F.lit(x) for g, n in limit.items() for x in (g, n)])[F.col(group)])


def labelled(documents: DataFrame, labels: DataFrame, label: str, held_out: Column, bound: int) -> DataFrame:
    """(doc_id, text, y) of about ``bound`` labelled documents of each class outside the held-out fold.

    A document that is labelled twice counts once with its larger label, rows that repeat an id count each.  The sampled ids are at most
    ``bound`` a class, so that side is small enough for a broadcast whatever the size of the corpus; so is what they name, for the bound
    holds for its rows as well.
    """
    known = (
        labels.select("doc_id", F.col(label).cast("int").alias("y"))
        .filter(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1))
        .groupBy("doc_id").agg(F.max("y").alias("y"))
        .filter(~held_out)
    )
    picked = bounded_sample(known, F.col("doc_id"), "y", bound)
    named = documents.select("doc_id", "text").join(F.broadcast(picked), "doc_id").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "y")
    named = materialize(named, "labelled")
    return bounded_sample(named, F.concat_ws(":", "doc_id", "text"), "y", 2 * bound)
