"""Sources and sinks: JSON documents and chunks, CSV look-ups, chunked and tabular output, incremental refresh."""

from __future__ import annotations

import json
import re
import tempfile
import uuid
from collections.abc import Callable
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset, as on one machine, a temporary folder."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="peerlight-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: Where the tables that are in use have been written.
_PATHS: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def checkpointed(df: DataFrame) -> DataFrame:
    """Written to the shared folder and read back, so that loops don't grow their lineage and lost executors cost nothing."""
    path = f"{shared_folder(df.sparkSession)}/step-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _PATHS[out] = path
    return out


def discard(*written: DataFrame) -> None:
    """Deletes tables of ``checkpointed`` that nothing will read any more; others are left alone."""
    for df in written:
        if path := _PATHS.pop(df, None):
            where = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def read_record_document(spark: SparkSession, path: str, fields: T.StructType) -> DataFrame:
    """Rows of a JSON document, an object with a ``records`` array or a bare array, with their position as ``ordinal``; anything else is an error.

    Elements that aren't objects are dropped.
    """
    return _records(spark.read.option("recursiveFileLookup", True).text(path, wholetext=True), fields)


def _records(raw: DataFrame, fields: T.StructType, *keep: str, position: str = "ordinal") -> DataFrame:
    array = F.coalesce(F.get_json_object("value", "$.records"), F.col("value"))
    items = F.from_json(array, T.ArrayType(T.StringType()))
    checked = F.when(items.isNotNull(), items).otherwise(F.raise_error(F.lit("expected an array or an object with a records array")).cast("array<string>"))
    each = raw.select(*keep, F.posexplode(checked).alias(position, "item")).filter(F.trim("item").startswith("{"))
    return each.select(position, *keep, F.from_json("item", fields).alias("r")).select(position, *keep, "r.*")


def _uri(spark: SparkSession, path: str) -> str:
    """A path as Spark names it in the metadata of the rows that it reads."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return re.sub("^file:/+", "file:///", p.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(p).toUri().toString())


def read_manifest_chunks(spark: SparkSession, folder: str, manifest: str, fields: T.StructType) -> DataFrame:
    """Rows of the chunks that a manifest lists, in its order (``chunk``, ``position``); records inside the manifest win if there are any.

    A chunk is known by its path below the folder, whether a file or a folder of one file; files that the manifest doesn't list aren't read as chunks.
    """
    text = spark.read.text(f"{folder}/{manifest}", wholetext=True).first()[0]
    document = json.loads(text)
    if document.get("records"):
        return _records(spark.read.text(f"{folder}/{manifest}", wholetext=True), fields, position="position").withColumn("chunk", F.lit(0))
    names = [n.strip("/") for n in document.get("data_files", {}).get("record_chunks", [])]
    if not names:
        return spark.createDataFrame([], T.StructType([*fields.fields, T.StructField("position", T.IntegerType()), T.StructField("chunk", T.IntegerType())]))
    base = _uri(spark, folder).rstrip("/")
    escaped = lambda n: _uri(spark, f"{folder}/{n}") if re.search(r"[^\w./=-]", n) else f"{base}/{n}"
    # one scan of the folders that hold chunks, and one equality join, however many chunks there are
    roots = sorted({f"{folder}/{n.split('/')[0]}" for n in names})
    texts = spark.read.option("recursiveFileLookup", True).text(roots, wholetext=True).select("value", F.regexp_replace("_metadata.file_path", "^file:/+", "file:///").alias("_path"))
    chunks = spark.createDataFrame([(i, escaped(n)) for i, n in enumerate(names)], "chunk int, _name string")
    both = texts.withColumn("_name", F.explode(F.array("_path", F.regexp_replace("_path", "/[^/]*$", ""))))
    return _records(both.join(chunks, "_name"), fields, "chunk", position="position")


def read_csv_lookup(spark: SparkSession, path: str, columns: tuple[str, ...]) -> DataFrame:
    """A CSV with a header, all strings, blank as null; a missing file is an empty table."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    rows = spark.read.csv(path, header=True)
    return rows.select(*[(F.nullif(F.trim(F.col(c)), F.lit("")) if c in rows.columns else F.lit(None).cast("string")).alias(c) for c in columns])


# The columns of the slim output, in order.
SLIM_COLUMNS = (
    "office_no", "municipality", "corporation_type_label", "corporation_number", "corporation_name", "representative_name", "representative_role", "representative_raw", "representative_source_url",
    "representative_fetch_status", "office_name", "response_status", "remarks", "capacity", "average_daily_users", "average_wage_yen", "average_wage_error", "daily_user_capacity_ratio",
    "ratio_to_overall_mean", "ratio_to_municipality_mean", "ratio_to_type_mean", "ratio_to_capacity_band_mean", "z_score", "wage_outlier_flag", "wage_outlier_severity",
    "wage_band_label", "capacity_band_label", "market_position_quadrant", "is_new_office", "home_use_active", "home_use_user_ratio_decimal", "home_use_user_ratio_pct", "noufuku_active",
    "dir_match_status", "dir_match_confidence", "dir_fetch_status", "dir_office_number", "dir_office_url", "homepage_url", "homepage_source", "homepage_confidence",
    "profile_url", "profile_source", "profile_confidence", "dir_office_phone", "dir_office_address_city", "dir_office_address_line", "dir_office_capacity", "dir_primary_activity_type",
    "dir_primary_activity_detail", "dir_transport_available", "dir_meal_support_addon", "dir_regional_collaboration_addon", "dir_manager_multi_post", "dir_welfare_staff_fte_total",
    "dir_key_staff_fte_per_capacity", "dir_staffing_quadrant", "dir_staffing_outlier_flag", "dir_staffing_outlier_severity", "dir_average_wage_monthly_yen", "dir_average_wage_gap", "dir_service_manager_fte",
)


def slim_projection(df: DataFrame, columns: tuple[str, ...] = SLIM_COLUMNS) -> DataFrame:
    """The columns in order; null where one is absent."""
    return df.select(*[F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in columns])


def chunk_numbers(df: DataFrame, order: str, size: int = 250) -> DataFrame:
    """Adds ``chunk`` = floor((row number - 1) / size) in the order of a unique column.

    Rows are range-partitioned; the number of rows before each partition comes from one count per partition, so that no single task
    numbers all rows.
    """
    parts = df.repartitionByRange(order).withColumn("_part", F.spark_partition_id())
    parts = checkpointed(parts)
    before = parts.groupBy("_part").agg(F.count("*").alias("_n")).select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(order))
    return parts.join(F.broadcast(before), "_part").withColumn("chunk", F.floor((F.col("_before") + inside - 1) / size)).drop("_part", "_before")


MANIFEST = "manifest.json"


def _publish(spark: SparkSession, path: str, text: str) -> None:
    """Puts a file in place of what is there, in one step."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    target, draft = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}")
    system = target.getFileSystem(conf)
    out = system.create(draft, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    option = jvm.org.apache.hadoop.fs.Options.Rename
    over = spark.sparkContext._gateway.new_array(option, 1)
    over[0] = option.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(system.getUri(), conf).rename(system.makeQualified(draft), system.makeQualified(target), over)


def write_chunks(df: DataFrame, path: str, order: str, size: int = 250) -> DataFrame:
    """Writes documents of ``size`` rows each, an object with ``records``, and then the manifest that ``read_manifest_chunks`` reads; gives (chunk, count).

    Chunks go to a folder of their own, and the manifest with their list takes the place of the old one only when all of them are there; then older chunks are deleted.  A
    run that fails leaves the old manifest and its chunks.
    """
    spark, path = df.sparkSession, path.rstrip("/")
    numbered = checkpointed(chunk_numbers(df, order, size))
    item = F.struct(*[F.col(c) for c in df.columns])
    # a chunk is a bounded number of rows
    rows = numbered.groupBy("chunk").agg(F.transform(F.sort_array(F.collect_list(F.struct(F.col(order).alias("_order"), item.alias("r")))), lambda x: x["r"]).alias("records"))
    data = f"data-{uuid.uuid4().hex}"
    rows.select("chunk", F.to_json(F.struct("records")).alias("value")).write.partitionBy("chunk").text(f"{path}/{data}")
    made = numbered.groupBy("chunk").agg(F.count("*").alias("count"))
    chunks = checkpointed(made)
    n, total = chunks.agg(F.count("*"), F.coalesce(F.sum("count"), F.lit(0))).first()
    if not n:  # an empty table has no chunk
        spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(spark._jvm.org.apache.hadoop.fs.Path(path))
    names = [f"{data}/chunk={i}" for i in range(n)]  # numbers have no gaps
    _publish(spark, f"{path}/{MANIFEST}", json.dumps({"data_files": {"record_chunks": names, "record_count": total, "chunk_size": size}}))
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    for f in system.listStatus(folder):
        if f.getPath().getName().startswith("data-") and f.getPath().getName() != data:
            system.delete(f.getPath(), True)
    discard(numbered)
    return chunks


def write_table_outputs(df: DataFrame, path: str, report: DataFrame | None = None, summary: DataFrame | None = None) -> None:
    """The table as JSON lines and as CSV with a header; the match report as CSV, and the summary (block, label, count) as one JSON object of blocks, if given."""
    df.write.mode("overwrite").json(f"{path}/json")
    df.write.mode("overwrite").option("header", True).csv(f"{path}/csv")
    if report is not None:
        report.write.mode("overwrite").option("header", True).csv(f"{path}/report")
    if summary is not None:  # a handful of counts
        blocks = summary.groupBy("block").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("label", "count")))).alias("counts"))
        rows = sorted(blocks.select("block", F.to_json("counts").alias("counts")).collect())
        _publish(df.sparkSession, f"{path}/summary.json", "{" + ", ".join(f"{json.dumps(b)}: {c}" for b, c in rows) + "}")


def incremental_refresh(stored: DataFrame, wanted: DataFrame, key: str, process: Callable[[DataFrame], DataFrame], force: bool = False) -> DataFrame:
    """Stored rows of the wanted keys, and what ``process`` makes of the keys that have none (of all with ``force``)."""
    if force:
        return process(wanted)
    new = process(wanted.join(stored.select(key), key, "left_anti"))
    return stored.join(wanted.select(key).distinct(), key, "left_semi").unionByName(new.select(*stored.columns))
