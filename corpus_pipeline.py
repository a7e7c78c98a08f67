"""A training corpus from ``documents``: five stages, each written as Parquet and read again as the next one's input.

1. language: documents without a determinable language go (no letters, or hardly an n-gram that any language has).
2. near_duplicates: of each group of linked documents one row stays, that with the smallest id.
3. personal_data: every span is replaced by its kind, disclosing terms are generalised or removed.
4. mixing: each document as often as its source's rate says.
5. packing: the pieces of all documents and their places in sequences of 1024 tokens.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from peerlight.llm import jaccard, language, mixing, packing, pii
from peerlight.llm.common import materialize, release

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A document stays if its best language has at least this share of its n-grams.
KNOWN_SHARE = 0.05


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told.  Learns from ``docs`` itself.

    Null texts, empty ones and those without a letter go; null ids, sources and other nulls stay as they are, so do repeated rows.  If no row has a
    language, nothing can be told and all rows go.  Long texts are read whole.  Columns beyond those of documents are dropped.
    """
    model = language.train(docs)
    return language.predict(docs.select(*COLUMNS), model).filter((F.col("lang_pred") != "und") & (F.col("known") >= KNOWN_SHARE)).select(*COLUMNS)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows are told apart by a hash of all columns, not by id: rows that share an id or have none are compared like any others.

    Of each component one row stays, that with the smallest id, and rows without an id only where no other has one.  Rows that are equal in all columns stay once.
    Null and empty texts are like no other, each stays.
    """
    rows = docs.select(*COLUMNS).withColumn("_row", F.xxhash64(*COLUMNS, *[F.isnull(c) for c in COLUMNS]))
    groups = jaccard.join(rows.select(F.col("_row").alias("doc_id"), "text")).select(F.col("doc_id").alias("_row"), "component_id").distinct()
    named = groups.join(rows.select("_row", "doc_id").distinct(), "_row")
    first = F.min(F.struct(F.isnull("doc_id").alias("_none"), "doc_id", "_row"))
    stays = named.groupBy("component_id").agg(first.alias("_first")).select("_first._row")
    # both steps go by the row's hash, so that texts are shuffled once
    return rows.join(stays, "_row", "left_semi").dropDuplicates(["_row", *COLUMNS]).select(*COLUMNS)


def personal_data_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced and ``n_chars`` anew.  Null texts stay null, rows that repeat stay."""
    return pii.sanitize(docs.select(*COLUMNS)).select(*COLUMNS)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's rate says.  A null source is a source; documents without words are taken as often as others of their source."""
    return mixing.emit(docs.select(*COLUMNS))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, null texts as one end token; copies of a document are pieces of their own."""
    return packing.pack(docs, capacity=1024)


STAGES = [
    ("language", language_stage),
    ("near_duplicates", near_duplicate_stage),
    ("personal_data", personal_data_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]
#: SQL can't express language identification or tokens; tests/llm holds each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the last stage; what a stage has read is deleted once its result is written."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = materialize(docs, f"stage-{name}")
            if before is not None:
                release(before)
            before = docs
    return docs
