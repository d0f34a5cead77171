"""A corpus pipeline of five stages, each calling one operator.

quality classifier, line dedup, n-gram Jaccard join, PII, packing.  A stage
takes (spark, docs, sf_dir) and works on all that its predecessor kept; its
result is written as Parquet and read again as the next one's input.  All but
the last return the columns of ``documents``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runnel.llm import line_dedup, near_join, packing, pii, quality, registry
from runnel.llm.common import shared_dir

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _as_documents(rows: DataFrame) -> DataFrame:
    """The columns of ``documents``, with n_chars of the present text."""
    return rows.withColumn("n_chars", F.length("text").cast("bigint")).select(*COLUMNS)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    kept = quality.filter_quality(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return kept.select(*COLUMNS)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go; so do documents of which nothing but blank lines is left."""
    rows = line_dedup.dedup_lines(docs.select(*COLUMNS))
    left = (F.col("n_dropped") == 0) | (F.trim(F.regexp_replace("text", r"\s+", " ")) != "")
    return _as_documents(rows.where(left))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: five words, 0.8."""
    return near_join.keep_one(docs.select(*COLUMNS), n=5, percent=80).select(*COLUMNS)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data are replaced by their kinds."""
    return _as_documents(pii.redact(docs.select(*COLUMNS)))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their sequences and offsets."""
    return packing.pack(docs.select(*COLUMNS), registry.tokenizer_path("word_bpe_49k.json"))


STAGES = [
    ("quality classifier", quality_stage),
    ("line dedup", line_stage),
    ("n-gram Jaccard join", near_stage),
    ("PII", pii_stage),
    ("packing", packing_stage),
]

#: Trained scores, MinHash components and tokenisation have no SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``, with a table in the shared folder after each.

    Null and empty texts, repeated rows and empty tables are each operator's:
    null texts stay null until they are packed as empty ones.  The last table
    is the result and stays; the others go when their successor is written.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    done = ""
    for i, (_, stage) in enumerate(STAGES):
        out = f"{folder}/{i}"
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
        if done:
            _delete(spark, done)
        done = out
    return docs


def _delete(spark: SparkSession, path: str) -> None:
    """Remove one of run()'s own tables, wherever Spark keeps it."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
