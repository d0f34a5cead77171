"""Queries of the corpus operators.

None has SQL here: tokenisation, checksummed spans with offsets, tree scoring,
trained models, approximate search, images, packing and components are tested
against brute force, exact round trips or held-out accuracy instead.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, html_extract, line_dedup, media, near_join, packing, pii, quality, secrets, sentencepiece_fst

Query = Callable[[SparkSession, str], DataFrame]


def tokenizer_path(name: str) -> str:
    """Where a public vocabulary file is installed."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _documents(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/documents.parquet")


def op1_sentencepiece(spark: SparkSession, d: str) -> DataFrame:
    """Encode every text with the 32k piece model, and decode it again."""
    with open(tokenizer_path("piece_bpe_32k.model"), "rb") as f:
        model = f.read()
    return sentencepiece_fst.encode(_documents(spark, d), model)


def op2_pii(spark: SparkSession, d: str) -> DataFrame:
    return pii.digest(_documents(spark, d))


def op3_html_extraction(spark: SparkSession, d: str) -> DataFrame:
    return html_extract.extract(spark.read.parquet(f"{d}/pages.parquet"))


def op4_ngram_jaccard_join(spark: SparkSession, d: str) -> DataFrame:
    return near_join.near_duplicates(_documents(spark, d))


def op5_nearest_neighbours(spark: SparkSession, d: str) -> DataFrame:
    vectors = spark.read.parquet(f"{d}/embeddings.parquet")
    return ann.search(vectors, vectors.where("vec_id % 20 = 0"), k=20)


def op6_quality_classifier(spark: SparkSession, d: str) -> DataFrame:
    docs = _documents(spark, d)
    model = quality.train(docs, spark.read.parquet(f"{d}/labels.parquet"))
    scored = quality.score(docs, model)
    return scored.select("doc_id", quality.held_out().alias("held_out"), "score", (scored["score"] >= 0.5).cast("int").alias("predicted"))


def op7_media_columns(spark: SparkSession, d: str) -> DataFrame:
    return media.text_media(_documents(spark, d))


def op8_packing(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(_documents(spark, d), tokenizer_path("word_bpe_49k.json"))


def op9_line_dedup(spark: SparkSession, d: str) -> DataFrame:
    return line_dedup.dedup_lines(_documents(spark, d)).select("doc_id", "text", "n_lines", "n_dropped")


def op10_secret_scan(spark: SparkSession, d: str) -> DataFrame:
    """A source is an owner, what it has in one language a repository."""
    return secrets.find_secrets(_documents(spark, d), repo=F.concat_ws("/", "source", "lang"), owner="source")


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_sentencepiece, op2_pii, op3_html_extraction, op4_ngram_jaccard_join, op5_nearest_neighbours,
        op6_quality_classifier, op7_media_columns, op8_packing, op9_line_dedup, op10_secret_scan,
    )
}
ORACLES: dict[str, str] = {}
