"""From raw documents to token ids: junk goes, copies and near copies go, sources are mixed, texts are encoded."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadq.llm import bpe, exact_dedup, mixing, ngram_join, quality, queries
from leadq.session import new_folder


#: Pre-tokens that a worker remembers here, where it still holds what earlier stages left in it. No result depends on it.
REMEMBERED = 120_000
#: Bytes of rows that are sent to a Python worker at once, about; both sides hold them. No result depends on it.
SENT = "2m"


def sparing(docs: DataFrame) -> DataFrame:
    """`docs`, whose rows go to Python workers in small batches from here on: all stages share the memory of one session's executors."""
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", SENT)
    return docs


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that a scorer, trained on the labellers' agreement on these documents, holds for good."""
    return quality.keep_good(sparing(docs))


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id."""
    return exact_dedup.drop_duplicates(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest doc_id."""
    return ngram_join.keep_one(sparing(docs))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each time the mix takes a document; at a source's cut, the first words of one. n_chars is that of the row's text."""
    return mixing.take(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit integers) of every row, and digests of the ids and of what they decode to."""
    return bpe.digests(sparing(docs), queries.codec(REMEMBERED), with_ids=True).select("doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256")


STAGES = [
    ("quality classifier", quality_classifier),
    ("exact dedup", exact_duplicates),
    ("n-gram Jaccard join", near_duplicates),
    ("mixing sources to target weights", source_mix),
    ("byte-level BPE encoding and decoding", token_ids),
]

#: No SQL can train the classifier, compare n-gram sets or encode; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder. Each stage's rows are written to the shared folder and read again, so a lost
    executor repeats a part of one stage only."""
    docs, setting = spark.read.parquet(f"{sf_dir}/documents.parquet"), "spark.sql.execution.arrow.maxBytesPerBatch"
    was = spark.conf.get(setting)
    try:
        for name, stage in STAGES:
            path = new_folder(spark, name.split()[0])
            stage(spark, docs, sf_dir).write.parquet(path)
            docs = spark.read.parquet(path)
    finally:
        spark.conf.set(setting, was)
    return docs
