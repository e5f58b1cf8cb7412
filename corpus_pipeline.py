"""A corpus from raw documents to token files: classify, de-duplicate, decontaminate, mix, encode.

Each stage takes (spark, docs, sf_dir), works on all documents that the stage before kept, and its
result is written as Parquet and read back as the next one's ``docs``. All but the last return the
columns of ``documents``.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontamination, importance, jaccard, mixing, token_files
from tidemark.llm.data import table
from tidemark.llm.storage import fresh_path, written

#: Beyond so many dropped ids they are joined by a shuffle and not broadcast.
BROADCAST_ROWS = 1_000_000


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling rejects go."""
    return importance.resample(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates the document with the least id stays."""
    return jaccard.representatives(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with words of a benchmark window go. They are known by id and text, so that null
    and repeated ids are told apart."""
    named = docs.withColumn("_text_hash", F.xxhash64("text"))
    found = decontamination.hits(named.select("doc_id", "text", "_text_hash"), table(spark, sf_dir, "benchmark"), keep=("_text_hash",))
    gone = written(found.filter(F.size("spans") > 0).select(F.col("doc_id").alias("_gone"), F.col("_text_hash").alias("_gone_hash")).distinct(), "contaminated")
    hint = F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone
    return named.join(hint, named["doc_id"].eqNullSafe(gone["_gone"]) & (named["_text_hash"] == gone["_gone_hash"]), "left_anti").select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each time a document is taken, in training order; the last taking of a source may
    end within a document, whose text is cut there. Other columns stay as they are."""
    return mixing.mixed(docs)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files in the order of ``docs`` (its files, and rows within them), read back."""
    return token_files.digest(spark, *token_files.encode_in_file_order(docs, token_files.vocabulary()))


STAGES = [
    ("quality classifier", quality_classifier),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontaminate),
    ("mixing sources to target weights", mix),
    ("token-ID / binary output", token_output),
]

#: SQL has no tokenizer and no n-gram models; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            path = fresh_path(spark, f"stage-{i}")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
