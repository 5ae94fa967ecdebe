"""A corpus pipeline: each stage calls one operator of ``mediashelf.llm`` on all its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from mediashelf.llm import exact_dedup, near_dedup, pieces, quality
from mediashelf.llm.common import staged
from mediashelf.llm.queries import mix_documents, quality_model


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier takes for good; the others go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.keep_good(docs, quality_model(docs, labels))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts the one with the largest id."""
    return exact_dedup.without_copies(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five words, 0.8): the smallest id."""
    return near_dedup.one_of_each(docs)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture: a document of a leaf with more budget than tokens comes once per epoch."""
    return mix_documents(docs).select(*docs.columns)


def piece_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with its ids and the text that they decode to."""
    return pieces.with_ids(docs, remembered=200_000, rows=512)


STAGES = [
    ("quality classifier", quality_stage),
    ("exact dedup", exact_stage),
    ("MinHash near-dedup", near_stage),
    ("mixing sources to target weights", mix_stage),
    ("SentencePiece encoding and decoding", piece_stage),
]

# classifier, near-duplicates and ids have no SQL; tests compare every stage with a plain version
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each one's result written as Parquet and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), name.split()[0].lower())
    return docs
