"""The training-data pipeline over ``documents``: quality, line dedup, near-dedup, mixing, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillgraph.llm import line_dedup, mixing, packing, quality, simhash
from quillgraph.llm.common import materialise


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go, each judged by its own text. Null, empty and blank texts stay, as do
    languages without trusted documents."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that come again go: exactly, or within two edits if they have 20 characters; every document stays, also with a null
    id or text. Rows that repeat id and text are one document."""
    return line_dedup.drop_repeated_lines(docs, chars_col="n_chars")


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that of the smallest id, null last: sets of five-word shingles at a
    Jaccard similarity of 0.8 or more. Texts without words are alike."""
    return simhash.keep_similar(docs, similarity=0.8, size=5)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, ordered in blocks of sources in proportion to the target weights of those that have any left. A null
    source is a source of its own."""
    return mixing.mix_all(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in the training sequences, which are numbered so that they follow the order that the
    documents were mixed in; a null or empty text is a piece of one id."""
    return packing.pack_documents(docs, in_turn=True)


STAGES = [
    ("quality classifier", quality_stage),
    ("line dedup", line_dedup_stage),
    ("simhash near-dedup", near_dedup_stage),
    ("source mixing", mixing_stage),
    ("best-fit packing", packing_stage),
]

#: Kneser-Ney training, fingerprints and tokens are beyond SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage returns is written before the next reads it. Extra columns pass through all
    stages but the last, whatever their names; an empty table gives an empty result."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialise(docs, f"stage{k}")
    return docs
