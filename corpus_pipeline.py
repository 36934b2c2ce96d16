"""From raw documents to packed training sequences: five stages over the documents table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier rejects go; it learns from the labels of these documents."""
    from verba.llm.cotraining import good_documents

    return good_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    from verba.llm.simhash import keep_one

    return keep_one(docs, shingle=3, max_bits=3)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 200 bytes or more that repeat anywhere are cut out of the texts; all documents stay."""
    from verba.llm.suffix import texts_without_repeats

    return texts_without_repeats(docs, min_len=200)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target share takes them."""
    from verba.llm.mixing import mixed

    return mixed(docs, weights=(1, 2, 3), cap=3.0, seed=42)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of at most 2048: one row for each piece of a document."""
    from verba.llm.packing import pack
    from verba.llm.queries import vocabulary

    return pack(docs, vocabulary(), size=2048, end_id=1)


STAGES = [
    ("quality classifier", quality_classifier),
    ("simhash near-dedup", simhash_near_dedup),
    ("suffix-array dedup", suffix_array_dedup),
    ("mixing", mix_sources),
    ("packing", packing),
]

ORACLE_SQL = None  # the stages hash, train and tokenize in ways that SQL cannot express


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents; each stage's rows are written as Parquet and read again. What a stage
    wrote on its way goes once its rows are there, and its rows once the next stage's are."""
    from verba.llm.common import discard, scratch, shared_path, written

    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for k, (_, stage) in enumerate(STAGES[:-1]):
        path = shared_path(spark, f"stage{k}")
        with scratch(spark):
            docs = written(stage(spark, docs, sf_dir), f"stage{k}", path)
        if before:
            discard(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
