"""The corpus pipeline: stages over ``documents``, each written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orderflux.llm import decontaminate, line_dedup, mixing, quality, simhash
from orderflux.llm.common import removed, table, written


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted on the labelled ones, does not reject."""
    return quality.accepted(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def clean_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later occurrences of three-line windows; ``n_chars`` follows the text."""
    cut = line_dedup.dedup_lines(docs)
    return cut.withColumn("n_chars", F.length("text").cast("bigint")) if "n_chars" in cut.columns else cut


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of near copies.

    The SimHash operator with the shingle length and the bit distance of its contract, which are its defaults.
    """
    return simhash.keep_one(docs, radius=simhash.RADIUS, shingle=simhash.SHINGLE)


def clean_of_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that do not hold a benchmark item."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mixed(docs)


STAGES = [
    ("quality classifier", good_documents),
    ("line dedup", clean_lines),
    ("SimHash near-dedup", distinct_documents),
    ("benchmark decontamination", clean_of_benchmark),
    ("source mixing", mixed_sources),
]

#: Trained models and random choices have no SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, folder = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES:
        docs, done = written(stage(spark, docs, sf_dir))
        if folder:
            removed(spark, folder)
        folder = done
    return docs
