"""The corpus pipeline: quality rules, line dedup, near-dedup, mixing, packing.

Each stage works on what the one before has kept. The first four return the columns of documents; the last returns
packed sequences, a row for each piece of a document. `run` owns the tables that its stages leave and deletes each stage's once the next has been written; a stage that is called alone leaves the few narrow ones that its
result reads, since only the caller knows when it has been read. SQL can't express the near-duplicate and packing stages, so there is no ORACLE_SQL; the tests hold the stages against plain versions.

Defined cases, for every stage: null ids, languages and sources are values like any other; null and empty texts, and texts without a word, fail the quality rules and so end there (a later
stage that is called alone passes them on: without lines, near each other only, without tokens, the end id alone); very long texts are read whole, by
one task each; of repeated rows near-dedup keeps one; ties go to the smaller id; an empty table gives no rows; further columns stay as they are, whatever their names, up to the
packing, which has columns of its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from capsift.llm import common, lines, mixing, packing, quality, simhash

ORACLE_SQL = None


def _counted(docs: DataFrame, columns: list[str]) -> DataFrame:
    """n_chars follows the text."""
    if "n_chars" in columns:
        docs = docs.withColumn("n_chars", F.length("text").cast("long"))
    return docs.select(*columns)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that weak supervision takes for good."""
    return quality.filter_quality(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines go that equal an earlier line or are one word's edit from one."""
    return _counted(lines.dedup_lines(docs).select(*docs.columns), docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: SimHash prunes, and of their five-word shingles 0.8 or more are common."""
    return simhash.drop_near_duplicates(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many tokens as come in, shared out among domains, languages and sources by weight; a document comes once for each epoch that takes it."""
    mixed = mixing.mix_default(docs)
    return _counted(mixed.withColumn("text", mixing.taken_text()), docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in sequences of at most 2048 tokens."""
    return packing.pack(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("mix_sources", mix_sources),
    ("pack_sequences", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in STAGES:
        result, written = stage(spark, docs, sf_dir), []
        with common.noted(written):
            docs = common.materialize(result, name)
        for path in last:  # what this stage has read
            common.remove(spark, path)
        last = written
    return docs
