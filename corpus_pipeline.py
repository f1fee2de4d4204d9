"""The corpus pipeline: documents in, packed sequences out. Each stage works on what the one before kept.

Null and blank texts fail the quality rules, so none enters the later stages; documents that line or suffix dedup
leaves without a word go in the stage after it or in the same one, and no blank text is packed. Null ids are ids. Rows that
repeat id and text are one document from the Jaccard join on, and of documents alike the one with the smallest id stays.
Additional columns travel along to the last stage. An empty table gives no rows.
"""

from __future__ import annotations

import sys
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent))

from textforge.llm import lines, near, packing, quality, suffixes  # noqa: E402
from textforge.llm.common import materialise  # noqa: E402


#: Bytes of a repeated passage: shorter than the 400 of the operator's own query, so that passages of some 50 words go too.
PASSAGE = 256


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule or their group's adaptive fences reject go."""
    return quality.filter_quality(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated runs of lines go from the texts; every document stays."""
    return _counted(lines.drop_repeated_runs(docs))


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays; those that line dedup left without a word go."""
    return near.keep_one(_worded(docs))


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of ``PASSAGE`` bytes that occur elsewhere go from the texts, and documents that have no word left."""
    return _worded(_counted(suffixes.cut_repeats(docs, length=PASSAGE)))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Batches of sequences for training, by document id."""
    return packing.pack(docs)


def _worded(docs: DataFrame) -> DataFrame:
    return docs.where(F.col("text").rlike(r"[^\x20\x09-\x0D]"))


def _counted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("n-gram jaccard join", jaccard_join),
    ("suffix-array dedup", suffix_dedup),
    ("packing", pack),
]

#: Line hashes, MinHash buckets and byte strings across documents are beyond SQL; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
