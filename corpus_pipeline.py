"""Corpus cleaning in five stages over ``documents``; part of the corpus subpackage.

``STAGES`` holds (name, function) pairs. A function takes (spark, docs, sf_dir) and returns a DataFrame, which
is written as Parquet and read again as the next one's documents. All stages but the last return the
columns of ``documents``; the last one adds ``copy``, the number of the copy.

1. toxicity: documents that score 0.5 or more go.
2. line_dedup: lines that repeat an earlier line, up to one word, go; a document left without words is a
   copy as a whole and goes.
3. near_dedup: one document of each class of near copies stays.
4. decontamination: documents that hold ten consecutive words of a benchmark item go.
5. mixing: each document occurs as often as its source's target asks.

Line deduplication has SQL, the scores, signatures and rates of the other stages don't, so the result as a
whole has none; the tests run it against a plain version on a small fixture.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ruleloom.llm.bagminhash import drop_near_duplicates
from ruleloom.llm.common import discard, settled
from ruleloom.llm.decontaminate import decontaminate
from ruleloom.llm.linededup import dedup_lines
from ruleloom.llm.mixing import mixed
from ruleloom.llm.toxicity import drop_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return dedup_lines(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixed(docs)


STAGES = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixing", mixing),
]

#: The stages can't be expressed in SQL as a whole.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = before = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (name, stage) in enumerate(STAGES[:-1]):
        docs = settled(lambda: stage(spark, before, sf_dir), f"stage-{name}")  # noqa: B023
        if number:
            discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
