"""The corpus pipeline: toxicity, line dedup, near dedup, substring dedup, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return
the columns of documents, with n_chars following the text. `run` writes each stage's result as
Parquet in the checkpoint folder and reads it again as the next one's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloakframe.llm import lines, minhash, packing, substrings, toxicity
from cloakframe.llm.common import written
from cloakframe.llm.labelled import remainder


def _sized(df: DataFrame) -> DataFrame:
    if "n_chars" not in df.columns:
        return df
    return df.withColumn("n_chars", F.length("text").cast(df.schema["n_chars"].dataType))


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the grammar's model doesn't reject; it learns from the same rows as op6."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.accepted(docs, toxicity.fit(docs, labels, remainder("doc_id", 4) != 2))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that match an earlier line, however short."""
    return _sized(lines.remove_lines(docs, min_tokens=1))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return minhash.keep_one(docs)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without words covered by a window that an earlier document has."""
    return _sized(substrings.remove_repeats(docs, counts=None))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Place of every piece of every document in the packed sequences."""
    return packing.packed(docs)


STAGES = [
    ("toxicity", toxicity_stage),
    ("line_dedup", line_stage),
    ("minhash_dedup", near_stage),
    ("substring_dedup", substring_stage),
    ("best_fit_packing", packing_stage),
]

#: The first stage is a learned model and the last a heuristic plan; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
