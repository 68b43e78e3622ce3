"""The corpus pipeline: toxicity, quality, line dedup, near duplicates, packing.

Each stage takes ``(spark, docs, sf_dir)`` and works on all rows its predecessor kept; ``run``
writes every stage's result as a Parquet table in the shared folder and reads it back as the
next one's ``docs``.  The models of the first two stages are fitted on the rows they are given.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pixelmill.llm import entry, jaccard_join, linededup, quality, toxicity
from pixelmill.session import stage_table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return linededup.filter_documents(docs)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.one_of_each(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return entry.packed(docs)


STAGES = [("toxicity", drop_toxic), ("quality", keep_good), ("line_dedup", dedup_lines), ("near_duplicates", one_of_each), ("packing", pack)]

#: Two stages score with models trained on the corpus, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stage_table(stage(spark, docs, sf_dir), f"pipeline-{name}")
    name, stage = STAGES[-1]
    return stage(spark, docs, sf_dir)
