"""Corpus pipeline over documents: language ID, exact dedup, near dedup, decontamination, packing.

Each stage gets all rows that its predecessor kept, and its decisions take effect. The stages but the last return the columns of
documents; their rows are written as Parquet and read again as the next stage's input. Stages drop rows, not ids: rows that share a
doc_id, or have none, are decided on one by one, and of rows that are equal in id and text one stays. What a stage does with nulls, repeats and
empty tables is what its operator does.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from skeinflow.llm import decontaminate, exact, langid, near, packing
from skeinflow.llm.common import staged


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.keep_identified(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact.drop_exact(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near.drop_near(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [("language_id", language_id), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("decontamination", decontamination), ("best_fit_packing", best_fit_packing)]

#: Language ID, near dedup and retrieval can't be expressed in SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = staged(docs, name)
    return docs
