"""Query op4: quality scores of all ``documents``. A fitted network is beyond SQL; the tests measure held-out accuracy."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docflow.llm.quality_classifier import quality_scores


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
