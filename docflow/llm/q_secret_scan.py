"""Query op5: secrets in all of ``documents``. SQL has no match positions; the tests compare with Python's ``re``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docflow.llm.secret_scan import secret_scan


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
