"""Query op2: licenses in all of ``documents``. SQL has no alignment; the tests compare with plain versions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docflow.llm.license_scan import licenses


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"))
