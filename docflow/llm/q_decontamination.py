"""Query op10: documents that hold passages of ``benchmark``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docflow.llm.spaced_seeds import contaminated


def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
