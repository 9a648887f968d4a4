"""Query op8: main text of every page. SQL has no HTML parser; the tests use pages of known text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docflow.llm.html_text import extract


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
