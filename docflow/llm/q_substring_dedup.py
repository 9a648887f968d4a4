"""Query op7: words of ``documents`` that repeat earlier passages. SQL over all windows is too slow; the tests compare with brute force."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docflow.llm.fingerprint_index import remove_repeats


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
