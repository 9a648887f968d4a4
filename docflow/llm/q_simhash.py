"""Query op9: SimHash near-duplicates over all of ``documents``. SQL has no XXH64; the tests compare with brute force."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docflow.llm.simhash import near_duplicates

#: Fingerprints that a tree is expected to have.
TREE = 4096


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str, pruned: list | None = None) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), group=TREE, fit=True, pruned=pruned)
