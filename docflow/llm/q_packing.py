"""Query op3: packing of all ``documents``. SQL has no tokenizer; the tests compare with plain encoding and the contract's rules."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from docflow.llm.packing import pack


def op3_best_fit_packing(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokenizer or public_tokenizers.path("word_bpe_49k.json"))
