"""The splitters and the embedding for SQL: table functions for lateral joins, an Arrow function for vectors."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession, functions as F

from docflow.operators import splitting
from docflow.plugins import hash_embedding
from docflow.schema import SplitConfig


class RecursiveSplit:
    """``split_recursive(text, size, overlap)``: ``part, content``."""

    def eval(self, text: str, size: int, overlap: int) -> Iterator[tuple[int, str]]:
        yield from enumerate(splitting.recursive_split(text or "", size, overlap, SplitConfig().separators))


class SemanticSplit:
    """``split_semantic(text, percentile)``: ``part, content``."""

    def eval(self, text: str, percentile: float) -> Iterator[tuple[int, str]]:
        yield from enumerate(splitting.semantic_split(text or "", hash_embedding, float(percentile)))


def register(spark: SparkSession, embed: Callable[[str], np.ndarray] = hash_embedding) -> None:
    """Make ``split_recursive``, ``split_semantic`` and ``embed`` known to the session's SQL."""
    returns = "part int, content string"
    spark.udtf.register("split_recursive", F.udtf(RecursiveSplit, returnType=returns))
    spark.udtf.register("split_semantic", F.udtf(SemanticSplit, returnType=returns))

    @F.pandas_udf("array<float>")
    def vectors(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else embed(t).astype(np.float32))

    spark.udf.register("embed", vectors)
