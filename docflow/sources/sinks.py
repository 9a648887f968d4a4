"""Writers of rows and chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from docflow.operators.registration import CREATED, decided
from docflow.sources.workspace import new_path


def append(rows: DataFrame, path: str) -> None:
    """Add rows to a table."""
    rows.write.mode("append").parquet(path)


def replace(rows: DataFrame, path: str) -> None:
    """Put rows in place of a table; ``rows`` must not be read from it."""
    rows.write.mode("overwrite").parquet(path)


def clear(table: DataFrame, path: str) -> None:
    """Empty a table and keep its columns."""
    table.sparkSession.createDataFrame([], table.schema).write.mode("overwrite").parquet(path)


def dump_json(chunks: DataFrame, path: str) -> None:
    """All chunks as JSON lines, in place of the dump before."""
    chunks.write.mode("overwrite").json(path)


def register(candidates: DataFrame, users: DataFrame, path: str, order: str = "id", keys: tuple[str, ...] = ("email", "username")) -> DataFrame:
    """Append the candidates that get in, first come first served; returns every candidate once, with ``status``.

    Decided first, then stored, then appended: what is returned is what was decided, though ``users`` may read ``path``.
    """
    found = decided(candidates, users, order, keys)
    kept = new_path(candidates.sparkSession, "decided")
    found.write.parquet(kept)
    found = candidates.sparkSession.read.schema(found.schema).parquet(kept)
    append(found.where(F.col("status") == CREATED).drop("status"), path)
    return found
