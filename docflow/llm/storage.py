"""Intermediate tables in the folder that all executors share.

``spark.checkpoint.dir`` names that folder; a table written there cuts lineage
and survives lost executors. Only a local session without the setting gets a
temporary folder of its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from docflow.sources.workspace import delete, new_path

#: Rows that go to Python at a time: whole texts are among them, on both sides of the socket.
BATCH_ROWS = 1024


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it again."""
    spark = df.sparkSession
    path = new_path(spark, name)
    rows = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(min(BATCH_ROWS, int(rows)) if int(rows) > 0 else BATCH_ROWS))
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files of a table made by :func:`stored` that nothing reads any more."""
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        delete(df.sparkSession, folder)
