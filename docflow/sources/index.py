"""The vector index: one partition for each model and document, replaced as a whole."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from docflow.functions.text import model_directory

KEYS = ["embedding_model", "document_id"]


def save(chunks: DataFrame, path: str, model: str) -> None:
    """Replace the partitions of all documents in ``chunks``; other documents stay. Nothing is written for no rows.

    A null document id fails. Rows are dealt out by document and a hash of their
    content, so a large document is written by several tasks.
    """
    known = F.when(F.col("document_id").isNull(), F.raise_error(F.lit("a chunk has no document id")).cast("string")).otherwise(F.col("document_id").cast("string"))
    rows = chunks.withColumns({"embedding_model": model_directory(F.lit(model)), "document_id": known})
    # Maps have no hash.
    spread = [f.name for f in chunks.schema if f.name != "document_id" and "map<" not in f.dataType.simpleString()]
    rows = rows.repartition("document_id", *([F.pmod(F.xxhash64(*spread), F.lit(8))] if spread else []))
    rows.write.partitionBy(*KEYS).mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)


def load(spark: SparkSession, path: str, model: str, document: str | None = None) -> DataFrame:
    """The index of a model, or of one of its documents: other partitions are not read."""
    rows = spark.read.option("basePath", path).parquet(path).where(F.col("embedding_model") == model_directory(F.lit(model)))
    # Partition values come back as the type they look like; ids are strings.
    rows = rows.withColumn("document_id", F.col("document_id").cast("string"))
    return rows if document is None else rows.where(F.col("document_id") == document)


def load_or_none(spark: SparkSession, path: str, model: str, document: str | None = None) -> DataFrame | None:
    """As :func:`load`; None where there is no index or no such document."""
    try:
        rows = load(spark, path, model, document)
    except AnalysisException:
        return None
    return None if rows.isEmpty() else rows


def remove(spark: SparkSession, path: str, model: str, document: str) -> None:
    """Delete one document's partition."""
    jvm, hadoop = spark._jvm, spark._jsc.hadoopConfiguration()
    folder = jvm.org.apache.hadoop.fs.Path(f"{path}/embedding_model={model.replace('/', '_')}/document_id={document}")
    folder.getFileSystem(hadoop).delete(folder, True)
