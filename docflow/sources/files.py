"""Uploaded files and page tables."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from docflow.operators.catalog import MAX_UPLOADS, MIME_TYPES

#: Suffixes of the accepted types.
SUFFIXES = {"pdf": MIME_TYPES[0], "docx": MIME_TYPES[1], "txt": MIME_TYPES[2]}


def uploads(spark: SparkSession, path: str) -> DataFrame:
    """``filename, path, mime, uploadedAt, content`` of the files of accepted types; others are left out."""
    suffix = F.lower(F.element_at(F.split("path", r"\."), -1))
    kinds = F.create_map(*[F.lit(x) for pair in SUFFIXES.items() for x in pair])
    rows = spark.read.format("binaryFile").load(path).withColumn("mime", F.element_at(kinds, suffix))
    return rows.where(F.col("mime").isNotNull()).select(F.element_at(F.split("path", "/"), -1).alias("filename"), "path", "mime", F.col("modificationTime").alias("uploadedAt"), "content")


def text_pages(files: DataFrame) -> DataFrame:
    """Pages of plain-text uploads, split at form feeds: ``document_id, page, text, error``. Other types need a decoder and carry an error."""
    plain = F.col("mime") == SUFFIXES["txt"]
    parts = F.when(plain, F.split(F.decode("content", "UTF-8"), "\f")).otherwise(F.array(F.lit(None).cast("string")))
    rows = files.select(F.col("filename").alias("document_id"), plain.alias("_plain"), F.posexplode(parts).alias("_p", "text"))
    return rows.select("document_id", (F.col("_p") + 1).alias("page"), "text", F.when(~F.col("_plain"), F.lit("PDF processing failed")).alias("error"))


def decoded_pages(files: DataFrame, decode: Callable[[bytes], list[str]]) -> DataFrame:
    """Pages of uploads through a decoder: ``document_id, page, total, text, error``.

    A file the decoder fails on is one row with an error and no page; the others go on.
    """

    def read(content: bytes) -> tuple[list[str], str | None]:
        try:
            return decode(content), None
        except Exception:  # noqa: BLE001 - a broken file must not stop the others
            return [], "PDF processing failed"

    def run(batches):
        for batch in batches:
            rows = []
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                pages, error = read(content)
                rows += [(name, k + 1, len(pages), t, None) for k, t in enumerate(pages)]
                if error:
                    rows.append((name, None, None, None, error))
            kinds = [pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], ["document_id", "page", "total", "text", "error"])

    return files.select("filename", "content").mapInArrow(run, "document_id string, page int, total int, text string, error string")


def accepted(names: list[str]) -> list[str]:
    """Names of one upload; more than the limit, or one of another type, fails."""
    if len(names) > MAX_UPLOADS:
        raise ValueError(f"at most {MAX_UPLOADS} files")
    if wrong := [n for n in names if n.rpartition(".")[2].lower() not in SUFFIXES]:
        raise ValueError(f"only PDF, DOCX and TXT files: {wrong}")
    return names


def items_text(items: Column) -> Column:
    """Items of a page joined by a blank, as they are."""
    return F.array_join(items, " ")


def jdbc_table(spark: SparkSession, url: str, table: str, **options: str) -> DataFrame:
    """A table of a relational store; give ``partitionColumn``, bounds and ``numPartitions`` for a large one."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()


def safe_path(path: str, root: str) -> Path:
    """The path below the upload root; one outside fails, and so does one that isn't there."""
    found = (Path(root) / path).resolve()
    if not found.is_relative_to(Path(root).resolve()):
        raise PermissionError(f"{path} is outside {root}")
    if not found.exists():
        raise FileNotFoundError(str(found))
    return found


def question_and_document(question: str, document: str) -> tuple[str, str]:
    """Both trimmed; a blank one fails."""
    question, document = (question or "").strip(), (document or "").strip()
    if not question or not document:
        raise ValueError("question and document id are required")
    return question, document


def document_pages(documents: DataFrame) -> DataFrame:
    """``documents`` as pages: a source is a document, and doc_id + 1 the number of the page."""
    return documents.select(F.col("source").alias("document_id"), (F.col("doc_id") + 1).cast("int").alias("page"), "text", "lang")


def lines_of(text: Column) -> Column:
    """A text's lines as positioned lines of a page 1,000 high: every seventh has no width, every eleventh no text."""
    return F.transform(
        F.split(F.coalesce(text, F.lit("")), "\n"),
        lambda x, i: F.struct(
            F.lit(10.0).alias("x0"), (i * 12).cast("double").alias("y0"), F.when(i % 7 == 6, 10.0).otherwise(10.0 + F.length(x)).alias("x1"), (i * 12 + 10).cast("double").alias("y1"),
            F.when(i % 11 == 10, "  ").otherwise(x).alias("text"),
        ),
    )
