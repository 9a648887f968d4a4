"""Row types and settings."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

BBOX = T.StructType([T.StructField(c, T.DoubleType()) for c in ("x", "y", "width", "height")])
SPAN = T.StructType([T.StructField("text", T.StringType()), T.StructField("bbox", BBOX)])
LINE = T.StructType([*(T.StructField(c, T.DoubleType()) for c in ("x0", "y0", "x1", "y1")), T.StructField("text", T.StringType())])
HEADING = T.StructType([T.StructField("text", T.StringType()), T.StructField("level", T.IntegerType())])
USER = T.StructType([T.StructField("id", T.IntegerType()), T.StructField("username", T.StringType()), T.StructField("email", T.StringType())])
DOCUMENT = T.StructType([T.StructField("id", T.IntegerType()), T.StructField("filename", T.StringType()), T.StructField("path", T.StringType()), T.StructField("uploadedAt", T.TimestampType()), T.StructField("userId", T.IntegerType())])
MESSAGE = T.StructType([T.StructField("id", T.IntegerType()), T.StructField("documentId", T.IntegerType()), T.StructField("role", T.StringType()), T.StructField("content", T.StringType()), T.StructField("createdAt", T.TimestampType())])
ANSWER = "contextAnswer string, additionalInfo string"
#: A chunk without place: what every splitter returns.
CHUNK = "heading string, chunk_type string, content string"


@dataclass(frozen=True)
class SplitConfig:
    """Settings of the splitters; sizes are characters for text and tokens for spans."""

    max_tokens_single: int = 512
    chunk_size: int = 800
    overlap: int = 100
    separators: tuple[str, ...] = ("\n\n", "\n", ". ", " ", "")
    semantic_percentile: float = 95.0
    min_chars: int = 80
    min_part_tokens: int = 3
    max_chunks: int | None = None


@dataclass(frozen=True)
class NodeSplitConfig:
    """Settings of the section splitter."""

    chunk_size: int = 1000
    overlap: int = 200
    separators: tuple[str, ...] = ("\n\n", "\n", " ", "")
    max_tokens: int = 8192


@dataclass(frozen=True)
class IngestConfig:
    mode: str = "semantic"
    min_chars: int = 5
    dedupe: bool = True


@dataclass(frozen=True)
class PageConfig:
    use_ocr: bool = True
    keep_text: bool = True
    skip_empty: bool = True
    trim: bool = True


@dataclass(frozen=True)
class AnswerConfig:
    retrieved: int = 10
    used: int = 4
    separator: str = "\n\n---\n\n"
