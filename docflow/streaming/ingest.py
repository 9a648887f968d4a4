"""Incremental ingest: new page rows are split, filtered, deduplicated and stored per micro-batch.

An extension; a replayed micro-batch replaces the same partitions, so the index
ends the same.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

from docflow.operators import chunks, ingest, retrieval
from docflow.plugins import hash_embedding
from docflow.schema import IngestConfig, SplitConfig
from docflow.sources import index


def prepared(pages: DataFrame, mode: str = "recursive", cfg: SplitConfig = SplitConfig(), rules: IngestConfig = IngestConfig()) -> DataFrame:  # noqa: B008
    """Chunks of pages (``document_id, page, text``) that are long enough, each content once a document."""
    made = chunks.split_texts(pages, "document_id", "page", "text", mode, cfg).where(ingest.long_enough(chunks.F.col("content"), rules.min_chars))
    return ingest.first_of_equal(made, "document_id", "content", ["page", "section", "part"]) if rules.dedupe else made


def into_index(pages: DataFrame, path: str, model: str, embed=hash_embedding, mode: str = "recursive") -> DataStreamWriter:
    """A writer that stores every micro-batch of a page stream; a document's pages must arrive together."""

    def store(batch: DataFrame, _: int) -> None:
        index.save(retrieval.embedded(prepared(batch, mode), "content", embed), path, model)

    return pages.writeStream.foreachBatch(store)


