"""Rules between splitting and storing: length filters, exact deduplication, guards, counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from docflow.functions import text as X
from docflow.schema import IngestConfig


def long_enough(content: Column, min_chars: int) -> Column:
    """At least ``min_chars`` characters without outer white space; 0 or less lets all pass."""
    return F.lit(True) if min_chars <= 0 else F.length(X.strip(F.coalesce(content, F.lit("")))) >= min_chars


def first_of_equal(chunks: DataFrame, document: str, content: str, order: list[str]) -> DataFrame:
    """The first chunk, by ``order``, of those of a document with equal normalised content.

    An aggregation, not a window: thousands of copies shrink before they are
    shuffled and never meet in one task.
    """
    key = F.sha1(F.encode(X.normalize(F.col(content)), "UTF-8"))
    rest = [c for c in chunks.columns if c not in {document, *order}]
    first = F.min_by(F.struct(*order, *rest), F.struct(*order))
    return chunks.groupBy(F.col(document), key.alias("_key")).agg(first.alias("_first")).select(document, *[F.col("_first")[c].alias(c) for c in [*order, *rest]])


def counters(inputs: DataFrame, chunks: DataFrame, document: str, text: str, content: str, cfg: IngestConfig = IngestConfig()) -> DataFrame:  # noqa: B008
    """Per document: ``inputs_seen, inputs_non_empty, chunks_before_filter, filtered_out, deduped_out, stored, status``."""
    seen = inputs.groupBy(document).agg(F.count("*").alias("inputs_seen"), F.count_if(X.strip(F.coalesce(F.col(text), F.lit(""))) != "").alias("inputs_non_empty"))
    passed = long_enough(F.col(content), cfg.min_chars)
    by_content = chunks.groupBy(F.col(document), F.sha1(F.encode(X.normalize(F.col(content)), "UTF-8")).alias("_key")).agg(F.count("*").alias("n"), F.count_if(passed).alias("kept"))
    kept = F.col("kept") if not cfg.dedupe else F.when(F.col("kept") > 0, 1).otherwise(0)
    # Contents that differ only in outer white space pass or fail together, so a group is all kept or all dropped.
    made = by_content.groupBy(document).agg(F.sum("n").alias("chunks_before_filter"), F.sum(F.col("n") - F.col("kept")).alias("filtered_out"), F.sum(F.col("kept") - kept).alias("deduped_out"), F.sum(kept).alias("stored"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    status = F.when(F.coalesce("stored", F.lit(0)) > 0, "success").otherwise("error").alias("status")
    return seen.join(made, document, "left").select(document, "inputs_seen", "inputs_non_empty", zero("chunks_before_filter"), zero("filtered_out"), zero("deduped_out"), zero("stored"), status)


def one_document(rows: DataFrame, group: str, document: str) -> DataFrame:
    """``group, documents, status``: an error where a group has more than one document."""
    found = rows.groupBy(group).agg(F.count_distinct(document).alias("documents"))
    return found.withColumn("status", F.when(F.col("documents") > 1, "error").otherwise("ok"))


def checked(chunks: DataFrame, chunk_id: str) -> DataFrame:
    """``chunks``; running it fails if one has no id."""
    return chunks.withColumn(chunk_id, F.when(F.col(chunk_id).isNull(), F.raise_error(F.lit("a chunk has no id"))).otherwise(F.col(chunk_id)))


def with_default(metadata: Column, key: str, value: Column) -> Column:
    """A map with ``key`` set unless it is there."""
    return F.when(F.map_contains_key(metadata, key), metadata).otherwise(F.map_concat(metadata, F.create_map(F.lit(key), value)))


def with_override(metadata: Column, more: Column) -> Column:
    """Both maps; ``more`` wins."""
    return F.map_concat(F.map_filter(metadata, lambda k, _: ~F.map_contains_key(more, k)), more)


def zipped(texts: Column, metadata: Column) -> Column:
    """``array<struct>`` of texts and metadata by place; unequal lengths fail."""
    same = F.when(F.size(texts) != F.size(metadata), F.raise_error(F.lit("texts and metadata differ in length")).cast("array<int>"))
    return F.when(same.isNull(), F.arrays_zip(texts.alias("text"), metadata.alias("metadata")))
