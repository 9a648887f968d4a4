"""Chunkers: a row for each text becomes rows of chunks.

Splitting by section or heading is native. Sections then pass through Python once,
in Arrow batches, where those over the single-chunk limit are split further.
"""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from docflow.functions import ids, text as X
from docflow.operators import splitting
from docflow.operators.rows import passing, unnest
from docflow.plugins import hash_embedding
from docflow.schema import NodeSplitConfig, SplitConfig

log = logging.getLogger(__name__)

#: Bytes of text that a Python worker splits at a time, and parts that it hands back at a time.
SLICE_BYTES, SLICE_PARTS = 1 << 20, 1 << 12
#: Bytes of text in a row that goes to Python: batches are limited in rows only, so this bounds their bytes, however long texts are.
BLOCK_BYTES = 1 << 9

_SECTION = "array<struct<heading:string,content:string>>"


def legal_sections(text: Column) -> Column:
    """``array<struct<heading, content>>``: a part before every paragraph sign with a word after it."""
    parts = F.filter(F.transform(F.split(text, r"(?U)(?=§\s*\w+)"), X.strip), lambda x: x != "")
    sign = lambda x: F.regexp_extract(x, r"(?U)§\s*(\w+)", 1)
    return F.transform(parts, lambda x: F.struct(F.concat(F.lit("§"), sign(x)).alias("heading"), x.alias("content")))


def heading_sections(text: Column) -> Column:
    """``array<struct<heading, content>>``: lines under each markdown heading; those before the first are the introduction.

    Headings without a line below are dropped. Positions of headings cut the lines,
    so the cost is linear in the lines.
    """

    def cut(lines: Column) -> Column:
        starts = F.concat(F.array(F.lit(0)), F.filter(F.transform(lines, lambda x, i: F.when(X.is_heading(x), i + 1)), lambda i: i.isNotNull()))
        return X.bound(starts, lambda a: between(lines, a, F.concat(F.slice(a, 2, F.size(a)), F.array(F.size(lines) + 1))))

    def between(lines: Column, starts: Column, ends: Column) -> Column:
        return F.transform(
            F.arrays_zip(starts.alias("a"), ends.alias("b")),
            lambda s: F.struct(
                F.when(s["a"] == 0, F.lit("Introduction")).otherwise(X.heading_text(F.get(lines, s["a"] - 1))).alias("heading"),
                F.slice(lines, s["a"] + 1, s["b"] - s["a"] - 1).alias("lines"),
            ),
        )

    kept = F.filter(X.bound(F.split(text, "\n"), cut), lambda s: F.size(s["lines"]) > 0)
    return F.transform(kept, lambda s: F.struct(s["heading"].alias("heading"), F.array_join(s["lines"], "\n").alias("content")))


def node_sections(text: Column, cfg: NodeSplitConfig = NodeSplitConfig()) -> Column:  # noqa: B008
    """``array<struct<section, content>>``: parts before a paragraph sign with digits, labelled by place, within the token limit."""
    parts = F.filter(F.split(text, "(?=§[0-9]+)"), lambda x: X.strip(x) != "")
    labelled = F.transform(parts, lambda x, i: F.struct(F.concat(F.lit("§"), (i + 1).cast("string")).alias("section"), X.strip(x).alias("content")))
    return F.filter(labelled, lambda s: X.token_count(s["content"]).between(1, cfg.max_tokens))


def sections(text: Column, legal: bool) -> Column:
    """Sections of a cleaned text with their chunk type: legal, hierarchical or generic."""
    typed = lambda found, kind: F.transform(found, lambda s: F.struct(s["heading"].alias("heading"), F.lit(kind).alias("chunk_type"), s["content"].alias("content")))
    none = F.lit(None).cast("string")
    generic = lambda t: F.array(F.struct(none.alias("heading"), F.lit("generic").alias("chunk_type"), t.alias("content")))

    def by_heading(t: Column) -> Column:
        trimmed = lambda found: F.transform(found, lambda s: F.struct(s["heading"].alias("heading"), X.strip(s["content"]).alias("content")))
        return X.bound(heading_sections(t), lambda found: F.when(F.size(found) > 1, typed(F.filter(trimmed(found), lambda s: s["content"] != ""), "hierarchical")).otherwise(generic(t)))

    return X.bound(text, lambda t: F.when(t.contains("§"), typed(legal_sections(t), "legal")).otherwise(by_heading(t)) if legal else by_heading(t))


def _in_blocks(df: DataFrame, column: str) -> DataFrame:
    """``df`` with neighbouring rows for the blocks of ``column``: ``_block_at, _block_bytes, _block_last``; other columns are null but in the first. Null has one block."""

    def blocks(data: Column) -> Column:
        last = F.floor(F.greatest(F.octet_length(data) - 1, F.lit(0)) / BLOCK_BYTES).cast("int")
        block = lambda k: F.struct(F.substring(data, k * BLOCK_BYTES + 1, F.lit(BLOCK_BYTES)).alias("bytes"), (k == last).alias("last"))
        return F.transform(F.sequence(F.lit(0), last), block)

    others = [c for c in df.columns if c != column]
    rows = unnest(df, [f"`{c}`" for c in others], X.bound(F.col(f"`{column}`").cast("binary"), blocks), "_block_at", "_block")
    return rows.select(*[F.when(F.col("_block_at") == 0, F.col(f"`{c}`")).alias(c) for c in others], "_block_at", F.col("_block.bytes").alias("_block_bytes"), F.col("_block.last").alias("_block_last"))


def _whole(batches: Iterator[pa.RecordBatch], names: list[str], at: int) -> Iterator[pa.RecordBatch]:
    """Batches of ``_in_blocks`` with whole texts again, as column ``at`` of ``names``, about ``SLICE_BYTES`` of them each; a longer text is alone or last."""

    def joined(rows: pa.RecordBatch) -> pa.RecordBatch:
        *others, place, block, _ = rows.columns
        starts = np.flatnonzero(place.to_numpy() == 0)
        texts = pc.binary_join(pa.ListArray.from_arrays(pa.array([*starts, rows.num_rows], pa.int32()), block), b"").cast(pa.string())
        columns = [x.take(pa.array(starts)) for x in others]
        return pa.RecordBatch.from_arrays([*columns[:at], texts, *columns[at:]], names)

    held: list[pa.RecordBatch] = []  # of a text that later batches go on with
    for batch in batches:
        *_, block, last = batch.columns
        ends = np.flatnonzero(last.to_numpy(zero_copy_only=False)) + 1
        if not len(ends):
            held.append(batch)
            continue
        if held:
            yield joined(pa.concat_batches([*held, batch.slice(0, ends[0])]))
        first = ends[0] if held else 0
        held = [batch.slice(ends[-1])] if ends[-1] < batch.num_rows else []
        before = np.cumsum([0, *pc.fill_null(pc.binary_length(block), 0).to_numpy(zero_copy_only=False)])[ends[:-1]]
        borders = [first, *ends[:-1][np.diff(before // SLICE_BYTES, prepend=0) > 0], ends[-1]]
        yield from (joined(batch.slice(a, b - a)) for a, b in zip(borders, borders[1:], strict=False) if b > a)


def apply_split(df: DataFrame, column: str, split: Callable[[str], list[str]], flag: str | None = None, instead: Callable[[str], list[str]] | None = None) -> DataFrame:
    """``df`` with a row for each part of ``column``, and its place ``part``; rows without the ``flag`` stay whole.

    Texts go to Python in blocks, so a worker holds batches of bounded size and one text. Where ``split`` fails on a text, ``instead`` splits it, if given, and ``instead`` is true in its rows.
    """
    names = df.columns
    at, marked = names.index(column), names.index(flag) if flag else None

    def attempt(text: str) -> tuple[list[str], bool]:
        if instead is None:
            return split(text), False
        try:
            return split(text), False
        except Exception:  # noqa: BLE001 - whatever an embedder raises
            log.exception("splitting failed, the text is split the other way")
            return instead(text), True

    def split_rows(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        texts = batch.column(at).to_pylist()
        wanted = batch.column(marked).to_pylist() if flag else [True] * len(texts)
        done = [([], False) if x is None else attempt(x) if w else ([x], False) for x, w in zip(texts, wanted, strict=True)]
        found = [(row, place, part, failed) for row, (parts, failed) in enumerate(done) for place, part in enumerate(parts)]
        for k in range(0, len(found), SLICE_PARTS):
            rows, places, parts, failed = zip(*found[k : k + SLICE_PARTS], strict=True)
            own = pa.array(parts, pa.string())
            # A whole text is never repeated for its parts.
            columns = [own if c == at else batch.column(c).take(pa.array(rows, pa.int64())) for c in range(batch.num_columns)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(places, pa.int32()), pa.array(failed, pa.bool_())], [*names, "part", "instead"])

    def run(batches):
        for batch in _whole(batches, names, at):
            yield from split_rows(batch)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return _in_blocks(df, column).mapInArrow(run, f"{fields}, part int, instead boolean")


def recursive(df: DataFrame, column: str, cfg: SplitConfig | NodeSplitConfig, flag: str | None = None) -> DataFrame:
    size, overlap, separators = cfg.chunk_size, cfg.overlap, cfg.separators
    return apply_split(df, column, lambda x: splitting.recursive_split(x, size, overlap, separators), flag).drop("instead")


def semantic(df: DataFrame, column: str, cfg: SplitConfig, embed=hash_embedding, flag: str | None = None) -> DataFrame:
    """Parts by sentence distance; a text that ``embed`` fails on is split by separators and has ``instead`` set."""
    percentile, size, overlap, separators = cfg.semantic_percentile, cfg.chunk_size, cfg.overlap, cfg.separators
    return apply_split(df, column, lambda x: splitting.semantic_split(x, embed, percentile), flag, lambda x: splitting.recursive_split(x, size, overlap, separators))


def with_identity(df: DataFrame, document: str, page: str) -> DataFrame:
    """Add ``token_count`` and ``chunk_id`` to chunks."""
    return df.withColumns({"token_count": X.token_count(F.col("content")), "chunk_id": ids.chunk_id(F.col(document), F.col(page), F.col("heading"), F.col("chunk_type"), F.col("content"))})


def split_texts(df: DataFrame, document: str, page: str, text: str, mode: str = "semantic", cfg: SplitConfig = SplitConfig(), embed=hash_embedding) -> DataFrame:  # noqa: B008
    """``document, page, section, part, heading, chunk_type, content, token_count, chunk_id`` of every text.

    ``mode``: legal splits at paragraph signs first; semantic splits long sections by
    sentence distance, anything else by separators.
    """
    cleaned = passing(df, [document, page], X.boilerplate_clean(F.col(text)), "_t", lambda t: X.strip(t) != "")
    rows = unnest(cleaned, [document, page], sections(F.col("_t"), mode == "legal"), "section", "s").select(document, page, "section", "s.*")
    # Short sections go along whole: a branch for each kind would read and clean everything twice.
    rows = rows.withColumn("_long", X.token_count(F.col("content")) > cfg.max_tokens_single)
    kind = "semantic" if mode == "semantic" and embed else "recursive"
    parts = semantic(rows, "content", cfg, embed, "_long") if kind == "semantic" else recursive(rows, "content", cfg, "_long")
    kind_of_part = F.when(F.col("instead"), "recursive").otherwise(kind) if kind == "semantic" else F.lit(kind)
    made = with_identity(parts.withColumn("chunk_type", F.when(F.col("_long"), kind_of_part).otherwise(F.col("chunk_type"))), document, page)
    return made.where(~F.col("_long") | (F.col("token_count") >= cfg.min_part_tokens)).drop("_long", "instead")


def node_split(df: DataFrame, document: str, text: str, cfg: NodeSplitConfig = NodeSplitConfig()) -> DataFrame:  # noqa: B008
    """``document, section, chunk_type, content``: by numbered sections where there is a paragraph sign, else by size."""
    rows = passing(df, [document], X.strip(F.col(text)), "content", lambda t: t != "")
    whole = lambda t: F.array(F.struct(F.lit(None).cast("string").alias("section"), t.alias("content")))
    parts = unnest(rows, [document], F.when(F.col("content").contains("§"), node_sections(F.col("content"), cfg)).otherwise(whole(F.col("content"))), "_at", "s")
    parts = parts.select(document, "s.section", "s.content").withColumn("_whole", F.col("section").isNull())
    split = recursive(parts, "content", cfg, "_whole")
    section = F.when(F.col("_whole"), F.concat(F.lit("chunk-"), (F.col("part") + 1).cast("string"))).otherwise(F.col("section"))
    return split.select(document, section.alias("section"), F.when(F.col("_whole"), "recursive").otherwise("section").alias("chunk_type"), "content")


def full_text_fallback(parts: Column, text: Column) -> Column:
    """The parts, or the whole text as one where splitting gave none."""
    return F.when(parts.isNull() | (F.size(parts) == 0), F.array(text)).otherwise(parts)


def combined_pages(pages: DataFrame, document: str, page: str, text: str) -> DataFrame:
    """``document, page (null), text``: the texts of a document's pages in order, joined by line feeds.

    For documents that fit a row; ``combined.split_combined`` chunks those of any size by headings and size.
    """
    ordered = F.sort_array(F.collect_list(F.when(F.coalesce(F.col(text), F.lit("")) != "", F.struct(F.col(page).alias("p"), F.col(text).alias("t")))))
    joined = pages.groupBy(document).agg(F.array_join(F.transform(ordered, lambda x: x["t"]), "\n").alias(text))
    return joined.withColumn(page, F.lit(None).cast(pages.schema[page].dataType))


def capped(chunks: DataFrame, document: str, order: list[str], limit: int | None) -> DataFrame:
    """At most ``limit`` chunks of a document, in order; no limit for null or 0. A report's limit, not a way around skew."""
    if not limit:
        return chunks
    return chunks.withColumn("_n", F.row_number().over(Window.partitionBy(document).orderBy(*order))).where(F.col("_n") <= limit).drop("_n")
