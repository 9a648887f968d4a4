"""Pages of a document chunked as one text, without the text in one row.

The joined text is a table of lines in order. Cleaning, sections and sizes need a line's neighbours and running sums only; both
are worked out per block of lines, with the lines next to a block's border lent to it and the sums of the blocks before added.
Sections within the single-chunk limit are joined (the limit bounds them). Long ones are cut by size: where a chunk ends
depends only on where it starts, so every block maps the places at which a chunk may come in to the place where the last one goes out.
These maps, a few numbers a block, are chained in order, and every block then cuts its own lines, the overlap among them.

All of this needs no text but a line's length, words, heading, label or number. The texts are stored once, numbered in order; everything is decided
on these few values, places of chunks included, and the texts then join their places and move to their chunk once.

No task holds more than a block of lines and, at once, one section within the limit. Python gets the lines of long sections only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from docflow.functions import text as X
from docflow.operators import splitting
from docflow.operators.chunks import with_identity
from docflow.operators.joins import to_totals
from docflow.schema import SplitConfig
from docflow.sources.workspace import new_path

#: Lines of a block, as a power of two; as many blocks make a group of blocks.
BITS = 12


def _stored(df: DataFrame, name: str) -> DataFrame:
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def running(rows: DataFrame, at: str, bits: int, then: tuple[str, ...] = (), **values: Column) -> DataFrame:
    """``rows`` with running sums of ``values`` in the order of ``at`` (and ``then``), own row included.

    Sums are taken in blocks of ``at``, over the blocks of a group, and over groups: one row for each group is the most a task sorts at once.
    """
    names = list(values)
    rows = rows.withColumns(values | {"_block": F.shiftright(at, bits), "_group": F.shiftright(at, 2 * bits)})
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    earlier = lambda n, w: F.coalesce(F.sum(n).over(before(w)), F.lit(0))
    blocks = rows.groupBy("_group", "_block").agg(*[F.sum(n).alias(n) for n in names])
    groups = blocks.groupBy("_group").agg(*[F.sum(n).alias(n) for n in names])
    groups = groups.select("_group", *[earlier(n, Window.orderBy("_group")).alias(f"_g_{n}") for n in names])
    blocks = blocks.select("_group", "_block", *[earlier(n, Window.partitionBy("_group").orderBy("_block")).alias(f"_b_{n}") for n in names])
    start = blocks.join(groups, "_group").select(F.col("_block").alias("_of"), *[(F.col(f"_b_{n}") + F.col(f"_g_{n}")).alias(f"_s_{n}") for n in names])
    inside = Window.partitionBy("_block").orderBy(at, *then).rowsBetween(Window.unboundedPreceding, 0)
    summed = rows.withColumns({n: F.sum(n).over(inside) for n in names})
    return summed.join(start, F.col("_block") == F.col("_of")).withColumns({n: F.col(n) + F.col(f"_s_{n}") for n in names}).drop("_of", "_block", "_group", *[f"_s_{n}" for n in names])


def beside(rows: DataFrame, at: str, bits: int, **values: tuple[str, int]) -> DataFrame:
    """``rows``, numbered without gaps by ``at``, with columns of the row before (-1) or after (1); null where there is none."""
    own = F.shiftright(at, bits)
    lent = F.array_distinct(F.array(own, F.shiftright(F.col(at) - 1, bits), F.shiftright(F.col(at) + 1, bits)))
    w = Window.partitionBy("_block").orderBy(at)
    near = rows.withColumn("_block", F.explode(lent)).withColumns({name: F.lag(c, -away).over(w) if away > 0 else F.lag(c, 1).over(w) for name, (c, away) in values.items()})
    return near.where(F.col("_block") == own).drop("_block")


def _clean(line: Column) -> Column:
    return X.rstrip(F.regexp_replace(line, "[ \t]+", " "))


def _measures(text: Column) -> dict[str, Column]:
    """What sections and sizes need of a line's text."""
    return {"name": F.when(X.is_heading(text), X.heading_text(text)), "words": X.word_count(text), "chars": F.length(text), "lead": F.length(text) - F.length(F.ltrim(text, F.lit(X.WHITE)))}


def _lines(pages: DataFrame, document: str, page: str, text: str) -> DataFrame:
    """``_d, _m, line``: lines in the order of ``_m``."""
    own = pages.select(F.col(document).alias("_d"), F.col(page).alias("_page"), F.col(text).alias("_t")).where(F.coalesce("_t", F.lit("")) != "")
    # Pages lie in ranges of their order: the ids of exploded lines follow it.
    dealt = own.repartitionByRange("_d", "_page", "_t").sortWithinPartitions("_d", "_page", "_t")
    lines = dealt.select("_d", F.explode(F.split("_t", "\n")).alias("line")).withColumn("_m", F.monotonically_increasing_id())
    return _stored(lines.where(X.strip(F.col("line")) != ""), "lines")


def _facts(lines: DataFrame, bits: int) -> DataFrame:
    """``_d, _doc, _n, _m`` and measures of cleaned lines that are kept; ``_n`` orders them, ``_doc`` numbers the documents, ``_join`` is the text of a label with its number."""
    found = lambda pattern: F.when(F.col("line").rlike(pattern), F.regexp_extract("line", pattern, 1))
    own = lines.select("_d", "_m", found(r"(?U)^([^\n:]{2,}?:)\s*\z").alias("label"), found(r"(?U)^\s*(\d{3,})\s*\z").alias("number"), F.col("line").rlike(X.BOILERPLATE_LINE).alias("_idle"), _clean(F.col("line")).alias("_t"))
    own = _stored(own.select("_d", "_m", "label", "number", "_idle", *[c.alias(n) for n, c in _measures(F.col("_t")).items()]), "facts")
    rows = running(own, "_m", bits, _n=F.lit(1).cast("long"))
    rows = beside(rows, "_n", bits, before=("_d", -1), any_before=("_n", -1), after=("_d", 1), any_after=("_n", 1), label_before=("label", -1), number_after=("number", 1))
    first = F.col("any_before").isNull() | ~F.col("before").eqNullSafe(F.col("_d"))
    last = F.col("any_after").isNull() | ~F.col("after").eqNullSafe(F.col("_d"))
    joined = F.col("label").isNotNull() & ~last & F.col("number_after").isNotNull()
    used = F.col("number").isNotNull() & ~first & F.col("label_before").isNotNull()
    cleaned = rows.select("_d", "_m", first.alias("_first"), (~used & (joined | ~F.col("_idle"))).alias("_kept"), F.when(joined, _clean(F.concat_ws(" ", "label", "number_after"))).alias("_join"), "name", "words", "chars", "lead")
    cleaned = cleaned.withColumns({n: F.when(F.col("_join").isNull(), F.col(n)).otherwise(c) for n, c in _measures(F.col("_join")).items()})
    counted = running(cleaned, "_m", bits, _doc=F.col("_first").cast("long"), _n=F.col("_kept").cast("long"))
    return _stored(counted.where("_kept").drop("_first", "_kept"), "facts")


def _sectioned(facts: DataFrame, bits: int) -> DataFrame:
    """Lines with ``_sec``, the section they stand in, its number and heading; headings only where the document is one section."""
    lines = beside(facts.withColumn("_head", F.col("name").isNotNull()), "_n", bits, before=("_doc", -1), head_before=("_head", -1), name_before=("name", -1))
    own = F.coalesce(F.col("before") == F.col("_doc"), F.lit(False))
    starts = ~F.col("_head") & (~own | F.col("head_before"))
    lines = lines.withColumns({"_start": starts, "heading": F.when(starts, F.when(own, F.col("name_before")).otherwise("Introduction"))})
    lines = _stored(running(lines, "_n", bits, _run=F.col("_start").cast("long")).drop("before", "head_before", "name_before", "name"), "facts")
    runs = lambda f: f(F.when(~F.col("_head"), F.col("_run")))
    docs = lines.groupBy("_doc").agg(runs(F.min).alias("_low"), runs(F.max).alias("_high"))
    lines = to_totals(lines, docs, "_doc").withColumn("_parted", F.coalesce(F.col("_high") > F.col("_low"), F.lit(False)))
    lines = lines.where(~F.col("_parted") | ~F.col("_head"))
    trimmed = F.col("_parted") & F.col("_start")
    return lines.select(
        "_d", "_n", "_m", F.when(F.col("_parted"), F.col("_run")).otherwise(-F.col("_doc")).alias("_sec"), F.when(F.col("_parted"), (F.col("_run") - F.col("_low")).cast("int")).otherwise(0).alias("section"),
        F.when(F.col("_parted"), F.col("heading")).alias("heading"), F.when(F.col("_parted"), "hierarchical").otherwise("generic").alias("chunk_type"),
        "_join", trimmed.alias("_trim"), "words", F.when(trimmed, F.col("chars") - F.col("lead")).otherwise(F.col("chars")).alias("chars"),
    )


def _texts(lines: DataFrame, placed: DataFrame, how: str = "inner") -> DataFrame:
    """``placed`` lines with their ``text``."""
    text = F.coalesce("_join", _clean(F.col("line")))
    trimmed = F.when(F.col("_trim"), F.ltrim(text, F.lit(X.WHITE))).otherwise(text)
    return lines.select("_m", "line").join(placed, "_m", how).withColumn("text", trimmed).drop("line", "_join", "_trim", "_m")


class Cuts:
    """A block's pieces (own ones, one before, some after): where a chunk that starts at a piece ends, and where the next one starts."""

    def __init__(self, table: pa.Table, block: int, bits: int, size: int, overlap: int) -> None:
        table = table.sort_by("_j")
        self.table = table
        j, sec, n, length = (table[c].to_numpy() for c in ("_j", "_sec", "_n", "_len"))
        self.low = block << bits
        lent = int(np.searchsorted(j, self.low))
        self.begin = np.ones(len(j), bool)
        self.begin[1:] = (sec[1:] != sec[:-1]) | (n[1:] != n[:-1] + 1)
        if not lent:
            self.begin[:1] = True
        self.ends = np.concatenate(([0], np.cumsum(length)))
        borders = np.append(np.flatnonzero(self.begin), len(j))
        place = np.arange(len(j))
        run_end = borders[np.searchsorted(borders, place, "right")]
        self.stop = np.minimum(np.searchsorted(self.ends, self.ends[:-1] + size, "right") - 1, run_end)
        after = np.minimum(self.stop + 1, len(j))
        back = np.searchsorted(self.ends, np.maximum(self.ends[self.stop] - overlap, self.ends[after] - size), "left")
        self.next = np.where(self.stop == run_end, self.stop, back)
        self.own = slice(lent, int(np.searchsorted(j, (block + 1) << bits)))
        self.shift = int(j[0])
        self.sec, self.n = sec, n

    def exits(self) -> np.ndarray:
        """For each own piece: the place (by ``_j``) where the chunks that start there leave the block."""
        out = self.next.copy()
        for a in range(self.own.stop - 1, self.own.start - 1, -1):
            if self.next[a] < self.own.stop:
                out[a] = out[self.next[a]]
        return out[self.own] + self.shift


def _dealt(pieces: DataFrame, bits: int, size: int) -> DataFrame:
    """Pieces in their block, the last also in the next one and the first ones in the one before."""
    own = F.shiftright("_j", bits)
    # A chunk of ``size`` characters has no more lines than this.
    after = F.shiftright(F.col("_j") - (size // 2 + 3), bits)
    lent = F.array_distinct(F.array(own, after, F.shiftright(F.col("_j") + 1, bits)))
    return pieces.withColumn("_block", F.explode(lent)).where("_block >= 0")


def _entries(dealt: DataFrame, bits: int, size: int, overlap: int) -> DataFrame:
    """``_block, _entry``: the first chunk's place in each block that doesn't begin with a run of its own."""

    def maps(key: tuple, table: pa.Table) -> pa.Table:
        block = key[0].as_py()
        rows: dict[str, list] = {"_sec": [], "_block": [], "_at": [], "_exit": []}
        cuts = Cuts(table, block, bits, size, overlap)
        if cuts.own.stop > cuts.own.start:
            exits, begin, sec = cuts.exits(), cuts.begin[cuts.own], cuts.sec[cuts.own]
            if not begin[0]:
                # Equal exits in a row are one entry of the map.
                change = np.flatnonzero(np.append(True, exits[1:] != exits[:-1]))
                rows["_sec"].append(int(sec[0]))
                rows["_at"].append((change + cuts.low).tolist())
                rows["_exit"].append(exits[change].tolist())
            if begin.any() and (begin[0] or sec[-1] != sec[0]):
                # All chunks pass through the beginning of a run.
                rows["_sec"].append(int(sec[-1]))
                rows["_at"].append([cuts.low])
                rows["_exit"].append([int(exits[np.flatnonzero(begin)[-1]])])
        rows["_block"] = [block] * len(rows["_sec"])
        kinds = {"_sec": pa.int64(), "_block": pa.int64(), "_at": pa.list_(pa.int64()), "_exit": pa.list_(pa.int64())}
        return pa.table({c: pa.array(rows[c], t) for c, t in kinds.items()})

    def chained(table: pa.Table) -> pa.Table:
        table = table.sort_by("_block")
        blocks, entries, entry = [], [], None
        for block, at, out in zip(*(table[c].to_pylist() for c in ("_block", "_at", "_exit")), strict=True):
            if entry is not None and entry >> bits == block:
                blocks.append(block)
                entries.append(entry)
                entry = out[int(np.searchsorted(at, entry, "right")) - 1]
            else:
                entry = out[0]
        return pa.table({"_block": pa.array(blocks, pa.int64()), "_entry": pa.array(entries, pa.int64())})

    found = dealt.select("_block", "_j", "_sec", "_n", "_len").groupBy("_block").applyInArrow(maps, "_sec bigint, _block bigint, _at array<bigint>, _exit array<bigint>")
    return found.groupBy("_sec").applyInArrow(chained, "_block bigint, _entry bigint")


def _cut(dealt: DataFrame, entries: DataFrame, bits: int, size: int, overlap: int) -> DataFrame:
    """``_sec, _n, _j, _stop``: every block's chunks, by the numbers of the first piece and the one after the last."""

    def run(key: tuple, table: pa.Table, found: pa.Table) -> pa.Table:
        rows: dict[str, list] = {"_sec": [], "_n": [], "_j": [], "_stop": []}
        if len(table):
            cuts = Cuts(table, key[0].as_py(), bits, size, overlap)
            at = int(found["_entry"][0].as_py()) - cuts.shift if len(found) else cuts.own.start
            while at < cuts.own.stop:
                for name, value in zip(rows, (cuts.sec[at], cuts.n[at], at + cuts.shift, cuts.stop[at] + cuts.shift), strict=True):
                    rows[name].append(int(value))
                at = int(cuts.next[at])
        return pa.table({c: pa.array(v, pa.int64()) for c, v in rows.items()})

    own = dealt.select("_block", "_j", "_sec", "_n", "_len")
    return own.groupBy("_block").cogroup(entries.groupBy("_block")).applyInArrow(run, "_sec bigint, _n bigint, _j bigint, _stop bigint")


def _filled(pieces: DataFrame, cuts: DataFrame, bits: int, size: int) -> DataFrame:
    """``cuts`` (``_j, _stop`` and others) with their ``content``, from pieces ``_j, piece``."""
    others = [f for f in cuts.schema if f.name not in ("_j", "_stop")]

    def run(key: tuple, table: pa.Table, found: pa.Table) -> pa.Table:
        table, found = table.sort_by("_j"), found.sort_by("_j")
        texts = table["piece"].to_pylist()
        shift = table["_j"][0].as_py() if texts else 0
        content = ["".join(texts[a - shift : b - shift]).strip() for a, b in zip(found["_j"].to_pylist(), found["_stop"].to_pylist(), strict=True)]
        return found.select(names).append_column("content", pa.array(content, pa.string()))

    names = [f.name for f in others]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in others)
    own, before = F.shiftright("_j", bits), F.shiftright(F.col("_j") - (size // 2 + 3), bits)
    # A block's last chunks go on in the next one: that lends its first pieces.
    dealt = pieces.select(F.explode(F.array_distinct(F.array(own, before))).alias("_block"), "_j", "piece").where("_block >= 0")
    return dealt.groupBy("_block").cogroup(cuts.withColumn("_block", own).groupBy("_block")).applyInArrow(run, f"{fields}, content string")


def _split_alone(pieces: DataFrame, cfg: SplitConfig) -> DataFrame:
    """``_sec, _n, _sub, content``: pieces that are too long, or all of their section, split by themselves."""
    size, overlap, separators = cfg.chunk_size, cfg.overlap, cfg.separators
    finer = separators[separators.index("\n") + 1 :]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(s, n, k, x) for s, n, alone, t in zip(*(c.to_pylist() for c in batch.columns), strict=True) for k, x in enumerate(splitting.recursive_split(t, size, overlap, separators if alone else finer))]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int32(), pa.string()))], ["_sec", "_n", "_sub", "content"])

    return pieces.select("_sec", "_n", "_alone", "piece").mapInArrow(run, "_sec bigint, _n bigint, _sub int, content string")


def split_combined(pages: DataFrame, document: str, page: str, text: str, cfg: SplitConfig = SplitConfig(), bits: int = BITS) -> DataFrame:  # noqa: B008
    """As ``split_texts(combined_pages(...), mode="recursive")``: ``document, page (null), section, part, heading, chunk_type, content, token_count, chunk_id``.

    Pages without text play no part; those of one number follow by their texts. The separators must hold a line feed, and none before it may occur in text without empty lines.
    """
    if "\n" not in cfg.separators or any("\n\n" not in s for s in cfg.separators[: cfg.separators.index("\n")]):
        raise ValueError("separators must begin with line feeds")
    size, overlap = cfg.chunk_size, cfg.overlap
    if 2 * (size // 2 + 3) > 1 << bits:
        raise ValueError("a block must hold two chunks")
    lines = _lines(pages, document, page, text)
    placed = _stored(_sectioned(_facts(lines, bits), bits), "sectioned")
    sums = placed.groupBy("_sec").agg(
        F.first("_d").alias("_d"), F.first("section").alias("section"), F.first("chunk_type").alias("chunk_type"), F.max("heading").alias("heading"),
        F.min("_n").alias("_low"), F.count("*").alias("_lines"), F.sum("words").alias("_words"), F.sum("chars").alias("_chars"),
    )
    tokens = F.greatest(F.lit(1), (F.col("_words") * F.lit(1.3) + (F.col("_chars") + F.col("_lines") - 1) * F.lit(0.2)).cast("int"))
    sections = _stored(sums.withColumn("_long", tokens > cfg.max_tokens_single), "sections")
    sized = to_totals(placed.select("_sec", "_n", "_m", "_join", "_trim", "chars"), sections.select("_sec", "_low", "_lines", "_long"), "_sec")
    sized = sized.withColumns({"_later": F.col("_n") != F.col("_low"), "_alone": F.col("_lines") == 1}).withColumn("_len", F.col("chars") + F.col("_later").cast("int"))
    sized = _stored(sized.withColumn("_apart", F.col("_alone") | (F.col("_len") > size)).drop("chars", "_low", "_lines"), "sized")
    piece = F.when(F.col("_later"), F.concat(F.lit("\n"), "text")).otherwise(F.col("text"))
    facts = sections.select("_sec", "_d", "section", "heading", F.when(F.col("_long"), "recursive").otherwise(F.col("chunk_type")).alias("chunk_type"), "_long")

    # Chunks of long sections: pieces that are split by themselves (only long lines can be), and cuts between the others.
    apart = _texts(lines.where(F.length("line") >= min(size, cfg.max_tokens_single)), sized.where("_long and _apart"), "right")
    alone = _stored(_split_alone(apart.withColumn("piece", piece), cfg), "alone")
    small = running(sized.where("_long and not _apart").select("_sec", "_n", "_m", "_join", "_trim", "_later", "_len"), "_n", bits, _j=F.lit(1).cast("long"))
    small = _stored(small.withColumn("_j", F.col("_j") - 1), "pieces")
    dealt = _dealt(small.select("_j", "_sec", "_n", "_len"), bits, size)
    cuts = _stored(_cut(dealt, _entries(dealt, bits, size, overlap), bits, size, overlap), "cuts")
    # Places within the section: chunks before, less those before the section's first.
    marks = cuts.select("_sec", "_n", F.lit(1).cast("long").alias("_c")).unionByName(alone.groupBy("_sec", "_n").agg(F.count("*").alias("_c")))
    numbered = running(marks, "_n", bits, _q=F.col("_c")).select("_sec", "_n", (F.col("_q") - F.col("_c")).alias("_q"))
    numbered = _stored(numbered, "numbered")
    long = to_totals(numbered, facts.join(numbered.groupBy("_sec").agg(F.min("_q").alias("_q0")), "_sec"), "_sec").withColumn("part", (F.col("_q") - F.col("_q0")).cast("int")).drop("_sec", "_q", "_q0")

    # Texts move to their chunks. Sections within the limit: their tokens bound their lines.
    ordered = F.sort_array(F.collect_list(F.struct("_n", "text")))
    short = lambda: _texts(lines, sized.where("not _long").select("_sec", "_n", "_m", "_join", "_trim")).groupBy("_sec").agg(F.array_join(F.transform(ordered, lambda x: x["text"]), "\n").alias("content"))
    pieces = _texts(lines, small.select("_j", "_m", "_join", "_trim", "_later")).select("_j", piece.alias("piece"))
    columns = ["_d", "section", "part", "heading", "chunk_type", "content", "_long"]
    chunks = _filled(pieces, cuts.drop("_sec").join(long, "_n"), bits, size).select(columns)
    if not sections.where("not _long").isEmpty():
        chunks = chunks.unionByName(short().join(facts, "_sec").withColumn("part", F.lit(0)).select(columns))
    chunks = chunks.unionByName(alone.join(long, "_n").withColumn("part", F.col("part") + F.col("_sub")).select(columns))
    out = chunks.select(F.col("_d").alias(document), F.lit(None).cast(pages.schema[page].dataType).alias(page), *columns[1:])
    made = with_identity(out, document, page)
    return made.where(~F.col("_long") | (F.col("token_count") >= cfg.min_part_tokens)).drop("_long")
