"""Chunks from positioned lines, and documents whose pages may or may not have them.

Spans are packed in columns, page by page, without a shuffle and without Python: cumulative token counts by
doubling, for every span the end of the run that would start there (a search by halving steps over these counts),
and from the first span on the starts of all runs by pointer jumping: each round doubles the known starts and
the length of the jumps. A page of n spans takes about 3 log2(n) passes over its arrays. Only short runs, which
depend on what joined a chunk before, are folded, within the chunk they may join.

Defined results: null and empty arrays, null spans and blank texts give no chunk; a box without a value in any span is null;
null documents and pages stay; repeated pages are packed each; other columns aren't read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from docflow.functions import ids, text as X
from docflow.operators import chunks, pages as P
from docflow.schema import SplitConfig


def _doublings(n: Column) -> Column:
    """1, 2, 4, ... up to the first power of two that isn't below ``n``."""
    return F.transform(F.sequence(F.lit(0), F.length(F.bin(F.greatest(n, F.lit(1)))).cast("int")), lambda k: F.pow(F.lit(2), k).cast("int"))


def running_totals(sizes: Column, steps: Column) -> Column:
    """Cumulative sums of an array."""
    return F.aggregate(steps, sizes, lambda sums, step: F.transform(sums, lambda x, i: x + F.coalesce(F.get(sums, i - step), F.lit(0).cast("long"))))


def run_ends(sizes: Column, totals: Column, steps: Column, limit: int) -> Column:
    """For every place the end (exclusive) of the run that starts there: as many neighbours as have ``limit`` together, one at least; last, the array's own end."""
    n = F.size(sizes)
    before = lambda i: F.get(totals, i) - F.get(sizes, i)

    def further(end: Column, i: Column, step: Column) -> Column:
        return F.when((end + step <= n) & (F.get(totals, end + step - 1) - before(i) <= limit), end + step).otherwise(end)

    first = F.transform(sizes, lambda x, i: i)
    reached = F.aggregate(F.reverse(steps), first, lambda ends, step: F.transform(ends, lambda end, i: further(end, i, step)))
    return F.concat(F.transform(reached, lambda end, i: F.greatest(end, i + 1)), F.array(n))


def run_starts(ends: Column, steps: Column) -> Column:
    """Starts of the runs from place 0 on, by pointer jumping over ``run_ends``."""
    n = F.size(ends) - 1
    known = F.when(n > 0, F.array(F.lit(0))).otherwise(F.array().cast("array<int>"))
    start = F.struct(known.alias("starts"), ends.alias("jump"))

    def doubled(s: Column, step: Column) -> Column:
        beyond = F.filter(F.transform(s["starts"], lambda x: F.get(s["jump"], x)), lambda x: x < n)
        return F.struct(F.concat(s["starts"], beyond).alias("starts"), F.transform(s["jump"], lambda x: F.get(s["jump"], x)).alias("jump"))

    return F.aggregate(steps, start, doubled, lambda s: s["starts"])


def _box(spans: Column) -> Column:
    """Smallest box around those of the spans."""
    boxes = F.transform(F.filter(spans, lambda s: s["bbox"].isNotNull()), lambda s: s["bbox"])

    def around(b: Column) -> Column:
        left, bottom = F.array_min(F.transform(b, lambda s: s["x"])), F.array_min(F.transform(b, lambda s: s["y"]))
        right, top = F.array_max(F.transform(b, lambda s: s["x"] + s["width"])), F.array_max(F.transform(b, lambda s: s["y"] + s["height"]))
        return F.when(F.size(b) > 0, F.struct(left.alias("x"), bottom.alias("y"), (right - left).alias("width"), (top - bottom).alias("height")))

    return X.bound(boxes, around)


def _with_tails(runs: Column, cfg: SplitConfig) -> Column:
    """``content, first, bbox, dropped`` of each run that stands for itself, with the short ones after it that fit; ``dropped`` counts those of the whole page that don't."""
    most = int(1.2 * cfg.chunk_size)
    own = F.filter(F.transform(runs, lambda r, i: F.when(~r["short"], i)), lambda i: i.isNotNull())

    def made(at: Column) -> Column:
        def chunk(i: Column, k: Column) -> Column:
            run = F.get(runs, i)
            after = F.slice(runs, i + 2, F.coalesce(F.get(at, k + 1), F.size(runs)) - i - 1)

            def joined(s: Column, r: Column) -> Column:
                longer = F.concat_ws("\n", s["content"], r["text"])
                return F.when(X.token_count(longer) <= most, F.struct(longer.alias("content"), s["dropped"].alias("dropped"))).otherwise(F.struct(s["content"].alias("content"), (s["dropped"] + 1).alias("dropped")))

            whole = F.aggregate(after, F.struct(run["text"].alias("content"), F.lit(0).alias("dropped")), joined)
            return X.bound(whole, lambda w: F.struct(w["content"].alias("content"), run["text"].alias("first"), run["bbox"].alias("bbox"), w["dropped"].alias("dropped")))

        # Short runs before the first other one have nothing to join.
        lost = lambda found: F.aggregate(found, F.get(at, F.lit(0)), lambda s, c: s + c["dropped"])
        return X.bound(F.transform(at, chunk), lambda found: X.bound(lost(found), lambda n: F.transform(found, lambda c: c.withField("dropped", n))))

    return X.bound(own, made)


def packed(spans: Column, cfg: SplitConfig) -> Column:
    """Chunks ``content, first, bbox, dropped`` of a page's spans: runs of neighbours up to ``chunk_size`` tokens, a span above that alone.

    A run of spans shorter than ``min_chars`` joins the chunk before if that stays
    within 1.2 times the limit (its tokens, id and box stay those of its first part), else it is dropped.
    """
    known = F.filter(F.transform(spans, lambda s: F.struct(X.strip(s["text"]).alias("text"), s["bbox"].alias("bbox"))), lambda s: F.coalesce(s["text"], F.lit("")) != "")
    lines = F.transform(known, lambda s: s.withField("size", X.token_count(s["text"]).cast("long")))

    def runs(found: Column, sizes: Column, ends: Column, starts: Column) -> Column:
        def run(at: Column) -> Column:
            inside = F.slice(found, at + 1, F.get(ends, at) - at)
            text = F.array_join(F.transform(inside, lambda s: s["text"]), "\n")
            return X.bound(text, lambda t: F.struct(t.alias("text"), _box(inside).alias("bbox"), ((F.get(sizes, at) <= cfg.chunk_size) & (F.length(t) < cfg.min_chars)).alias("short")))

        return F.transform(starts, run)

    def by_runs(found: Column, sizes: Column, steps: Column) -> Column:
        ends = X.bound(running_totals(sizes, steps), lambda totals: run_ends(sizes, totals, steps, cfg.chunk_size))
        made = lambda e: X.bound(run_starts(e, steps), lambda s: runs(found, sizes, e, s))
        return X.bound(X.bound(ends, made), lambda r: _with_tails(r, cfg))

    return X.bound(lines, lambda found: X.bound(F.transform(found, lambda s: s["size"]), lambda sizes: X.bound(_doublings(F.size(sizes)), lambda steps: by_runs(found, sizes, steps))))


def span_chunks(pages: DataFrame, document: str, page: str, spans: str, cfg: SplitConfig = SplitConfig()) -> DataFrame:  # noqa: B008
    """``document, page, part, chunk_type, content, token_count, chunk_id, bbox, dropped_tails`` of pages with spans.

    Packing depends on order within a page; pages are independent. Tokens, id and box are those of a chunk before a short tail joined it.
    """
    own = pages.select(document, page, F.coalesce(F.col(spans), F.array().cast(pages.schema[spans].dataType)).alias("_spans"))
    rows = own.select(document, page, F.posexplode(packed(F.col("_spans"), cfg)).alias("part", "_c"))
    key = ids.chunk_id(F.col(document), F.col(page), F.lit(None).cast("string"), F.lit("by_spans"), F.col("_c.first"))
    return rows.select(document, page, "part", F.col("_c.content").alias("content"), X.token_count(F.col("_c.first")).alias("token_count"), F.col("_c.bbox").alias("bbox"), F.col("_c.dropped").alias("dropped_tails"), F.lit("by_spans").alias("chunk_type"), key.alias("chunk_id"))


def pages_with_spans(pages: DataFrame, document: str, page: str, spans: str, text: str, mode: str = "semantic", cfg: SplitConfig = SplitConfig()) -> DataFrame:  # noqa: B008
    """Chunks of pages: by spans where a page has some, else by its text. Pages without a number are skipped."""
    known = P.numbered(pages, page)
    has = F.coalesce(F.size(spans), F.lit(0)) > 0
    by_span = span_chunks(known.where(has), document, page, spans, cfg).withColumns({"section": F.lit(0), "heading": F.lit(None).cast("string")}).drop("bbox", "dropped_tails")
    by_text = chunks.split_texts(known.where(~has), document, page, text, mode, cfg)
    return chunks.capped(by_span.unionByName(by_text), document, [page, "section", "part"], cfg.max_chunks)
