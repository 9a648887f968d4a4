"""Page records from page texts: source choice, cleaning, headings, counts, line boxes."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from docflow.functions import ids, text as X
from docflow.operators.joins import to_totals
from docflow.operators.rows import passing
from docflow.schema import PageConfig


def page_text(embedded: Column, recognised: Column | None) -> Column:
    """``struct<text, source>``: embedded text if there is any, else recognised text, else empty (tagged text)."""
    own, ocr = X.strip(F.coalesce(embedded, F.lit(""))), X.strip(F.coalesce(recognised, F.lit(""))) if recognised is not None else F.lit("")
    pair = lambda t, s: F.struct(t.alias("text"), F.lit(s).alias("source"))
    return F.when(own != "", pair(own, "text")).when(ocr != "", pair(ocr, "ocr")).otherwise(pair(F.lit(""), "text"))


def recognise(pages: DataFrame, embedded: str, image: str, ocr: Callable[[bytes], str], out: str = "recognised") -> DataFrame:
    """``pages`` with recognised text. Only pages without embedded text meet the engine; a page it fails on has none."""
    blank = X.strip(F.coalesce(F.col(embedded), F.lit(""))) == ""

    def read(value: bytes | None) -> str | None:
        try:
            return ocr(value) if value is not None else None
        except Exception:  # noqa: BLE001 - an engine's failure leaves the page empty
            return None

    def run(batches):
        for batch in batches:
            at = batch.schema.names.index(image)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([read(x) for x in batch.column(at).to_pylist()], pa.string())], [*batch.schema.names, out])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.schema)
    return pages.where(~blank).withColumn(out, F.lit(None).cast("string")).unionByName(pages.where(blank).mapInArrow(run, f"{fields}, {out} string"))


def spans(lines: Column, height: Column) -> Column:
    """``array<struct<text, bbox>>`` with the origin at the bottom left; lines without area or text are left out.

    ``lines`` has ``x0, y0, x1, y1, text`` with the origin at the top left.
    """
    real = F.filter(lines, lambda x: (x["x1"] - x["x0"] > 0) & (x["y1"] - x["y0"] > 0) & (X.strip(F.coalesce(x["text"], F.lit(""))) != ""))
    box = lambda x: F.struct(x["x0"].alias("x"), (height - x["y1"]).alias("y"), (x["x1"] - x["x0"]).alias("width"), (x["y1"] - x["y0"]).alias("height"))
    return F.coalesce(F.transform(real, lambda x: F.struct(X.strip(x["text"]).alias("text"), box(x).alias("bbox"))), F.array().cast("array<struct<text:string,bbox:struct<x:double,y:double,width:double,height:double>>>"))


def union_bbox(found: Column) -> Column:
    """Box around all spans; spans without one don't count, none gives null."""
    boxes = F.transform(F.filter(found, lambda s: s["bbox"].isNotNull()), lambda s: s["bbox"])
    x, y = F.array_min(F.transform(boxes, lambda b: b["x"])), F.array_min(F.transform(boxes, lambda b: b["y"]))
    right, top = F.array_max(F.transform(boxes, lambda b: b["x"] + b["width"])), F.array_max(F.transform(boxes, lambda b: b["y"] + b["height"]))
    return F.when(F.size(boxes) > 0, F.struct(x.alias("x"), y.alias("y"), (right - x).alias("width"), (top - y).alias("height")))


def page_records(pages: DataFrame, document: str, number: str, embedded: str, recognised: str | None = None, cfg: PageConfig = PageConfig()) -> DataFrame:  # noqa: B008
    """One row a page: ``document, pageNumber, pageId, textSource, headings, wordCount, charCount, pageIndicator`` and ``content``.

    Page totals count all pages, also those left out as empty.
    """
    totals = pages.groupBy(document).agg(F.count("*").alias("_total"))
    read = pages.select(document, F.col(number).alias("pageNumber"), page_text(F.col(embedded), F.col(recognised) if recognised and cfg.use_ocr else None).alias("_p"))
    read = read.select(document, "pageNumber", F.col("_p.source").alias("textSource"), F.col("_p.text").alias("_own"))
    content = X.page_clean(F.col("_own")) if cfg.trim else F.col("_own")
    rows = passing(read, [document, "pageNumber", "textSource"], content, "content", lambda t: X.strip(t) != "" if cfg.skip_empty else F.lit(True))
    out = to_totals(rows, totals, document).withColumns(
        {
            "pageId": ids.page_id(F.col(document), F.col("pageNumber")), "headings": X.headings(F.col("content")), "wordCount": X.word_count(F.col("content")),
            "charCount": F.length("content"), "pageIndicator": X.page_indicator(F.col("pageNumber"), F.col("_total")),
        }
    )
    return out.drop("_total") if cfg.keep_text else out.drop("_total", "content")


def extraction_summary(pages: DataFrame, records: DataFrame, document: str) -> DataFrame:
    """``document, totalPages, pagesReturned, ocrUsed`` of every document."""
    totals = pages.groupBy(document).agg(F.count("*").alias("totalPages"))
    found = records.groupBy(document).agg(F.count("*").alias("pagesReturned"), F.bool_or(F.col("textSource") == "ocr").alias("ocrUsed"))
    return totals.join(found, document, "left").select(document, "totalPages", F.coalesce("pagesReturned", F.lit(0)).cast("long").alias("pagesReturned"), F.coalesce("ocrUsed", F.lit(False)).alias("ocrUsed"))


def view_pages(pages: DataFrame, document: str, number: str, items: str) -> DataFrame:
    """Viewer rows: items joined, empty pages kept, with the number of pages and ``Page i``."""
    totals = pages.groupBy(document).agg(F.count("*").alias("totalPages"))
    return to_totals(pages, totals, document).select(document, F.col(number).alias("pageNumber"), X.view_text(F.col(items)).alias("text"), "totalPages", X.page_indicator(F.col(number)).alias("pageIndicator"))


def numbered(pages: DataFrame, number: str) -> DataFrame:
    """Pages whose number is one; others are skipped."""
    return pages.withColumn(number, F.expr(f"try_cast(`{number}` as int)")).where(F.col(number).isNotNull())
