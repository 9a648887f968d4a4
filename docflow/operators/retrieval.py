"""Similarity search and the assembly of answers."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from docflow.functions import text as X
from docflow.operators.neighbours import BLOCK, PIVOTS, search
from docflow.schema import ANSWER, AnswerConfig

def nearest(queries: DataFrame, rows: DataFrame, k: int | None = 10, within: tuple[str, str] | None = None, block: int = BLOCK, pivots: int = PIVOTS) -> DataFrame:
    """``query_id, row_id, distance, rank``: the k nearest rows of each query, see :func:`docflow.operators.neighbours.search`."""
    return search(queries, rows, k, within, block, pivots).found


def first_of_document(found: DataFrame, matches: Column, n: int) -> DataFrame:
    """Rows that match, re-ranked, the first ``n``: the filter stands above the ranking, so fewer may remain."""
    own = found.where(matches).withColumn("used_rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank")))
    return own.where(F.col("used_rank") <= n)


def context(rows: DataFrame, query: str, rank: str, content: str, cfg: AnswerConfig = AnswerConfig()) -> DataFrame:  # noqa: B008
    """``query, context``: the contents in rank order, joined."""
    ordered = F.sort_array(F.collect_list(F.struct(F.col(rank).alias("r"), F.col(content).alias("c"))))
    return rows.groupBy(query).agg(F.array_join(F.transform(ordered, lambda x: x["c"]), cfg.separator).alias("context"))


def sources(rows: DataFrame, content: str, page: str, question: str) -> DataFrame:
    """Rows as answer sources: ``textMatch, pageIndicator, confidence, highlights`` beside their metadata."""
    return rows.withColumns({"textMatch": F.col(content), "pageIndicator": X.page_indicator(F.col(page)), "confidence": F.lit(1), "highlights": X.highlights(F.col(content), F.col(question))})


def parse_answer(raw: Column) -> Column:
    """The generator's JSON as a struct; anything else fails."""
    return F.from_json(raw, ANSWER, {"mode": "FAILFAST"})


def stored_answer(answer: Column) -> Column:
    """What is kept as the assistant's message."""
    return F.coalesce(F.nullif(answer, F.lit("")), F.lit("No answer"))


#: Asks for the JSON that ``parse_answer`` reads.
PROMPT = """Use only the context to answer, and name the page you found it on. Reply with JSON: the answer in the field "contextAnswer",
anything the reader should know besides in "additionalInfo" (empty if there is nothing).

Context:
{context}

Question: {question}
"""


def prompt(context: Column, question: Column, template: str = PROMPT) -> Column:
    """A generator's prompt: ``{context}`` and ``{question}`` of the template filled in; nulls count as empty."""
    before, rest = template.split("{context}")
    between, after = rest.split("{question}")
    empty = lambda c: F.coalesce(c, F.lit(""))
    return F.concat(F.lit(before), empty(context), F.lit(between), empty(question), F.lit(after))


def answered(contexts: DataFrame, context_col: str, question: str, generate: Callable[[str, str], str]) -> DataFrame:
    """``contexts`` with the generator's raw reply in ``raw``."""

    def run(batches):
        for batch in batches:
            names = batch.schema.names
            pairs = zip(batch.column(names.index(context_col)).to_pylist(), batch.column(names.index(question)).to_pylist(), strict=True)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([generate(c or "", q or "") for c, q in pairs], pa.string())], [*names, "raw"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in contexts.schema)
    return contexts.mapInArrow(run, f"{fields}, raw string")


def counted(found: DataFrame, used: DataFrame) -> DataFrame:
    """``query_id, chunksAnalyzed, chunksUsed, status``; a query without usable chunks is not found."""
    analysed, kept = found.groupBy("query_id").agg(F.count("*").alias("chunksAnalyzed")), used.groupBy("query_id").agg(F.count("*").alias("chunksUsed"))
    n = F.coalesce("chunksUsed", F.lit(0)).cast("long")
    return analysed.join(kept, "query_id", "left").select("query_id", "chunksAnalyzed", n.alias("chunksUsed"), F.when(n > 0, "found").otherwise("not_found").alias("status"))


def embedded(df: DataFrame, text: str, embed: Callable[[str], np.ndarray], out: str = "vector") -> DataFrame:
    """``df`` with the embedding of a text column."""

    def run(batches):
        for batch in batches:
            values = [embed(x).astype(np.float32).tolist() if x is not None else None for x in batch.column(batch.schema.names.index(text)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(values, pa.list_(pa.float32()))], [*batch.schema.names, out])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.mapInArrow(run, f"{fields}, {out} array<float>")
