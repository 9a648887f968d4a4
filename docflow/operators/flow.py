"""Whole flows: pages or texts into the index, a question into an answer."""

from __future__ import annotations

import logging
import time
from collections.abc import Callable

import numpy as np
from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

from docflow.functions import text as X
from docflow.operators import chunks, ingest, pages as P, retrieval as R
from docflow.plugins import extractive_answer, hash_embedding
from docflow.schema import AnswerConfig, IngestConfig, PageConfig, SplitConfig
from docflow.sources import index, ordered_writes, sinks

log = logging.getLogger(__name__)


def page_chunks(pages: DataFrame, document: str, page: str, text: str, cfg: SplitConfig = SplitConfig(), rules: IngestConfig = IngestConfig()) -> DataFrame:  # noqa: B008
    """Chunks of pages that are long enough, each content once a document: the first."""
    made = chunks.split_texts(pages, document, page, text, rules.mode, cfg).where(ingest.long_enough(F.col("content"), rules.min_chars))
    return ingest.first_of_equal(made, document, "content", [page, "section", "part"]) if rules.dedupe else made


def ingest_report(records: DataFrame, stored: DataFrame, document: str) -> DataFrame:
    """``document, status, pages_processed, ocr_used, chunk_count, stored, reason`` of every document with pages."""
    seen = records.groupBy(document).agg(F.count("*").alias("pages_processed"), F.bool_or(F.col("textSource") == "ocr").alias("ocr_used"))
    n = F.coalesce("chunk_count", F.lit(0)).cast("long")
    out = seen.join(stored.groupBy(document).agg(F.count("*").alias("chunk_count")), document, "left")
    return out.select(
        document, F.when(n > 0, "success").otherwise("error").alias("status"), "pages_processed", "ocr_used", n.alias("chunk_count"), n.alias("stored"),
        F.when(n == 0, "no_usable_chunks_after_split").alias("reason"),
    )


def ingest_pages(pages: DataFrame, document: str, number: str, embedded: str, recognised: str | None, path: str, model: str, embed: Callable[[str], np.ndarray] = hash_embedding, page_cfg: PageConfig = PageConfig(), cfg: SplitConfig = SplitConfig(), rules: IngestConfig = IngestConfig()) -> DataFrame:  # noqa: B008
    """Page rows through cleaning, splitting, filters and embedding into the index; returns the report."""
    records = P.page_records(pages, document, number, embedded, recognised, page_cfg)
    made = page_chunks(records, document, "pageNumber", "content", cfg, rules)
    index.save(R.embedded(made.withColumnsRenamed({document: "document_id", "pageNumber": "page"}), "content", embed), path, model)
    kept = index.load(made.sparkSession, path, model).select(F.col("document_id").cast("string").alias(document))
    return ingest_report(records.withColumn(document, F.col(document).cast("string")), kept, document)


def _metrics(observed: Observation) -> dict:
    """The metrics; none where Spark found that part of the plan empty and dropped it, metrics and all."""
    try:
        return observed.get
    except Py4JJavaError:
        return {}


def ingest_run(pages: DataFrame, document: str, number: str, embedded: str, recognised: str | None, path: str, model: str, embed: Callable[[str], np.ndarray] = hash_embedding, page_cfg: PageConfig = PageConfig(), cfg: SplitConfig = SplitConfig(), rules: IngestConfig = IngestConfig(), clock: Callable[[], float] = time.perf_counter) -> dict:  # noqa: B008
    """As :func:`ingest_pages` for one upload: its report with seconds by step, counted while the index is written.

    The counts are metrics of the writing job itself, so nothing is read a second time. ``extract_s`` is what is done
    before that job begins, ``store_s`` the job, which extracts, splits and embeds on its way. A lost stage that is worked out again may count its rows again.
    """
    began = clock()
    seen, kept = Observation(), Observation()
    records = P.page_records(pages, document, number, embedded, recognised, page_cfg)
    records = records.observe(seen, F.count(F.lit(1)).alias("pages"), F.count_if(F.col("textSource") == "ocr").alias("ocr"))
    made = R.embedded(page_chunks(records, document, "pageNumber", "content", cfg, rules).withColumnsRenamed({document: "document_id", "pageNumber": "page"}), "content", embed)
    writing = clock()
    index.save(made.observe(kept, F.count(F.lit(1)).alias("chunks")), path, model)
    counts = _metrics(seen) | _metrics(kept)
    n = counts.get("chunks", 0)
    return {
        "status": "success" if n else "error", "pages_processed": counts.get("pages", 0), "ocr_used": counts.get("ocr", 0) > 0, "chunk_count": n, "stored": n,
        "reason": None if n else "no_usable_chunks_after_split", "timings": {"extract_s": round(writing - began, 3), "store_s": round(clock() - writing, 3)},
    }


def ingest_texts(texts: DataFrame, document: str, place: str, text: str, path: str, model: str, metadata: Column | None = None, embed: Callable[[str], np.ndarray] = hash_embedding, cfg: SplitConfig = SplitConfig(), rules: IngestConfig = IngestConfig()) -> DataFrame:  # noqa: B008
    """Text rows into the index, with the caller's metadata beside the chunk's own; returns the counters."""
    named = texts.select(document, place, X.strip(F.coalesce(F.col(text), F.lit(""))).alias("_text")).where("_text != ''")
    made = chunks.split_texts(named, document, place, "_text", rules.mode, cfg).withColumn(place, F.lit(None).cast(texts.schema[place].dataType))
    unique = ingest.first_of_equal(made.where(ingest.long_enough(F.col("content"), rules.min_chars)), document, "content", ["section", "part"]) if rules.dedupe else made
    own = F.create_map(F.lit("chunk_type"), F.col("chunk_type"))
    rows = unique.withColumn("metadata", own if metadata is None else ingest.with_override(own, metadata)).withColumnsRenamed({document: "document_id", place: "page"})
    index.save(R.embedded(rows, "content", embed), path, model)
    return ingest.counters(texts, made, document, text, "content", rules)


def unsupported(spark: SparkSession, document: str) -> DataFrame:
    """The report on a source of no known kind."""
    return spark.createDataFrame([(document, "error", "unsupported_source_type")], "document_id string, status string, reason string")


def ask(questions: DataFrame, rows: DataFrame, generate: Callable[[str, str], str] = extractive_answer, embed: Callable[[str], np.ndarray] = hash_embedding, cfg: AnswerConfig = AnswerConfig()) -> tuple[DataFrame, DataFrame]:  # noqa: B008
    """Answers and sources of questions (``id, document_id, question``) over index rows (``row, document_id, page, content, vector``).

    Answers: ``id, question, answer, additional, chunksAnalyzed, chunksUsed, status``;
    a question without a usable chunk is not found. Sources: a row for each chunk used.
    """
    asked = R.embedded(questions.select("id", "document_id", F.trim("question").alias("question")).where("question != ''"), "question", embed)
    found = R.nearest(asked.select("id", "vector", "document_id"), rows.select(F.col("row").alias("id"), "vector", "document_id"), cfg.retrieved, within=("document_id", "document_id"))
    detail = found.join(rows.select(F.col("row").alias("row_id"), F.col("document_id").alias("found_in"), "page", "content"), "row_id")
    detail = detail.join(asked.select(F.col("id").alias("query_id"), F.col("document_id").alias("asked_of"), "question"), "query_id")
    used = R.first_of_document(detail, F.col("found_in").cast("string") == F.col("asked_of").cast("string"), cfg.used)
    contexts = R.context(used, "query_id", "used_rank", "content", cfg).join(asked.select(F.col("id").alias("query_id"), "question"), "query_id")
    parsed = R.answered(contexts, "context", "question", generate).withColumn("a", R.parse_answer(F.col("raw")))
    counted = asked.select(F.col("id").alias("query_id"), "question").join(R.counted(found, used), "query_id", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    answers = counted.join(parsed.select("query_id", R.stored_answer(F.col("a.contextAnswer")).alias("answer"), F.col("a.additionalInfo").alias("additional")), "query_id", "left").select(
        F.col("query_id").alias("id"), "question", "answer", "additional", zero("chunksAnalyzed"), zero("chunksUsed"), F.coalesce("status", F.lit("not_found")).alias("status")
    )
    return answers, R.sources(used, "content", "page", "question").drop("vector")


def chat_messages(answers: DataFrame, document: str) -> DataFrame:
    """The user's message of every question, then the assistant's where there is an answer: ``document, place, role, content``."""
    said = F.array(
        F.struct(F.lit(0).alias("place"), F.lit("user").alias("role"), F.col("question").alias("content")),
        F.struct(F.lit(1).alias("place"), F.lit("assistant").alias("role"), F.col("answer").alias("content")),
    )
    return answers.select(document, F.explode(said).alias("m")).select(document, "m.*").where("content is not null")


def upload(rows: DataFrame, path: str, ingest_new: Callable[[DataFrame], object]) -> bool:
    """Append document rows, then ingest them; a failed ingest is logged and leaves the rows. Returns whether it went through."""
    sinks.append(rows, path)
    try:
        ingest_new(rows)
    except Exception:  # noqa: BLE001 - the rows stay, as the upload did happen
        log.exception("ingest failed")
        return False
    return True


def converse(questions: DataFrame, path: str, answer: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Append the users' messages, then the assistant's; if answering fails only the first remain, and the failure is raised.

    ``questions`` has ``id, document_id, question``; ``answer`` gives ``id, answer`` for them.
    """
    message = lambda role, content: (F.col("id"), F.col("document_id"), F.lit(role).alias("role"), F.col(content).alias("content"))
    sinks.append(questions.select(*message("user", "question")), path)
    answers = questions.select("id", "document_id").join(answer(questions).select("id", R.stored_answer(F.col("answer")).alias("answer")), "id")
    sinks.append(answers.select(*message("assistant", "answer")), path)
    return answers


def converse_once(questions: DataFrame, path: str, key: str, answer: Callable[[DataFrame], DataFrame], **retry) -> list[str]:
    """As :func:`converse`, in a table of ``ordered_writes``: tried again under the same key, neither message is stored twice and no question is answered twice."""
    message = lambda role, content: (F.col("id"), F.col("document_id"), F.lit(role).alias("role"), F.col(content).alias("content"))
    said = lambda: questions.select("id", "document_id").join(answer(questions).select("id", R.stored_answer(F.col("answer")).alias("answer")), "id").select(*message("assistant", "answer"))
    return ordered_writes.ordered(path, key, [("user", lambda: questions.select(*message("user", "question"))), ("assistant", said)], **retry)
