import numpy as np
import pytest
from pyspark.sql import functions as F

from docflow.functions import images as I
from docflow.functions.sql import register
from docflow.operators import flow
from docflow.schema import IngestConfig
from docflow.sources import files, index


def test_pages_into_index_and_answers(spark, tmp_path):
    path = str(tmp_path / "index")
    rows = [("7", 1, "The red fox runs over the hill", None), ("7", 2, "  ", "A scanned page about boats"), ("7", 3, "The red fox runs  over the hill", None), ("8", 1, "ab", None)]
    pages = spark.createDataFrame(rows, "doc string, n int, own string, ocr string")
    report = {r.doc: r for r in flow.ingest_pages(pages, "doc", "n", "own", "ocr", path, "org/m", rules=IngestConfig(mode="recursive")).collect()}
    assert (report["7"].status, report["7"].pages_processed, report["7"].ocr_used, report["7"].stored) == ("success", 3, True, 2)
    assert (report["8"].status, report["8"].reason) == ("error", "no_usable_chunks_after_split")
    stored = index.load(spark, path, "org/m").withColumn("row", F.monotonically_increasing_id())
    questions = spark.createDataFrame([(1, "7", " red fox? "), (2, "9", "anything"), (3, "7", "  ")], "id bigint, document_id string, question string")
    answers, sources = flow.ask(questions, stored)
    got = {r.id: r for r in answers.collect()}
    assert set(got) == {1, 2} and got[1].answer == "The red fox runs over the hill" and (got[1].chunksAnalyzed, got[1].chunksUsed) == (2, 2) and got[2].status == "not_found"
    first = sources.where("used_rank = 1").first()
    assert first.highlights == ["red"] and first.pageIndicator == "Page 1" and first.confidence == 1
    said = flow.chat_messages(answers, "id").orderBy("id", "place").collect()
    assert [(r.id, r.role) for r in said] == [(1, "user"), (1, "assistant"), (2, "user")]


def test_texts_into_index(spark, tmp_path):
    texts = spark.createDataFrame([("d", k, t) for k, t in enumerate(["Alpha   beta", "Alpha beta", "x", "   "])], "doc string, k int, t string")
    meta = F.create_map(F.lit("chunk_type"), F.lit("mine"), F.lit("source"), F.lit("s"))
    got = flow.ingest_texts(texts, "doc", "k", "t", str(tmp_path / "i"), "m", meta, rules=IngestConfig(mode="recursive")).first()
    assert (got.inputs_seen, got.inputs_non_empty, got.filtered_out, got.deduped_out, got.stored) == (4, 3, 1, 1, 1)
    row = index.load(spark, str(tmp_path / "i"), "m").first()
    assert row.metadata == {"chunk_type": "mine", "source": "s"} and len(row.chunk_id) == 16
    assert flow.unsupported(spark, "d").first().reason == "unsupported_source_type"


def test_decoder_failures_are_rows(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"one|two")
    (tmp_path / "b.pdf").write_bytes(b"broken")

    def decode(content):
        if b"|" not in content:
            raise ValueError("not a document")
        return content.decode().split("|")

    got = sorted(map(tuple, files.decoded_pages(files.uploads(spark, str(tmp_path)), decode).collect()), key=str)
    assert got == [("a.pdf", 1, 2, "one", None), ("a.pdf", 2, 2, "two", None), ("b.pdf", None, None, None, "PDF processing failed")]
    assert files.accepted(["a.pdf", "b.TXT"]) == ["a.pdf", "b.TXT"]
    for names in (["a.png"], ["a.pdf"] * 11):
        with pytest.raises(ValueError):
            files.accepted(names)


def page(h=40, w=60):
    image = np.full((h, w, 3), 255, np.uint8)
    image[10:14, 10:50] = 0
    return image


def test_image_steps():
    assert I.shrunk(np.zeros((400, 600, 3), np.uint8), 300).shape == (200, 300, 3) and I.shrunk(page(), 300) is not None
    turned = I.rotated(page(), 90)
    assert turned.shape == (60, 40, 3) and (turned == np.rot90(page(), -1)).all()
    tilted = I.rotated(page(), 30)
    assert tilted.shape[0] > 40 and (tilted[0, 0] == 255).all() and tilted.min() < 50
    assert (I.deskewed(page(), lambda _: "x: 1\nRotate: 180\n") == I.rotated(page(), 180)).all()
    assert (I.deskewed(page(), lambda _: "Rotate: none") == page()).all() and (I.deskewed(page(), None) == page()).all()
    black = I.cleaned_binary(page())
    assert set(np.unique(black)) == {0, 255} and black[12, 30] == 0 and black[30, 30] == 255
    gray = I.cleaned_gray(page())
    assert gray.min() == 0 and gray.max() == 255 and gray.shape == (40, 60)


def test_recognition_falls_back_and_never_raises():
    calls = []

    def engine(image, cfg):
        calls.append(cfg.psm)
        if cfg.psm == 6:
            raise RuntimeError("first setting fails")
        return " text \n"

    assert I.recognised(lambda dpi: page(), engine) == "text" and calls == [6, 11]
    assert I.recognised(lambda dpi: 1 / 0, engine) == ""
    assert I.recognised(lambda dpi: page(), lambda *_: 1 / 0) == ""
    assert I.recognised(lambda dpi: page(), lambda i, c: None, cfg=I.OcrConfig(binary=False)) == ""


def test_a_run_counts_while_it_writes(spark, tmp_path):
    schema = "doc string, n int, own string, ocr string"
    rows = [("d", k, f"Page {k} has some words. " * 3, None) for k in range(1, 40)] + [("d", 40, " ", "scanned words here"), ("d", 41, "", None), ("d", 42, "Page 1 has some words. " * 3, None)]
    pages = spark.createDataFrame(rows, schema).repartition(3)
    cfg, ticks = IngestConfig(mode="recursive"), iter([1.0, 1.25049, 4.0])
    got = flow.ingest_run(pages, "doc", "n", "own", "ocr", str(tmp_path / "a"), "m", rules=cfg, clock=lambda: next(ticks))
    want = flow.ingest_pages(pages, "doc", "n", "own", "ocr", str(tmp_path / "b"), "m", rules=cfg).first()
    assert got.pop("timings") == {"extract_s": 0.25, "store_s": 2.75}
    assert got == {k: want[k] for k in got} and got["ocr_used"] and got["chunk_count"] == 40 and got["pages_processed"] == 41
    none = flow.ingest_run(pages.where("n = 41"), "doc", "n", "own", "ocr", str(tmp_path / "c"), "m", rules=cfg)
    assert (none["status"], none["chunk_count"], none["reason"]) == ("error", 0, "no_usable_chunks_after_split") and set(none["timings"]) == {"extract_s", "store_s"}


def test_upload_and_conversation(spark, tmp_path):
    docs, chat = str(tmp_path / "docs"), str(tmp_path / "chat")
    rows = spark.createDataFrame([(1, "a.pdf")], "id int, filename string")
    assert flow.upload(rows, docs, lambda r: r.count()) and not flow.upload(rows, docs, lambda r: 1 / 0)
    assert spark.read.parquet(docs).count() == 2
    questions = spark.createDataFrame([(1, 7, "Hi?")], "id int, document_id int, question string")
    flow.converse(questions, chat, lambda q: q.select("id", F.lit("").alias("answer")))
    with pytest.raises(ZeroDivisionError):
        flow.converse(questions, chat, lambda q: 1 / 0)
    assert sorted((r.role, r.content) for r in spark.read.parquet(chat).collect()) == [("assistant", "No answer"), ("user", "Hi?"), ("user", "Hi?")]


def test_sql_functions(spark):
    register(spark)
    spark.createDataFrame([(1, "one two. three four. five six"), (2, None)], "id int, t string").createOrReplaceTempView("sql_texts")
    got = spark.sql("SELECT id, part, content FROM sql_texts, LATERAL split_recursive(t, 12, 0) ORDER BY id, part").collect()
    assert [r.content for r in got] == ["one two", ". three four", ". five six"]
    assert spark.sql("SELECT count(*) AS n FROM sql_texts, LATERAL split_semantic(t, 95)").first().n >= 1
    vectors = spark.sql("SELECT id, embed(t) AS v FROM sql_texts ORDER BY id").collect()
    assert len(vectors[0].v) == 64 and vectors[1].v is None
