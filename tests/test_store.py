import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from docflow import plugins
from docflow.operators import catalog as C, ingest, retrieval as R
from docflow.schema import IngestConfig
from docflow.sources import files, index, sinks, workspace
from docflow.streaming.ingest import into_index, prepared


def test_dedupe_counters_and_filters(spark):
    texts = ["Alpha   beta", "Alpha beta", "x", "   "]
    inputs = spark.createDataFrame([("d", k, t) for k, t in enumerate(texts)], "document_id string, page int, text string")
    assert prepared(inputs).count() == 1
    made = inputs.where(F.trim("text") != "").withColumnRenamed("text", "content")
    got = ingest.counters(inputs, made, "document_id", "text", "content", IngestConfig()).first().asDict()
    assert got == {"document_id": "d", "inputs_seen": 4, "inputs_non_empty": 3, "chunks_before_filter": 3, "filtered_out": 1, "deduped_out": 1, "stored": 1, "status": "success"}
    (kept,) = ingest.first_of_equal(made.where("length(content) > 3"), "document_id", "content", ["page"]).collect()
    assert kept.page == 0 and kept.content == "Alpha   beta"
    none = ingest.counters(inputs, made.limit(0), "document_id", "text", "content").first()
    assert none.status == "error" and none.stored == 0
    assert made.where(ingest.long_enough(F.col("content"), 0)).count() == 3


def test_guards(spark):
    df = spark.createDataFrame([("c1",), (None,)], "chunk_id string")
    with pytest.raises(Exception, match="no id"):
        ingest.checked(df, "chunk_id").collect()
    pair = spark.createDataFrame([(["a"], [1, 2])], "a array<string>, b array<int>")
    with pytest.raises(Exception, match="differ in length"):
        pair.select(ingest.zipped(F.col("a"), F.col("b")).alias("z")).collect()
    groups = spark.createDataFrame([("g", "a"), ("g", "b"), ("h", "a")], "g string, d string")
    assert {r.g: r.status for r in ingest.one_document(groups, "g", "d").collect()} == {"g": "error", "h": "ok"}


def test_index_replaces_prunes_and_removes(spark, tmp_path):
    path = str(tmp_path / "index")
    assert index.load_or_none(spark, path, "m") is None
    rows = spark.createDataFrame([("a", k, [float(k)]) for k in range(5)] + [("b", 9, [0.0])], "document_id string, chunk int, vector array<double>")
    index.save(rows, path, "org/m")
    index.save(rows.where("document_id = 'a' and chunk = 2"), path, "org/m")
    index.save(rows.limit(0), path, "org/m")
    assert sorted((r.document_id, r.chunk) for r in index.load(spark, path, "org/m").collect()) == [("a", 2), ("b", 9)]
    plan = index.load(spark, path, "org/m", "a")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(embedding_model" in plan
    index.remove(spark, path, "org/m", "a")
    assert index.load_or_none(spark, path, "org/m", "a") is None and index.load_or_none(spark, path, "org/m", "b") is not None
    with pytest.raises(Exception, match="no document id"):
        index.save(spark.createDataFrame([(None, 1)], "document_id string, chunk int"), path, "m")


@pytest.mark.parametrize("block", [4096, 7])
def test_nearest_equals_brute_force(spark, block):
    rng = np.random.default_rng(4)
    v = rng.normal(size=(60, 8)).round(1)
    v[10] = v[3]
    rows = spark.createDataFrame([(k, x.tolist(), k % 3) for k, x in enumerate(v)] + [(99, None, 0)], "id bigint, vector array<double>, doc int")
    queries = rows.where("id < 10")
    got = {(r.query_id, r["rank"]): r.row_id for r in R.nearest(queries, rows, 4, block=block).collect()}
    inside = {(r.query_id, r["rank"]): r.row_id for r in R.nearest(queries, rows, 4, within=("doc", "doc"), block=block).collect()}
    for q in range(10):
        order = sorted(range(60), key=lambda k: (((v[q] - v[k]) ** 2).sum(), k))
        assert [got[q, r] for r in range(1, 5)] == order[:4]
        assert [inside[q, r] for r in range(1, 5)] == [k for k in order if k % 3 == q % 3][:4]
    assert R.nearest(queries, rows, 0).count() == 100 and R.nearest(queries.limit(0), rows, 3).count() == 0


def test_answers(spark):
    rows = spark.createDataFrame([("q", 2, "second"), ("q", 1, "first")], "q string, r int, c string")
    joined = R.context(rows, "q", "r", "c")
    assert joined.first().context == "first\n\n---\n\nsecond"
    said = R.answered(joined.withColumn("question", F.lit("?")), "context", "question", plugins.extractive_answer)
    assert said.select(R.parse_answer(F.col("raw"))["contextAnswer"].alias("a")).first().a == "first"
    bad = spark.createDataFrame([("no json",)], "raw string")
    with pytest.raises(Exception, match="(?i)malformed"):
        bad.select(R.parse_answer(F.col("raw")).alias("a")).collect()
    empty = spark.createDataFrame([("",), (None,), ("x",)], "a string").select(R.stored_answer(F.col("a")).alias("s")).collect()
    assert [r.s for r in empty] == ["No answer", "No answer", "x"]


def test_catalog_rules(spark):
    users = spark.createDataFrame([("a@x.de", "anna")], "email string, username string")
    new = spark.createDataFrame([("a@x.de", "bert"), ("b@x.de", "anna"), ("c@x.de", "carl")], "email string, username string")
    assert [r.username for r in C.unused(new, users).collect()] == ["carl"]
    check = lambda f, x: spark.createDataFrame([(x,)], "v string").select(f(F.col("v")).alias("ok")).first().ok
    assert check(C.valid_email, "user@example.com") and not check(C.valid_email, "user@example") and not check(C.valid_email, "a" * 45 + "@ex.com")
    assert check(C.valid_password, "Abcdef1!") and not check(C.valid_password, "abcdef1!") and not check(C.valid_password, "Abcdefg1#")
    assert check(C.valid_username, "abc") and not check(C.valid_username, "ab")


def test_history_is_ordered(spark):
    rows = spark.createDataFrame([(1, 2, "assistant", "Hello!"), (1, 1, "user", "Hi"), (1, 0, "system", "s")], "d int, at int, role string, content string")
    got = C.by_document(C.history(rows, "role"), "d", "at", "role", "content").first().messages
    assert [m.content for m in got] == ["Hi", "Hello!"]


def test_files_and_sinks(spark, tmp_path):
    up = tmp_path / "up"
    up.mkdir()
    (up / "a.txt").write_text("page one\fpage two é")
    (up / "b.pdf").write_bytes(b"%PDF")
    (up / "c.png").write_bytes(b"no")
    found = files.uploads(spark, str(up))
    assert sorted(r.filename for r in found.collect()) == ["a.txt", "b.pdf"]
    pages = sorted(files.text_pages(found).collect(), key=lambda r: (r.document_id, r.page))
    assert [(r.document_id, r.page, r.text, r.error) for r in pages] == [("a.txt", 1, "page one", None), ("a.txt", 2, "page two é", None), ("b.pdf", 1, None, "PDF processing failed")]
    assert files.safe_path("a.txt", str(up)).name == "a.txt"
    with pytest.raises(PermissionError):
        files.safe_path("../up_x/a.txt", str(up))
    with pytest.raises(FileNotFoundError):
        files.safe_path("none.txt", str(up))
    assert files.question_and_document(" q ", "d") == ("q", "d")
    with pytest.raises(ValueError, match="required"):
        files.question_and_document(" ", "d")
    table = str(tmp_path / "users")
    users = spark.createDataFrame([("a@x.de", "anna")], "email string, username string")
    sinks.append(users, table)
    new = spark.createDataFrame([("a@x.de", "bert"), ("c@x.de", "carl")], "email string, username string")
    assert {r.email: r.status for r in sinks.register(new, users, table, "email").collect()} == {"a@x.de": "in_use", "c@x.de": "created"}
    assert spark.read.parquet(table).count() == 2
    sinks.clear(users, table)
    assert spark.read.parquet(table).collect() == []
    sinks.dump_json(new, str(tmp_path / "dump"))
    assert spark.read.json(str(tmp_path / "dump")).count() == 2


def test_stream_into_index(spark, tmp_path):
    schema = "document_id string, page int, text string"
    spark.createDataFrame([("d", 1, "Some page of words"), ("d", 2, "Some page of  words"), ("e", 1, "Other page")], schema).write.json(str(tmp_path / "in"))
    pages = spark.readStream.schema(schema).json(str(tmp_path / "in"))
    q = into_index(pages, str(tmp_path / "index"), "m").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    got = index.load(spark, str(tmp_path / "index"), "m").collect()
    assert sorted(r.document_id for r in got) == ["d", "e"] and all(len(r.vector) == 64 for r in got)


def test_default_plugins():
    assert np.allclose(plugins.hash_embedding("a b"), plugins.hash_embedding("b a")) and not plugins.hash_embedding("").any()
    assert plugins.no_ocr(b"") == "" and json.loads(plugins.extractive_answer("c", "q"))["contextAnswer"] == "c"


def test_work_tables_are_the_applications_own(spark, tmp_path):
    path = workspace.new_path(spark, "t")
    spark.range(3).write.parquet(path)
    assert spark.read.parquet(path).count() == 3 and spark.sparkContext.applicationId in path
    workspace.delete(spark, path)
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(path)
    with pytest.raises(ValueError, match="not this application's"):
        workspace.delete(spark, str(tmp_path))
    workspace.clear(spark)
