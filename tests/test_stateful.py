import random
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from docflow.operators import chunks, ingest
from docflow.schema import IngestConfig
from docflow.streaming import stateful as S

SCHEMA = "document_id string, page int, text string"
COLUMNS = ["document_id", "page", "section", "part", "heading", "chunk_type", "content", "token_count", "chunk_id"]


@pytest.fixture(autouse=True)
def rocksdb(spark):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    S.settings(spark)
    yield
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def pages(seed, n=60):
    rng = random.Random(seed)
    some = ["Terms and conditions apply.", "ab", "One  page of words", "One page of words", "# Head\nbody text\n# Next\nmore text", None, " \n "]
    return [(rng.choice("abc"), rng.choice([None, *range(1, 30)]), rng.choice([*some, f"Page {i} has text of its own"])) for i in range(n)]


def start(spark, tmp_path, **kw):
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    q = S.into_folder(stream, str(tmp_path / "out"), **kw).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    assert q.awaitTermination(300)


def add(spark, tmp_path, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").json(str(tmp_path / "in"))


def compare(spark, tmp_path, rows, rules):
    df = spark.createDataFrame(rows, SCHEMA)
    made = chunks.split_texts(df, "document_id", "page", "text", "recursive")
    whole = ingest.first_of_equal(made.where(ingest.long_enough(F.col("content"), rules.min_chars)), "document_id", "content", S.ORDER)
    table = lambda x: Counter(tuple(r[c] for c in COLUMNS) for r in x.collect())
    # Rows of equal place and content (a page that came twice) are one row.
    assert table(S.stored_chunks(spark, str(tmp_path / "out"))) == table(whole)
    want = ingest.counters(df, made, "document_id", "text", "content", rules)
    assert sorted(map(tuple, S.stored_counters(spark, str(tmp_path / "out")).collect())) == sorted(map(tuple, want.select("document_id", *S.COUNTERS, "status").collect()))


def test_any_split_over_batches_and_a_restart(spark, tmp_path):
    rows, rules = pages(1), IngestConfig()
    for k in range(2):
        add(spark, tmp_path, rows[20 * k : 20 * k + 20])
    start(spark, tmp_path, buckets=3)
    compare(spark, tmp_path, rows[:40], rules)
    # Another run from the checkpoint, with pages that stand before those stored.
    add(spark, tmp_path, rows[40:])
    start(spark, tmp_path, buckets=3)
    compare(spark, tmp_path, rows, rules)
    assert len([p for p in (tmp_path / "out").iterdir() if p.name.startswith("batch=")]) >= 3


def test_state_of_idle_documents_goes(spark, tmp_path):
    add(spark, tmp_path, [("a", 2, "A page of words"), ("a", 3, "Another page of words")])
    stream = spark.readStream.schema(SCHEMA).json(str(tmp_path / "in"))
    out = str(tmp_path / "out")
    q = S.into_folder(stream, out, buckets=1, idle_ms=1).option("checkpointLocation", str(tmp_path / "ck")).trigger(processingTime="1 second").start()
    finished = lambda n: (tmp_path / "out").exists() and spark.read.schema(f"kind string, {', '.join(f'{c} bigint' for c in S.COUNTERS)}").parquet(out).where(f"kind = 'finished' and inputs_seen = {n}").count()
    try:
        for n, more in ((2, [("b", 1, "Some other text"), ("a", 1, "A page of words")]), (1, [])):
            until = time.time() + 40
            while not finished(n) and time.time() < until and q.isActive:
                time.sleep(1)
            assert finished(n), q.exception()
            if more:
                add(spark, tmp_path, more)
    finally:
        q.stop()
    got = {(r.document_id, r.page, r.content) for r in S.stored_chunks(spark, out).collect()}
    assert got == {("a", 1, "A page of words"), ("a", 3, "Another page of words"), ("b", 1, "Some other text")}
    # What came after the state had gone was counted anew.
    counted = {r.document_id: (r.inputs_seen, r.stored) for r in S.stored_counters(spark, out).collect()}
    assert counted == {"a": (3, 3), "b": (1, 1)}
