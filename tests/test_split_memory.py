"""Python memory of splitting: a text must not be held once for each of its parts."""

import os

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from docflow.operators import chunks, splitting
from docflow.plugins import hash_embedding
from docflow.schema import SplitConfig

CFG = SplitConfig()


@pytest.fixture
def peak(spark):
    """Growth of Arrow's peak memory in a worker, in bytes, while ``texts`` are split in one batch."""

    def run(texts, split):
        held = lambda x: [str(pa.default_memory_pool().max_memory())] if x == "probe" else split(x)
        n = len(texts)
        # Batches of n rows: one that asks, the texts, one that asks again.
        rows = [(0, "probe"), *[(1, None)] * (n - 1), *[(1, t) for t in texts], (2, "probe")]
        before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(n))
        try:
            got = chunks.apply_split(spark.createDataFrame(spark.sparkContext.parallelize(rows, 1), "k int, content string"), "content", held).collect()
        finally:
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
        asked = {r.k: int(r.content) for r in got if r.k != 1}
        assert [r.content for r in got if r.k == 1] == [x for t in texts for x in split(t)]
        assert [r.part for r in got if r.k == 1] == [i for t in texts for i in range(len(split(t)))]
        return asked[2] - asked[0]

    return run


def test_one_long_text(peak):
    text = "some words of a text " * 25_000
    assert peak([text], lambda x: splitting.recursive_split(x, CFG.chunk_size, CFG.overlap, CFG.separators)) < 60e6


def test_many_texts_of_a_batch_by_distance(peak):
    texts = [f"Text {i}. " + " ".join(f"Word{j * i % 977} and word{j} of it." for j in range(1500)) for i in range(150)]
    assert peak(texts, lambda x: splitting.semantic_split(x, hash_embedding, CFG.semantic_percentile)) < 60e6


def test_long_texts_of_a_batch(spark):
    # 400 rows a batch: one that asks for the worker's memory and nulls, then 126 MB of text, where each text asks again.
    resident = lambda x: [open("/proc/self/statm").read().split()[1]]  # noqa: E731, SIM115
    k = F.col("id")
    text = F.when(k == 0, "first").when(k >= 400, F.concat(k.cast("string"), F.repeat(F.lit(" words of a long text"), 15_000)))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "400")
    try:
        first, *rest = [int(r.content) for r in chunks.apply_split(spark.range(0, 800, 1, 1).select("id", text.alias("content")), "content", resident).collect()]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert len(rest) == 400
    assert (max(rest) - first) * os.sysconf("SC_PAGE_SIZE") < 50e6


@pytest.mark.parametrize("batch", ["1", "3", "10000"])
@pytest.mark.parametrize("flag", [None, "f"])
def test_texts_of_any_length_come_whole(spark, batch, flag):
    size = chunks.BLOCK_BYTES
    texts = [None, "", " ", *["a" * (size + k) for k in (-1, 0, 1)], "é" * (size // 2), "x" * (size - 1) + "é", "中" * 3 * size, "😀a" * 2 * size]
    rows = [(i, t, [None, True, False][i % 3], {"i": i}) for i, t in enumerate(texts)]
    cut = lambda x: [x[k : k + 700] for k in range(0, len(x), 700)]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        df = spark.createDataFrame(spark.sparkContext.parallelize(rows, 2), "k int, content string, f boolean, m map<string,int>")
        got = [(r.k, r.content, r.f, r.m, r.part) for r in chunks.apply_split(df, "content", cut, flag).collect()]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert got == [(k, p, f, m, i) for k, t, f, m in rows if t is not None for i, p in enumerate(cut(t) if f or not flag else [t])]
