"""What operators shuffle, spill and write, as multiples of their texts."""

import random

from docflow.operators import combined, sentences
from docflow.plugins import hash_embeddings
from docflow.schema import SplitConfig


def moved(spark, run):
    """Bytes shuffled, spilled and written by ``run``."""
    sc, java = spark.sparkContext._jsc.sc(), spark.sparkContext._jvm

    def stages():
        sc.listenerBus().waitUntilEmpty(30_000)
        nothing = java.java.util.ArrayList()
        found = sc.statusStore().stageList(nothing, False, False, spark.sparkContext._gateway.new_array(java.double, 0), nothing)
        return {(s.stageId(), s.attemptId()): s.shuffleWriteBytes() + s.diskBytesSpilled() + s.outputBytes() for s in (found.apply(i) for i in range(found.size()))}

    before = stages()
    run()
    return sum(n for k, n in stages().items() if k not in before)


def prose(n, lines):
    rng = random.Random(n)
    sentence = lambda: " ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(2, 9))) for _ in range(9)).capitalize() + "."
    return [(f"d{i % 3}", i, "\n".join(" ".join(sentence() for _ in range(6)) for _ in range(lines))) for i in range(n)]


def test_sentence_distance_moves_texts_once(spark):
    rows = prose(600, 8)
    df = spark.createDataFrame(rows, "d string, k int, content string").repartition(4)
    df.cache().count()
    got = moved(spark, lambda: sentences.semantic_once(df, "content", SplitConfig(), hash_embeddings).write.format("noop").mode("overwrite").save())
    assert got < 3 * sum(len(t) for _, _, t in rows)


def test_combined_pages_move_texts_few_times(spark):
    rows = prose(400, 12)
    df = spark.createDataFrame(rows, "d string, k int, content string").repartition(4)
    df.cache().count()
    # Sort-merge joins, as at size: a broadcast would spare the texts a shuffle.
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = moved(spark, lambda: combined.split_combined(df, "d", "k", "content").write.format("noop").mode("overwrite").save())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert got < 6 * sum(len(t) for _, _, t in rows)
