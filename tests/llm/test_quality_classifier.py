import re
import zlib

import numpy as np
import pyarrow as pa
import xxhash

from docflow.llm import quality_classifier as Q
from docflow.llm.q_quality_classifier import op4_quality_classifier


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    got = op4_quality_classifier(spark, folder).collect()
    assert len(got) == spark.read.parquet(f"{folder}/documents.parquet").count()
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    held = [(labels[r.doc_id], r.predicted, r.score) for r in got if r.held_out and r.doc_id in labels]
    y, p, s = (np.array(x) for x in zip(*held, strict=True))
    accuracy, caught = (y == p).mean(), (p[y == 0] == 0).mean()
    error = abs(s.mean() - y.mean())

    assert accuracy >= 0.97 and caught >= 0.9 and error < 0.03


def test_odd_rows_and_missing_labels(spark):
    docs = spark.createDataFrame([(1, None, 0.1), (2, "", 0.2), (None, "a b c", 0.3), (3, "a b c", 0.4), (3, "a b c", 0.4), (4, "w " * 300000, 0.5)], "doc_id bigint, text string, score double")
    labels = spark.createDataFrame([(3, 1), (3, 0), (None, 1), (9, None)], "doc_id bigint, quality int")
    got = Q.quality_scores(docs, labels).collect()
    assert len(got) == 6 and {r.predicted for r in got} == {1} and not any(r.held_out for r in got if r.doc_id is None)
    got = Q.quality_scores(docs, labels.limit(0)).collect()
    assert {r.score for r in got} == {0.5}
    assert Q.quality_scores(docs.limit(0), labels).collect() == []


def test_vectors_without_the_other_inputs(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    truth = {r.doc_id: r.quality for r in labels.collect()}
    held = [(truth[r.doc_id], r.predicted) for r in Q.quality_scores(docs, labels, extra=False).collect() if r.held_out and r.doc_id in truth]
    y, p = (np.array(x) for x in zip(*held, strict=True))
    assert (y == p).mean() >= 0.93 > (y == 1).mean() + 0.05


def plain_contexts(texts):
    """Index vectors of the neighbours of every word, word by word."""
    sums, counts = {}, {}
    for text in texts:
        slots = [xxhash.xxh64_intdigest(w.encode()) % Q.SLOTS for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
        for i, s in enumerate(slots):
            counts[s] = counts.get(s, 0) + 1
            v = sums.setdefault(s, np.zeros(Q.SIZE, int))
            for j in range(max(0, i - Q.WINDOW), min(len(slots), i + Q.WINDOW + 1)):
                if j != i:
                    for place, sign in zip(Q._PLACE[slots[j]], Q._SIGN[slots[j]], strict=True):
                        v[place] += sign
    return sums, counts


TEXTS = ["one two three one two three", None, "ünï çode\nlines\nlines", "x", "", "zebra " * 70000, "three two\tone one \x1f two"]


def test_context_vectors_equal_the_plain_sums(spark):
    sums, counts = Q.context_sums(spark.createDataFrame([(t, "clash") for t in TEXTS], "text string, sums string").repartition(3))
    want_sums, want_counts = plain_contexts(TEXTS)
    assert {s: n for s, n in enumerate(counts.tolist()) if n} == want_counts
    assert all((sums[s] == v).all() for s, v in want_sums.items())
    table = Q.word_table(sums, counts)
    assert np.allclose(np.linalg.norm(table[counts > 0], axis=1), 1, atol=1e-4)


def test_features_do_not_depend_on_the_batch():
    sums, counts = np.zeros((Q.SLOTS, Q.SIZE), np.int32), np.zeros(Q.SLOTS, np.int64)
    Q.add_contexts(sums, counts, pa.array(TEXTS))
    table = Q.word_table(sums, counts)
    all_of = Q.features(pa.array(TEXTS), table)
    for k, t in enumerate(TEXTS):
        assert (Q.features(pa.array([t], pa.string()), table)[0] == all_of[k]).all()


def test_network_learns_and_calibrates():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(4000, Q.SIZE + Q.EXTRA))
    p = 1 / (1 + np.exp(-3 * (x[:, 0] + x[:, Q.SIZE])))
    y = (rng.random(4000) < p).astype(float)
    net = Q.fit(x[:3000], y[:3000])
    s = net.scores(x[3000:])
    assert ((s > 0.5) == (p[3000:] > 0.5)).mean() > 0.85
    assert abs(s.mean() - y[3000:].mean()) < 0.06
