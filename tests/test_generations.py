import pytest
from pyspark.sql import functions as F

from docflow.sources import generations as G

SCHEMA = "document_id string, chunk int"
CREATE = G._create


def rows(spark, root, document=None, number=None):
    found = G.snapshot(spark, root, number).load("org/m", document)
    return None if found is None else sorted((r.document_id, r.chunk) for r in found.collect())


def frame(spark, data):
    return spark.createDataFrame(data, SCHEMA)


def test_replace_remove_and_pinned_readers(spark, tmp_path):
    root = str(tmp_path)
    assert rows(spark, root) is None and G.snapshot(spark, root).number == 0
    assert G.save(frame(spark, [("a", 1), ("a", 2), ("007", 3), ("7", 4)]), root, "org/m") == 1
    pinned = G.snapshot(spark, root)
    reading = pinned.load("org/m")
    assert G.save(frame(spark, [("a", 9), ("b", 5)]), root, "org/m") == 2
    assert G.remove(spark, root, "org/m", frame(spark, [("7", 0), ("none", 0)])) == 3
    assert rows(spark, root) == [("007", 3), ("a", 9), ("b", 5)]
    # The reader that was open, and a new one of its commit, see the old rows.
    assert sorted((r.document_id, r.chunk) for r in reading.collect()) == rows(spark, root, number=1) == [("007", 3), ("7", 4), ("a", 1), ("a", 2)]
    assert rows(spark, root, "a") == [("a", 9)] and rows(spark, root, "7") is None and rows(spark, root, "007") == [("007", 3)]
    assert G.snapshot(spark, root).load("other") is None
    assert G.save(frame(spark, []), root, "org/m") == 3
    G.save(frame(spark, [("a", 1)]), root, "other")
    assert rows(spark, root, "a") == [("a", 9)]


@pytest.mark.parametrize("step", ["written", "listed", "torn commit"])
def test_a_write_that_breaks_off(spark, tmp_path, monkeypatch, step):
    root = str(tmp_path)
    G.save(frame(spark, [("a", 1), ("b", 1)]), root, "org/m")

    def fail(name):
        if name == step:
            raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(G, "_step", fail)
        if step == "torn commit":
            m.setattr(G, "_create", lambda spark, path, text: CREATE(spark, path, text[:7]))
            G.save(frame(spark, [("a", 2)]), root, "org/m")
        else:
            with pytest.raises(RuntimeError):
                G.save(frame(spark, [("a", 2)]), root, "org/m")
    assert rows(spark, root) == [("a", 1), ("b", 1)]
    for k in (3, 4):
        G.save(frame(spark, [("a", k)]), root, "org/m")
        assert rows(spark, root) == [("a", k), ("b", 1)]
    left = len(G._names(spark, f"{root}/data"))
    assert left == 4
    assert G.clean(spark, root, keep=1, older_ms=3_600_000) == 0
    assert G.clean(spark, root, keep=1, older_ms=0) >= 2
    assert rows(spark, root) == [("a", 4), ("b", 1)] and len(G._names(spark, f"{root}/data")) == 2


def test_two_writers(spark, tmp_path, monkeypatch):
    root, done = str(tmp_path), []
    G.save(frame(spark, [("a", 1)]), root, "org/m")

    def other(name):
        if name == "listed" and not done:
            done.append(True)
            G.save(frame(spark, [("b", 2)]), root, "org/m")

    monkeypatch.setattr(G, "_step", other)
    assert G.save(frame(spark, [("a", 3)]), root, "org/m") == 3
    assert rows(spark, root) == [("a", 3), ("b", 2)]


def test_lists_are_merged(spark, tmp_path, monkeypatch):
    root = str(tmp_path)
    monkeypatch.setattr(G, "MERGE", 3)
    for k in range(5):
        G.save(frame(spark, [(f"d{k % 2}", k), (f"e{k}", k)]), root, "m")
    G.remove(spark, root, "m", frame(spark, [("e0", 0), ("e4", 0)]))
    last = G.snapshot(spark, root)
    assert len(last.lists) <= 3
    assert sorted((r.document_id, r.chunk) for r in last.load("m").collect()) == [("d0", 4), ("d1", 3), ("e1", 1), ("e2", 2), ("e3", 3)]
    assert last.documents().where(F.col("document_id").isin("e0", "e4")).count() == 0
