import pytest
from pyspark.sql import functions as F

from docflow.operators.flow import converse_once
from docflow.sources import ordered_writes as W

SCHEMA = "id int, name string"


@pytest.fixture
def path(tmp_path):
    return f"file://{tmp_path}/table"


def frame(spark, *ids):
    return spark.createDataFrame([(i, f"n{i}") for i in ids], SCHEMA).repartition(3)


def ids(spark, path):
    return sorted(r.id for r in W.read(spark, path, SCHEMA).collect())


def test_a_key_is_written_once(spark, path, tmp_path):
    assert ids(spark, path) == []
    W.write_once(frame(spark, 1, 2, 3), path, "a")
    W.write_once(frame(spark, 1, 2, 3), path, "a")
    # Also where the second try didn't see the first one's commit.
    frame(spark, 1, 2, 3).write.format("docflow_once").option("path", path).option("key", "a").mode("append").save()
    W.write_once(frame(spark, 4), path, "b")
    W.write_once(frame(spark).limit(0), path, "none")
    assert ids(spark, path) == [1, 2, 3, 4] and W.committed(path, "none")
    before = len(list((tmp_path / "table" / "parts").iterdir()))
    W.write_once(frame(spark, 9), path, "b")
    assert len(list((tmp_path / "table" / "parts").iterdir())) == before
    with pytest.raises(ValueError, match="not a key"):
        W.write_once(frame(spark, 1), path, "../x")
    with pytest.raises(Exception, match="only appends"):
        frame(spark, 1).write.format("docflow_once").option("path", path).option("key", "c").mode("overwrite").save()


def test_waits_grow_and_end():
    waits, calls = [], []

    def step():
        calls.append(1)
        if len(calls) < 3:
            raise RuntimeError("not yet")
        return "done"

    assert W.retried(step, sleep=waits.append) == "done" and waits == [1.0, 2.0]
    calls.clear()
    with pytest.raises(RuntimeError):
        W.retried(step, attempts=2, sleep=waits.append)
    waits.clear()
    with pytest.raises(ZeroDivisionError):
        W.retried(lambda: 1 / 0, attempts=6, sleep=waits.append)
    assert waits == [1.0, 2.0, 4.0, 8.0, 8.0]


def test_a_task_that_fails(spark, path, tmp_path):
    """The first try fails in a task, after others have written their parts."""
    marker = tmp_path / "broken"
    marker.touch()

    def fails(batches):
        for batch in batches:
            if marker.exists() and 2 in batch.column(0).to_pylist():
                raise RuntimeError("lost")
            yield batch

    waits = []

    def sleep(seconds):
        waits.append(seconds)
        assert ids(spark, path) == []
        marker.unlink()

    assert W.ordered(path, "k", [("one", lambda: frame(spark, 1, 2, 3).mapInArrow(fails, SCHEMA))], sleep=sleep) == ["one"]
    assert ids(spark, path) == [1, 2, 3] and waits == [1.0]


def test_a_commit_that_fails(spark, path, tmp_path):
    """The folder of commits can't be made: parts are there and don't count."""
    (tmp_path / "table").mkdir()
    (tmp_path / "table" / "commits").write_text("in the way")
    waits = []
    with pytest.raises(Exception, match="commits"):
        W.ordered(path, "k", [("one", lambda: frame(spark, 1))], sleep=waits.append)
    assert waits == [1.0, 2.0]
    (tmp_path / "table" / "commits").unlink()
    assert ids(spark, path) == [] and W.unfinished(path) == [("k", ["one"])]
    assert W.ordered(path, "k", [("one", lambda: frame(spark, 1))]) == ["one"]
    assert ids(spark, path) == [1] and W.unfinished(path) == []


def test_the_second_step_fails_and_is_taken_up_again(spark, path):
    questions = spark.createDataFrame([(1, "d", "What?"), (2, "d", "Why?")], "id int, document_id string, question string")
    asked, waits = [], []

    def answer(df):
        asked.append(1)
        if len(asked) <= 3:
            raise RuntimeError("no model")
        return df.select("id", F.concat(F.lit("about "), "question").alias("answer"))

    said = lambda: sorted(tuple(r) for r in W.read(spark, path, "id int, document_id string, role string, content string").select("id", "role", "content").collect())
    with pytest.raises(RuntimeError):
        converse_once(questions, path, "talk", answer, sleep=waits.append)
    assert said() == [(1, "user", "What?"), (2, "user", "Why?")] and waits == [1.0, 2.0] and W.unfinished(path) == [("talk", ["assistant"])]
    assert converse_once(questions, path, "talk", answer) == ["assistant"]
    assert converse_once(questions, path, "talk", answer) == [] and len(asked) == 4
    assert said() == [(1, "assistant", "about What?"), (1, "user", "What?"), (2, "assistant", "about Why?"), (2, "user", "Why?")]
