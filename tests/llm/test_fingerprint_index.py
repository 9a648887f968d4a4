import hashlib
import random
import re

import pytest

from docflow.llm import fingerprint_index as I
from docflow.llm.q_substring_dedup import op7_substring_dedup


def plain(rows, width=50):
    split = [(d, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t in rows]
    first = {}
    for d, w in split:
        if d is not None:
            for i in range(len(w) - width + 1):
                key = hash(tuple(w[i : i + width]))
                first[key] = min(first.get(key, d), d)
    out = []
    for d, w in split:
        gone = set()
        for i in range(len(w) - width + 1):
            if d is not None and first[hash(tuple(w[i : i + width]))] < d:
                gone.update(range(i, i + width))
        out.append((d, len(w), len(gone), hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in gone).encode()).hexdigest()))
    return sorted(out, key=repr)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_query_equals_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    got = rows_of(op7_substring_dedup(spark, "/root/testdata/sf0.01"))
    assert got == plain(rows) and sum(r[2] > 0 for r in got) > 50


@pytest.mark.parametrize("seed", [1, 2])
def test_odd_and_overlapping_passages(spark, seed):
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefgh") + rng.choice("ijklmnop")
    passages = [[word() for _ in range(rng.choice([49, 50, 51, 90, 300]))] for _ in range(8)]
    rows = []
    for d in range(120):
        w = []
        for _ in range(rng.randint(0, 5)):
            p = rng.choice(passages)
            a = rng.randint(0, max(0, len(p) - 60))
            w += [word() for _ in range(rng.randint(0, 30))] + p[a : a + rng.choice([49, 50, 55, 400])]
        rows.append((rng.choice([d, d, d, None, 7]), rng.choice([" ", "\n", " \t"]).join(w)))
    rows += [(500, None), (501, ""), (502, " \n"), (503, "x " * 400), (504, "x " * 49), (505, "x " * 50), (506, "é " * 60), (2, "é é " * 60), rows[0], rows[3], (1000, " ".join(passages[3] * 40)), (-5, " ".join(passages[3]))]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id bigint, text string, _first string")
    assert rows_of(I.remove_repeats(df)) == plain(rows)


def test_empty_and_single(spark):
    df = spark.createDataFrame([(1, "a " * 60)], "doc_id bigint, text string")
    assert rows_of(I.remove_repeats(df)) == plain([(1, "a " * 60)])
    assert I.remove_repeats(df.limit(0)).collect() == []


def test_runs_are_joined_without_shuffle_and_compacted(spark):
    index = I.FingerprintIndex(spark, buckets=4, max_runs=2)
    rows = lambda d, hs: spark.createDataFrame([(h, d, 0) for h in hs], "h bigint, _id bigint, _th bigint")
    assert index.add(rows(1, [1, 2, 3])).collect() == []
    assert [r.h for r in index.add(rows(2, [3, 4])).collect()] == [3]
    assert sorted(r.h for r in index.add(rows(3, [1, 4, 9])).collect()) == [1, 4]
    assert len(index.runs) == 1 and index.rows().count() == 8
    join = spark.table(index.runs[0]).select("h").join(spark.table(index.runs[0]).withColumnRenamed("_id", "x").hint("merge"), "h", "left_semi")
    with I.in_order(spark):
        plan = join._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan and "Sort [" not in plan
    assert sorted(r.h for r in index.add(rows(4, [9, 10, 10])).collect()) == [9]
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("fingerprints_") and t.name not in index.runs]


def test_index_takes_batches_in_later_sessions(spark, tmp_path):
    rng = random.Random(5)
    passages = [" ".join(rng.choice("abcdefgh") + rng.choice("ijklmnop") for _ in range(70)) for _ in range(6)]
    rows = [(d, " ".join([f"own{d}a own{d}b", rng.choice(passages), f"own{d}c", rng.choice(passages)])) for d in range(60)]
    rows[50] = (50, rows[3][1])
    rows[51] = (51, rows[50][1])
    path, got = f"file://{tmp_path}/index", []
    for low, high in [(0, 25), (25, 26), (26, 60)]:
        session = spark.newSession()
        frame = lambda some, s=session: s.createDataFrame(some, "doc_id bigint, text string")
        index = I.FingerprintIndex(session, path, max_runs=3)
        got += rows_of(I.remove_repeats(frame(rows[low:high]), batches=2, index=index, history=frame(rows[:low])))
        index.close()
    assert sorted(got, key=repr) == plain(rows)
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("fingerprints_") and spark.table(t.name).inputFiles() and path[7:] in spark.table(t.name).inputFiles()[0]]


def test_a_run_without_manifest_does_not_count(spark, tmp_path):
    path = f"file://{tmp_path}/index"
    index = I.FingerprintIndex(spark, path, buckets=2, width=60, gram=10)
    index.add(spark.createDataFrame([(1, 1, 0)], "h bigint, _id bigint, _th bigint"))
    index._write(spark.createDataFrame([(2, 1, 0)], "h bigint, _id bigint, _th bigint"))
    again = I.FingerprintIndex(spark, path)
    assert (again.buckets, again.width, again.gram) == (2, 60, 10) and [r.h for r in again.rows().collect()] == [1]


def test_a_manifest_that_broke_off_is_in_nobodys_way(spark, tmp_path):
    path = str(tmp_path / "index")
    rows = lambda *h: spark.createDataFrame([(x, x, x) for x in h], "h bigint, _id bigint, _th bigint")
    index = I.FingerprintIndex(spark, path, buckets=2)
    index.add(rows(1, 2))
    (tmp_path / "index" / f"manifest-{index.version + 1:08d}").mkdir()
    (tmp_path / "index" / "fingerprints_orphan").mkdir()
    index.close()
    again = I.FingerprintIndex(spark, path)
    assert sorted(r.h for r in again.rows().collect()) == [1, 2]
    again.add(rows(3))
    again.clean()
    again.close()
    last = I.FingerprintIndex(spark, path)
    assert sorted(r.h for r in last.rows().collect()) == [1, 2, 3]
    assert sorted(x.name for x in (tmp_path / "index").iterdir()) == sorted([*last.runs, f"manifest-{last.version:08d}"])
    last.close(delete=True)


def test_entries_are_written_a_few_times(spark, tmp_path, monkeypatch):
    """Eighteen batches: levels of three."""
    index, written = I.FingerprintIndex(spark, str(tmp_path / "index"), buckets=2), []
    write = index._write
    monkeypatch.setattr(index, "_write", lambda rows: written.append(rows.count()) or write(rows))
    for k in range(18):
        index.add(spark.createDataFrame([(100 * k + x, k, x) for x in range(50)], "h bigint, _id bigint, _th bigint"))
        assert len(index.runs) <= 6
    assert index.rows().count() == 900 and sorted(index.levels) == [2, 2]
    assert sum(written) == 900 * 3
    index.close(delete=True)
