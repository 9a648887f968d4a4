import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from docflow.operators import neighbours as N

SCHEMA = "id bigint, vector array<float>, doc string, n int, _p string"


def plain(queries, rows, k=10, within=False):
    ok = lambda v: v is not None and all(x is not None and np.isfinite(x) for x in v)
    out = []
    for q, qv, qd in queries:
        if q is None or not ok(qv) or (within and qd is None):
            continue
        own = np.array(qv, np.float32).astype(float)
        found = sorted((((own - np.array(v, np.float32).astype(float)) ** 2).sum(), r) for r, v, d in rows if r is not None and ok(v) and (not within or d == qd))
        out += [(q, n + 1, r, round(float(x), 9)) for n, (x, r) in enumerate(found[:k])]
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame([(i, v, d, 7, "x") for i, v, d in rows], SCHEMA)


def run(spark, queries, rows, k=10, within=False, **kw):
    found = N.search(frame(spark, queries), frame(spark, rows), k, ("doc", "doc") if within else None, **kw)
    return found, sorted((r.query_id, r["rank"], r.row_id, round(r.distance, 9)) for r in found.found.collect())


def clustered(seed, n=1500, groups=12, dims=6):
    rng = np.random.default_rng(seed)
    middle = rng.normal(0, 20, (groups, dims))
    at = rng.integers(0, groups, n)
    return [(i, (middle[at[i]] + rng.normal(0, 1, dims)).tolist(), f"d{at[i] % 3}") for i in range(n)]


@pytest.mark.parametrize("within", [False, True])
def test_clusters_are_pruned(spark, within):
    rows = clustered(1)
    queries = rows[::20]
    found, got = run(spark, queries, rows, 5, within, block=32, pivots=40)
    assert got == plain(queries, rows, 5, within)
    rings, opened = found.rings.count(), found.opened.count()
    # Most pairs of a query and a ring are never opened, and none twice.
    assert opened < 0.15 * rings * len(queries)
    assert found.opened.select("query_id", "_p", "_ring").distinct().count() == opened
    assert found.rings.agg(F.sum("n")).first()[0] == len(rows)


def test_noise_without_clusters(spark):
    rng = random.Random(2)
    rows = [(i, [rng.gauss(0, 1) for _ in range(16)], "d") for i in range(400)]
    assert run(spark, rows[::10], rows, 7, block=50)[1] == plain(rows[::10], rows, 7)


@pytest.mark.parametrize("block", [5, 64, 4096])
def test_ties_and_a_third_of_equal_vectors(spark, block):
    rng = random.Random(3)
    rows = [(i, [1.0, 2.0, 3.0] if i % 3 == 0 else [float(rng.randint(0, 3)) for _ in range(3)], "d") for i in range(300)]
    rng.shuffle(rows)
    found, got = run(spark, rows[:90], rows, 4, block=block)
    assert got == plain(rows[:90], rows, 4)
    # Of equal vectors only k rows are looked at.
    assert found.rings.agg(F.sum("n")).first()[0] <= 4 * 65


def test_vectors_at_one_distance_from_each_other(spark):
    rows = [(i, [float(i == j) for j in range(60)], "d") for i in range(60)]
    assert run(spark, rows, rows, 3, block=8)[1] == plain(rows, rows, 3)


def test_nulls_and_odd_values(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0], "a"), (2, None, "a"), (None, [1.0, 2.0], "a"), (4, [nan, 1.0], "a"), (5, [None, 1.0], "a"), (6, [inf, 1.0], "b"), (7, [0.0, 0.0], None), (8, [5.0, 5.0], "b"), (9, [1e19, -1e19], "b")]
    for within in (False, True):
        for k in (1, 3, 20):
            assert run(spark, rows, rows, k, within, block=2)[1] == plain(rows, rows, k, within)


def test_empty_sides(spark):
    rows = [(1, [1.0, 2.0], "a")]
    for q, r in (([], rows), (rows, []), ([], [])):
        assert run(spark, q, r)[1] == []
    assert run(spark, rows, rows, None)[1] == [(1, 1, 1, 0.0)]


def test_documents_without_a_query_are_not_opened(spark):
    rows = clustered(4, 300)
    queries = [r for r in rows if r[2] == "d1"][:5]
    found, got = run(spark, queries, rows, 3, True, block=16)
    assert got == plain(queries, rows, 3, True)
    assert found.opened.count() < found.rings.where("document = 'd1'").count() * 5
