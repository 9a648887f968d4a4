import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from docflow.llm.q_topk_search import ORACLE, op13_exact_topk
from docflow.llm.topk_search import products, top_k

SCHEMA = "vec_id bigint, embedding array<float>, rank string, _q int, score double"


def plain(rows, k=10, by=100):
    """Rows are (id, vector); every row is told from the others by its place."""
    whole = [(i, [int(np.floor(1024 * float(np.float32(x)))) for x in v]) if v is not None and all(x is not None and np.isfinite(np.float32(x)) for x in v) else None for i, v in rows]
    out = []
    for a, q in enumerate(whole):
        if q is None or q[0] is None or q[0] % by:
            continue
        found = [(-sum(x * y for x, y in zip(q[1], r[1], strict=True)), r[0] is None, r[0] or 0, b) for b, r in enumerate(whole) if r is not None and b != a and len(r[1]) == len(q[1])]
        out += [(q[0], n + 1, None if none else i, -s) for n, (s, none, i, _) in enumerate(sorted(found)[:k])]
    return sorted(out, key=repr)


def run(spark, rows, **kw):
    df = spark.createDataFrame([(i, v, "x", 1, 0.5) for i, v in rows], SCHEMA)
    return sorted((tuple(r) for r in top_k(df, F.col("vec_id") % 100 == 0, **kw).collect()), key=repr)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_equals_sql(spark, sf):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '/root/testdata/{sf}/embeddings.parquet'")
    want = con.sql(ORACLE)
    got = op13_exact_topk(spark, f"/root/testdata/{sf}")
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(want.fetchall())


@pytest.mark.parametrize("bins", [2, 16, 2048])
def test_ties_copies_and_small_blocks(spark, bins):
    rng = random.Random(3)
    hot = [rng.uniform(-1, 1) for _ in range(6)]
    rows = [(i, hot if i % 3 == 0 else [rng.choice([-0.5, 0.0, 0.25, 1.0]) for _ in range(6)]) for i in range(400)]
    rng.shuffle(rows)
    assert run(spark, rows, bins=bins, query_block=2, row_block=37) == plain(rows)


@pytest.mark.parametrize("seed", range(3))
def test_scores_next_to_the_border_of_a_bin(spark, seed):
    rng = random.Random(seed)
    rows = [(i, [round(rng.gauss(0, 0.05), 3) for _ in range(4)]) for i in range(700)]
    assert run(spark, rows, bins=[4, 32, 2048][seed]) == plain(rows)


def test_nulls_odd_values_and_lengths(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (100, [nan, 1.0]), (200, None), (300, [inf, 0.0]), (400, [None, 1.0]), (500, [1.0]), (600, []), (700, []), (None, [1.0, 2.0]), (None, [0.5, 0.5]), (1, [1.0, 2.0]), (-100, [3.0, -1.0])]
    assert run(spark, rows) == plain(rows)


def test_repeated_ids_and_rows_are_rows_of_their_own(spark):
    rows = [(100, [1.0, 0.0]), (100, [1.0, 0.0]), (100, [0.0, 1.0]), (7, [1.0, 0.0]), (7, [1.0, 0.0])]
    assert run(spark, rows, k=3) == plain(rows, 3)


def test_fewer_than_k_and_none(spark):
    assert run(spark, [(100, [1.0])]) == []
    assert run(spark, []) == []
    assert run(spark, [(1, [1.0]), (2, [2.0])]) == []
    rows = [(100, [1.0]), (2, [2.0]), (3, [-5.0])]
    assert run(spark, rows) == plain(rows) == [(100, 1, 2, 2097152), (100, 2, 3, -5242880)]


def test_large_components(spark):
    rows = [(100, [3e5, -2e5, 1.0]), (1, [2.5e5, 1e5, 0.0]), (2, [-3e5, 1e5, 2.0]), (3, [1.9e6, 1.9e6, 1.9e6])]
    assert run(spark, rows, bins=64) == plain(rows)
    # Beyond 32 bits components count as the bound, beyond 2**61 scores do: no crash.
    assert [r[2] for r in run(spark, [(100, [3e38, 3e38]), (1, [3e38, 3e38]), (2, [-3e38, 3e38]), (3, [1.0, 1.0])])] == [1, 3, 2]


def test_products_are_exact():
    rng = np.random.default_rng(5)
    for most in (1 << 10, 1 << 25, 1 << 30):
        q, r = (rng.integers(-most, most, (3, 5)).astype(np.int32) for _ in range(2))
        want = [[min(max(sum(int(x) * int(y) for x, y in zip(a, b, strict=True)), -(1 << 61)), 1 << 61) for b in r] for a in q]
        assert products(q, r).tolist() == want
