import hashlib
import random

import duckdb
import numpy as np
import pytest

from docflow.llm import kdtree_clustering as K
from docflow.llm.q_kdtree_clustering import ORACLE, op12_centroid_clustering

SCHEMA = "vec_id bigint, embedding array<float>, cluster string, _v int"


def plain(rows, k, rounds, dims, factor=64):
    limit = (1 << 31) - 1
    whole = [(i, [int(max(-limit, min(limit, np.floor(factor * float(np.float32(x)))))) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and np.isfinite(np.float32(x)) for x in v)]
    centroids = [v for _, v in sorted(whole, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))[:k]]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    for step in range(rounds + 1):
        near = [min((far(v, z), c) for c, z in enumerate(centroids)) for _, v in whole]
        if step < rounds:
            for c in range(len(centroids)):
                if own := [v for (_, v), (_, b) in zip(whole, near, strict=True) if b == c]:
                    centroids[c] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    top = (1 << 63) - 1
    each = [min(d, top) for d, _ in near]
    return sorted(((i, c, d, min(sum(e for e, (_, b) in zip(each, near, strict=True) if b == c), top), min(sum(each), top), hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()) for (i, _), d, (_, c) in zip(whole, each, near, strict=True)), key=repr)


def run(spark, rows, **kw):
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], SCHEMA).repartition(3)
    return sorted((tuple(r) for r in K.clustered(df, **kw).collect()), key=repr)


def test_query_equals_sql(spark):
    con = duckdb.connect()
    con.sql("CREATE VIEW embeddings AS SELECT * FROM '/root/testdata/sf0.001/embeddings.parquet'")
    want = con.sql(ORACLE)
    got = op12_centroid_clustering(spark, "/root/testdata/sf0.001").select(*want.columns).collect()
    assert sorted(map(tuple, got)) == sorted(want.fetchall())
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").select("vec_id", "embedding").collect()]
    assert sorted(map(tuple, got), key=repr) == plain(rows, 16, 3, 64)


@pytest.mark.parametrize("seed", range(3))
def test_ties_and_copies_in_small_trees(spark, seed):
    rng = random.Random(seed)
    hot = [0.5, -0.5, 0.25]
    rows = [(i, hot if i % 3 == 0 else [rng.choice([-1.0, -0.5, 0.0, 0.5, 1.0]) for _ in range(3)]) for i in range(300)]
    assert run(spark, rows, k=7, rounds=4, dims=3, tree=40, leaf=3) == plain(rows, 7, 4, 3)


def test_odd_vectors_ids_and_sizes(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0]), (1, [1.0, 2.0]), (1, [-3.0, 0.0]), (None, [0.1, 0.2]), (2, None), (3, [nan, 1.0]), (4, [-inf, 1.0]), (5, [None, 1.0]), (6, [1.0]), (7, []), (8, [1.0, 2.0, 3.0])]
    for k in (1, 3, 16):
        assert run(spark, rows, k=k, rounds=3, dims=2) == plain(rows, k, 3, 2)
    assert run(spark, []) == []
    assert run(spark, [(1, None)], dims=2) == []


def test_large_components(spark):
    rng = random.Random(9)
    rows = [(i, [rng.uniform(-3e7, 3e7), rng.uniform(-10, 10)]) for i in range(60)] + [(99, [3e38, -3e38])]
    assert run(spark, rows, k=4, rounds=2, dims=2, tree=16, leaf=4) == plain(rows, 4, 2, 2)


def blob(seed, n=2000, dims=8, parts=6):
    rng = np.random.default_rng(seed)
    middle = rng.integers(-500, 500, (parts, dims))
    return (middle[rng.integers(0, parts, n)] + rng.integers(-20, 21, (n, dims))).astype(np.int32), middle.astype(np.int64)


def tree_of(points, leaf=K.LEAF):
    order, low, high, sums = K.build(points, leaf)
    return {"n": len(points), "points": points[order], "lows": low, "highs": high, "sums": sums, "small": True}, order


def test_whole_nodes_are_assigned_and_centroids_pruned():
    points, middle = blob(1)
    tree, _ = tree_of(points)
    found = list(K.assigned(tree, middle))
    assert sorted(i for a, b, *_ in found for i in range(a, b)) == list(range(2000))
    whole = [x for x in found if x[3] is not None]
    # Clusters far apart: nearly all points go by whole nodes, most of them above the leaves.
    assert sum(b - a for a, b, *_ in whole) > 1900
    assert len(found) < 100
    for a, b, node, cluster, each in found:
        want = K.squares(tree["points"][a:b].astype(np.int64), middle).argmin(axis=1)
        assert (want == (each if each is not None else cluster)).all()
        assert (tree["sums"][node] == tree["points"][a:b].sum(axis=0)).all()


def test_a_tie_on_the_box_is_not_pruned():
    # Both centroids are equally far from every point: only the number decides.
    points = np.array([[0, y] for y in range(40)], np.int32)
    tree, _ = tree_of(points, 4)
    for z in ([[5, 3], [-5, 3]], [[-5, 3], [5, 3]]):
        for _, _, _, cluster, each in K.assigned(tree, np.array(z, np.int64), 4):
            assert cluster in (None, 0) and (each is None or not each.any())


def test_layout_covers_every_point():
    for n in (1, 2, 15, 16, 17, 33, 100, 2048):
        for level in K.layout(n, 16):
            assert all(b > a for a, b in level)
        leaves = sorted(x for level in K.layout(n, 16) for x in level if x[1] - x[0] <= 16)
        assert [i for a, b in leaves for i in range(a, b)] == list(range(n))
