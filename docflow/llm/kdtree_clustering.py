"""Centroid clustering (k-means on whole numbers) filtered through kd-trees.

Every partition's vectors are put in kd-trees of bounded size once. A node keeps
its count, its componentwise sums and its bounding box. In each round a tree is
gone through level by level with the centroids that may still be nearest: a
centroid is dropped for a node when another is strictly nearer to every point of
the node's box. A node with one centroid left is given to it whole, by count and
sums; leaves with several are resolved exactly, point by point, ties to the
smaller number. Ties inside a box are never pruned, so the result is that of
comparing all vectors with all centroids.

Scale: no vector is shuffled. A round sends each partition's counts and sums, k x
components, which Spark adds up by (cluster, component); k x components sums reach
the driver, and the centroids go back with the next round. Trees are written to the
shared folder once and read in every round. Equal vectors fill nodes
whose box is a point, which go to one centroid whole unless two are equally near.

Defined results: vectors that are null, have another number of components than
asked, or hold a null, NaN or infinite component give no row. Components whose
scaled value is beyond 32 bits count as that bound; distances and sums of distances
beyond 63 bits count as the largest long. Rows that repeat an id are vectors of
their own; among equal hashes the first centroids go by the vectors' components.
Null ids come last there. Fewer vectors than k give as many centroids. An empty
table gives no rows. Extra columns play no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from docflow.llm.arrow import lean
from docflow.llm.storage import discard, stored
from docflow.llm.text import pick
from docflow.llm.vectors import matrix, scaled, usable

#: Vectors of one tree and of a leaf.
TREE, LEAF = 2048, 16
#: Trees that go to Python at a time: one is a row of about 700 kB with 64 components.
BATCH = 8
#: Differences are squared in 64 bits while all components are within this.
SMALL = 1 << 27
MOST = (1 << 63) - 1
SCHEMA = "n int, points binary, ids array<{}>, lows binary, highs binary, sums binary"


@cache
def layout(n: int, leaf: int) -> list[list[tuple[int, int]]]:
    """Ranges of points by level: halves of the range above, down to the leaf size. Ranges of leaves are not split further."""
    levels = [[(0, n)]]
    while any(b - a > leaf for a, b in levels[-1]):
        levels.append([x for a, b in levels[-1] if b - a > leaf for x in ((a, (a + b) // 2), ((a + b) // 2, b))])
    return levels


def build(points: np.ndarray, leaf: int = LEAF) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The points' order, and lows, highs and sums of all nodes, level by level. A node is halved at the median of its widest component."""
    order = np.arange(len(points))
    lows, highs, sums = [], [], []
    for level in layout(len(points), leaf):
        for a, b in level:
            own = points[order[a:b]]
            low, high = own.min(axis=0), own.max(axis=0)
            lows.append(low)
            highs.append(high)
            sums.append(own.sum(axis=0, dtype=np.int64))
            if b - a > leaf:
                wide = int(np.argmax(high.astype(np.int64) - low))
                order[a:b] = order[a:b][np.argpartition(own[:, wide], (b - a) // 2)]
    return order, np.array(lows, np.int32), np.array(highs, np.int32), np.array(sums, np.int64)


def exact(small: bool):
    """The type that holds squares: 64 bits where they fit, else Python's whole numbers."""
    return np.int64 if small else object


def squares(points: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances, points x centroids, in the given type."""
    return ((points[:, None, :] - centroids[None, :, :]) ** 2).sum(axis=2)


def dominated(low: np.ndarray, high: np.ndarray, alive: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """``alive`` (nodes x centroids) without those that another one beats strictly all over the node's box.

    The other one is the alive centroid next to the box's middle. Where ``z`` does best against it is the
    box's corner in the direction from it to ``z``; if ``z`` loses there, it loses everywhere.
    """
    middle = low + high
    far = ((2 * centroids[None, :, :] - middle[:, None, :]) ** 2).sum(axis=2)
    worst = far.max() + 1 if far.size else 0
    star = np.where(alive, far, worst).argmin(axis=1)
    best = centroids[star][:, None, :]
    away = centroids[None, :, :] - best
    corner = np.where(away > 0, high[:, None, :], low[:, None, :])
    lead = (away * (centroids[None, :, :] + best - 2 * corner)).sum(axis=2)
    return alive & ~(lead > 0)


def assigned(tree: dict, centroids: np.ndarray, leaf: int = LEAF) -> Iterator[tuple[int, int, int, int | None, np.ndarray | None]]:
    """``(a, b, node, cluster, each)``: ranges of points with one cluster for all, or with each point's own (cluster is None then)."""
    kind = exact(tree["small"] and bool((np.abs(centroids) <= SMALL).all()))
    z = centroids.astype(kind)
    low, high = tree["lows"].astype(kind), tree["highs"].astype(kind)
    alive, first = np.ones((1, len(z)), bool), 0
    levels = layout(tree["n"], leaf)
    open_ = np.array([True])
    for k, level in enumerate(levels):
        nodes = np.arange(first, first + len(level))
        at = np.flatnonzero(open_)
        left = np.zeros((len(level), len(z)), bool)
        left[at] = dominated(low[nodes[at]], high[nodes[at]], alive[at], z)
        single = open_ & (left.sum(axis=1) == 1)
        for i in np.flatnonzero(single):
            yield *level[i], int(nodes[i]), int(left[i].argmax()), None
        inner = np.array([b - a > leaf for a, b in level])
        for i in np.flatnonzero(open_ & ~single & ~inner):
            a, b = level[i]
            use = np.flatnonzero(left[i])
            yield a, b, int(nodes[i]), None, use[squares(tree["points"][a:b].astype(kind), z[use]).argmin(axis=1)]
        # Halves of the inner nodes, in order, with what is left of their parents.
        first += len(level)
        if k + 1 < len(levels):
            alive = np.repeat(left[inner], 2, axis=0)
            open_ = np.repeat((open_ & ~single)[inner], 2)


def trees(vectors: DataFrame, dims: int, size: int = TREE, leaf: int = LEAF) -> DataFrame:
    """``vectors`` (``_id, _v``) as trees, each partition's rows in trees of at most ``size``."""
    kind = vectors.schema["_id"].dataType

    def row(ids: pa.Array, points: np.ndarray) -> pa.RecordBatch:
        order, low, high, sums = build(points, leaf)
        own = ids.take(pa.array(order))
        lists = pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), own)
        blob = lambda x: pa.array([x.tobytes()], pa.binary())
        return pa.RecordBatch.from_arrays([pa.array([len(points)], pa.int32()), blob(points[order]), lists, blob(low), blob(high), blob(sums)], ["n", "points", "ids", "lows", "highs", "sums"])

    def run(batches):
        ids, rows, n = [], [], 0
        for batch in batches:
            for lo in range(0, batch.num_rows, size):
                part = batch.slice(lo, size)
                ids.append(part.column(0))
                rows.append(matrix(part.column(1), dims))
                n += part.num_rows
                while n >= size:
                    all_ids, points = pa.concat_arrays(ids), np.concatenate(rows)
                    yield row(all_ids.slice(0, size), points[:size])
                    ids, rows, n = [all_ids.slice(size)], [points[size:]], n - size
        if n:
            yield row(pa.concat_arrays(ids), np.concatenate(rows))

    return vectors.mapInArrow(lean(run), SCHEMA.format(kind.simpleString()))


def unpacked(batch: pa.RecordBatch, dims: int) -> Iterator[dict]:
    """The trees of a batch."""
    column = lambda name: batch.column(batch.schema.names.index(name))
    ids = column("ids")
    for k, n in enumerate(column("n").to_pylist()):
        read = lambda name, kind: np.frombuffer(column(name)[k].as_buffer(), kind).reshape(-1, dims)  # noqa: B023, E731
        tree = {"n": n, "ids": ids[k].values, "points": read("points", np.int32), "lows": read("lows", np.int32), "highs": read("highs", np.int32), "sums": read("sums", np.int64)}
        root = np.concatenate([tree["lows"][:1], tree["highs"][:1]]).astype(np.int64)
        yield tree | {"small": bool((np.abs(root) <= SMALL).all())}


def new_centroids(forest: DataFrame, centroids: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """Componentwise floors of the clusters' means; an empty cluster's centroid stays."""
    k, dims = centroids.shape

    def run(batches):
        n, sums = np.zeros(k, np.int64), np.zeros((k, dims), np.int64)
        for batch in batches:
            for tree in unpacked(batch, dims):
                for a, b, node, cluster, each in assigned(tree, centroids, leaf):
                    if each is None:
                        n[cluster] += b - a
                        sums[cluster] += tree["sums"][node]
                    else:
                        np.add.at(n, each, 1)
                        np.add.at(sums, each, tree["points"][a:b])
        used = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(n[used]), pa.array(sums[used].tolist(), pa.list_(pa.int64()))], ["cluster", "n", "sums"])

    parts = forest.mapInArrow(lean(run), "cluster int, n bigint, sums array<bigint>").select("cluster", "n", F.posexplode("sums").alias("dim", "s"))
    total = parts.groupBy("cluster", "dim").agg(F.sum(F.col("n").cast("decimal(38,0)")).alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    out = centroids.copy()
    for r in total.collect():  # k x components rows
        out[r["cluster"], r["dim"]] = int(r["s"]) // int(r["n"])
    return out


def distances(forest: DataFrame, centroids: np.ndarray, leaf: int = LEAF) -> DataFrame:
    """``_id, cluster, distance`` of every vector."""
    dims = centroids.shape[1]
    kind = forest.schema["ids"].dataType.elementType

    def run(batches):
        for batch in batches:
            for tree in unpacked(batch, dims):
                whole = exact(tree["small"] and bool((np.abs(centroids) <= SMALL).all()))
                cluster = np.empty(tree["n"], np.int32)
                for a, b, _, one, each in assigned(tree, centroids, leaf):
                    cluster[a:b] = one if each is None else each
                far = ((tree["points"].astype(whole) - centroids.astype(whole)[cluster]) ** 2).sum(axis=1)
                yield pa.RecordBatch.from_arrays([tree["ids"], pa.array(cluster), pa.array(np.minimum(far, MOST).astype(np.int64))], ["_id", "cluster", "distance"])

    return forest.mapInArrow(lean(run), T.StructType([T.StructField("_id", kind), T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType())]))


def first_centroids(vectors: DataFrame, k: int) -> np.ndarray:
    """The k vectors with the smallest SHA-256 of ``1:<id>``, in that order: k rows reach the driver."""
    hashed = vectors.select(F.sha2(F.concat(F.lit("1:"), F.col("_id").cast("string")), 256).alias("h"), "_v").orderBy(F.col("h").asc_nulls_last(), "_v").limit(k)
    return np.array([r["_v"] for r in hashed.collect()], np.int64)


def clustered(rows: DataFrame, k: int = 16, rounds: int = 3, dims: int = 64, factor: int = 64, id_col: str = "vec_id", vector_col: str = "embedding", tree: int = TREE, leaf: int = LEAF) -> DataFrame:
    """``id_col, cluster, distance, cluster_inertia, inertia, centroid_sha256`` of every kept vector."""
    spark = rows.sparkSession
    own = pick(rows, _id=id_col, _e=vector_col).where((F.size("_e") == dims) & usable(F.col("_e")))
    vectors = own.select("_id", scaled(F.col("_e"), factor).alias("_v"))
    empty = f"`{id_col}` {vectors.schema['_id'].dataType.simpleString()}, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string"
    centroids = first_centroids(vectors, k)
    if not len(centroids):
        return spark.createDataFrame([], empty)
    forest = stored(trees(vectors, dims, tree, leaf), "trees")
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(setting)
    spark.conf.set(setting, str(BATCH))
    try:
        for _ in range(rounds):
            centroids = new_centroids(forest, centroids, leaf)
        found = stored(distances(forest, centroids, leaf), "assigned")
    finally:
        spark.conf.set(setting, before)
    discard(forest)
    inertia = {r["cluster"]: int(r["s"]) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}  # k rows
    lines = [(c, min(inertia.get(c, 0), MOST), min(sum(inertia.values()), MOST), hashlib.sha256(",".join(map(str, z)).encode()).hexdigest()) for c, z in enumerate(centroids.tolist())]
    facts = spark.createDataFrame(lines, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    # k rows: their number is a parameter.
    return found.join(F.broadcast(facts), "cluster").select(F.col("_id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
