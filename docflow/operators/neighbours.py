"""Exact nearest neighbours: cells around pivots, pruned by the triangle inequality.

Rows lie in the cell of their nearest pivot, cells are cut into rings by the distance from the pivot, and rings of more than
a block into parts by hash. What stands beyond a ring's inner and outer radius, seen from a query, can't be nearer than the difference,
so a first pass through the cells next to a query gives it a k-th distance and the second opens only what may hold a nearer row.

Results don't depend on the pivots. They are a bounded sample of the rows (``pivots``, those with the smallest hash of their
id), sent to all tasks. No row is copied but for cells that more than a block of queries open. Of rows with one vector only the
k smallest ids can be among the k nearest, so other copies leave before anything meets.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from docflow.operators.joins import to_totals
from docflow.sources.workspace import new_path

#: Rows of one part of a ring, and queries that meet one at a time.
BLOCK = 4096
PIVOTS = 128
#: Rings of a cell at most.
RINGS = 64
#: Numbers held at a time while distances are worked out.
CELLS = 1 << 20
#: Share of a distance by which bounds give way to rounding.
SLACK = 1e-9

class Search(NamedTuple):
    """``found``: the nearest rows; ``opened``: ``query_id, pass, ring`` of what each query opened; ``rings``: ``document, pivot, ring, n`` of all there is."""

    found: DataFrame
    opened: DataFrame
    rings: DataFrame


def squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all pairs, in double."""
    step = max(1, CELLS // max(1, b.size))
    return np.concatenate([((a[lo : lo + step, None, :] - b[None, :, :]) ** 2).sum(axis=2) for lo in range(0, len(a), step)] or [np.zeros((0, len(b)))])


def _matrix(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    found = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return found.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(found), width)


def _best(queries: pa.Table, rows: pa.Table, k: int) -> pa.Table:
    """The k nearest rows of each query, ties by id."""
    if not len(queries) or not len(rows):
        return pa.table({"_q": pa.array([], pa.int64()), "_r": pa.array([], pa.int64()), "distance": pa.array([], pa.float64())})
    width = len(rows["_v"][0])
    q, ids = queries["_q"].to_numpy(), rows["_r"].to_numpy()
    order = np.argsort(ids, kind="stable")
    r, ids = _matrix(rows["_v"], width)[order], ids[order]
    own, out = _matrix(queries["_qv"], width), []
    step = max(1, CELLS // max(1, r.size))
    for lo in range(0, len(q), step):
        d = squares(own[lo : lo + step], r)
        near = np.argsort(d, axis=1, kind="stable")[:, :k]
        out.append((np.repeat(q[lo : lo + step], near.shape[1]), ids[near].ravel(), np.take_along_axis(d, near, 1).ravel()))
    return pa.table({name: np.concatenate([x[i] for x in out]) for i, name in enumerate(["_q", "_r", "distance"])})


def _stored(df: DataFrame, name: str) -> DataFrame:
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _finite(vector: str) -> Column:
    return F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def _keyed(df: DataFrame, name: str, vector: str, key: str | None) -> DataFrame:
    known = df.where(F.col("id").isNotNull() & F.coalesce(_finite("vector"), F.lit(False)))
    return known.select(F.col("id").alias(name), F.col("vector").alias(vector), (F.col(key).cast("string") if key else F.lit("")).alias("_w")).where("_w is not null")


def _in_cells(rows: DataFrame, pivots: np.ndarray, k: int) -> DataFrame:
    """``_w, _v, _r, _p, _ring, _t``: nearest pivot, ring and distance; of equal vectors the k smallest ids."""
    width = _ring_width(pivots)

    def run(batches):
        for batch in batches:
            d = squares(_matrix(batch.column(1), pivots.shape[1]), pivots)
            at = d.argmin(axis=1)
            t = np.sqrt(d[np.arange(len(at)), at])
            ring = np.minimum(t / width, RINGS - 1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at.astype(np.int32)), pa.array(ring), pa.array(t)], ["_w", "_v", "_r", "_p", "_ring", "_t"])

    kind = rows.schema["_v"].dataType.simpleString()
    near = rows.select("_w", "_v", "_r").mapInArrow(run, f"_w string, _v {kind}, _r bigint, _p int, _ring int, _t double")
    copy = F.row_number().over(Window.partitionBy("_w", "_v").orderBy("_r"))
    return near.withColumn("_copy", copy).where(F.col("_copy") <= k).drop("_copy")


def _ring_width(pivots: np.ndarray) -> float:
    """A quarter of the median distance from a pivot to the next; a single cell, of a block at most, is one ring."""
    if len(pivots) == 1:
        return float("inf")
    d = squares(pivots, pivots)
    np.fill_diagonal(d, np.inf)
    near = np.sqrt(d.min(axis=1))
    near = near[np.isfinite(near) & (near > 0)]
    return float(np.median(near)) / 4 if len(near) else 1.0


def _cells(rows: DataFrame) -> DataFrame:
    """``_w, _p, lo, hi, n, rings``: a row for each cell; rings are structs of number, radii and count, ``RINGS`` at most."""
    rings = rows.groupBy("_w", "_p", "_ring").agg(F.min("_t").alias("lo"), F.max("_t").alias("hi"), F.count("*").alias("n"))
    return rings.groupBy("_w", "_p").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("n").alias("n"), F.collect_list(F.struct(F.col("_ring").alias("ring"), "lo", "hi", "n")).alias("rings"))


def _keyed_join(rows: DataFrame, totals: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with the columns of ``totals``, which has one row for each value of the keys."""
    key = F.to_json(F.struct(*keys))
    return to_totals(rows.withColumn("_key", key), totals.withColumn("_key", key).drop(*keys), "_key").drop("_key")


def _parts(n: Column, block: int) -> Column:
    return F.ceil(n / block).cast("int")


def _measured(queries: DataFrame, around: DataFrame, pivots: np.ndarray, k: int) -> DataFrame:
    """Queries with their distances from the pivots and ``_open``: the cells that come first by lower bound and hold k rows together."""
    rows = to_totals(queries.select("_q", "_qv", "_w"), around, "_w").select("_q", "_qv", "_w", "_cells")

    def run(batches):
        for batch in batches:
            away = np.sqrt(squares(_matrix(batch.column(1), pivots.shape[1]), pivots))
            chosen = []
            for own, cells in zip(away, batch.column(3), strict=True):
                p, lo, hi, n = (cells.values.field(j).to_numpy(zero_copy_only=False) for j in range(4))
                d = own[p]
                order = np.lexsort((d, np.maximum(np.maximum(d - hi, lo - d), 0)))
                before = np.cumsum(n[order]) - n[order]
                chosen.append(p[order[before < k]])
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, away.size + 1, len(pivots)), pa.int32()), pa.array(away.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists, pa.array(chosen, pa.list_(pa.int32()))], ["_q", "_qv", "_w", "_cells", "_d", "_open"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(run, f"{fields}, _d array<double>, _open array<int>")


def _least(away: Column, ring: Column) -> Column:
    """The least distance that a row between two radii can have, a little less for rounding."""
    return F.greatest(away - ring["hi"], ring["lo"] - away, F.lit(0.0)) - SLACK * (away + ring["hi"])


def _opened(queries: DataFrame, cells: DataFrame, k: int, second: bool) -> DataFrame:
    """``_q, _qv``, ring and its count for every ring that a query opens.

    First: of the cells in ``_open``, the rings that come first by lower bound and hold k rows together. Second: all other
    rings that may hold a row within ``_kth``.
    """
    away = lambda c: F.element_at("_d", c["_p"] + 1)
    # A row of another pivot's cell is at least half the difference of the two distances away.
    least = lambda c: F.greatest(_least(away(c), c), (away(c) - F.array_min("_d")) / 2 - SLACK * away(c))
    which = F.transform(F.filter("_cells", lambda c: least(c) <= F.col("_kth")), lambda c: c["_p"]) if second else F.col("_open")
    kept = ["_q", "_qv", "_w", "_d", "_open", *(["_kth"] if second else [])]
    pairs = queries.select(*kept, F.explode(which).alias("_p"))
    pairs = pairs.select(*[c for c in kept if c not in ("_d", "_open")], "_p", F.element_at("_d", F.col("_p") + 1).alias("_away"), F.array_contains("_open", F.col("_p")).alias("_old"))
    pairs = _keyed_join(pairs, cells.select("_w", "_p", "rings"), ["_p", "_w"])
    ranked = F.sort_array(F.transform("rings", lambda r: F.struct(_least(F.col("_away"), r).alias("least"), r["ring"].alias("ring"), r["n"].alias("n"))))
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(None).cast("double").alias("least"))
    pairs = pairs.withColumn("_ranked", ranked)
    pairs = pairs.withColumn("_first", F.aggregate("_ranked", start, lambda s, r: F.when(s["n"] >= k, s).otherwise(F.struct((s["n"] + r["n"]).alias("n"), r["least"].alias("least"))))["least"])
    old = lambda r: F.col("_old") & (r["least"] <= F.col("_first"))
    near = F.filter("_ranked", lambda r: (r["least"] <= F.col("_kth")) & ~old(r) if second else old(r))
    return pairs.select("_q", "_qv", "_w", "_p", F.explode(near).alias("r")).select("_q", "_qv", "_w", "_p", F.col("r.ring").alias("_ring"), F.col("r.n").alias("_n"))


def _met(opened: DataFrame, rows: DataFrame, k: int, block: int) -> DataFrame:
    """``_q, _r, distance``: the k nearest rows of each part of a ring for each query that opens it."""
    ring = ["_ring", "_p", "_w"]
    sizes = opened.groupBy(*ring).agg(_parts(F.first("_n"), block).alias("_nr"), _parts(F.count("*"), block).alias("_nq"))
    part = lambda name, n: F.pmod(F.xxhash64(name), F.col(n).cast("long")).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = _keyed_join(opened.select("_q", "_qv", *ring), sizes, ring).select("_q", "_qv", *ring, part("_q", "_nq").alias("_a"), every("_nr").alias("_b"))
    right = _keyed_join(rows.select("_r", "_v", *ring), sizes, ring).select("_r", "_v", *ring, part("_r", "_nr").alias("_b"), every("_nq").alias("_a"))
    by = [*ring, "_a", "_b"]
    return left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(lambda a, b: _best(a, b, k), "_q bigint, _r bigint, distance double")


def search(queries: DataFrame, rows: DataFrame, k: int | None = 10, within: tuple[str, str] | None = None, block: int = BLOCK, pivots: int = PIVOTS) -> Search:
    """The k nearest of ``rows`` (``id, vector``) for each of ``queries`` (``id, vector``) by squared L2 in double, ties by id: ``query_id, row_id, distance, rank``.

    ``within`` names a column on each side that must agree. Null or 0 for k means 10. Rows and queries without an
    id or vector, with a component that is null or not finite, or without a value of ``within`` are left out. Vectors must have one length.
    """
    k = int(k or 10)
    left, right = _keyed(queries, "_q", "_qv", within and within[0]), _keyed(rows, "_r", "_v", within and within[1])
    # As many pivots as there are blocks of rows, up to a bound: cells of about a block.
    n = min(pivots, -(-right.count() // block))
    sample = right.orderBy(F.xxhash64("_r"), "_r").limit(n).select("_v").collect() if n else []
    middle = np.array([x["_v"] for x in sample], float) if sample else np.zeros((1, 1))
    placed = _stored(_in_cells(right, middle, k), "cells-rows")
    cells = _stored(_cells(placed), "cells")
    around = cells.groupBy("_w").agg(F.collect_list(F.struct("_p", "lo", "hi", "n")).alias("_cells"))
    known = _measured(left, around, middle, k)
    first = _opened(known, cells, k, False)
    found = _stored(_met(first, placed, k, block), "cells-first")
    # The k-th distance so far; a query that has fewer than k rows has opened all of them.
    ranked = found.withColumn("_n", F.row_number().over(Window.partitionBy("_q").orderBy("distance", "_r"))).where(F.col("_n") <= k)
    kth = ranked.where(F.col("_n") == k).select("_q", (F.sqrt("distance") * (1 + SLACK)).alias("_kth"))
    both, opened = ranked.drop("_n"), [first.withColumn("_pass", F.lit(1))]
    if len(middle) > 1:
        # With one cell of one ring nothing is left to open.
        second = _opened(known.join(kth, "_q"), cells, k, True)
        both, opened = both.unionByName(_met(second, placed, k, block)), [*opened, second.withColumn("_pass", F.lit(2))]
    best = F.row_number().over(Window.partitionBy("_q").orderBy("distance", "_r"))
    out = both.select(F.col("_q").alias("query_id"), F.col("_r").alias("row_id"), "distance", best.alias("rank")).where(F.col("rank") <= k)
    rings = cells.select(F.col("_w").alias("document"), F.col("_p").alias("pivot"), F.explode("rings").alias("r")).select("document", "pivot", "r.ring", "r.n")
    told = reduce(DataFrame.unionByName, opened).select(F.col("_q").alias("query_id"), F.col("_pass").alias("pass"), "_p", "_ring")
    return Search(out, told, rings)
