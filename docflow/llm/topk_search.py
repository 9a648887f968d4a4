"""Exact top-k search by distributed histogram selection.

Queries are dealt out in blocks, and so are all rows; a pair of blocks is one
task's work, which scores every query of the one with every row of the other. No
score is kept. Each round counts, per query, the scores by the bins of an
interval that must hold the k-th best; the bins of all tasks are summed and the
bin of the k-th becomes the next interval, until it is one value wide (or its
lower end leaves exactly k scores). The last pass scores once more, lets through
what reaches the k-th value, and ties go to the smaller id.

Scale: two rounds and the last pass for scores of 22 bits with 2,048 bins, each
further 11 bits cost one more round. A pass shuffles rows x query blocks and
queries x row blocks; both block sizes are parameters. A task sends at most
``k`` bins a query: below the bin where its own k-th lies, the k-th of all can't lie.
Counts are summed before they are shuffled. In the last pass a task sends at most k
rows a query, so a vector that a third of all rows share sends k a task, not all its
copies. Only the largest norm, two row counts and one number a round reach the driver.

Defined results: vectors that are null or hold a null, NaN or infinite component
take no part, neither as query nor as candidate; a query meets the rows of its own
number of components (an empty vector scores 0 with another). The query's own row
is left out, and only that: another row with the same id or vector is a candidate.
Rows that repeat a query's id are queries of their own. Null ids are candidates
after all others and never queries by an id rule. Fewer than k candidates give them
all; an empty table, or one without queries, gives no rows. Extra columns play no part.
Scaled components beyond 32 bits count as that bound and scores beyond 2**61 as that.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from docflow.llm.storage import discard, stored
from docflow.llm.text import pick
from docflow.llm.vectors import matrix, scaled, usable

#: Bins of one round.
BINS = 2048
#: Queries and rows of one block, and scores held at a time.
QUERY_BLOCK, ROW_BLOCK, CELLS = 4096, 1024, 1 << 19
#: Scores are held within this.
MOST = 1 << 61
#: Marks the query's own row.
OWN = -(1 << 63)


def products(q: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Inner products as int64: exact, in doubles while all sums fit in 53 bits."""
    most = (int(np.abs(q.astype(np.int64)).max(initial=0)) * int(np.abs(r.astype(np.int64)).max(initial=0))) * q.shape[1]
    if most < 1 << 53:
        return (q.astype(np.float64) @ r.astype(np.float64).T).astype(np.int64)
    if most < MOST:
        return q.astype(np.int64) @ r.astype(np.int64).T
    return np.clip(q.astype(object) @ r.astype(object).T, -MOST, MOST).astype(np.int64)


def tiles(queries: pa.Table, rows: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Query places, row places and scores of two blocks, a bounded number at a time; own rows have OWN."""
    vectors = [t[c].combine_chunks() for t, c in ((queries, "_qv"), (rows, "_v"))]
    sizes = [v.value_lengths().to_numpy() for v in vectors]
    uids = [t[c].to_numpy() for t, c in ((queries, "_q"), (rows, "_r"))]
    for width in np.intersect1d(*sizes):
        at = [np.flatnonzero(s == width) for s in sizes]
        q, r = (matrix(v.take(pa.array(i)), int(width)) for v, i in zip(vectors, at, strict=True))
        step = max(1, CELLS // len(r))
        for lo in range(0, len(q), step):
            part = at[0][lo : lo + step]
            scores = products(q[lo : lo + step], r)
            scores[uids[0][part][:, None] == uids[1][at[1]][None, :]] = OWN
            yield part, at[1], scores


def paired(queries: DataFrame, rows: DataFrame, blocks: tuple[int, int], run, schema: str) -> DataFrame:
    """``run`` over every pair of a block of queries and a block of rows."""
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    block = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    left = queries.withColumn("_a", block("_q", blocks[0])).withColumn("_b", every(blocks[1]))
    right = rows.withColumn("_b", block("_r", blocks[1])).withColumn("_a", every(blocks[0]))
    return left.groupBy("_a", "_b").cogroup(right.groupBy("_a", "_b")).applyInArrow(run, schema)


def histogram(k: int, bins: int):
    """A task's counts by query and bin: those in the query's interval, down to the bin of its own k-th."""

    def run(queries: pa.Table, rows: pa.Table) -> pa.Table:
        own, low, span, above = (queries[c].to_numpy() for c in ("_q", "_low", "_span", "_above"))
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for at, _, scores in tiles(queries, rows):
            # Differences are taken after the scores are known to lie within the interval: they can't pass 64 bits.
            lo, long_ = low[at][:, None], span[at][:, None]
            inside = (scores >= lo) & (scores != OWN)
            away = np.where(inside, scores, lo) - lo
            inside &= away < long_
            bin_ = away // ((long_ - 1) // bins + 1)
            query, _ = np.nonzero(inside)
            found, n = np.unique(query * bins + bin_[inside], return_counts=True)
            query, bin_ = found // bins, found % bins
            # Counts of the query's higher bins, by suffix sums within the query.
            total = np.bincount(query, n, len(at)).astype(np.int64)
            before = np.cumsum(n) - n
            first = np.cumsum(total) - total
            higher = total[query] - (before - first[query]) - n
            use = higher + above[at][query] < k
            out.append((own[at][query[use]], bin_[use], n[use]))
        return pa.table({"_q": np.concatenate([x[0] for x in out]), "bin": np.concatenate([x[1] for x in out]), "n": np.concatenate([x[2] for x in out])})

    return run


def survivors(k: int):
    """A task's rows that reach the query's k-th value, at most k a query."""

    def run(queries: pa.Table, rows: pa.Table) -> pa.Table:
        own, qid, low = queries["_q"], queries["query_id"], queries["_low"].to_numpy()
        # Places by id, nulls last: of equal scores the smaller id comes first.
        uid = rows["_r"].to_numpy()
        order = pc.sort_indices(rows.select(["vec_id", "_r"]), sort_keys=[("vec_id", "ascending"), ("_r", "ascending")], null_placement="at_end").to_numpy()
        place = np.empty(len(uid), np.int64)
        place[order] = np.arange(len(uid))
        left, right, score = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for at, there, scores in tiles(queries, rows):
            query, row = np.nonzero((scores >= low[at][:, None]) & (scores != OWN))
            s = scores[query, row]
            by = np.lexsort((place[there[row]], -s, query))
            query, row, s = query[by], row[by], s[by]
            first = np.searchsorted(query, np.arange(len(at)))
            use = np.arange(len(query)) - first[query] < k
            left.append(at[query[use]])
            right.append(there[row[use]])
            score.append(s[use])
        a, b = pa.array(np.concatenate(left)), pa.array(np.concatenate(right))
        return pa.table({"_q": own.take(a), "query_id": qid.take(a), "vec_id": rows["vec_id"].take(b), "_r": rows["_r"].take(b), "score": np.concatenate(score)})

    return run


def top_k(rows: DataFrame, is_query: Column, k: int = 10, factor: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding", bins: int = BINS, query_block: int = QUERY_BLOCK, row_block: int = ROW_BLOCK) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k best of all other rows for each row with ``is_query``, a condition on column ``vec_id``."""
    own = pick(rows, vec_id=id_col, _e=vector_col).where(usable(F.col("_e")))
    whole = stored(own.select(F.monotonically_increasing_id().alias("_r"), "vec_id", scaled(F.col("_e"), factor).alias("_v")), "vectors")
    square = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x.cast("double") * x)
    # The norms are doubles: a little is added for their rounding.
    n, norm = whole.agg(F.count("*"), F.sqrt(F.max(square("_v")))).first()
    queries = whole.where(is_query).select(F.col("_r").alias("_q"), F.col("vec_id").alias("query_id"), F.col("_v").alias("_qv"))
    most = F.ceil(F.least(F.lit(float(MOST)), F.sqrt(square("_qv")) * F.lit(norm or 0.0) * 1.000001 + 2.0))
    state = stored(queries.withColumn("_most", most).select("_q", (-F.col("_most")).alias("_low"), (2 * F.col("_most") + 1).alias("_span"), F.lit(0).cast("long").alias("_above"), F.lit(False).alias("_done")), "thresholds")
    blocks = (max(1, -(-state.count() // query_block)), max(1, -(-n // row_block)))
    while state.where("not _done").limit(1).count():
        open_ = queries.join(state.where("not _done").drop("_done"), "_q")
        counts = paired(open_, whole, blocks, histogram(k, bins), "_q bigint, bin bigint, n bigint").groupBy("_q", "bin").agg(F.sum("n").alias("n"))
        higher = F.sum("n").over(Window.partitionBy("_q").orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, -1))
        kth = counts.withColumn("higher", F.coalesce(higher, F.lit(0))).withColumn("last", F.row_number().over(Window.partitionBy("_q").orderBy("bin")) == 1)
        at = state.where("not _done").withColumn("_width", F.expr(f"(_span - 1) div {bins} + 1")).join(kth, "_q", "left")
        through = F.col("_above") + F.col("higher") + F.col("n")
        # The k-th lies in this bin; with fewer than k scores in all, the lowest score is the k-th.
        at = at.where(F.col("bin").isNull() | ((F.col("_above") + F.col("higher") < k) & ((through >= k) | F.col("last"))))
        start = F.coalesce("bin", F.lit(0)) * F.col("_width")
        at = at.select(
            "_q", (F.col("_low") + start).alias("_low"), F.least("_width", F.col("_span") - start).alias("_span"), (F.col("_above") + F.coalesce("higher", F.lit(0))).alias("_above"),
            (F.col("bin").isNull() | (through <= k) | (F.col("_width") == 1)).alias("_done"),
        )
        after = stored(state.where("_done").unionByName(at), "thresholds")
        discard(state)
        state = after
    found = paired(queries.join(state.select("_q", "_low"), "_q"), whole, blocks, survivors(k), f"_q bigint, query_id {whole.schema['vec_id'].dataType.simpleString()}, vec_id {whole.schema['vec_id'].dataType.simpleString()}, _r bigint, score bigint")
    best = Window.partitionBy("_q").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last(), "_r")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
