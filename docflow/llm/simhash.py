"""SimHash near-duplicates through a Gray-order hierarchical index.

1. Fingerprints: 64 majority bits over the XXH64 of a text's word shingles, in
   Arrow batches, long texts in blocks.
2. What is equal collapses to one node (with its smallest id) before anything is
   compared, so groups of copies cost one row.
3. Dealing out: two fingerprints that differ in at most d bits agree on r of d + r
   bit blocks, so each goes under the value of every r blocks. Each pair within d
   bits meets at least once. r grows with the number of nodes, so that a value is
   expected to have no more than ``group`` of them: more rows, but no larger trees. With ``fit`` only as many
   bits of a block are its value as that takes, so values keep trees of about ``group`` nodes at every
   size, and the index parts the fingerprints. It moves work only and loses no pair.
4. Index: rows are range-partitioned by (value, Gray rank), so a value with many
   fingerprints lies in many tasks. Every run of one value, ``block`` rows at most, is a
   tree of ``gray_index``, which searches it. Trees of one value in different
   runs meet by their roots first: pairs of roots that differ in too many shared bits go, the
   others are searched against each other.
5. Each tree gives a spanning set of links, never all pairs; components follow.

With ``shingle_width`` nodes are texts (equal but for case and white space) and a link
also needs the given Jaccard similarity of their sets of shingles. The index then asks
for a sketch of these sets as well (256 MinHash bits, a limit that a pair of that
similarity misses once in 250 times), keeps the most similar links first, and its links are verified
on the sets themselves: a row a link, never one a pair. A link that fails is
dropped; where it alone joined two parts of a value's tree, they stay apart.

Defined results: null and blank texts have fingerprint zero and link like any
other (as texts they equal each other); a null id never names a component unless
nothing else is in it; repeated rows stay repeated; an empty table gives an empty
result; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Accumulator, TaskContext
from pyspark.sql import Column, DataFrame, functions as F, types as T

from docflow.llm.arrow import lean
from docflow.llm.components import components
from docflow.llm.gray_index import Forest, Search
from docflow.llm.shingles import SKETCH_WORDS, agreement, sets_of, shingle_set, similar, sketch, word_list
from docflow.llm.storage import stored
from docflow.llm.text import pick

SEED = 42
#: Shingles hashed at a time; bounds the memory of a long text.
BLOCK_SHINGLES = 1 << 16
#: Nodes that a value of the dealing is expected to have at most, fingerprints of a tree, and rows searched at a time.
GROUP, BLOCK, CHUNK = 1024, 8192, 1 << 15
_SKETCH = [f"_k{k}" for k in range(SKETCH_WORDS)]


def simhash(words: list[bytes], width: int, seed: int = SEED) -> int:
    """Unsigned fingerprint of a list of words."""
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    first, last = (starts[: len(words) - width + 1], ends[width - 1 :]) if len(words) >= width else (starts[:1], ends[-1:])
    digest, counts = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for k in range(0, len(first), BLOCK_SHINGLES):
        spans = zip(first[k : k + BLOCK_SHINGLES].tolist(), last[k : k + BLOCK_SHINGLES].tolist(), strict=True)
        hashes = np.array([digest(joined[s:e], seed) for s, e in spans], ">u8")
        counts += np.unpackbits(hashes.view(np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.uint32)
    return int.from_bytes(np.packbits(2 * counts > len(first)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, shingle_width: int | None = None, seeds: tuple[int, ...] = (SEED,)) -> DataFrame:
    """``_id, _th, _node, _fp0, ...`` (signed longs) of every row, and ``_k0, ...`` with the sketch of its shingles if asked; ``_th`` is the hash of the raw text."""
    own = pick(docs, _id=id_col, _text=text_col).select("_id", F.xxhash64("_text").alias("_th"), "_text")
    names = ["_node", *(f"_fp{k}" for k in range(len(seeds))), *(_SKETCH if shingle_width else [])]

    def run(batches):
        for batch in batches:
            out = np.empty((len(batch), len(names)), np.uint64)
            for k, text in enumerate(batch.column(2).to_pylist()):
                words = word_list(text)
                out[k, 1 : 1 + len(seeds)] = [simhash(words, width, seed) for seed in seeds]
                out[k, 0] = out[k, 1]
                if shingle_width:
                    out[k, 0] = xxhash.xxh64_intdigest(b" ".join(words), SEED)
                    out[k, 1 + len(seeds) :] = sketch(shingle_set(words, shingle_width))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(np.ascontiguousarray(out[:, k]).view(np.int64)) for k in range(len(names)))], ["_id", "_th", *names])

    return own.mapInArrow(lean(run), T.StructType([own.schema["_id"], *(T.StructField(n, T.LongType()) for n in ("_th", *names))]))


def gray_rank(fp: Column) -> Column:
    """Place of a fingerprint in the Gray sequence, ordered as a signed long."""
    for shift in (1, 2, 4, 8, 16, 32):
        fp = fp.bitwiseXOR(F.shiftrightunsigned(fp, shift))
    return fp.bitwiseXOR(F.lit(-(1 << 63)))


def block_masks(bits: int, agree: int, width: int = 64) -> list[int]:
    """Masks over the first ``width`` bits of each of ``agree`` of ``bits + agree`` blocks of the 64 bits, as signed longs."""
    n = bits + agree
    edges = [64 * k // n for k in range(n + 1)]
    blocks = [(1 << hi) - (1 << max(lo, hi - width)) for lo, hi in zip(edges, edges[1:], strict=False)]
    return [m - (1 << 64) if m >> 63 else m for m in dict.fromkeys(sum(x) for x in combinations(blocks, agree))]


def blocks_to_agree(nodes: int, bits: int, group: int = GROUP) -> int:
    """How many blocks a value of the dealing takes, so that it is expected to have at most ``group`` nodes."""
    agree = 1
    while nodes > group * 2 ** (64 * agree / (bits + agree)) and agree < 4:
        agree += 1
    return agree


def bits_to_agree(nodes: int, agree: int, group: int) -> int:
    """How many bits of each block that takes: none while all nodes fit one tree."""
    return -(-(-(-max(nodes, 1) // group) - 1).bit_length() // agree)


def _unsigned(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).view(np.uint64)


def _search(trees: np.ndarray, fps: np.ndarray, sketches: np.ndarray | None, bits: int, agree: int, paired: bool, pruned: list[Accumulator] | None) -> tuple[np.ndarray, np.ndarray]:
    """Links in every tree, or between every two trees that follow each other."""
    forest = Forest(trees, fps)
    roots = np.arange(len(forest.ones[-1]))
    search = Search(forest, bits, sketches, agree)
    found = search.run(roots[::2], roots[1::2]) if paired else search.run(roots, roots)
    for counter, n in zip(pruned or [], search.pruned, strict=False):
        counter.add(n)
    return found


def tree_links(keyed: DataFrame, bits: int, block: int, agree: int, pruned: list[Accumulator] | None = None) -> DataFrame:
    """Links ``a, b`` within each tree of the sorted ``_g, _fp, _node, ...``, and the rows of values that other trees may share.

    The latter have ``_t``, the number of their tree: values above ``block`` rows, and the first and the last value of a partition.
    """
    names = keyed.columns

    def run(batches):
        part, serial = TaskContext.get().partitionId() << 32, 0
        kept, first, cut = None, None, None

        def out(rows: np.ndarray, last: bool):
            """Trees of whole values, but for one that was cut before or is cut now."""
            nonlocal serial, cut
            if not len(rows):
                return
            g = rows[:, 0]
            starts = np.flatnonzero(np.concatenate(([True], g[1:] != g[:-1])))
            sizes = np.diff(np.append(starts, len(g)))
            place = np.arange(len(g)) - np.repeat(starts, sizes)
            tree = np.cumsum((place % block == 0).astype(np.int64)) - 1
            shared = np.repeat((sizes > block) | (g[starts] == first) | (False if cut is None else g[starts] == cut), sizes)
            if last:
                shared |= g == g[-1]
            used = np.repeat(sizes > 1, sizes)
            sketches = rows[:, 3:] if rows.shape[1] > 3 else None
            if used.any():
                a, b = _search(tree[used], rows[used, 1], None if sketches is None else sketches[used], bits, agree, False, pruned)
                if len(a):
                    node = rows[used, 2]
                    yield batch_of([None] * (len(names) + 1) + [node[a], node[b]], len(a))
            if shared.any():
                yield batch_of([*rows[shared].T, (tree[shared] + part + serial).astype(np.uint64), None, None], int(shared.sum()))
            serial += int(tree[-1]) + 1

        def batch_of(columns, n):
            return pa.RecordBatch.from_arrays([pa.nulls(n, pa.int64()) if c is None else pa.array(np.ascontiguousarray(c).view(np.int64)) for c in columns], [*names, "_t", "a", "b"])

        for batch in batches:
            rows = np.column_stack([_unsigned(c) for c in batch.columns])
            rows = rows if kept is None else np.concatenate((kept, rows))
            kept = rows
            if not len(rows):
                continue
            first = rows[0, 0] if first is None else first
            if len(rows) < CHUNK:
                continue
            edges = np.flatnonzero(rows[1:, 0] != rows[:-1, 0]) + 1
            # Up to the last border of a value; a value that fills the chunk is cut after whole trees, and one row at least stays.
            end = int(edges[-1]) if len(edges) else (len(rows) - 1) // block * block
            whole = bool(len(edges))
            if not end:
                continue
            if not whole:
                cut = rows[0, 0]
            yield from out(rows[:end], False)
            kept = rows[end:]
        if kept is not None:
            yield from out(kept, True)

    return keyed.mapInArrow(lean(run), ", ".join(f"{n} bigint" for n in (*names, "_t", "a", "b")))


def cross_links(shared: DataFrame, bits: int, agree: int, pruned: list[Accumulator] | None = None) -> DataFrame:
    """Links between the trees ``_t`` of one value ``_g`` whose roots don't rule them out."""
    roots = shared.groupBy("_g", "_t").agg(F.bit_and("_fp").alias("_and"), F.bit_or("_fp").alias("_or"))
    roots = roots.select("_g", "_t", F.col("_and").alias("_ones"), F.bitwise_not(F.col("_and").bitwiseXOR(F.col("_or"))).alias("_same"))
    x, y = roots.toDF("_g", "_t0", "_o0", "_s0"), roots.toDF("_g", "_t1", "_o1", "_s1")
    differ = F.bit_count(F.col("_o0").bitwiseXOR(F.col("_o1")).bitwiseAND(F.col("_s0")).bitwiseAND(F.col("_s1")))
    pairs = x.join(y, "_g").where((F.col("_t0") < F.col("_t1")) & (differ <= bits)).select("_t0", "_t1", F.explode(F.array("_t0", "_t1")).alias("_t"))
    rest = [c for c in shared.columns if c not in ("_g", "_t")]
    rows = pairs.join(shared.select("_t", *rest), "_t").withColumn("_r", gray_rank(F.col("_fp"))).repartition("_t0", "_t1").sortWithinPartitions("_t0", "_t1", "_t", "_r", "_node")

    def run(batches):
        kept = None
        for batch in batches:
            rows = np.column_stack([_unsigned(c) for c in batch.columns])
            rows = rows if kept is None else np.concatenate((kept, rows))
            edges = np.flatnonzero((rows[1:, :2] != rows[:-1, :2]).any(axis=1)) + 1
            end = int(edges[-1]) if len(edges) else 0
            kept = rows[end:]
            yield from out(rows[:end])
        if kept is not None:
            yield from out(kept)

    def out(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        if len(rows):
            tree = np.cumsum(np.concatenate(([0], (rows[1:, :3] != rows[:-1, :3]).any(axis=1).astype(np.int64))))
            a, b = _search(tree, rows[:, 3], rows[:, 5:] if rows.shape[1] > 5 else None, bits, agree, True, pruned)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(rows[x, 4]).view(np.int64)) for x in (a, b)], ["a", "b"])

    return rows.select("_t0", "_t1", "_t", *rest).mapInArrow(lean(run), "a bigint, b bigint")


def links(nodes: DataFrame, bits: int = 4, block: int = BLOCK, agree: int = 0, group: int = GROUP, fit: bool = False, pruned: list[Accumulator] | None = None) -> DataFrame:
    """Spanning links ``a, b`` among the distinct ``_node`` with their fingerprints ``_fp0, ...`` and, if any, sketch columns.

    ``_g`` numbers a value by hash; a clash only puts two values together, and
    every link is verified on the fingerprints themselves. With ``fit`` a
    partition gets the rows of about one tree.
    """
    n = nodes.count()
    dealt = blocks_to_agree(n, bits, group)
    masks = block_masks(bits, dealt, bits_to_agree(n, dealt, group) if fit else 64)
    prints = [c for c in nodes.columns if c.startswith("_fp")]
    under = [F.struct(F.xxhash64(F.lit(p), F.lit(k), F.col(p).bitwiseAND(F.lit(m))).alias("g"), F.col(p).alias("f")) for p in prints for k, m in enumerate(masks)]
    rest = [c for c in nodes.columns if c != "_node" and c not in prints]
    keyed = nodes.select("_node", *rest, F.explode(F.array(*under)).alias("m")).select(F.col("m.g").alias("_g"), F.col("m.f").alias("_fp"), "_node", *rest).withColumn("_r", gray_rank(F.col("_fp")))
    by = ("_g", "_r", "_node")
    ranged = keyed.repartitionByRange(-(-max(n, 1) * len(prints) * len(masks) // group), *by) if fit else keyed.repartitionByRange(*by)
    ordered = ranged.sortWithinPartitions("_g", "_r", "_node").drop("_r")
    found = stored(tree_links(ordered, bits, block, agree, pruned), "tree-links")
    across = cross_links(found.where("_t is not null").drop("a", "b"), bits, agree, pruned)
    return found.where("a is not null").select("a", "b").unionByName(across).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def verified(found: DataFrame, nodes: DataFrame, docs: DataFrame, shingle_width: int, similarity: tuple[int, int]) -> DataFrame:
    """The links whose texts are as similar as asked; ``nodes`` has ``_node, _first`` (id and raw text hash of one row)."""
    needed = found.select(F.explode(F.array("a", "b")).alias("_node")).distinct()
    rows = nodes.join(needed, "_node", "left_semi").select("_node", "_first")
    at = (docs["_id"].eqNullSafe(F.col("_first._id"))) & (docs["_th"] == F.col("_first._th"))
    # Rows that repeat give their set again; one is kept.
    sets = stored(sets_of(docs.join(rows, at).select("_node", "_text"), shingle_width).dropDuplicates(["_node"]), "sets")
    return similar(found, sets, similarity)


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, bits: int = 4, block: int = BLOCK, shingle_width: int | None = None, similarity: tuple[int, int] = (4, 5), seeds: tuple[int, ...] = (SEED,), group: int = GROUP, fit: bool = False, pruned: list[Accumulator] | None = None
) -> DataFrame:
    """``id_col, fingerprint, component_id`` for every row (see the module's docstring).

    ``width`` words make a shingle of the fingerprint; of several ``seeds`` each gives a fingerprint, and a pair needs one of them
    within ``bits``. The first is returned. With ``shingle_width`` links need a similarity (a fraction) of shingles of that many words as well. ``group`` and ``fit``
    rule the dealing. ``pruned``, accumulators by level of the trees, leaf nodes first, count the node pairs that the index cut off.
    """
    prints = stored(fingerprints(docs, id_col, text_col, width, shingle_width, seeds), "fingerprints")
    own = [F.first(c).alias(c) for c in prints.columns if c not in ("_id", "_th", "_node")]
    nodes = stored(prints.groupBy("_node").agg(*own, F.min("_id").alias("_least"), F.first(F.struct("_id", "_th")).alias("_first")), "nodes")
    found = links(nodes.drop("_least", "_first"), bits, block, agreement(similarity[0] / similarity[1]) if shingle_width else 0, group, fit, pruned)
    if shingle_width:
        raw = pick(docs, _id=id_col, _text=text_col).withColumn("_th", F.xxhash64("_text"))
        found = verified(stored(found, "found"), nodes, raw, shingle_width, similarity)
    roots = components(found, "a", "b")
    classes = nodes.join(roots, nodes["_node"] == roots["node"], "left").select("_node", "_least", F.coalesce("root", "_node").alias("_root"))
    names = classes.groupBy("_root").agg(F.min("_least").alias("_component"))
    # Under the complement the names are dealt out anew, so AQE can split the join at a large component.
    around = names.select(F.bitwise_not("_root").alias("_k"), "_component")
    named = classes.withColumn("_k", F.bitwise_not("_root")).join(around, "_k").select("_node", "_component")
    return prints.join(named, "_node").select(F.col("_id").alias(id_col), F.lower(F.lpad(F.hex("_fp0"), 16, "0")).alias("fingerprint"), F.col("_component").alias("component_id"))
