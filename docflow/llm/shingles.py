"""Sets of word shingles: similarity sketches and the exact check of a pair.

Words are lower-cased (A-Z) and split at U+0020 and U+0009 to U+000D; a text with
fewer words than a shingle has one, all its words; null and blank texts have none.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from docflow.llm.arrow import lean

#: 64-bit words of a sketch, and shingles hashed at a time.
SKETCH_WORDS, BLOCK = 4, 1 << 12
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_ODD = np.random.default_rng(17).integers(1, 1 << 63, 64 * SKETCH_WORDS + 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def word_list(text: str | None) -> list[bytes]:
    """Words of a text; bytes.split() splits at the contract's white space only."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()


def shingle_set(words: list[bytes], width: int) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles."""
    if not words:
        return np.zeros(0, np.uint64)
    table = {w: xxhash.xxh64_intdigest(w) for w in set(words)}
    w = np.fromiter((table[x] for x in words), np.uint64, len(words))
    width = min(width, len(w))
    n = len(w) - width + 1
    h = np.zeros(n, np.uint64)
    for k in range(width):
        h = (h ^ w[k : k + n]) * _ODD[k % 16]
        h ^= h >> np.uint64(31)
    return np.unique(h)


def sketch(shingles: np.ndarray) -> np.ndarray:
    """One bit of each of the set's MinHashes, as 64-bit words: two sets agree in a share of (1 + J) / 2 of them."""
    least = np.full(64 * SKETCH_WORDS, np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(shingles), BLOCK):
        np.minimum(least, (shingles[None, k : k + BLOCK] * _ODD[16:, None]).min(axis=1), out=least)
    return np.packbits((least >> np.uint64(20)).astype(np.uint8) & 1).view(np.uint64)


def agreement(similarity: float) -> int:
    """Equal sketch bits that a pair of the given similarity has but once in 250 times (2.7 standard deviations below the mean)."""
    n, p = 64 * SKETCH_WORDS, (1 + similarity) / 2
    return int(n * p - 2.7 * (n * p * (1 - p)) ** 0.5)


def sets_of(texts: DataFrame, width: int) -> DataFrame:
    """``_node, _set`` of every row of ``_node, _text``."""

    def run(batches):
        for batch in batches:
            found = [shingle_set(word_list(t), width).view(np.int64) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int64()))], ["_node", "_set"])

    return texts.select("_node", "_text").mapInArrow(lean(run), T.StructType([texts.schema["_node"], T.StructField("_set", T.ArrayType(T.LongType()))]))


def similar(pairs: DataFrame, sets: DataFrame, similarity: tuple[int, int]) -> DataFrame:
    """The pairs ``a, b`` whose sets have a Jaccard similarity of the given fraction or more."""
    one, other = sets.select(F.col("_node").alias("a"), F.col("_set").alias("x")), sets.select(F.col("_node").alias("b"), F.col("_set").alias("y"))
    shared, both = F.size(F.array_intersect("x", "y")), F.size("x") + F.size("y")
    least, of = similarity
    return pairs.join(one, "a").join(other, "b").where((least + of) * shared >= least * both).select("a", "b")
