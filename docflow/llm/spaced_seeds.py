"""Benchmark decontamination by spaced-seed hashing.

A seed is a fixed mask over neighbouring words that ignores some places, so one
substituted word leaves most seeds around it whole. Seeds of the benchmark items
and of the documents are joined on their hash; each hit fixes a diagonal (document
place less item place), and on that diagonal the item is compared word by word.
A document holds an item when ``min_run`` of the item's words stand in a row on one hit
diagonal, or at least ``min_coverage`` of its words stand in order on hit diagonals that
lie within ``max_shift`` of each other, as they do where a few words were inserted or left
out. Pieces of an item that are far apart, or in another order, don't add up.

Masks depend on the item's length (``FAMILIES``). Wherever a fifth of an item's words
stand, at most, some seed of its family avoids them all, so at a coverage of 0.8 or more
on one diagonal no item of any length is missed; items under five words have to stand whole,
so their seed's hit is all there is to find and their words are not compared.

Before the join, documents test their seeds against a bitmap of all benchmark
seeds. It grows with them up to ``2 ** MAX_BITS`` bits (32 MB) and
has no false negatives; that bitmap alone is sent to the executors. Only documents
with a hit travel on, as word hashes. The joins are on hash, document row and item
row; AQE splits a passage that a third of all documents hold. Of a document only the
places where the item matches leave the join. Diagonals of one document and item meet
``STRETCH`` at a time, with those within ``max_shift`` of the border lent.

Words are lower-cased, split at white space, and stripped of punctuation at
their ends. Defined results: null and blank texts hold nothing; items without a word
match nothing; items that repeat are reported one by one;
rows that repeat are reported once each; an empty table gives an empty result.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, functions as F

from docflow.llm.arrow import lean, lists, slices
from docflow.llm.storage import stored
from docflow.llm.text import pick

#: Least number of an item's words, and the masks over neighbouring words for items from there on: 1 is read, 0 ignored.
#: They were found by search; the tests try all ways to change a fifth of the words.
FAMILIES = (
    (1, ("1",)), (2, ("11",)), (3, ("111",)), (4, ("1111",)),
    (5, ("1111", "11101", "11011", "10111")),
    (8, ("111111", "1111011", "1101111")),
    (10, ("111011", "11010011", "11111")),
    (15, ("1111011", "11001000111", "11010110001")),
    (20, ("1111011", "11001000111", "11010110001", "111111")),
    (21, ("1111011", "11001000111", "11010110001")),
)
MASKS = tuple(dict.fromkeys(m for _, family in FAMILIES for m in family))
#: Bits of the bitmap, and how many there are to a seed.
MIN_BITS, MAX_BITS, PER_SEED = 20, 28, 256
#: Neighbouring diagonals that meet, as a power of two, and words of the items that only their seed finds, at most.
STRETCH, SHORT = 10, 4
#: Characters of text encoded at a time; a longer text goes alone.
CHUNK = 1 << 22
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~¡¿«»‘’“”„…–—"
_ODD = np.random.default_rng(11).integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts, and the number of words of each."""
    found = pc.utf8_split_whitespace(pc.utf8_lower(pc.fill_null(texts, "")))
    coded = found.flatten().dictionary_encode()
    bare = pc.utf8_trim(coded.dictionary, characters=PUNCTUATION).to_pylist()
    table = np.array([xxhash.xxh64_intdigest(x) for x in bare], np.uint64)
    has_word = np.array([bool(x) for x in bare], bool)
    codes = coded.indices.to_numpy()
    owner = np.repeat(np.arange(len(texts)), np.diff(found.offsets.to_numpy()))
    kept = has_word[codes] if len(codes) else np.zeros(0, bool)
    return (table[codes[kept]] if len(codes) else np.zeros(0, np.uint64)), np.bincount(owner[kept], minlength=len(texts))


def seeds(words: np.ndarray, owner: np.ndarray, mask: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of one mask's seeds that stay within a text."""
    shape = MASKS[mask]
    n = len(words) - len(shape) + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = np.full(n, _ODD[mask], np.uint64)
    for k, read in enumerate(shape):
        if read == "1":
            h += words[k : k + n] * _ODD[20 + 13 * mask % 32 + k]
    h ^= h >> np.uint64(29)
    h *= _ODD[19]
    at = np.flatnonzero(owner[:n] == owner[len(shape) - 1 :])
    return at, h[at]


def _slots(h: np.ndarray, bits: int, which: int) -> np.ndarray:
    """One of a seed's three slots."""
    if which == 0:
        return h >> np.uint64(64 - bits)
    return ((h >> np.uint64(8)) if which == 1 else (h >> np.uint64(33)) ^ h) & np.uint64((1 << bits) - 1)


def item_words(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``_row, _item, _iw`` (word hashes) of the items with a word."""
    own = pick(items, _item=id_col, _text=text_col).select(F.monotonically_increasing_id().alias("_row"), F.col("_item"), F.col("_text"))

    def run(batches):
        for batch in batches:
            words, counts = word_hashes(batch.column(2))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists(pa.array(words.view(np.int64)), counts)], ["_row", "_item", "_iw"])

    return own.mapInArrow(lean(run), f"_row bigint, _item {own.schema['_item'].dataType.simpleString()}, _iw array<bigint>").where(F.size("_iw") > 0)


def item_seeds(items: DataFrame) -> DataFrame:
    """``_h, _row, _ip``: hash, item row and place, by the masks for the item's length."""
    least = np.array([n for n, _ in FAMILIES])
    uses = np.array([[m in family for m in MASKS] for _, family in FAMILIES])

    def run(batches):
        for batch in batches:
            found = batch.column(1)
            counts = np.diff(found.offsets.to_numpy())
            words, owner = found.flatten().to_numpy(zero_copy_only=False).view(np.uint64), np.repeat(np.arange(len(counts)), counts)
            starts, rows = np.cumsum(counts) - counts, batch.column(0).to_numpy()
            for mask in range(len(MASKS)):
                at, h = seeds(words, owner, mask)
                use = uses[np.searchsorted(least, counts[owner[at]], "right") - 1, mask]
                at, h = at[use], h[use]
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(rows[owner[at]]), pa.array((at - starts[owner[at]]).astype(np.int32)), pa.array(np.full(len(at), mask, np.int32))], ["_h", "_row", "_ip", "_mask"])

    return items.select("_row", "_iw").mapInArrow(lean(run), "_h bigint, _row bigint, _ip int, _mask int")


def seed_bitmap(found: DataFrame) -> tuple[np.ndarray, int, list[int]]:
    """The bitmap over all item seeds, its size as a power of two, and the masks in use. At most 2**(MAX_BITS - 6) rows reach the driver."""
    masks = {r["_mask"]: r["n"] for r in found.groupBy("_mask").agg(F.count("*").alias("n")).collect()}
    bits = min(max(MIN_BITS, (PER_SEED * sum(masks.values())).bit_length()), MAX_BITS)
    low = F.lit((1 << bits) - 1)
    slot = F.explode(F.array(F.shiftrightunsigned("_h", 64 - bits), F.shiftrightunsigned("_h", 8).bitwiseAND(low), F.shiftrightunsigned("_h", 33).bitwiseXOR(F.col("_h")).bitwiseAND(low)))
    parts = found.select(slot.alias("s")).groupBy(F.shiftright("s", 6).alias("k")).agg(F.expr("bit_or(shiftleft(1L, cast(s & 63 as int)))").alias("v")).toArrow()
    words = np.zeros(1 << bits >> 6, np.int64)
    words[parts["k"].to_numpy()] = parts["v"].to_numpy()
    return words.view(np.uint8), bits, sorted(masks) or [0]


def document_hits(docs: DataFrame, id_col: str, text_col: str, bitmap: np.ndarray, size: int, masks: list[int]) -> DataFrame:
    """``_doc, _id, _w, _h, _p`` of the documents with a seed in the bitmap: word hashes, seed hashes and their places."""
    own = pick(docs, _id=id_col, _text=text_col).select(F.monotonically_increasing_id().alias("_doc"), "_id", "_text")
    sent = docs.sparkSession.sparkContext.broadcast(bitmap)

    def run(batches):
        bits = sent.value
        for batch in batches:
            texts = batch.column(2)
            for lo, hi in slices(texts, CHUNK):
                words, counts = word_hashes(texts.slice(lo, hi - lo))
                owner, starts = np.repeat(np.arange(hi - lo), counts), np.cumsum(counts) - counts
                at, hashes = [], []
                for mask in masks:
                    a, h = seeds(words, owner, mask)
                    for which in (0, 1, 2):
                        slot = _slots(h, size, which)
                        on = (bits[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 == 1
                        a, h = a[on], h[on]
                    at.append(a)
                    hashes.append(h)
                at, hashes = np.concatenate(at), np.concatenate(hashes)
                if not len(at):
                    continue
                order = np.argsort(at, kind="stable")
                at, hashes = at[order], hashes[order]
                hit, sizes = np.unique(owner[at], return_counts=True)
                kept = np.isin(owner, hit)
                took = pa.array(hit + lo)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(took), batch.column(1).take(took), lists(pa.array(words[kept].view(np.int64)), counts[hit]), lists(pa.array(hashes.view(np.int64)), sizes), lists(pa.array((at - starts[owner[at]]).astype(np.int32)), sizes)],
                    ["_doc", "_id", "_w", "_h", "_p"],
                )

    return own.mapInArrow(lean(run), f"_doc bigint, _id {own.schema['_id'].dataType.simpleString()}, _w array<bigint>, _h array<bigint>, _p array<int>")


def in_order(pairs: list[tuple[int, int]]) -> int:
    """The longest chain of (item place, document place) that rises in both."""
    ends: list[int] = []
    for _, place in sorted(pairs, key=lambda p: (p[0], -p[1])):
        at = bisect_left(ends, place)
        ends[at : at + 1] = [place]
    return len(ends)


def best_match(diagonals: list[tuple[int, np.ndarray]], n: int, max_shift: int) -> tuple[int, int]:
    """Most words of an item of ``n`` words in order on diagonals within ``max_shift``, and the longest run on one."""
    diagonals = sorted(diagonals, key=lambda d: d[0])
    best = max((len(at) for _, at in diagonals), default=0)
    run = 0
    for _, at in diagonals:
        edges = np.flatnonzero(np.diff(at) != 1)
        run = max(run, int(np.diff(np.concatenate(([-1], edges, [len(at) - 1]))).max()) if len(at) else 0)
    last = 0
    for first in range(len(diagonals)):
        while last < len(diagonals) and diagonals[last][0] - diagonals[first][0] <= max_shift:
            last += 1
        if best == n:
            break
        near = diagonals[first:last]
        if len(near) > 1 and min(n, sum(len(at) for _, at in near)) > best:
            best = max(best, in_order([(int(m), int(m) + off) for off, at in near for m in at]))
    return best, run


def _compared(each: DataFrame, max_shift: int) -> DataFrame:
    """``_doc, _row, _id, _item, _n, _k, _run``: what each stretch of diagonals (``_d``: places by diagonal) makes of an item."""

    def run(batches):
        for batch in batches:
            names = batch.schema.names
            found = [best_match([(d["_off"], np.array(d["_at"], np.int64)) for d in row], n, max_shift) for n, row in zip(batch.column(names.index("_n")).to_pylist(), batch.column(names.index("_d")).to_pylist(), strict=True)]
            kept = [batch.column(names.index(c)) for c in ("_doc", "_row", "_id", "_item", "_n")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array([k for k, _ in found], pa.int32()), pa.array([r for _, r in found], pa.int32())], ["_doc", "_row", "_id", "_item", "_n", "_k", "_run"])

    kind = lambda c: each.schema[c].dataType.simpleString()
    return each.mapInArrow(lean(run), f"_doc bigint, _row bigint, _id {kind('_id')}, _item {kind('_item')}, _n int, _k int, _run int")


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", min_coverage: float = 0.8, min_run: int = 13, max_shift: int = 8) -> DataFrame:
    """``id_col, item_col, item_words, matched_words, longest_run, coverage`` for every document and item it holds."""
    own = stored(item_words(items, item_col, item_text_col), "items")
    found = stored(item_seeds(own), "seeds")
    hits = stored(document_hits(docs, id_col, text_col, *seed_bitmap(found)), "hits")
    each = hits.select("_doc", F.explode(F.arrays_zip("_h", "_p")).alias("x")).select("_doc", "x._h", "x._p")
    sized = own.select("_row", F.size("_iw").alias("_n"))
    diagonals = each.join(found.join(sized, "_row").select("_h", "_row", "_ip", "_n"), "_h").select("_doc", "_row", "_n", F.when(F.col("_n") > SHORT, F.col("_p") - F.col("_ip")).alias("_off")).distinct()
    names = own.select("_row", "_item")
    short = diagonals.where(F.col("_n") <= SHORT).join(names, "_row").join(hits.select("_doc", "_id"), "_doc").select("_doc", "_row", "_id", "_item", "_n", F.col("_n").alias("_k"), F.col("_n").alias("_run"))
    place = F.filter(F.sequence(F.lit(0), F.size("_iw") - 1), lambda p: F.get("_w", p + F.col("_off")) == F.get("_iw", p))
    places = diagonals.where(F.col("_n") > SHORT).join(own, "_row").join(hits.select("_doc", "_id", "_w"), "_doc").select("_doc", "_row", "_id", "_item", "_n", "_off", place.alias("_at"))
    stretch = F.explode(F.array_distinct(F.array(F.shiftright("_off", STRETCH), F.shiftright(F.col("_off") - max_shift, STRETCH))))
    met = places.withColumn("_s", stretch).groupBy("_doc", "_row", "_s").agg(F.first("_id").alias("_id"), F.first("_item").alias("_item"), F.first("_n").alias("_n"), F.sum(F.size("_at")).alias("_sum"), F.collect_list(F.struct("_off", "_at")).alias("_d"))
    met = met.where((F.col("_sum") >= min_coverage * F.col("_n")) | (F.col("_sum") >= min_run))
    matched = _compared(met.select("_doc", "_row", "_id", "_item", "_n", "_d"), max_shift).unionByName(short)
    matched = matched.groupBy("_doc", "_row").agg(*[F.first(c).alias(c) for c in ("_id", "_item", "_n")], F.max("_k").alias("_k"), F.max("_run").alias("_run"))
    share = F.col("_k") / F.col("_n")
    return matched.where((share >= min_coverage) | (F.col("_run") >= min_run)).select(F.col("_id").alias(id_col), F.col("_item").alias(item_col), F.col("_n").cast("long").alias("item_words"), F.col("_k").cast("long").alias("matched_words"), F.col("_run").cast("long").alias("longest_run"), share.alias("coverage"))
