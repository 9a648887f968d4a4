"""Quality classifier: random-indexing word vectors pooled per document, and a two-layer network in numpy.

Word vectors: every word has a fixed sparse random index vector. Its context vector is
the sum of the index vectors of the words up to ``WINDOW`` places before and after
it, over all documents; less what words have in common (the mean over all places) and at length one it is the
word's vector. Words share ``SLOTS`` slots by hash, so the table has a fixed size however large
the vocabulary. A document's pooled vector is the mean over its words.

The index vectors of the document's own words, of its three-word phrases and of its lines are summed as well;
only the length of those sums is kept, which tells how often a document repeats itself (n
different phrases give a sum of squared length n, repeated ones a longer one).
The share of neighbouring words that are equal and the number of words join them. ``extra=False`` leaves these five out.

Network: standardised inputs, one hidden layer, one output, fitted with Adam; the
logits are divided by a temperature fitted on labelled rows that the fit has not
seen, so scores are calibrated probabilities.

Scale: a first pass sums context vectors in every task and sends one row for each slot in use on, of whole numbers, so
sums don't depend on the order; a second pass writes one short vector a document. The fit reads a
bounded sample of labelled rows (``max_rows``), everything else covers all rows.
Only the table (``SLOTS`` rows), the sample and the weights pass through the driver.

Defined results: null and blank texts have a vector of zeros and are scored like
any other; rows that repeat are scored each; a null id is never held out and has no
label; of repeated labels the largest counts. Without labels of both kinds
every score is the share of label 1, or 0.5 where there are none. An empty table
gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, functions as F

from docflow.llm.arrow import lean, slices
from docflow.llm.storage import stored
from docflow.llm.text import pick

#: Size of word vectors, non-zero places of an index vector, slots of words, neighbours on each side, size of the sums for repetition, and their number.
SIZE, PLACES, SLOTS, WINDOW, SKETCH, EXTRA = 128, 2, 1 << 15, 2, 512, 5
#: Bytes of text at a time, words whose vectors are pooled at a time, and rows of a batch of sums.
CHUNK, POOLED, ROWS = 1 << 21, 1 << 15, 1 << 10
MIX = np.uint64(0x9E3779B97F4A7C15)


#: Bound of the standardised inputs, and the weight of the inputs beside the pooled vector.
LIMIT = 4.0
_WEIGHT = np.concatenate((np.full(SIZE, 0.5), np.full(EXTRA, 2.0)))


def _index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the slots' index vectors."""
    rng = np.random.default_rng(17)
    return rng.integers(0, SIZE, (SLOTS, PLACES)), rng.choice(np.array([-1, 1], np.int32), (SLOTS, PLACES))


_PLACE, _SIGN = _index_vectors()


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * MIX
    return h ^ (h >> np.uint64(29))


def _hashes(strings: pa.Array) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(x) for x in strings.to_pylist()], np.uint64)


def _slots(hashes: np.ndarray) -> np.ndarray:
    return (hashes % np.uint64(SLOTS)).astype(np.int64)


def add_contexts(sums: np.ndarray, counts: np.ndarray, texts: pa.Array) -> None:
    """Add the index vectors around every word of the texts to the sums of the word's slot."""
    owner, codes, words = _split(pc.fill_null(texts, ""), False)
    if not len(codes):
        return
    slot = _slots(_hashes(words))[codes]
    counts += np.bincount(slot, minlength=SLOTS)
    flat = sums.reshape(-1)
    for away in range(1, WINDOW + 1):
        at = np.flatnonzero(owner[:-away] == owner[away:])
        for word, near in ((slot[at], slot[at + away]), (slot[at + away], slot[at])):
            for k in range(PLACES):
                np.add.at(flat, word * SIZE + _PLACE[near, k], _SIGN[near, k])


def context_sums(docs: DataFrame, text_col: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """Sums of context vectors by slot over all documents, and how many words stand in each slot."""

    def rows(sums: np.ndarray, counts: np.ndarray):
        used = np.flatnonzero(counts)
        for k in range(0, len(used), ROWS):
            at = used[k : k + ROWS]
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(counts[at]), pa.array([x.tobytes() for x in sums[at]], pa.binary())], ["slot", "n", "sums"])

    def summed(batches):
        sums, counts = np.zeros((SLOTS, SIZE), np.int32), np.zeros(SLOTS, np.int64)
        for batch in batches:
            for lo, hi in slices(batch.column(0), CHUNK):
                add_contexts(sums, counts, batch.column(0).slice(lo, hi - lo))
        yield from rows(sums, counts)

    def merged(batches):
        total, counts = {}, {}
        for batch in batches:
            for slot, n, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                total[slot] = total.get(slot, 0) + np.frombuffer(value, np.int32).astype(np.int64)
                counts[slot] = counts.get(slot, 0) + n
        at = sorted(total)
        for k in range(0, len(at), ROWS):
            part = at[k : k + ROWS]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array([counts[x] for x in part], pa.int64()), pa.array([total[x].tobytes() for x in part], pa.binary())], ["slot", "n", "sums"])

    schema = "slot int, n bigint, sums binary"
    parts = pick(docs, _text=text_col).mapInArrow(lean(summed), schema)
    found = parts.repartition("slot").mapInArrow(lean(merged), schema).toArrow()
    sums, counts = np.zeros((SLOTS, SIZE), np.float64), np.zeros(SLOTS, np.int64)
    slot = found["slot"].to_numpy()
    counts[slot] = found["n"].to_numpy()
    if len(slot):
        sums[slot] = np.frombuffer(b"".join(found["sums"].to_pylist()), np.int64).reshape(-1, SIZE)
    return sums, counts


def word_table(sums: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A vector of length one for every slot in use: its mean context, less the mean over all places."""
    mean = sums / np.maximum(counts, 1)[:, None] - sums.sum(axis=0) / max(int(counts.sum()), 1)
    mean[counts == 0] = 0
    return (mean / np.maximum(np.linalg.norm(mean, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def _repeats(owner: np.ndarray, hashes: np.ndarray, n: int) -> np.ndarray:
    """Mean multiplicity of each document's items, from the length of the sum of their index vectors."""
    mixed = _mixed(hashes)
    sign = np.where(mixed & np.uint64(1), 1.0, -1.0)
    sums = np.bincount(owner * SKETCH + (mixed >> np.uint64(40)).astype(np.int64) % SKETCH, weights=sign, minlength=n * SKETCH).reshape(n, SKETCH)
    return (sums**2).sum(axis=1) / np.maximum(np.bincount(owner, minlength=n), 1)


def _split(texts: pa.Array, lines: bool) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    found = pc.split_pattern(texts, "\n") if lines else pc.ascii_split_whitespace(texts)
    coded = found.flatten().dictionary_encode()
    codes, owner = coded.indices.to_numpy().astype(np.int64), np.repeat(np.arange(len(texts)), np.diff(found.offsets.to_numpy()))
    kept = (pc.binary_length(coded.dictionary).to_numpy(zero_copy_only=False) > 0)[codes] if len(codes) else np.zeros(0, bool)
    return owner[kept], codes[kept], coded.dictionary


def features(texts: pa.Array, table: np.ndarray) -> np.ndarray:
    """Pooled vectors of a batch of texts, ``SIZE + EXTRA`` numbers each."""
    texts, n = pc.fill_null(texts, ""), len(texts)
    owner, codes, words = _split(texts, False)
    hashes = _hashes(words)
    vectors = table[_slots(hashes)]
    out = np.zeros((n, SIZE + EXTRA), np.float32)
    count = np.bincount(owner, minlength=n)
    pooled, begin = np.zeros((n, SIZE)), np.cumsum(count) - count
    for k in np.flatnonzero(count).tolist():
        # Text by text, in blocks from its own start, so the sum depends on nothing else in the batch.
        for at in range(begin[k], begin[k] + count[k], POOLED):
            pooled[k] += vectors[codes[at : min(at + POOLED, begin[k] + count[k])]].sum(axis=0, dtype=np.float64)
    out[:, :SIZE] = pooled / np.maximum(count, 1)[:, None]
    h = hashes[codes] if len(codes) else np.zeros(0, np.uint64)
    whole = np.flatnonzero(owner[:-2] == owner[2:]) if len(owner) > 2 else np.zeros(0, np.int64)
    with np.errstate(over="ignore"):
        phrases = h[whole] * np.uint64(3) + h[whole + 1] * np.uint64(0x100000001B3) + h[whole + 2] * MIX if len(whole) else np.zeros(0, np.uint64)
    line_owner, line_codes, lines = _split(texts, True)
    line_hashes = _hashes(lines)
    for k, (own, items) in enumerate(((owner, h), (owner[whole], phrases), (line_owner, line_hashes[line_codes] if len(line_codes) else np.zeros(0, np.uint64)))):
        out[:, SIZE + k] = np.log1p(_repeats(own, items, n))
    out[:, SIZE + 3] = np.log1p(count)
    again = (owner[:-1] == owner[1:]) & (codes[:-1] == codes[1:])
    out[:, SIZE + 4] = np.bincount(owner[1:][again], minlength=n) / np.maximum(count, 1)
    return out


def document_vectors(docs: DataFrame, table: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``_id, x`` of every row."""
    own = pick(docs, _id=id_col, _text=text_col)
    sent = docs.sparkSession.sparkContext.broadcast(table)

    def run(batches):
        for batch in batches:
            for lo, hi in slices(batch.column(1), CHUNK):
                x = features(batch.column(1).slice(lo, hi - lo), sent.value)
                flat = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel(), pa.float32()), SIZE + EXTRA).cast(pa.list_(pa.float32()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), flat], ["_id", "x"])

    return own.mapInArrow(lean(run), f"_id {own.schema['_id'].dataType.simpleString()}, x array<float>")


@dataclass
class Network:
    """Two layers over standardised inputs, and the temperature of the output."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def inputs(self, x: np.ndarray) -> np.ndarray:
        """Standardised, and bounded: documents of few words have pooled vectors far from all others."""
        return np.clip((x - self.mean) / self.scale, -LIMIT, LIMIT) * _WEIGHT

    def logits(self, x: np.ndarray) -> np.ndarray:
        hidden = np.maximum(self.inputs(x) @ self.w1 + self.b1, 0)
        return hidden @ self.w2 + self.b2

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -40, 40)))


def constant(share: float) -> Network:
    """A network that scores every document alike."""
    share = min(max(share, 1e-6), 1 - 1e-6)
    size = SIZE + EXTRA
    return Network(np.zeros(size), np.ones(size), np.zeros((size, 1)), np.zeros(1), np.zeros(1), float(np.log(share / (1 - share))))


def fit(x: np.ndarray, y: np.ndarray, hidden: int = 32, epochs: int = 40, rate: float = 3e-3, decay: float = 1e-3, seed: int = 5) -> Network:
    """Fit on four fifths of the rows; the last fifth sets the temperature."""
    if len(y) < 10 or len(set(y.tolist())) < 2:
        return constant(float(y.mean()) if len(y) else 0.5)
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(y))
    own, rest = order[len(y) // 5 :], order[: len(y) // 5]
    mean, scale = x[own].mean(axis=0), x[own].std(axis=0) + 1e-3
    net = Network(mean, scale, rng.normal(0, np.sqrt(2 / x.shape[1]), (x.shape[1], hidden)), np.zeros(hidden), rng.normal(0, np.sqrt(1 / hidden), hidden), 0.0)
    z = net.inputs(x)
    values = [net.w1, net.b1, net.w2, np.zeros(1)]
    first, second, step = [np.zeros_like(v) for v in values], [np.zeros_like(v) for v in values], 0
    for _ in range(epochs):
        own = rng.permutation(own)
        for k in range(0, len(own), 256):
            at = own[k : k + 256]
            a = z[at] @ values[0] + values[1]
            h = np.maximum(a, 0)
            error = (1 / (1 + np.exp(-np.clip(h @ values[2] + values[3], -40, 40))) - y[at]) / len(at)
            back = np.outer(error, values[2]) * (a > 0)
            grads = [z[at].T @ back + decay * values[0], back.sum(axis=0), h.T @ error + decay * values[2], np.array([error.sum()])]
            step += 1
            for v, g, m, s in zip(values, grads, first, second, strict=True):
                m += 0.1 * (g - m)
                s += 0.001 * (g * g - s)
                v -= rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
    net.w1, net.b1, net.w2, net.b2 = values[0], values[1], values[2], float(values[3][0])
    logits, truth = net.logits(x[rest]), y[rest]

    def loss(t: float) -> float:
        v = np.clip(logits / t, -40, 40)
        return float(np.mean(np.logaddexp(0, v) - truth * v))

    net.temperature = min(np.geomspace(0.25, 8, 60).tolist(), key=loss) if len(rest) else 1.0
    return net


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", threshold: float = 0.3, folds: int = 5, max_rows: int = 20000, extra: bool = True) -> DataFrame:
    """``id_col, held_out, score, predicted`` of every row.

    Rows whose crc32 of the id as text is 0 modulo ``folds`` are held out; the fit
    reads about ``max_rows`` of the other labelled rows at most, chosen by hash.
    """
    vectors = stored(document_vectors(docs, word_table(*context_sums(docs, text_col)), id_col, text_col), "vectors")
    if not extra:
        vectors = vectors.withColumn("x", F.transform("x", lambda v, k: F.when(k < SIZE, v).otherwise(F.lit(0.0).cast("float"))))
    held_out = F.coalesce(F.crc32(F.col("_id").cast("string")) % folds == 0, F.lit(False))
    known = pick(labels, _id=id_col, _y=label_col).where("_id is not null and _y is not null").groupBy("_id").agg(F.max("_y").cast("double").alias("_y"))
    usable = known.where(~held_out)
    # Labels may belong to documents that aren't here; the share is over those that are.
    n = vectors.select("_id").join(usable, "_id", "left_semi").count()
    bound = (1 << 20) if n <= max_rows else int((1 << 20) * max_rows / n)
    sample = vectors.join(usable.where(F.pmod(F.xxhash64("_id"), F.lit(1 << 20)) < bound), "_id").select("_id", "x", "_y").toArrow()
    x = np.array(sample["x"].combine_chunks().flatten(), np.float64).reshape(-1, SIZE + EXTRA) if len(sample) else np.zeros((0, SIZE + EXTRA))
    y = sample["_y"].to_numpy()
    # Rows arrive in any order; the fit must not depend on it.
    order = np.lexsort((*x.T, np.array(sample["_id"].to_pylist()))) if len(sample) else np.zeros(0, int)
    sent = docs.sparkSession.sparkContext.broadcast(fit(x[order], y[order]))

    def run(batches):
        net = sent.value
        for batch in batches:
            if not len(batch):
                continue
            values = net.scores(batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(batch), -1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values)], ["_id", "score"])

    scored = vectors.mapInArrow(lean(run), f"_id {vectors.schema['_id'].dataType.simpleString()}, score double")
    return scored.select(F.col("_id").alias(id_col), held_out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
