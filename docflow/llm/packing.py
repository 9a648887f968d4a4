"""Best-fit packing by patterns fitted with non-negative least squares.

1. Texts are tokenised and cut into pieces of at most ``capacity`` tokens.
2. The plan is made from the histogram of piece lengths alone, whose size is
   fixed by the capacity: patterns of few lengths that fill a sequence are
   enumerated over coarse bins (each as long as its pieces are on average), their repeat
   counts are fitted to the histogram by non-negative least squares, rounded down, and
   filled with exact lengths of the bins, the last two so that they fill the sequence to the
   last token. What is left over, and all pieces of the smallest bin, go, longest first, to the
   fullest sequence that still has room.
3. The plan names, for each length, which sequence and place the first, second,
   ... piece of that length takes. Pieces learn their rank among pieces of their
   length from a window over (length, salt) plus the salted counts, so a length
   that a third of all pieces share is ranked in many tasks.

The driver holds histogram and plan only: ``capacity * SALTS`` counts and a number
of plan rows that depends on the capacity, not on the documents.

Defined results: a null or empty text is one piece that holds the end token; rows
that repeat are packed each; ids are only carried along; an empty table gives an
empty result.
"""

from __future__ import annotations

import os
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from docflow.llm.arrow import lean, slices
from docflow.llm.storage import stored
from docflow.llm.text import pick

CAPACITY, END, RANKED = 4096, 1, 1 << 17
#: Coarse bins of the fit and the documents of a pattern at most.
FIT_BINS, PATTERN_DOCS = 32, 8
#: Bytes tokenised at a time, words kept by a worker, the longest that are encoded many at a time, and how many.
CHUNK, KEPT_WORDS, KEPT_CHARS, JOINED = 1 << 22, 1 << 19, 64, 1000
#: Lower-case letters that the tokenizer's rules keep together and leave as they are.
LETTER = "[a-z\u00df-\u00f6\u00f8-\u00ff]"


class WordTokens:
    """Token ids of texts, word by word.

    The tokenizer drops white space and its rules never look across it, so the ids
    of a text are those of its words, unless it holds one of the tokenizer's special tokens:
    such texts are encoded whole. Nor do its rules look across the border between
    a letter and a closing stop or comma, so that is taken off first. Distinct words
    are encoded once a batch, and a bounded number of them is kept between batches.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.exact, self.tokenizer = Tokenizer.from_file(path), Tokenizer.from_file(path)
        self.special = [t.content for t in self.exact.get_added_tokens_decoder().values()]
        # What comes here word by word is lower-cased and has no special token of its own.
        self.tokenizer.encode_special_tokens = True
        vocabulary = self.tokenizer.get_vocab()
        #: Tokens that end a word, and the ids of a closing stop and comma.
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[k for x, k in vocabulary.items() if x.endswith("</w>")]] = True
        self.stop, self.comma = (self.encode([x])[0] for x in (".", ","))
        self.forget()

    def forget(self) -> None:
        self.known, self.ids, self.starts = pa.array([], pa.string()), np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def new_words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words on end, and how many each has. Plain words are encoded many at a time: their last token says where they end."""
        plain = pc.match_substring_regex(words, f"^{LETTER}+$").to_numpy(zero_copy_only=False) & (pc.binary_length(words).to_numpy() <= KEPT_CHARS)
        counts, parts = np.zeros(len(words), np.int64), np.empty(len(words), object)
        at = np.flatnonzero(plain)
        listed = words.take(pa.array(at)).to_pylist()
        flat = np.fromiter(chain.from_iterable(self.encode([" ".join(listed[k : k + JOINED]) for k in range(0, len(listed), JOINED)])), np.uint32)
        last = np.flatnonzero(self.ends[flat])
        if len(last) != len(at) or (len(at) and last[-1] != len(flat) - 1):
            raise ValueError("the tokenizer does not mark the end of each word")
        counts[at] = np.diff(last, prepend=-1)
        for k, ids in zip(np.flatnonzero(~plain).tolist(), self.encode(words.filter(pa.array(~plain)).to_pylist()), strict=True):
            counts[k], parts[k] = len(ids), ids
        out = np.empty(int(counts.sum()), np.uint32)
        owned = np.repeat(plain, counts)
        out[owned] = flat
        out[~owned] = np.fromiter(chain.from_iterable(parts[~plain]), np.uint32)
        return out, counts

    def words(self, words: pa.Array) -> np.ndarray:
        """Places of distinct words in ``starts``; words that aren't known yet are added."""
        if len(self.known) > KEPT_WORDS or len(self.ids) > 16 * KEPT_WORDS:
            self.forget()
        place = pc.index_in(words, value_set=self.known)
        new = words.filter(pc.is_null(place))
        ids, counts = self.new_words(new)
        self.known = pa.concat_arrays([self.known, new])
        self.ids = np.concatenate((self.ids, ids))
        self.starts = np.concatenate((self.starts, self.starts[-1] + np.cumsum(counts)))
        found = place.fill_null(0).to_numpy().astype(np.int64)
        missing = place.is_null().to_numpy(zero_copy_only=False)
        found[missing] = len(self.known) - len(new) + np.arange(len(new))
        return found

    def texts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts on end, and how many each has."""
        texts, whole = pc.fill_null(texts, ""), np.zeros(len(texts), bool)
        for token in self.special:
            whole |= pc.match_substring(texts, token).to_numpy(zero_copy_only=False)
        if not whole.any():
            return self.of_words(texts)
        flat, counts = self.of_words(pc.if_else(pa.array(whole), "", texts))
        parts, begin = [], np.cumsum(counts) - counts
        for k, n in enumerate(counts.tolist()):
            parts.append(np.array(self.exact.encode(texts[k].as_py(), add_special_tokens=False).ids, np.uint32) if whole[k] else flat[begin[k] : begin[k] + n])
        return np.concatenate(parts), np.array([len(x) for x in parts], np.int64)

    def of_words(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """As ``texts``, word by word."""
        lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
        coded = lists.flatten().dictionary_encode()
        closed = pc.match_substring_regex(coded.dictionary, f"{LETTER}[.,]$")
        comma = pc.ends_with(coded.dictionary, ",").to_numpy(zero_copy_only=False)
        cores = pc.if_else(closed, pc.binary_slice(coded.dictionary.cast(pa.binary()), 0, -1), coded.dictionary.cast(pa.binary())).cast(pa.string()).dictionary_encode()
        found = self.words(cores.dictionary)[cores.indices.to_numpy()] if len(cores) else np.zeros(0, np.int64)
        closed = closed.to_numpy(zero_copy_only=False)
        # The ids of the batch's distinct words, then those of all words by repeating them.
        sizes = self.starts[found + 1] - self.starts[found] + closed
        ends = np.cumsum(sizes)
        flat = self.ids[np.minimum(_ranges(self.starts[found], sizes), max(len(self.ids) - 1, 0))] if len(found) else np.zeros(0, np.uint32)
        flat[ends[closed] - 1] = np.where(comma[closed], self.comma[0], self.stop[0])
        codes = coded.indices.to_numpy()
        of_word = sizes[codes]
        owner = np.repeat(np.arange(len(texts)), np.diff(lists.offsets.to_numpy()))
        return flat[_ranges((ends - sizes)[codes], of_word)], np.bincount(owner, weights=of_word, minlength=len(texts)).astype(np.int64)


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """``starts[k], starts[k] + 1, ...`` with ``sizes[k]`` numbers for each k, on end."""
    total = int(sizes.sum())
    kind = np.int32 if total < 1 << 31 and (not len(starts) or int(starts.max()) < (1 << 31) - total) else np.int64
    return np.repeat((starts - (np.cumsum(sizes) - sizes)).astype(kind), sizes) + np.arange(total, dtype=kind)


_TOKENS: dict[str, WordTokens] = {}


def tokens_of(path: str) -> WordTokens:
    """One tokenizer a worker process."""
    if path not in _TOKENS:
        _TOKENS[path] = WordTokens(path)
    return _TOKENS[path]


def pieces(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """``_id, piece, start, length, ids_crc32`` (and ``ids``) of every piece."""
    own = pick(docs, _id=id_col, _text=text_col)

    def run(batches):
        tokens = tokens_of(tokenizer)
        for batch in batches:
            for lo, hi in slices(batch.column(1), CHUNK):
                flat, counts = tokens.texts(batch.column(1).slice(lo, hi - lo))
                # The end token follows each text.
                flat, counts = np.insert(flat, np.cumsum(counts), np.uint32(END)).astype("<u4"), counts + 1
                cuts = -(-counts // capacity)
                row = np.repeat(np.arange(lo, hi), cuts)
                piece = _ranges(np.zeros(hi - lo, np.int64), cuts)
                start = piece.astype(np.int64) * capacity
                length = np.minimum(np.repeat(counts, cuts) - start, capacity)
                edges = np.append(0, np.cumsum(length))
                bytes_ = memoryview(flat).cast("B")
                crc = np.fromiter((zlib.crc32(bytes_[4 * x : 4 * y]) for x, y in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)), np.int64, len(length))
                columns = [batch.column(0).take(pa.array(row)), *(pa.array(x) for x in (piece.astype(np.int32), start, length, crc))]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), pa.array(flat.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(columns, ["_id", "piece", "start", "length", "ids_crc32", "ids"][: len(columns)])

    kind = own.schema["_id"].dataType.simpleString()
    return own.mapInArrow(lean(run), f"_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids array<int>" * with_ids)


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 400) -> np.ndarray:
    """Non-negative least squares by active sets: min |a x - b| over x >= 0."""
    x = np.zeros(a.shape[1])
    active = np.zeros(a.shape[1], bool)
    for _ in range(rounds):
        gain = a.T @ (b - a @ x)
        gain[active] = -np.inf
        best = int(np.argmax(gain))
        if gain[best] <= 1e-9 * max(1.0, float(np.abs(b).max(initial=0))):
            break
        active[best] = True
        while True:
            at = np.flatnonzero(active)
            z = np.linalg.lstsq(a[:, at], b, rcond=None)[0]
            if (z > 0).all():
                x[:] = 0
                x[at] = z
                break
            down = z <= 0
            step = np.min(x[at][down] / np.maximum(x[at][down] - z[down], 1e-300))
            x[at] += step * (z - x[at])
            x[at[x[at] <= 1e-12]] = 0
            active &= x > 0
            if not active.any():
                break
    return x


def patterns(sizes: list[float], capacity: int, docs: int, slack: float) -> list[tuple[int, ...]]:
    """Multisets of 2 to ``docs`` places in ``sizes`` (which falls) whose sum fills ``capacity`` up to ``slack``."""
    out: list[tuple[int, ...]] = []
    work: list[tuple[tuple[int, ...], float]] = [((), float(capacity))]
    while work:
        done, room = work.pop()
        if room <= slack and len(done) > 1:
            out.append(done)
        if len(done) < docs:
            work += [((*done, k), room - sizes[k]) for k in range(done[-1] if done else 0, len(sizes)) if sizes[k] <= room]
    return sorted(out)


class Bins:
    """The pieces of each length that are left, by bins of neighbouring lengths."""

    def __init__(self, counts: np.ndarray, capacity: int, bins: int):
        self.capacity, self.left = capacity, counts[:capacity].astype(np.int64).copy()
        edges = np.linspace(0, capacity, min(bins, capacity) + 1).astype(int)
        #: First and last length and mean length of the bins in use, longest first; the smallest bin is not fitted.
        self.low, self.high, self.size, self.count = [], [], [], []
        for low, high in list(zip(edges[:-1] + 1, np.minimum(edges[1:], capacity - 1), strict=True))[:0:-1]:
            if n := int(self.left[low : high + 1].sum()):
                self.low.append(int(low))
                self.high.append(int(high))
                self.size.append(float(self.left[low : high + 1] @ np.arange(low, high + 1)) / n)
                self.count.append(n)

    def lengths(self, k: int, room: int, taken: list[int]) -> np.ndarray:
        """Lengths of a bin up to ``room`` that still have a piece besides those taken."""
        left = self.left[self.low[k] : min(self.high[k], room) + 1].copy()
        for x in taken:
            if 0 <= x - self.low[k] < len(left):
                left[x - self.low[k]] -= 1
        return self.low[k] + np.flatnonzero(left > 0)

    def filled(self, pattern: tuple[int, ...]) -> list[int] | None:
        """Lengths for the places of a pattern that fill the capacity exactly, or None."""
        taken: list[int] = []
        due = 0.0
        for k in pattern[:-2]:
            due += self.size[k]
            found = self.lengths(k, self.capacity - sum(taken), taken)
            if not len(found):
                return None
            taken.append(int(found[np.argmin(np.abs(found - (due - sum(taken))))]))
        room = self.capacity - sum(taken)
        for x in self.lengths(pattern[-2], room, taken).tolist():
            if room - x in range(self.low[pattern[-1]], self.high[pattern[-1]] + 1) and self.left[room - x] > (taken + [x]).count(room - x):
                return [*taken, x, room - x]
        return None


def plan(counts: np.ndarray, capacity: int, bins: int = FIT_BINS, docs: int = PATTERN_DOCS) -> list[tuple[int, tuple[int, ...]]]:
    """``(repeats, lengths)`` of the sequences that hold ``counts[length]`` pieces of each length."""
    full = [(int(counts[capacity]), (capacity,))] if counts[capacity] else []
    have = Bins(counts, capacity, bins)
    return full + best_fit(fitted(have, docs, capacity / (2 * bins)), have.left, capacity)


def fitted(have: Bins, docs: int, slack: float) -> dict[tuple[int, ...], int]:
    """Repeats of the sequences that patterns fill; takes their pieces out of ``have``."""
    out: dict[tuple[int, ...], int] = {}
    fits = patterns(have.size, have.capacity, docs, slack)
    if not fits:
        return out
    a = np.zeros((len(have.size), len(fits)))
    for k, p in enumerate(fits):
        np.add.at(a[:, k], list(p), 1)
    wanted = np.floor(nnls(a, np.array(have.count, float)) + 1e-9).astype(np.int64)
    for k in np.argsort(-wanted, kind="stable").tolist():
        left = int(wanted[k])
        while left > 0 and (lengths := have.filled(fits[k])):
            n = min(left, *(int(have.left[x]) // lengths.count(x) for x in set(lengths)))
            for x in lengths:
                have.left[x] -= n
            out[key] = out.get(key := tuple(lengths), 0) + n
            left -= n
    return out


def best_fit(open_: dict[tuple[int, ...], int], rest: np.ndarray, capacity: int) -> list[tuple[int, tuple[int, ...]]]:
    """Pieces that are left, longest first, into the fullest sequence with room; sequences with equal contents move together."""
    rooms: dict[int, list[list]] = {}
    space = np.zeros(capacity + 1, np.int64)
    for lengths, n in open_.items():
        rooms.setdefault(capacity - sum(lengths), []).append([n, lengths])
        space[capacity - sum(lengths)] += n
    for length in np.flatnonzero(rest)[::-1].tolist():
        left = int(rest[length])
        while left > 0:
            fit = np.flatnonzero(space[length:capacity])
            if not len(fit):
                # As many as fit together fill new sequences.
                each = min(capacity // length, left)
                n = left // each
                rooms.setdefault(capacity - each * length, []).append([n, (length,) * each])
                space[capacity - each * length] += n
                left -= n * each
                continue
            room = length + int(fit[0])
            group = rooms[room][-1]
            n = min(left, group[0])
            group[0] -= n
            if not group[0]:
                rooms[room].pop()
            rooms.setdefault(room - length, []).append([n, (*group[1], length)])
            space[room] -= n
            space[room - length] += n
            left -= n
    return [(n, lengths) for groups in rooms.values() for n, lengths in groups]


def slots(made: list[tuple[int, tuple[int, ...]]], capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The plan by length: where each length's rows begin, their first ranks, first sequences and offsets."""
    rows, first = [], 0
    for n, lengths in made:
        offset = 0
        for length in lengths:
            rows.append((length, n, first, offset))
            offset += length
        first += n
    table = np.array(rows, np.int64).reshape(-1, 4)
    table = table[np.argsort(table[:, 0], kind="stable")]
    begin = np.searchsorted(table[:, 0], np.arange(capacity + 2))
    ranks = np.cumsum(table[:, 1]) - table[:, 1]
    ranks -= ranks[np.minimum(begin[table[:, 0]], max(len(table) - 1, 0))] if len(table) else 0
    return begin, ranks, table[:, 2], table[:, 3]


def packed(cut: DataFrame, capacity: int = CAPACITY, bins: int = FIT_BINS) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to stored pieces."""
    found = cut.groupBy("length").agg(F.count("*").alias("n")).toArrow()
    counts = np.zeros(capacity + 1, np.int64)
    counts[found["length"].to_numpy()] = found["n"].to_numpy()
    salts = counts // RANKED + 1
    first = np.cumsum(salts) - salts
    of_length = F.get(F.array(*map(F.lit, salts.tolist())), F.col("length").cast("int"))
    salted = cut.withColumn("_salt", F.pmod(F.xxhash64("_id", "piece", "ids_crc32"), of_length).cast("int"))
    found = salted.groupBy("length", "_salt").agg(F.count("*").alias("n")).toArrow()
    cells = np.zeros(int(salts.sum()), np.int64)
    cells[first[found["length"].to_numpy()] + found["_salt"].to_numpy()] = found["n"].to_numpy()
    # Pieces of a length before those of each salt.
    before = np.cumsum(cells) - cells
    before -= np.repeat(before[first], salts)
    sent = cut.sparkSession.sparkContext.broadcast((first, before, slots(plan(counts, capacity, bins), capacity)))
    ranked = salted.withColumn("_rank", F.row_number().over(Window.partitionBy("length", "_salt").orderBy("_id", "piece")) - 1)

    def run(batches):
        first, before, (begin, ranks, sequence, offset) = sent.value
        for batch in batches:
            length, salt, rank = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "_salt", "_rank"))
            rank = rank + before[first[length] + salt]
            at = np.empty(len(rank), np.int64)
            for x in np.unique(length).tolist():
                own = length == x
                at[own] = begin[x] + np.searchsorted(ranks[begin[x] : begin[x + 1]], rank[own], "right") - 1
            names = [c for c in batch.schema.names if c not in ("_salt", "_rank")]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(sequence[at] + rank - ranks[at]), pa.array(offset[at])], [*names, "sequence_id", "offset"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cut.schema)
    return ranked.mapInArrow(lean(run), f"{fields}, sequence_id bigint, offset bigint")


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """A row for each piece with its place; its ids are given by their checksum."""
    return packed(stored(pieces(docs, tokenizer, id_col, text_col, capacity), "pieces"), capacity).withColumnRenamed("_id", id_col)


def pack_ids(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """``sequence_id, ids``: the packed sequences themselves."""
    found = packed(stored(pieces(docs, tokenizer, id_col, text_col, capacity, with_ids=True), "pieces"), capacity)
    return found.groupBy("sequence_id").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("offset", "ids"))), lambda x: x["ids"])).alias("ids"))
