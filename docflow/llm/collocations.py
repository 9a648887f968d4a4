"""Phrase collocations: n-grams counted by language, scored at their weakest cut.

All 1- to ``max_n``-grams of a text's pieces become DataFrame rows, which are counted
by language with a hash aggregation; counts of first and last parts are joined, the score is
worked out in Decimal, one-word extensions take out what they cover (an anti join),
and a window ranks each language.

A phrase with ``least`` occurrences has only parts with as many. So the rows come in
three passes: words; pairs whose words are frequent; longer phrases whose pairs are
all frequent. Frequent words and pairs are sent as a bitmap of bounded size without
false negatives, so every phrase that can be a candidate is counted in full, and false positives only
cost rows. ``prune=False`` makes all rows.

Covering needs one-word extensions only: if a longer candidate has four fifths of a
phrase's occurrences, so has the extension by one word that lies between them.

Scale: a slice of texts is counted before it leaves Python, a task's slices before they are shuffled,
so the most frequent word sends one row a slice. The joins have one row a phrase on the other
side and are planned between two exchanges, which AQE can split at a hot first word. Ranking is done
within buckets first, of which each sends at most ``top`` rows on. The driver gets the bitmap's
words (at most 2**21 rows) and nothing else.

Defined results: null and blank texts have no words; a null language is ``und``
(and counts with rows of that name); every row of a repeated document counts; texts
of any length are cut between pieces into blocks of about ``BLOCK`` characters, so only a piece is held whole; an
empty table, or one without candidates, gives no rows. Extra columns play no part.
Fewer candidates than ``top`` in a language give all.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from docflow.llm.arrow import lean, slices
from docflow.llm.storage import stored
from docflow.llm.text import pick

#: Bytes of text counted at a time, and characters after which a long text is cut at the next border of pieces.
CHUNK, BLOCK = 4 << 20, 4 << 20
#: Borders of pieces (fixed by the contract).
BORDER = r"[.,;:!?\x0A-\x0D]"
#: Stands for a border among the words: no word holds a line feed.
MARK = "\n"
#: Bits of the bitmap: 16 MB.
BITS = 27
#: Buckets of the first ranking.
BUCKETS = 32
#: Odd constants of the hashes of phrases.
_STEP, _LAST = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def blocks(text: str, size: int) -> Iterator[str]:
    """A text in blocks of at least ``size`` characters (the last may be shorter), cut at borders of pieces."""
    border, lo = re.compile(BORDER), 0
    while len(text) - lo > size and (found := border.search(text, lo + size)):
        yield text[lo : found.start()]
        lo = found.end()
    yield text[lo:]


def word_hashes(words: pa.Array) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(w) for w in words.to_pylist()), np.uint64, len(words))


def slot(lang: np.ndarray, parts: list[np.ndarray], bits: int) -> np.ndarray:
    """The bitmap's place for phrases given by their words' hashes, and the language's."""
    with np.errstate(over="ignore"):
        h = lang * _LAST
        for p in parts:
            h = (h ^ (h >> np.uint64(29))) * _STEP + p
        return ((h ^ (h >> np.uint64(32))) * _LAST) >> np.uint64(64 - bits)


def tokens(texts: pa.Array, langs: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray, pa.Array]:
    """Word codes in order (-1 between pieces and texts), the words, language codes in order, the languages."""
    spaced = pc.replace_substring_regex(pc.ascii_lower(texts), BORDER, f" {MARK} ")
    # The mark at the end parts this text from the next.
    spaced = pc.binary_join_element_wise(spaced, pa.scalar(MARK), " ")
    split = pc.split_pattern_regex(spaced, r"[\x20\x09]+")
    coded = split.flatten().dictionary_encode()
    words, code = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    known = langs.dictionary_encode()
    lang = np.repeat(known.indices.to_numpy(zero_copy_only=False).astype(np.int64), split.value_lengths().to_numpy())
    keep = code != words.index("").as_py() if words.index("").as_py() >= 0 else np.ones(len(code), bool)
    code, lang = code[keep], lang[keep]
    code[code == words.index(MARK).as_py()] = -1
    return code, words, lang, known.dictionary


def grams(texts: pa.Array, langs: pa.Array, sizes: list[int], bitmap: np.ndarray | None, known: int, bits: int) -> Iterator[pa.RecordBatch]:
    """Counted phrases of the asked sizes; with a bitmap, those whose parts of ``known`` words are all in it."""
    code, words, lang, names = tokens(texts, langs)
    ok = code >= 0
    if bitmap is not None:
        own, tongue = word_hashes(words), word_hashes(names)[lang]
        m = max(0, len(code) - known + 1)
        at = slot(tongue[:m], [own[code[i : m + i]] for i in range(known)], bits)
        seen = (bitmap[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
    # Phrases as numbers: that of all words but the last, and the last.
    start, number = np.flatnonzero(ok), code[ok] + lang[ok] * len(words)
    for n in range(1, max(sizes) + 1):
        if n > 1:
            use = start + n - 1 < len(code)
            use[use] = ok[start[use] + n - 1]
            if bitmap is not None and n > known:
                for away in {0, n - known}:
                    use[use] = seen[start[use] + away]
            start, number = start[use], number[use] * len(words) + code[start[use] + n - 1]
        elif bitmap is not None and known == 1:
            use = seen[start]
            start, number = start[use], number[use]
        _, first, number, count = np.unique(number, return_index=True, return_inverse=True, return_counts=True)
        if n in sizes and len(first):
            at = start[first]
            parts = [words.take(pa.array(code[at + i])) for i in range(n)]
            phrase = parts[0] if n == 1 else pc.binary_join_element_wise(*parts, " ")
            yield pa.RecordBatch.from_arrays([names.take(pa.array(lang[at])), pa.array(np.full(len(at), n, np.int32)), phrase, pa.array(count.astype(np.int64))], ["lang", "size", "phrase", "f"])


def counted(docs: DataFrame, sizes: list[int], bitmap: np.ndarray | None = None, known: int = 0, bits: int = BITS, block: int = BLOCK) -> DataFrame:
    """``lang, size, phrase, f`` of the phrases of ``docs`` (``_lang, _text``)."""
    sent = docs.sparkSession.sparkContext.broadcast(bitmap)

    def run(batches):
        for batch in batches:
            langs, texts = batch.column(0), batch.column(1)
            long_ = pc.greater(pc.binary_length(texts), block)
            if pc.any(long_).as_py():
                cut = [(l, b) for l, t in zip(langs.to_pylist(), texts.to_pylist(), strict=True) for b in blocks(t, block)]
                langs, texts = pa.array([l for l, _ in cut], pa.string()), pa.array([b for _, b in cut], pa.string())
            for lo, hi in slices(texts, CHUNK):
                yield from grams(texts.slice(lo, hi - lo), langs.slice(lo, hi - lo), sizes, sent.value, known, bits)

    rows = docs.mapInArrow(lean(run), "lang string, size int, phrase string, f bigint")
    return rows.groupBy("lang", "size", "phrase").agg(F.sum("f").alias("f"))


def bitmap_of(frequent: DataFrame, size: int, bits: int = BITS) -> np.ndarray:
    """The bitmap of the frequent phrases of ``size`` words: at most 2**(bits - 6) rows reach the driver."""

    def run(batches):
        for batch in batches:
            split = pc.split_pattern(batch.column(1), " ")
            own = word_hashes(split.flatten()).reshape(-1, size)
            at = slot(word_hashes(batch.column(0)), [own[:, i] for i in range(size)], bits)
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int64))], ["s"])

    places = frequent.select("lang", "phrase").mapInArrow(lean(run), "s bigint")
    parts = places.groupBy(F.shiftright("s", 6).alias("k")).agg(F.expr("bit_or(shiftleft(1L, cast(s & 63 as int)))").alias("v")).toArrow()
    found = np.zeros(1 << bits >> 6, np.int64)
    found[parts["k"].to_numpy()] = parts["v"].to_numpy()
    return found.view(np.uint8)


def phrase_counts(docs: DataFrame, max_n: int, least: int, prune: bool = True, bits: int = BITS, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """All phrases of 1 to ``max_n`` words with ``least`` occurrences, and ``lang, n``, how many words a language has."""
    keep = lambda df, name: stored(df.where(F.col("f") >= least), name)
    words = stored(counted(docs, [1], block=block), "words")
    totals = words.groupBy("lang").agg(F.sum("f").alias("n"))
    found = words.where(F.col("f") >= least)
    if max_n > 1:
        pairs = keep(counted(docs, [2], bitmap_of(found, 1, bits) if prune else None, 1, bits, block), "pairs")
        found = found.unionByName(pairs)
    if max_n > 2:
        found = found.unionByName(keep(counted(docs, list(range(3, max_n + 1)), bitmap_of(pairs, 2, bits) if prune else None, 2, bits, block), "phrases"))
    return found, totals


def collocations(docs: DataFrame, max_n: int = 4, least: int = 30, cover_pct: int = 80, top: int = 2000, scale: int = 2_000_000, text_col: str = "text", lang_col: str = "lang", prune: bool = True, bits: int = BITS, block: int = BLOCK) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: each language's ``top`` phrases (see the module's docstring)."""
    own = pick(docs, _lang=lang_col, _text=text_col).select(F.coalesce(F.col("_lang").cast("string"), F.lit("und")).alias("_lang"), F.coalesce("_text", F.lit("")).alias("_text"))
    found, totals = phrase_counts(own, max_n, least, prune, bits, block)
    found = stored(found, "frequent")
    candidates = found.where("size > 1").withColumnRenamed("f", "a")
    # Every cut, with the counts of both parts.
    part = lambda lo, n: F.concat_ws(" ", F.slice(F.split("phrase", " "), lo, n))
    cuts = candidates.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
    cuts = cuts.withColumns({"head": part(F.lit(1), F.col("k")), "tail": part(F.col("k") + 1, F.col("size") - F.col("k"))})
    counts = lambda part, out: found.select(F.col("lang"), F.col("phrase").alias(part), F.col("f").alias(out))
    cuts = cuts.join(counts("head", "l"), ["lang", "head"]).join(counts("tail", "r"), ["lang", "tail"])
    # a <= l and a <= r, so the quotient is at most half the scale; the product takes Decimal.
    wide = lambda c: F.col(c).cast("decimal(19,0)").cast("decimal(28,0)")
    whole = cuts.withColumns({"_p": (F.lit(scale).cast("decimal(9,0)") * wide("a")).cast("decimal(38,0)"), "_d": (wide("l") + wide("r")).cast("decimal(38,0)")})
    scored = whole.withColumn("score", F.expr("_p div _d")).groupBy("lang", "size", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("x"))
    # What a one-word extension covers, whichever end the word stands at.
    shorter = F.explode(F.array(part(F.lit(1), F.col("size") - 1), part(F.lit(2), F.col("size") - 1)))
    longer = candidates.where("size > 2").select("lang", shorter.alias("phrase"), F.col("a").alias("f")).groupBy("lang", "phrase").agg(F.max("f").alias("f"))
    wider = lambda c: F.col(c).cast("decimal(38,0)")
    free = scored.join(longer.alias("e"), (scored["lang"] == F.col("e.lang")) & (scored["phrase"] == F.col("e.phrase")) & (100 * wider("e.f") >= cover_pct * wider("a")), "left_anti")
    best = [F.desc("score"), F.desc("a"), F.col("phrase")]
    out = free.select("lang", "phrase", "a", "x.l", "x.r", "x.score", F.pmod(F.xxhash64("phrase"), F.lit(BUCKETS)).alias("_b"))
    out = out.withColumn("_n", F.row_number().over(Window.partitionBy("lang", "_b").orderBy(*best))).where(F.col("_n") <= top)
    out = out.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best)).cast("long")).where(F.col("rank") <= top)
    return out.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
