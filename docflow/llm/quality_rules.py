"""Quality rules with a cross-document line frequency (native DataFrame code).

Per document, in the row: word, symbol, repeated-line and repeated-window
counts. Across documents: every line is normalised and hashed, distinct
documents are counted per (host, line), lines above the limit are removed and a
document that loses more than a share of its words is rejected as depleted.

Copies of one document must not make its own lines look like boilerplate, so
documents of the same whole text (by its hash) count once unless ``count_copies`` is set; all
others count each, whatever lines they share.

Scale: one pass over the texts for the counts, one for the lines, whose small
rows are written once to the shared folder and read twice. The count is pre-aggregated twice (by line and
text, then by line), so a line in a third of all documents never meets in one
task; the lookup of flagged lines is a semi join that AQE may split or, once it
has measured the flagged side, broadcast.

Defined results: null text counts as empty (no words, ``base_failed``); a null
host is a host of its own; rows that repeat a document get equal verdicts; a null
or repeated doc_id is matched together with text and host; an empty table gives
an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from docflow.llm.storage import stored
from docflow.llm.text import WS, pick, words

#: Symbols counted by ``n_symbols`` (fixed by the contract).
SYMBOLS = "#*$%&|<>"
POSITION_BITS = 31


def _repeat_words(df: DataFrame) -> DataFrame:
    """Add ``n_repeat_words``: words inside 3-word windows found twice or more.

    Window hashes (33 bits) and positions (31 bits) share a long, so the sort is
    one over primitives; equal neighbours are only candidates, which the windows'
    own words then confirm. Each step is a projection that refers to the one
    before more than once, so the optimizer keeps them apart.
    """
    position = F.lit((1 << POSITION_BITS) - 1).cast("long")
    tag = lambda x: F.shiftrightunsigned(x, POSITION_BITS)
    near = lambda a, i, f, x: (f(F.get(a, i + 1)) == x) | (f(F.get(a, i - 1)) == x)
    df = df.withColumn("_h", F.transform("_w", lambda w: F.xxhash64(w)))
    df = df.withColumn(
        "_p",
        F.when(
            F.size("_h") >= 3,
            F.sort_array(
                F.transform(
                    F.slice("_h", 1, F.greatest(F.size("_h") - 2, F.lit(0))),
                    lambda h, i: F.shiftleft(F.xxhash64(h, F.get("_h", i + 1), F.get("_h", i + 2)), POSITION_BITS).bitwiseOR(i.cast("long")),
                )
            ),
        ).otherwise(F.array().cast("array<bigint>")),
    )
    df = df.withColumn("_c", F.filter("_p", lambda x, i: near(F.col("_p"), i, tag, tag(x)))).drop("_h", "_p")
    at = lambda x: x.bitwiseAND(position).cast("int")
    df = df.withColumn(
        "_g",
        F.when(
            F.size("_c") > 0,
            F.sort_array(F.transform("_c", lambda x: F.struct(F.concat_ws(" ", F.get("_w", at(x)), F.get("_w", at(x) + 1), F.get("_w", at(x) + 2)).alias("g"), at(x).alias("p")))),
        ),
    ).drop("_c")
    df = df.withColumn("_q", F.sort_array(F.transform(F.filter("_g", lambda x, i: near(F.col("_g"), i, lambda y: y["g"], x["g"])), lambda x: x["p"]))).drop("_g")
    covered = F.aggregate(F.transform("_q", lambda p, i: F.least(F.lit(3), F.coalesce(F.get("_q", i + 1) - p, F.lit(3)))), F.lit(0).cast("long"), lambda a, x: a + x)
    return df.withColumn("n_repeat_words", F.when(F.size("_q") > 0, covered).otherwise(F.lit(0).cast("long"))).drop("_q")


def normalised(line: Column) -> Column:
    """Lower case, white space collapsed, digit runs as one 0."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(line), WS + "+", " "), "[0-9]+", "0"))


def base_rules(docs: DataFrame, min_words: int = 50, max_repeat_pct: int = 50) -> DataFrame:
    """``_id, _host, _th`` and the per-document counts of the contract."""
    text = F.coalesce(F.col("_text"), F.lit(""))
    with_word = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    df = docs.select(
        "_id", "_host", F.xxhash64("_text").alias("_th"), words(F.col("_text")).alias("_w"), with_word.alias("_l"),
        (F.length(text) - F.length(F.regexp_replace(text, "[#*$%&|<>]+", ""))).cast("long").alias("n_symbols"),
        F.length(F.regexp_replace(text, WS + "+", "")).cast("long").alias("word_chars"),
    )
    df = df.withColumns({"n_words": F.size("_w").cast("long"), "n_dup_lines": (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long")}).drop("_l")
    df = _repeat_words(df).drop("_w")
    return df.withColumn("base_failed", (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_pct * F.col("n_words")))


def host_lines(docs: DataFrame) -> DataFrame:
    """A row for each line with a word: document, place, line hash and words."""
    with_word = F.filter(F.split(F.coalesce(F.col("_text"), F.lit("")), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    df = docs.select("_id", "_host", F.xxhash64("_text").alias("_th"), F.transform(with_word, lambda x: F.struct(F.size(words(x)).alias("n"), normalised(x).alias("s"))).alias("_l"))
    # Outer: for an inner one the optimizer infers a filter that works all lines out a second time.
    df = df.select("_id", "_host", "_th", F.posexplode_outer("_l").alias("_pos", "_line")).where(F.col("_pos").isNotNull())
    return df.select("_id", "_host", "_th", "_pos", F.xxhash64(F.col("_line.s")).alias("_h"), F.col("_line.n").cast("long").alias("_n"))


def frequent_lines(lines: DataFrame, max_line_docs: int = 5, count_copies: bool = False) -> DataFrame:
    """``_host, _h`` of the lines that more than ``max_line_docs`` different documents of a host hold."""
    document = ["_id", "_th"] if count_copies else ["_th"]
    return lines.select("_host", "_h", *document).distinct().groupBy("_host", "_h").agg(F.count("*").alias("_docs")).where(F.col("_docs") > max_line_docs)


def removed_lines(docs: DataFrame, max_line_docs: int = 5, count_copies: bool = False) -> DataFrame:
    """Occurrences of lines above the limit, each place of a document once."""
    lines = stored(host_lines(docs), "lines")
    # Under the complement of the hash the counted side is dealt out anew, so AQE can split the join at a hot line.
    often = frequent_lines(lines, max_line_docs, count_copies).select("_host", F.bitwise_not("_h").alias("_k")).alias("o")
    hits = lines.withColumn("_k", F.bitwise_not("_h")).alias("l").join(often, F.col("l._host").eqNullSafe(F.col("o._host")) & (F.col("l._k") == F.col("o._k")), "left_semi")
    return hits.groupBy("_id", "_host", "_th", "_pos").agg(F.max("_n").alias("_n"))


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", min_words: int = 50, max_repeat_pct: int = 50, max_line_docs: int = 5, max_removed_pct: int = 50, count_copies: bool = False) -> DataFrame:
    """Counts, verdict and removed words of every document (see the module's docstring)."""
    own = pick(docs, _id=id_col, _text=text_col, _host=host_col)
    base = base_rules(own, min_words, max_repeat_pct).alias("b")
    gone = removed_lines(own, max_line_docs, count_copies).groupBy("_id", "_host", "_th").agg(F.sum("_n").alias("_gone")).alias("r")
    same = F.col("b._id").eqNullSafe(F.col("r._id")) & F.col("b._host").eqNullSafe(F.col("r._host")) & (F.col("b._th") == F.col("r._th"))
    removed = F.coalesce(F.col("r._gone"), F.lit(0))
    depleted = 100 * removed > max_removed_pct * F.col("b.n_words")
    return base.join(gone, same, "left").select(
        F.col("b._id").alias(id_col), "b.n_words", "b.word_chars", "b.n_symbols", "b.n_dup_lines", "b.n_repeat_words", "b.base_failed",
        (~F.col("b.base_failed") & ~depleted).alias("kept"), removed.alias("removed_words"),
    )


def clean_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", max_line_docs: int = 5) -> DataFrame:
    """``id_col, text_col`` with the lines above the limit taken out (lines without a word stay)."""
    own = pick(docs, _id=id_col, _text=text_col, _host=host_col).withColumn("_th", F.xxhash64("_text")).alias("d")
    gone = removed_lines(own, max_line_docs).groupBy("_id", "_host", "_th").agg(F.array_sort(F.collect_set("_pos")).alias("_gone")).alias("r")
    same = F.col("d._id").eqNullSafe(F.col("r._id")) & F.col("d._host").eqNullSafe(F.col("r._host")) & (F.col("d._th") == F.col("r._th"))
    lines = F.split(F.col("d._text"), "\n")
    is_word = lambda x: x.rlike(r"[^\x20\x09-\x0D]").cast("int")
    #: Places count lines with a word only.
    state = F.aggregate(
        lines,
        F.struct(F.lit(0).alias("k"), F.array().cast("array<string>").alias("out")),
        lambda a, x: F.struct((a["k"] + is_word(x)).alias("k"), F.when((is_word(x) == 1) & F.array_contains(F.col("r._gone"), a["k"]), a["out"]).otherwise(F.concat(a["out"], F.array(x))).alias("out")),
    )
    return own.join(gone, same, "left").select(F.col("d._id").alias(id_col), F.when(F.col("r._gone").isNull(), F.col("d._text")).otherwise(F.array_join(state["out"], "\n")).alias(text_col))
