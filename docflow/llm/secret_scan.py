"""Secret scans by pattern and by a battery of randomness tests (native DataFrame code).

Base: three patterns (assignments, access keys, hexadecimal runs). Method: other
long tokens of letters and digits get an inferred encoding (hexadecimal, base32,
base36, base62, base64); under it three tests ask whether the token looks
random: chi-squared uniformity over the alphabet (with the exact mean and variance
for the token's length), runs above and below the middle of the alphabet, and lag-1
serial correlation. Fisher's method combines them into one p-value, which is uniform for
random tokens and small for ordinary ones. A token is a finding if its p-value is above a
limit, and there are two for each class of lengths (a class has its own share of ordinary
tokens and its own power), of which the stricter holds:

* Dismissals follow Benjamini and Hochberg: of the tokens taken for ordinary at most a share
  ``q`` should be random.
* Findings are held to the same share the other way round: the number of random tokens is estimated from
  those with a p-value above ``LAMBDA`` (plus two standard deviations and one), and where findings exceed what so many
  random tokens would give by more than a share ``q``, the rest are ordinary tokens and the limit rises.

What is looked at is set by ``TOKEN`` and ``MIN_LENGTH``: tokens of 20 characters or more with a letter and a
digit, and those long enough for the tests to tell anything apart. Shorter tokens are never
findings of the tests. The power by length was not measured.

Places come from the gaps that the pattern leaves (``split``) and the matches
(``regexp_extract_all``), summed in order, which is linear in the matches.

Scale: one pass over the texts; only documents and matches, as small rows, are
shuffled, by document row. The rejection limits come from a histogram of fixed
size (length classes times p-value bins), never from ranks of all tokens.

Defined results: null text counts as empty, an empty text has no span; rows that
repeat are reported as often; ids are only carried along; an empty table gives an
empty result. Base spans always stay; a found token that overlaps one is not
listed again.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from docflow.llm.storage import stored
from docflow.llm.text import pick

#: Kinds in order, patterns and least lengths (fixed by the contract). A run of hex digits or of an access key
#: that is too short can't hide a longer one, so their limits stand in the pattern; assignments are filtered after matching.
KINDS = ("assign", "access", "hex", "random")
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
#: An equals sign is padding at the end of a token and a border elsewhere, so values after names and in query strings are tokens of their own.
TOKEN = r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*[0-9])(?=[0-9+/_-]*[A-Za-z])[A-Za-z0-9+/_-]{20,}(?:=+(?![A-Za-z0-9+/_=-]))?"
MIN_VALUE = 12
#: Alphabets in the order of their symbols, and the least length at which the tests are used.
DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ALPHABETS = {"base16": DIGITS + "abcdef", "base32": UPPER + "234567", "base36": DIGITS + LOWER, "base62": DIGITS + UPPER + LOWER, "base64": DIGITS + UPPER + LOWER + "+/"}
MIN_LENGTH = {"base16": 24, "base32": 24, "base36": 22, "base62": 20, "base64": 24}
#: Bins of -ln(p), and how many to a unit. P-values below the last bin's count as its own.
BINS, PER_UNIT = 512, 16
#: Bins above LAMBDA = exp(-SURE / PER_UNIT), about 0.47, count as random tokens only.
SURE = 12


def _found(text: Column, pattern: str, kind: int, first: Column) -> Column:
    """Matches of a kind in order: gap before, length, length of the value, and the token for the tests."""
    group = 1 if kind == 0 else 0
    lengths = F.transform(F.split(text, pattern), lambda g: F.length(g))
    match = F.arrays_zip(lengths.alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("v"))
    rows = F.transform(
        F.filter(match, lambda x: x["m"].isNotNull()),
        lambda x, i: F.struct(F.lit(kind).alias("kind"), i.alias("pos"), x["gap"].alias("gap"), F.length(x["m"]).alias("len"), F.length(x["v"]).alias("val"), (x["m"] if kind == 3 else F.lit(None).cast("string")).alias("token")),
    )
    return F.when(first & text.rlike(pattern), rows).otherwise(F.array().cast("array<struct<kind:int,pos:int,gap:int,len:int,val:int,token:string>>"))


def matches(docs: DataFrame) -> DataFrame:
    """``_row, _id, kind, start, end, token`` of all matches; a document without one has a row with a null kind."""
    text = F.coalesce(F.col("_text"), F.lit(""))
    found = F.concat(
        _found(text, ASSIGN, 0, text.rlike("[:=]")),
        _found(text, ACCESS, 1, text.contains("AKIA")),
        _found(text, HEX, 2, F.lit(True)),
        _found(text, TOKEN, 3, text.rlike("[0-9]")),
    )
    rows = docs.select("_row", "_id", found.alias("f")).select("_row", "_id", F.explode_outer("f").alias("x")).select("_row", "_id", "x.*").repartition("_row")
    so_far = Window.partitionBy("_row", "kind").orderBy("pos")
    rows = rows.withColumn("end", F.sum(F.col("gap") + F.col("len")).over(so_far)).withColumn("start", F.col("end") - F.col("len"))
    rows = rows.withColumn("kind", F.when((F.col("kind") != 0) | (F.col("val") >= MIN_VALUE), F.col("kind")))
    # A token that overlaps a base span says nothing new.
    base_end, base_start = F.when(F.col("kind") < 3, F.col("end")), F.when(F.col("kind") < 3, F.col("start"))
    here = Window.partitionBy("_row").orderBy("start")
    before, after = here.rangeBetween(Window.unboundedPreceding, Window.currentRow), here.rangeBetween(Window.currentRow, Window.unboundedFollowing)
    rows = rows.withColumns({"_b": F.max(base_end).over(before), "_a": F.min(base_start).over(after)})
    apart = (F.col("kind") != 3) | ((F.coalesce("_b", F.lit(0)) <= F.col("start")) & (F.coalesce("_a", F.col("end")) >= F.col("end")))
    return rows.select("_row", "_id", F.when(apart, F.col("kind")).alias("kind"), "start", "end", "token")


def _tail(z: Column) -> Column:
    """Upper tail of the normal distribution (logistic form, error below 2e-4), never zero."""
    z = F.least(F.greatest(z, F.lit(-6.0)), F.lit(6.0))
    return 1.0 / (1.0 + F.exp(1.5976 * z + 0.070565 * z * z * z))


def _battery(token: Column, alphabet: str) -> Column:
    """Fisher's combined p-value of the three tests under one alphabet."""
    k, n = len(alphabet), F.length(token).cast("double")
    counts = F.transform(F.array(*map(F.lit, alphabet)), lambda c: F.length(token) - F.length(F.replace(token, c, F.lit(""))))
    squares = F.aggregate(counts, F.lit(0.0), lambda a, x: a + x * x)
    chi = (squares * k / n - n - (k - 1)) / F.sqrt(2.0 * (k - 1) * (n - 1) / n)
    half = F.translate(token, alphabet, "0" * (k // 2) + "1" * (k - k // 2))
    ones = F.length(F.replace(half, F.lit("0"), F.lit(""))).cast("double")
    mean = 2 * ones * (n - ones) / n + 1
    runs = (F.length(F.regexp_replace(half, r"(.)\1+", "$1")) - mean) / F.sqrt(F.greatest((mean - 1) * (mean - 2) / (n - 1), F.lit(0.25)))
    # Symbols as numbers, and their lag-1 products around the middle of the alphabet.
    x = F.transform(F.split(token, ""), lambda c: F.instr(F.lit(alphabet), c) - 1 - (k - 1) / 2)
    moment = F.aggregate(
        x, F.struct(F.lit(0.0).alias("last"), F.lit(0.0).alias("lag"), F.lit(0.0).alias("sq")),
        lambda a, y: F.struct(y.alias("last"), (a["lag"] + a["last"] * y).alias("lag"), (a["sq"] + y * y).alias("sq")),
        lambda a: a["lag"] / F.greatest(a["sq"], F.lit(1e-9)),
    )
    serial = moment * F.sqrt(n)
    two_sided = lambda z: F.least(F.lit(1.0), 2.0 * _tail(F.abs(z)))
    half_x = -(F.ln(_tail(chi)) + F.ln(two_sided(runs)) + F.ln(two_sided(serial)))
    return F.exp(-half_x) * (1 + half_x + half_x * half_x / 2)


def tested(rows: DataFrame) -> DataFrame:
    """Add ``enc``, ``cls`` (length class) and ``bin`` (of the p-value) to the tokens that are long enough for the tests."""
    bare = F.regexp_replace("token", "=+$", "")
    enc = (
        F.when(bare.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$"), "base16").when(bare.rlike("^[A-Z2-7]+$"), "base32")
        .when(bare.rlike("^(?:[a-z0-9]+|[A-Z0-9]+)$"), "base36").when(bare.rlike("^[A-Za-z0-9]+$"), "base62").otherwise("base64")
    )
    rows = rows.withColumns({"enc": enc, "_t": F.when(enc.isin("base16", "base36"), F.lower(bare)).otherwise(F.translate(bare, "-_", "+/"))})
    p, least = F.lit(None).cast("double"), F.lit(None).cast("int")
    for name, alphabet in ALPHABETS.items():
        p = F.when(F.col("enc") == name, _battery(F.col("_t"), alphabet)).otherwise(p)
        least = F.when(F.col("enc") == name, MIN_LENGTH[name]).otherwise(least)
    long_enough = (F.col("kind") == 3) & (F.length("_t") >= least)
    place = F.least(F.floor(-F.ln(F.greatest(p, F.lit(1e-14))) * PER_UNIT), F.lit(BINS - 1)).cast("int")
    return rows.withColumns({"cls": F.when(long_enough, F.floor(F.log2(F.length("_t").cast("double"))).cast("int")), "bin": F.when(long_enough, place)}).drop("_t", "token")


def limits(rows: DataFrame, q: float) -> DataFrame:
    """``cls, limit``: the p-value bin of each length class from which on tokens are ordinary, by both controls."""
    counts = rows.where("bin is not null").groupBy("cls", "bin").agg(F.count("*").alias("n"))
    all_of, below, above = Window.partitionBy("cls"), Window.partitionBy("cls").orderBy(F.desc("bin")), Window.partitionBy("cls").orderBy("bin")
    sure = F.sum(F.when(F.col("bin") < SURE, F.col("n")).otherwise(0)).over(all_of)
    ranked = counts.select("cls", "bin", F.sum("n").over(below).alias("rank"), F.sum("n").over(all_of).alias("m"), F.sum("n").over(above).alias("found"), sure.alias("sure"))
    dismissed = F.exp(-F.col("bin") / PER_UNIT) <= q * F.col("rank") / F.col("m")
    random = (F.col("sure") + 2 * F.sqrt("sure") + 1) / F.lit(1 - math.exp(-SURE / PER_UNIT)) * (1 - F.exp(-(F.col("bin") + 1) / PER_UNIT))
    kept = F.col("found") - random <= q * F.col("found")
    of_class = ranked.groupBy("cls").agg(F.min(F.when(dismissed, F.col("bin"))).alias("_d"), F.max(F.when(kept, F.col("bin") + 1)).alias("_f"))
    return of_class.select("cls", F.least(F.coalesce("_d", F.lit(BINS)), F.coalesce("_f", F.lit(SURE))).alias("limit"))


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", q: float = 0.05) -> DataFrame:
    """``_row, _id, spans`` for every row; spans are ``array<struct<start, kind, end>>`` by start, then kind (a number of ``KINDS``)."""
    own = pick(docs, _id=id_col, _text=text_col).withColumn("_row", F.monotonically_increasing_id())
    rows = stored(tested(matches(own)), "matches")
    # At most one row a length class: 31 of them.
    judged = rows.join(F.broadcast(limits(rows, q)), "cls", "left")
    finding = (F.col("kind") < 3) | (F.col("bin") < F.coalesce("limit", F.lit(BINS)))
    span = F.when(finding, F.struct(F.col("start").cast("long").alias("start"), "kind", F.col("end").cast("long").alias("end")))
    return judged.groupBy("_row").agg(F.first("_id").alias("_id"), F.sort_array(F.collect_list(span)).alias("spans"))


def _named(spans: Column) -> Column:
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"], s["end"])), ",")


def secret_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", q: float = 0.05) -> DataFrame:
    """Counts, digest of the base spans and all spans of every row, as the contract names them."""
    found = secret_spans(docs, id_col, text_col, q)
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        F.col("_id").alias(id_col), count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(_named(F.filter("spans", lambda s: s["kind"] < 3)), 256).alias("base_sha256"), _named(F.col("spans")).alias("spans"), count(3).alias("n_random"),
    )


def redact(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with every span, overlapping ones together, replaced by ``mark``."""
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("out"))

    def step(a: Column, s: Column) -> Column:
        gap = F.substring(text, (a["at"] + 1).cast("int"), (s["start"] - a["at"]).cast("int"))
        inside = F.struct(F.greatest(a["at"], s["end"]).alias("at"), a["out"].alias("out"))
        return F.when((s["start"] < a["at"]) & (F.size(a["out"]) > 0), inside).otherwise(F.struct(s["end"].alias("at"), F.concat(a["out"], F.array(gap, F.lit(mark))).alias("out")))

    return F.aggregate(spans, start, step, lambda a: F.concat(F.array_join(a["out"], ""), F.substring(text, (a["at"] + 1).cast("int"), F.length(text))))
