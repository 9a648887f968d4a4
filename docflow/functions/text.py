"""Text functions, Column to Column.

Patterns use Java's ``(?U)`` (Unicode classes), and ``d`` where lines matter, so
white space, digits and word characters are those of Unicode and only a line feed
ends a line.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

#: Words and patterns that decide results.
WHITE = " \t\n\x0b\f\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
BOILERPLATE_WORD = r"(?iU)\b(?:Confidential|Draft)\b"
BOILERPLATE_LINE = r"(?mdiU)^(?:\s*(?:Confidential|Draft|\d+)\s*)$"
LABEL_AND_NUMBER = r"(?mdiU)^([^\n:]{2,}?:)\s*\n\s*(\d{3,})\s*$"
HEADING = r"(?sU)^\s{0,3}#{1,6}\s*([^\n#].*?)\s*\z"


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once, however often it is referred to, also inside lambdas."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def strip(text: Column) -> Column:
    """Without white space at both ends."""
    return F.btrim(text, F.lit(WHITE))


def rstrip(text: Column) -> Column:
    return F.rtrim(text, F.lit(WHITE))


def normalize(text: Column) -> Column:
    """White space collapsed to one blank and trimmed; null becomes empty."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " "))


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), r"(?U)\s+"), "")


def word_count(text: Column) -> Column:
    return F.size(words(text))


def token_count(text: Column) -> Column:
    """Estimate: 1.3 tokens a word and 0.2 a character, at least one."""
    n = word_count(text) * F.lit(1.3) + F.length(F.coalesce(text, F.lit(""))) * F.lit(0.2)
    return F.greatest(F.lit(1), n.cast("int"))


def _replaced(text: Column, pattern: str, by: str, *signs: str) -> Column:
    """``regexp_replace`` for texts that hold one of the signs without which the pattern can't match."""

    def use(t: Column) -> Column:
        some = t.contains(signs[0])
        for sign in signs[1:]:
            some = some | t.contains(sign)
        return F.when(some, F.regexp_replace(t, pattern, by)).otherwise(t)

    return bound(text, use)


def _squeezed(text: Column) -> Column:
    return _replaced(_replaced(text, "[ \t]+", " ", "  ", "\t"), "\n{3,}", "\n\n", "\n\n\n")


def page_clean(text: Column) -> Column:
    """Page text without boilerplate words, blank lines and lines of digits; lines trimmed."""
    lines = F.transform(F.split(_squeezed(F.regexp_replace(F.coalesce(text, F.lit("")), BOILERPLATE_WORD, "")), "\n"), strip)
    return F.array_join(F.filter(lines, lambda x: (x != "") & ~x.rlike(r"^\p{Nd}+$")), "\n")


def boilerplate_clean(text: Column) -> Column:
    """Chunk input: numbers joined to their label, boilerplate and blank lines removed, line ends trimmed."""
    joined = _replaced(F.coalesce(text, F.lit("")), LABEL_AND_NUMBER, "$1 $2", ":")
    lines = F.transform(F.split(_squeezed(F.regexp_replace(joined, BOILERPLATE_LINE, "")), "\n"), rstrip)
    return F.array_join(F.array_remove(lines, ""), "\n")


def heading_text(line: Column) -> Column:
    """Text of a markdown heading, or empty."""
    return F.regexp_extract(line, HEADING, 1)


def is_heading(line: Column) -> Column:
    return line.rlike(HEADING)


def headings(text: Column) -> Column:
    """``array<struct<text, level>>``; the level counts the hashes a line starts with."""
    found = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), is_heading)
    return F.transform(found, lambda x: F.struct(strip(heading_text(x)).alias("text"), F.length(F.regexp_extract(x, "^(#*)", 1)).alias("level")))


def view_text(items: Column) -> Column:
    """Items of a page joined by a blank, white space collapsed, trimmed."""
    return F.trim(F.regexp_replace(F.array_join(items, " "), r"(?U)\s+", " "))


def highlights(content: Column, question: Column) -> Column:
    """Words of the question that occur in the content as whole words, in any case; order and repeats kept."""
    # \E inside a word would end the quotation.
    quoted = lambda w: F.concat(F.lit(r"(?iU)\b\Q"), F.replace(w, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E\b"))
    return bound(F.coalesce(content, F.lit("")), lambda c: F.filter(words(question), lambda w: F.regexp_like(c, quoted(w))))


def model_directory(model: Column) -> Column:
    return F.replace(model, F.lit("/"), F.lit("_"))


def page_indicator(number: Column, total: Column | None = None) -> Column:
    return F.concat(F.lit("Page "), number.cast("string"), *([] if total is None else [F.lit("/"), total.cast("string")]))


def jwt_payload(token: Column, schema: str) -> Column:
    """Claims of a token, not verified."""
    part = F.translate(F.split_part(token, F.lit("."), F.lit(2)), "-_", "+/")
    return F.from_json(F.unbase64(F.rpad(part, (F.length(part) + 3 - (F.length(part) + 3) % 4).cast("int"), "=")).cast("string"), schema)


def date_display(at: Column) -> Column:
    return F.date_format(at, "d MMM yyyy")
