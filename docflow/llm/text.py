"""Column helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: One white-space character of the word contract: blank and U+0009 to U+000D, nothing else.
WS = r"[\x20\x09-\x0D]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text; null and blank texts have none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), WS + "+"), "")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only, as the contracts ask; other letters stay."""
    return F.translate(text, UPPER, LOWER)


def pick(df: DataFrame, **cols: str) -> DataFrame:
    """Only the named columns, under the operator's own names.

    Everything else is left behind, so extra columns of the input can't clash
    with the working columns of an operator.
    """
    return df.select(*[F.col(f"`{c}`").alias(name) for name, c in cols.items()])
