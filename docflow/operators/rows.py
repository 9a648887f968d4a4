"""Rows from arrays, and filters on computed columns, without computing them twice.

A filter on a computed column, and the one the optimizer infers for ``explode``,
moves below the projection and repeats its expression there. An outer explode has
no inferred filter, and nothing moves below it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F


def unnest(df: DataFrame, keep: list[str], array: Column, place: str, value: str) -> DataFrame:
    """``keep, place, value``: a row for each element of ``array``; empty and null arrays give none."""
    return df.select(*keep, F.posexplode_outer(array).alias(place, value)).where(F.col(place).isNotNull())


def passing(df: DataFrame, keep: list[str], value: Column, name: str, test: Callable[[Column], Column]) -> DataFrame:
    """``keep, name``: the rows whose computed ``value`` passes the test."""
    return unnest(df, keep, F.filter(F.array(value), test), "_place", name).drop("_place")
