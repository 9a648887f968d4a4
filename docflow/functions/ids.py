"""Deterministic identifiers: the first 16 hex digits of a version-5 UUID in the URL namespace."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from docflow.functions.text import normalize

#: RFC 9562: namespace of names that are URLs.
URL_NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"


def name_id(name: Column) -> Column:
    digest = F.substring(F.sha1(F.concat(F.unhex(F.lit(URL_NAMESPACE)), F.encode(name, "UTF-8"))), 1, 16)
    return F.overlay(digest, F.lit("5"), 13, 1)


def chunk_id(document: Column, page: Column, heading: Column, kind: Column, content: Column) -> Column:
    """Id of a chunk from its place and the first 160 characters; chunks that agree in these share it."""
    parts = [normalize(x.cast("string")) for x in (document, page, heading, kind, F.substring(content, 1, 160))]
    return name_id(F.concat_ws("|", *parts))


def page_id(document: Column, page: Column) -> Column:
    return name_id(F.concat_ws(":", document.cast("string"), page.cast("string")))
