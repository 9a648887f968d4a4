"""Pages of uploaded files as a Spark data source: ``spark.read.format("docflow_pages")``.

Options: ``path`` (a file or folder of any file system that pyarrow opens), ``password``, ``rangeBytes`` (above it a file is read in
ranges of pages), and ``decoder.<suffix>`` (``module:Class``) for further formats. Rows are ``document_id, page, total, text, error``; a file that can't be read, opened or
decoded is one row with an error and no page, and the others go on.

Filters on ``document_id`` and ``page`` choose files and ranges before anything is read (the session must have
``spark.sql.python.filterPushdown.enabled``, see :func:`register`, or the read ``pushdown`` as false). Files up to ``rangeBytes`` are one task's work each, and the driver reads none of them.
A larger file is gone through once when the read is planned, a few bytes at a time, for the places where its ranges begin; its tasks then read their own range only.
"""

from __future__ import annotations

import fnmatch
import importlib
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Protocol

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual

SCHEMA = "document_id string, page int, total int, text string, error string"
FAILED, LOCKED = "PDF processing failed", "password required"
RANGE_BYTES = 64 << 20
#: Bytes read at a time.
CHUNK = 1 << 20
#: Rows of one batch.
BATCH = 256
_KINDS = [pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string()]
_NAMES = ["document_id", "page", "total", "text", "error"]


class Locked(Exception):
    """The file needs a password, or another one."""


@dataclass(frozen=True)
class Range:
    """Pages ``first`` to ``last`` (None: the end) of a file, and the bytes that a decoder asked for them."""

    first: int = 1
    last: int | None = None
    start: int = 0
    end: int | None = None
    total: int | None = None


class Decoder(Protocol):
    """A format. ``ranges`` may cut a file without holding it; ``pages`` gives number, total and text of a range's pages."""

    def ranges(self, file: pa.NativeFile, password: str | None, size: int) -> list[Range]: ...

    def pages(self, file: pa.NativeFile, password: str | None, part: Range) -> Iterator[tuple[int, int, str]]: ...


class TextPages:
    """Plain text, UTF-8, pages parted by form feeds."""

    def ranges(self, file, password, size):
        starts, at = [0], 0
        while chunk := file.read(CHUNK):
            found = -1
            while (found := chunk.find(b"\f", found + 1)) >= 0:
                starts.append(at + found + 1)
            at += len(chunk)
        out, first = [], 0
        for k in range(1, len(starts) + 1):
            end = starts[k] if k < len(starts) else at + 1
            if k == len(starts) or end - starts[first] >= size:
                out.append(Range(first + 1, k, starts[first], end - 1, len(starts)))
                first = k
        return out

    def pages(self, file, password, part):
        file.seek(part.start)
        data = file.read() if part.end is None else file.read(part.end - part.start)
        pages = data.split(b"\f")
        for k, page in enumerate(pages):
            yield part.first + k, part.total or len(pages), page.decode("utf-8", "replace")


@dataclass
class PagePartition(InputPartition):
    path: str
    part: Range


def _decoder(path: str, options: dict) -> Decoder | None:
    suffix = path.rpartition(".")[2].lower()
    if named := options.get(f"decoder.{suffix}"):
        module, _, name = named.partition(":")
        return getattr(importlib.import_module(module), name)()
    return TextPages() if suffix == "txt" else None


class PlainReader(DataSourceReader):
    """Reads all pages."""

    def __init__(self, options: dict) -> None:
        self.options = {k.lower(): v for k, v in options.items()}
        self.documents: set[str] | None = None
        self.low, self.high = 1, None
        #: No page has a number while a filter asks for one.
        self.numbered = False

    def _wanted(self, part: Range) -> bool:
        return (part.last is None or part.last >= self.low) and (self.high is None or part.first <= self.high)

    def _files(self) -> list[tuple[str, int]]:
        system, path = fs.FileSystem.from_uri(self.options["path"])
        pattern = None
        if "*" in path:
            path, _, pattern = path.rpartition("/")
        info = system.get_file_info(path)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.options["path"])
        found = [info] if info.type == fs.FileType.File else [i for i in system.get_file_info(fs.FileSelector(path)) if i.type == fs.FileType.File]
        return sorted((i.path, i.size) for i in found if pattern is None or fnmatch.fnmatch(i.base_name, pattern))

    def partitions(self) -> list[PagePartition]:
        size, out = int(self.options.get("rangebytes", RANGE_BYTES)), []
        system, _ = fs.FileSystem.from_uri(self.options["path"])
        for path, bytes_ in self._files():
            if self.documents is not None and path.rpartition("/")[2] not in self.documents:
                continue
            parts, decoder = [Range()], _decoder(path, self.options)
            if decoder and bytes_ > size:
                try:
                    with system.open_input_file(path) as file:
                        parts = decoder.ranges(file, self.options.get("password"), size)
                except Exception:  # noqa: BLE001 - the task says what is wrong with this file
                    parts = [Range()]
            out += [PagePartition(path, p) for p in parts if self._wanted(p)]
        return out

    def read(self, partition: PagePartition) -> Iterator[pa.RecordBatch]:
        name, rows = partition.path.rpartition("/")[2], []
        batch = lambda rows: pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(_KINDS)], _NAMES)
        system, _ = fs.FileSystem.from_uri(self.options["path"])
        try:
            decoder = _decoder(partition.path, self.options)
            if decoder is None:
                raise ValueError(f"no decoder for {name}")
            with system.open_input_file(partition.path) as file:
                for page, total, text in decoder.pages(file, self.options.get("password"), partition.part):
                    if page >= self.low and (self.high is None or page <= self.high):
                        rows.append((name, page, total, text, None))
                    if len(rows) == BATCH:
                        yield batch(rows)
                        rows = []
        except Exception as e:  # noqa: BLE001 - a broken file must not stop the others
            rows += [] if self.numbered else [(name, None, None, None, LOCKED if isinstance(e, Locked) else FAILED)]
        if rows:
            yield batch(rows)


class PageReader(PlainReader):
    """Reads what filters on document and page leave."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Filters on document and page are wholly done here; others go back."""
        for f in filters:
            name = ".".join(f.attribute) if hasattr(f, "attribute") else ""
            if name == "document_id" and isinstance(f, EqualTo | In):
                wanted = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.documents = wanted if self.documents is None else self.documents & wanted
            elif name == "page" and isinstance(f, EqualTo | GreaterThan | GreaterThanOrEqual | LessThan | LessThanOrEqual):
                self.numbered = True
                if isinstance(f, EqualTo | GreaterThan | GreaterThanOrEqual):
                    self.low = max(self.low, f.value + isinstance(f, GreaterThan))
                if isinstance(f, EqualTo | LessThan | LessThanOrEqual):
                    most = f.value - isinstance(f, LessThan)
                    self.high = most if self.high is None else min(self.high, most)
            elif name == "page" and isinstance(f, IsNotNull):
                self.numbered = True
            elif not (name == "document_id" and isinstance(f, IsNotNull)):
                yield f


class PageSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "docflow_pages"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> PlainReader:
        if not self.options.get("path"):
            raise ValueError("option path is required")
        return (PlainReader if self.options.get("pushdown") == "false" else PageReader)(dict(self.options))


def register(spark: SparkSession) -> None:
    """Make the source known to the session and let filters reach it."""
    spark.dataSource.register(PageSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
