"""Writes that follow each other and may be tried again: nothing is written twice, nothing out of order.

``docflow_once`` is a Spark data source for writing (options ``path`` and ``key``). Tasks write parts, a commit named by the key says which of them count; it
is made once, so another try with the same key, after whatever went wrong, adds nothing. Parts of tries that broke off are never listed.
:func:`ordered` writes several tables one after the other under one key: an intent says what is to come, steps that are done are passed over,
and each has a few attempts with growing waits. Paths are of any file system that pyarrow opens.
"""

from __future__ import annotations

import json
import re
import time
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

#: Attempts of a step, and the first and longest wait in seconds.
ATTEMPTS, FIRST_WAIT, LONGEST_WAIT = 3, 1.0, 8.0


@dataclass
class Part(WriterCommitMessage):
    name: str
    rows: int


def _named(key: str) -> str:
    """Keys are file names."""
    if not re.fullmatch(r"[\w.-]+", key or ""):
        raise ValueError(f"not a key: {key!r}")
    return key


def _open(path: str) -> tuple[fs.FileSystem, str]:
    system, root = fs.FileSystem.from_uri(path)
    return system, root.rstrip("/")


def _exists(path: str) -> bool:
    system, found = _open(path)
    return system.get_file_info(found).type == fs.FileType.File


def _put(path: str, value: dict) -> None:
    """A small file that is whole as soon as it is there."""
    system, found = _open(path)
    system.create_dir(found.rpartition("/")[0], recursive=True)
    beside = f"{found}.{uuid.uuid4().hex}"
    with system.open_output_stream(beside) as out:
        out.write(json.dumps(value).encode())
    system.move(beside, found)


class OnceWriter(DataSourceArrowWriter):
    def __init__(self, path: str, key: str) -> None:
        self.path, self.key = path.rstrip("/"), _named(key)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Part:
        """One task's rows in a part of its own."""
        system, root = _open(self.path)
        name, rows, out = f"{self.key}-{uuid.uuid4().hex}.parquet", 0, None
        system.create_dir(f"{root}/parts", recursive=True)
        try:
            for batch in iterator:
                out = out or pq.ParquetWriter(f"{root}/parts/{name}", batch.schema, filesystem=system)
                out.write_batch(batch)
                rows += batch.num_rows
        finally:
            if out:
                out.close()
        return Part(name if out else "", rows)

    def commit(self, messages: list[Part | None]) -> None:
        """Make the parts count, unless an earlier try has."""
        parts = [m for m in messages if m and m.name]
        if _exists(f"{self.path}/commits/{self.key}.json"):
            self.abort(messages)
            return
        _put(f"{self.path}/commits/{self.key}.json", {"parts": [m.name for m in parts], "rows": sum(m.rows for m in parts)})

    def abort(self, messages: list[Part | None]) -> None:
        """Delete the parts of the tasks that went through."""
        system, root = _open(self.path)
        for m in messages:
            if m and m.name and system.get_file_info(f"{root}/parts/{m.name}").type == fs.FileType.File:
                system.delete_file(f"{root}/parts/{m.name}")


class OnceSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "docflow_once"

    def writer(self, schema, overwrite: bool) -> OnceWriter:
        if overwrite:
            raise ValueError("docflow_once only appends")
        return OnceWriter(self.options["path"], self.options["key"])


def committed(path: str, key: str) -> bool:
    return _exists(f"{path.rstrip('/')}/commits/{_named(key)}.json")


def write_once(rows: DataFrame, path: str, key: str) -> None:
    """Append ``rows`` under ``key``; a key that has been written adds nothing, and ``rows`` are not worked out."""
    if not committed(path, key):
        rows.sparkSession.dataSource.register(OnceSource)
        rows.write.format("docflow_once").option("path", path).option("key", key).mode("append").save()


def read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """All rows that count."""
    system, root = _open(path)
    info = system.get_file_info(fs.FileSelector(f"{root}/commits", allow_not_found=True))
    names = []
    for i in info:
        if i.base_name.endswith(".json"):
            with system.open_input_stream(i.path) as found:
                names += json.loads(found.read())["parts"]
    where = path.rstrip("/")
    return spark.read.schema(schema).parquet(*[f"{where}/parts/{n}" for n in names]) if names else spark.createDataFrame([], schema)


def retried(step: Callable[[], object], attempts: int = ATTEMPTS, first: float = FIRST_WAIT, longest: float = LONGEST_WAIT, sleep: Callable[[float], None] = time.sleep) -> object:
    """``step()``, tried again after waits that double, from ``first`` to ``longest`` seconds; the last failure is raised."""
    for n in range(1, attempts + 1):
        try:
            return step()
        except Exception:
            if n == attempts:
                raise
            sleep(min(longest, first * 2 ** (n - 1)))
    return None


def ordered(path: str, key: str, steps: list[tuple[str, Callable[[], DataFrame]]], attempts: int = ATTEMPTS, sleep: Callable[[float], None] = time.sleep) -> list[str]:
    """Write the steps' rows one after the other; returns the names of those that were written now.

    A step's frame is made only when its turn comes. If a step fails for good, those after it aren't begun; the same call later goes on there.
    """
    done, names = [], [name for name, _ in steps]
    if not _exists(f"{path.rstrip('/')}/intents/{_named(key)}.json"):
        retried(lambda: _put(f"{path.rstrip('/')}/intents/{key}.json", {"steps": names}), attempts, sleep=sleep)
    for name, rows in steps:
        if not committed(path, f"{key}.{name}"):
            retried(lambda: write_once(rows(), path, f"{key}.{name}"), attempts, sleep=sleep)  # noqa: B023
            done.append(name)
    return done


def unfinished(path: str) -> list[tuple[str, list[str]]]:
    """Keys whose intent has steps that aren't written, with these steps."""
    system, root = _open(path)
    out = []
    for i in system.get_file_info(fs.FileSelector(f"{root}/intents", allow_not_found=True)):
        if i.base_name.endswith(".json"):
            key = i.base_name[: -len(".json")]
            with system.open_input_stream(i.path) as found:
                if left := [s for s in json.loads(found.read())["steps"] if not committed(path, f"{key}.{s}")]:
                    out.append((key, left))
    return sorted(out)
