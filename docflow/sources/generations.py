"""The vector index in generations: a write never touches what readers have open.

Rows of a write go to a folder of their own, then the documents it replaced or removed to a list of their own, and last
a commit, a small file made only if it isn't there, names the lists that count. Whatever breaks off before the commit changes nothing and is in
nobody's way, since every folder has a new name and a commit takes the next number. Two writers: the later one finds its number taken and commits on top of the other.

A snapshot is pinned to a commit, so a reader finishes on its rows though newer ones exist. :func:`clean` deletes what neither the
last commits nor a recent write need.

Lists have a row for each document that a write changed. From ``MERGE`` lists on, a write merges them into one first.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from docflow.functions.text import model_directory
from docflow.sources import index

#: Lists of one commit at most.
MERGE = 16
TRIES = 5
LISTED = "embedding_model string, document_id string, folder string, number bigint"


class Taken(Exception):
    """Another writer has committed under this number."""


@dataclass(frozen=True)
class Snapshot:
    """The index as of a commit: number 0 is an index without one."""

    spark: SparkSession
    root: str
    number: int
    lists: tuple[str, ...]

    def documents(self) -> DataFrame:
        """``embedding_model, document_id, folder`` of every document: what the last list says of it."""
        if not self.lists:
            return self.spark.createDataFrame([], LISTED).drop("number")
        rows = self.spark.read.schema(LISTED).parquet(*[f"{self.root}/lists/{x}" for x in self.lists])
        last = rows.groupBy("embedding_model", "document_id").agg(F.max_by("folder", "number").alias("folder"))
        return last.where(F.col("folder").isNotNull())

    def load(self, model: str, document: str | None = None) -> DataFrame | None:
        """Rows of a model, or of one of its documents; None where there are none."""
        own = self.documents().where(F.col("embedding_model") == model_directory(F.lit(model)))
        own = own if document is None else own.where(F.col("document_id") == document)
        # One name a write that still counts.
        folders = [r["folder"] for r in own.select("folder").distinct().collect()]
        if not folders:
            return None
        with _ids_as_strings(self.spark):
            rows = self.spark.read.option("basePath", f"{self.root}/data").option("mergeSchema", "true").parquet(*[f"{self.root}/data/folder={x}" for x in folders])
        rows = rows.where(F.col("embedding_model") == model_directory(F.lit(model)))
        rows = rows if document is None else rows.where(F.col("document_id") == document)
        return rows.join(own.select("folder", "document_id"), ["folder", "document_id"], "left_semi").drop("folder")


@contextmanager
def _ids_as_strings(spark: SparkSession) -> Iterator[None]:
    """Partition values stay as they are written: 007 is no number."""
    name = "spark.sql.sources.partitionColumnTypeInference.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _path(spark: SparkSession, path: str):
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark._jsc.hadoopConfiguration()), found


def _names(spark: SparkSession, path: str) -> dict[str, int]:
    """Names in a folder, with the times they were changed."""
    system, found = _path(spark, path)
    return {s.getPath().getName(): s.getModificationTime() for s in system.listStatus(found)} if system.exists(found) else {}


def _read(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path, wholetext=True).first()[0])


def _create(spark: SparkSession, path: str, text: str) -> None:
    """A file that must not be there yet."""
    system, found = _path(spark, path)
    try:
        out = system.create(found, False)
    except Exception as e:
        if system.exists(found):
            raise Taken(path) from e
        raise
    out.write(bytearray(text.encode()))
    out.close()


def _commits(spark: SparkSession, root: str) -> list[int]:
    return sorted(int(n) for n in _names(spark, f"{root}/commits") if n.isdigit())


def snapshot(spark: SparkSession, root: str, number: int | None = None) -> Snapshot:
    """The index as of a commit, by default the last one that is whole."""
    for n in sorted(_commits(spark, root), reverse=True) if number is None else [number]:
        try:
            return Snapshot(spark, root, n, tuple(_read(spark, f"{root}/commits/{n:012d}")["lists"]))
        except (ValueError, TypeError):
            # A writer died while it wrote the commit: its number is used up, what it would have said isn't.
            if number is not None:
                raise
    return Snapshot(spark, root, 0, ())


def _step(name: str) -> None:
    """Between the steps of a write; tests break off here."""


def _commit(spark: SparkSession, root: str, changed: DataFrame) -> int:
    """Commit ``changed`` (``embedding_model, document_id, folder``; no folder: removed) on top of the last commit."""
    for _ in range(TRIES):
        base = snapshot(spark, root)
        number = max([0, *_commits(spark, root)]) + 1
        lists, rows = list(base.lists), changed.withColumn("number", F.lit(number).cast("long"))
        if len(lists) >= MERGE:
            old = base.documents().join(changed, ["embedding_model", "document_id"], "left_anti")
            lists, rows = [], rows.where(F.col("folder").isNotNull()).unionByName(old.withColumn("number", F.lit(number).cast("long")))
        name = f"{number:012d}-{uuid.uuid4().hex}"
        rows.select("embedding_model", "document_id", "folder", "number").write.parquet(f"{root}/lists/{name}")
        _step("listed")
        try:
            _create(spark, f"{root}/commits/{number:012d}", json.dumps({"lists": [*lists, name]}))
            return number
        except Taken:
            continue
    raise Taken(f"{root}: {TRIES} other writers came first")


def save(chunks: DataFrame, root: str, model: str) -> int:
    """Replace all documents in ``chunks``; other documents stay. Returns the commit's number; no rows make no commit."""
    spark, folder = chunks.sparkSession, uuid.uuid4().hex
    index.save(chunks, f"{root}/data/folder={folder}", model)
    _step("written")
    if not _names(spark, f"{root}/data/folder={folder}").keys() - {"_SUCCESS"}:
        return snapshot(spark, root).number
    with _ids_as_strings(spark):
        rows = spark.read.option("basePath", f"{root}/data/folder={folder}").parquet(f"{root}/data/folder={folder}")
    return _commit(spark, root, rows.select("embedding_model", "document_id").distinct().withColumn("folder", F.lit(folder)))


def remove(spark: SparkSession, root: str, model: str, documents: DataFrame) -> int:
    """Remove the documents named in ``document_id``."""
    named = documents.select(model_directory(F.lit(model)).alias("embedding_model"), F.col("document_id").cast("string").alias("document_id")).distinct()
    return _commit(spark, root, named.withColumn("folder", F.lit(None).cast("string")))


def clean(spark: SparkSession, root: str, keep: int = 2, older_ms: int = 86_400_000) -> int:
    """Delete folders and lists that none of the last ``keep`` commits needs and that are older than ``older_ms``; returns how many.

    A write that is under way is younger than that. Readers of earlier commits must have finished.
    """
    whole = []
    for n in sorted(_commits(spark, root), reverse=True):
        try:
            whole.append(snapshot(spark, root, n))
        except (ValueError, TypeError):
            continue
        if len(whole) == keep:
            break
    lists = {x for s in whole for x in s.lists}
    folders = {f"folder={r['folder']}" for s in whole for r in s.documents().select("folder").distinct().collect()}
    now, gone = spark._jvm.java.lang.System.currentTimeMillis(), 0
    for kind, needed in (("data", folders), ("lists", lists)):
        for name, at in _names(spark, f"{root}/{kind}").items():
            if name not in needed and now - at >= older_ms:
                system, found = _path(spark, f"{root}/{kind}/{name}")
                gone += system.delete(found, True)
    return gone
