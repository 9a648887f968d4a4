"""Ingest of documents whose pages arrive over several micro-batches.

State by document: the first place of every content so far, and the counters. A chunk goes on if its content is new or stands before
the one stored, so whatever the order and the batches, the stored rows resolve to what one batch would give. A document's state is dealt out in
buckets of its contents, so one that holds much of the stream is many keys. Needs the RocksDB state store (see :func:`settings`).
A bucket's contents lie in slots by their hash, a value each: what a batch brings to a slot asks the state once and is stored at once, since a call of the state
costs as much as thousands of places. Checkpoints with a value for each content can't be continued.

Stored rows lie in a folder for each micro-batch, which a replay overwrites: ``kind`` is chunk (a first place), counted (a bucket's counters so far) or
finished (the last ones: nothing came for ``idle_ms`` and the state is gone; contents that come later count anew, but are stored once all the same).
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.stateful_processor import StatefulProcessor
from pyspark.sql.types import StructType

from docflow.functions import text as X
from docflow.operators import chunks, ingest, retrieval
from docflow.plugins import hash_embedding
from docflow.schema import IngestConfig, SplitConfig

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
COUNTERS = ["inputs_seen", "inputs_non_empty", "chunks_before_filter", "filtered_out", "deduped_out", "stored"]
#: The key and place of a chunk, its counters and, as JSON, the chunk.
_OUT = f"document_id string, bucket int, kind string, epoch bigint, payload string, {', '.join(f'{c} bigint' for c in COUNTERS)}"
ORDER = ["page", "section", "part"]
BUCKETS = 16
#: Slots of a bucket's contents; 128 of a bucket of a million contents have 344 kB each.
SLOTS = 128
#: A content's hash and the numbers of its place.
_PLACE = np.dtype([("key", "V20"), ("place", "<i8", (len(ORDER),))])


def settings(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def _places(body: bytes | None) -> dict[bytes, tuple[int, ...]]:
    """The first places in a slot."""
    found = np.frombuffer(body or b"", _PLACE)
    return dict(zip((x.tobytes() for x in found["key"]), map(tuple, found["place"].tolist()), strict=True))


def _body(places: dict[bytes, tuple[int, ...]]) -> bytes:
    out = np.empty(len(places), _PLACE)
    out["key"] = np.frombuffer(b"".join(places), "V20")
    out["place"] = np.array(list(places.values()), np.int64)
    return out.tobytes()


class FirstPlaces(StatefulProcessor):
    """Of each content of a document's bucket, the first place; and the bucket's counters."""

    def __init__(self, idle_ms: int | None) -> None:
        self.idle_ms = idle_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.slots = handle.getMapState("slots", "slot int", "places binary")
        self.counts = handle.getValueState("counts", f"epoch bigint, {', '.join(f'{c} bigint' for c in COUNTERS)}")

    def _row(self, key, kind: str, counts: tuple) -> pd.DataFrame:
        return pd.DataFrame([{"document_id": key[0], "bucket": key[1], "kind": kind, "epoch": counts[0], "payload": None} | dict(zip(COUNTERS, counts[1:], strict=True))])

    def _better(self, firsts: pd.DataFrame) -> tuple[list[int], int]:
        """Rows whose content is new or stands before the one stored, which they replace; and how many are new."""
        better, fresh, by_slot = [], 0, {}
        for at, content, *place in firsts[["key", *ORDER]].itertuples(name=None):
            key = bytes.fromhex(content)
            by_slot.setdefault(key[0] % SLOTS, []).append((at, key, tuple(int(x) for x in place)))
        for slot, found in by_slot.items():
            held = self.slots.getValue((slot,))
            places, changed = _places(bytes(held[0]) if held else None), len(better)
            for at, key, place in found:
                before = places.get(key)
                if before is None or place < before:
                    places[key] = place
                    better.append(at)
                    fresh += before is None
            if len(better) > changed:
                self.slots.updateValue((slot,), (_body(places),))
        return better, fresh

    def handleInputRows(self, key, rows, timerValues):
        now = timerValues.getCurrentProcessingTimeInMs() if self.idle_ms is not None else 0
        held = self.counts.get()
        epoch, n = (int(held[0]), np.array(held[1:], np.int64)) if held else (now, np.zeros(len(COUNTERS), np.int64))
        for batch in rows:
            found = batch[batch["is_chunk"]]
            kept = found[found["long_enough"]]
            pages = batch[~batch["is_chunk"]]
            n[:4] += [len(pages), int(pages["long_enough"].sum()), len(found), len(found) - len(kept)]
            # Equal contents of a batch count once. Rows without a key are not deduplicated.
            firsts = kept[kept["key"].notna()].sort_values(ORDER, kind="stable").drop_duplicates("key")
            new = kept[kept["key"].isna()]
            better, fresh = self._better(firsts)
            fresh += len(new)
            n[4:] += [len(kept) - fresh, fresh]
            out = pd.concat([new, firsts.loc[better]])
            if len(out):
                empty = pd.array([None] * len(out), "Int64")
                yield pd.DataFrame({"document_id": key[0], "bucket": key[1], "kind": "chunk", "epoch": epoch, "payload": out["payload"].to_numpy()} | dict.fromkeys(COUNTERS, empty))
        counts = (epoch, *n.tolist())
        self.counts.update(counts)
        if self.idle_ms is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(now + self.idle_ms)
        yield self._row(key, "counted", counts)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        held = self.counts.get()
        self.slots.clear()
        self.counts.clear()
        if held:
            yield self._row(key, "finished", tuple(int(x) for x in held))

    def close(self) -> None:
        pass


def _split(pages: DataFrame, mode: str, cfg: SplitConfig) -> DataFrame:
    return chunks.split_texts(pages, "document_id", "page", "text", mode, cfg)


def accumulated(pages: DataFrame, mode: str = "recursive", cfg: SplitConfig = SplitConfig(), rules: IngestConfig = IngestConfig(), idle_ms: int | None = None, buckets: int = BUCKETS, split: Callable[[DataFrame], DataFrame] | None = None) -> tuple[DataFrame, StructType]:  # noqa: B008
    """Stored rows of a stream of ``document_id, page, text``, and the columns of the chunks in them.

    With ``idle_ms``, state that long without a page goes; timers keep a query running, so a run that is to end (``availableNow``) has none.
    """
    pages = pages.select(F.col("document_id").cast("string"), "page", "text")
    made = split(pages) if split else _split(pages, mode, cfg)
    key = F.sha1(F.encode(X.normalize(F.col("content")), "UTF-8")) if rules.dedupe else F.lit(None).cast("string")
    # Nulls come first, as they do in a batch.
    place = [F.coalesce(F.col(c).cast("long"), F.lit(-(1 << 62))).alias(c) for c in ORDER]
    bucket = lambda *c: F.pmod(F.xxhash64(*c), F.lit(buckets)).cast("int").alias("bucket")
    known = made.select("*", key.alias("_key"))
    of_chunks = known.select("document_id", bucket(F.coalesce("_key", "content")), F.lit(True).alias("is_chunk"), F.col("_key").alias("key"), ingest.long_enough(F.col("content"), rules.min_chars).alias("long_enough"), *place, F.to_json(F.struct(*made.columns)).alias("payload"))
    filled: Column = X.strip(F.coalesce(F.col("text"), F.lit(""))) != ""
    nothing = F.lit(None).cast("string")
    of_pages = pages.select("document_id", bucket("page", "text"), F.lit(False).alias("is_chunk"), nothing.alias("key"), filled.alias("long_enough"), *[F.lit(0).cast("long").alias(c) for c in ORDER], nothing.alias("payload"))
    out = of_chunks.unionByName(of_pages).groupBy("document_id", "bucket").transformWithStateInPandas(FirstPlaces(idle_ms), _OUT, "Update", "None" if idle_ms is None else "ProcessingTime")
    return out, made.schema


def into_folder(pages: DataFrame, path: str, embed=hash_embedding, **options) -> DataStreamWriter:
    """A writer that stores what a page stream adds, micro-batch by micro-batch; a document's pages may come in any of them. No vectors without ``embed``."""
    rows, kind = accumulated(pages, **options)

    def store(batch: DataFrame, number: int) -> None:
        flat = batch.withColumn("c", F.from_json("payload", kind)).select("kind", "bucket", "epoch", F.col("document_id").alias("_document"), *COUNTERS, *[F.col(f"c.{f.name}").alias(f.name) for f in kind])
        (retrieval.embedded(flat, "content", embed) if embed else flat).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return rows.writeStream.foreachBatch(store).outputMode("update")


def stored_chunks(spark: SparkSession, path: str) -> DataFrame:
    """The chunks: of equal contents of a document the first."""
    rows = spark.read.parquet(path).where("kind = 'chunk'")
    return ingest.first_of_equal(rows.drop("kind", "bucket", "epoch", "batch", "_document", *COUNTERS), "document_id", "content", ORDER)


def stored_counters(spark: SparkSession, path: str) -> DataFrame:
    """The counters of every document: the last of each bucket, added up."""
    rows = spark.read.parquet(path).where("kind != 'chunk'")
    last = rows.groupBy("_document", "bucket", "epoch").agg(F.max_by(F.struct(*COUNTERS), "batch").alias("c"))
    total = last.groupBy(F.col("_document").alias("document_id")).agg(*[F.sum(f"c.{c}").alias(c) for c in COUNTERS])
    return total.withColumn("status", F.when(F.col("stored") > 0, "success").otherwise("error"))
