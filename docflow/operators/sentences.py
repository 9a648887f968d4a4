"""Texts split by sentence distance, with every distinct sentence embedded once.

For embedders that cost more than a shuffle. Texts are told by their hash, so a text that many rows hold is split once; the
sentences of all texts make a dictionary of distinct ones, which the embedder gets in full batches; unit
vectors are joined back, neighbours compared through ``lag``, and the percentile taken per text, all in the plan.
Between the dictionary and the cuts only hashes, places and vectors move. A text's cuts (places of sentences) are written to the shared folder,
so no later step or action embeds again, and join the rows, whose texts move this once and are cut where they are.

Defined results: null and blank texts give no row; rows that aren't flagged stay whole; repeated rows are split each; texts
with a sentence that the embedder fails on are split by separators and have ``instead`` set, others in the same batch aren't
touched by it; distances count to 12 decimals; an empty table gives an empty result; extra columns are carried along.
"""

from __future__ import annotations

import logging
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from docflow.functions import text as X
from docflow.operators import chunks
from docflow.operators.rows import unnest
from docflow.schema import SplitConfig
from docflow.sources.workspace import new_path

log = logging.getLogger(__name__)
#: Sentences that the embedder gets at a time.
BATCH = 256


def _stored(df: DataFrame, name: str) -> DataFrame:
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _hash(text: Column | str) -> Column:
    return F.unhex(F.md5(text))


def _pieces(text: Column | str) -> Column:
    return F.filter(F.split(text, r"(?U)(?<=[.!?])\s+"), lambda s: X.strip(s) != "")


def _parts(text: Column, cuts: Column) -> Column:
    """The sentences of a text, joined from each cut to the next; a text of one is trimmed."""

    def joined(pieces: Column) -> Column:
        parts = F.transform(F.concat(F.array(F.lit(0)), cuts), lambda at, k: F.array_join(F.slice(pieces, at + 1, F.coalesce(F.get(cuts, k), F.size(pieces)) - at), " "))
        return F.when(F.size(pieces) == 1, F.array(X.strip(F.get(pieces, F.lit(0))))).otherwise(parts)

    return X.bound(_pieces(text), joined)


def embedded(texts: DataFrame, column: str, embed: Callable[[list[str]], np.ndarray], batch_size: int = BATCH) -> DataFrame:
    """``_sid`` (hash) and unit vector ``_v`` of every distinct text; null where ``embed`` fails on it."""

    def vectors(found: list[str]) -> list[np.ndarray | None]:
        try:
            made = np.asarray(embed(found), float)
            return list(made / np.maximum(np.linalg.norm(made, axis=1, keepdims=True), 1e-12))
        except Exception:  # noqa: BLE001 - whatever an embedder raises
            if len(found) == 1:
                log.exception("a sentence could not be embedded")
                return [None]
            return [v for x in found for v in vectors([x])]

    def run(batches):
        for batch in batches:
            found = batch.column(1).to_pylist()
            made = [v for k in range(0, len(found), batch_size) for v in vectors(found[k : k + batch_size])]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.list_(pa.float64()))], ["_sid", "_v"])

    distinct = texts.select(_hash(column).alias("_sid"), F.col(column).alias("_s")).dropDuplicates(["_sid"])
    return distinct.mapInArrow(run, "_sid binary, _v array<double>")


def semantic_once(df: DataFrame, column: str, cfg: SplitConfig, embed: Callable[[list[str]], np.ndarray], flag: str | None = None, batch_size: int = BATCH) -> DataFrame:
    """``df`` with a row for each part of ``column``, its place ``part`` and ``instead``: as ``chunks.semantic``, ``embed`` taking lists of sentences."""
    wanted = F.coalesce(F.col(flag), F.lit(False)) if flag else F.lit(True)
    marked = df.where(F.col(column).isNotNull()).withColumn("_key", F.when(wanted, _hash(column)))
    texts = marked.where("_key is not null").select("_key", _pieces(column).alias("_l"))
    known = embedded(texts.select(F.explode_outer("_l").alias("_s")).where("_s is not null"), "_s", embed, batch_size)
    places = unnest(texts.select("_key", F.transform("_l", _hash).alias("_l")).dropDuplicates(["_key"]), ["_key"], F.col("_l"), "_at", "_sid")

    text, ordered = Window.partitionBy("_key"), Window.partitionBy("_key").orderBy("_at")
    product = F.aggregate(F.zip_with("_v", "_before", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    away = places.join(known, "_sid").withColumn("_before", F.lag("_v").over(ordered)).select("_key", "_at", F.round(1 - product, 12).alias("_d"), F.col("_v").isNull().alias("_none"))
    limited = away.withColumn("_limit", F.percentile("_d", F.lit(cfg.semantic_percentile / 100)).over(text))
    cuts = limited.groupBy("_key").agg(F.max("_none").alias("_failed"), F.sort_array(F.collect_list(F.when(F.col("_d") > F.col("_limit"), F.col("_at")))).alias("_cuts"))
    cuts = _stored(cuts, "cuts")

    names = df.columns
    columns = lambda content: [content.alias(c) if c == column else F.col(f"`{c}`") for c in names]
    whole = marked.where("_key is null").select(*columns(F.col(column)), F.lit(0).alias("part"), F.lit(False).alias("instead"))
    split = marked.where("_key is not null").join(cuts, "_key")
    each = unnest(split.where("not _failed"), names, _parts(F.col(column), F.col("_cuts")), "part", "_p").select(*columns(F.col("_p")), "part", F.lit(False).alias("instead"))
    made = whole.unionByName(each) if flag else each
    if cuts.where("_failed").isEmpty():
        return made
    return made.unionByName(chunks.recursive(split.where("_failed").select(*names), column, cfg).withColumn("instead", F.lit(True)))
