"""Uniqueness on several keys among users and within a batch: first come, first served.

Taken one by one, a candidate would get in if nobody before it, user or accepted candidate, has one of its keys. The same set
comes out of rounds over all candidates at once: whoever is the first living one for each of its keys gets in, and
all others with such a key are out. A round is one aggregation a key and joins that move keys only. There are as many rounds as the
longest chain of candidates that wait for each other (each shares a key with the one before, by turns): a few for
keys that clash at random, one for one key, half the batch for a chain made to do so.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from docflow.sources.workspace import new_path

CREATED, IN_USE = "created", "in_use"


def _stored(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def decided(candidates: DataFrame, users: DataFrame, order: str, keys: tuple[str, ...] = ("email", "username")) -> DataFrame:
    """``candidates`` with ``status``, each row once: created or in_use.

    ``order`` says who comes first (nulls last; among equals any, but the same in every round). A null key clashes with nothing.
    """
    path = new_path(candidates.sparkSession, "registration")
    base = _stored(candidates.select(F.monotonically_increasing_id().alias("_u"), F.struct("*").alias("row")), f"{path}/rows")
    named = [f"_k{i}" for i in range(len(keys))]
    place = F.struct(F.col(f"row.`{order}`").isNull().alias("none"), F.col(f"row.`{order}`").alias("at"), F.col("_u").alias("u"))
    live = base.select("_u", place.alias("_at"), *[F.col(f"row.`{k}`").alias(n) for k, n in zip(keys, named, strict=True)])
    for k, n in zip(keys, named, strict=True):
        live = live.join(users.select(F.col(f"`{k}`").alias(n)), n, "left_anti")
    live = _stored(live, f"{path}/live-0")
    needed = reduce(lambda a, b: a + b, [F.col(n).isNotNull().cast("int") for n in named])
    step = 0
    while not live.isEmpty():
        firsts = [live.where(F.col(n).isNotNull()).groupBy(n).agg(F.min("_at").alias("m")).select(F.col("m.u").alias("_u")) for n in named]
        wins = reduce(DataFrame.unionAll, firsts).groupBy("_u").agg(F.count("*").alias("_wins"))
        taken = live.join(wins, "_u", "left").where(F.coalesce("_wins", F.lit(0)) == needed)
        taken = _stored(taken.select("_u", *named), f"{path}/created/round={step}")
        rest = live.join(taken.select("_u"), "_u", "left_anti")
        for n in named:
            rest = rest.join(taken.select(n).where(F.col(n).isNotNull()), n, "left_anti")
        step += 1
        live = _stored(rest, f"{path}/live-{step}")
    if not step:
        return base.select("row.*", F.lit(IN_USE).alias("status"))
    created = candidates.sparkSession.read.schema("_u bigint").parquet(*[f"{path}/created/round={i}" for i in range(step)])
    status = F.when(F.col("_in"), CREATED).otherwise(IN_USE)
    return base.join(created.withColumn("_in", F.lit(True)), "_u", "left").select("row.*", status.alias("status"))
