"""A corpus pipeline: documents to packed training sequences.

``STAGES`` lists ``(name, function)``; each function takes ``(spark, docs, sf_dir)``
and returns a DataFrame that is written as Parquet and read again as the next
stage's ``docs``. All but the last return the columns of ``documents``.

Rows are known by doc_id and text together, so null or repeated ids do no harm:
equal rows share every decision, and near-duplicate removal keeps one of them.

Defined results: null and empty texts fail the quality rules, so later stages see none from
``run`` (each of them takes them all the same); an empty table gives an empty table in every stage;
extra columns are carried along whatever their names, for a row travels as one struct.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from docflow.llm import packing, quality_rules, secret_scan, simhash, spaced_seeds
from docflow.llm.storage import new_path, stored


def _keyed(docs: DataFrame) -> DataFrame:
    """``row`` (all columns), ``key`` and the columns that the operators read. Keys are (id is null, id, hash of the text) and order as ids do, null ids last."""
    rows = docs.select(F.struct("*").alias("row"))
    key = F.struct(F.col("row.doc_id").isNull().alias("n"), F.col("row.doc_id").alias("d"), F.xxhash64("row.text").alias("h"))
    return rows.select("row", key.alias("key"), F.col("row.text").alias("text"), F.col("row.source").alias("source"))


def _joined(keyed: DataFrame, found: DataFrame, how: str) -> DataFrame:
    """Rows joined with ``found`` on its column ``other``, a key."""
    return keyed.join(found, F.col("key.d").eqNullSafe(F.col("other.d")) & (F.col("key.h") == F.col("other.h")), how)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, unchanged."""
    keyed = _keyed(docs)
    rejected = quality_rules.quality_rules(keyed, id_col="key").where(~F.col("kept")).select(F.col("key").alias("other")).distinct()
    return _joined(keyed, rejected, "left_anti").select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each group of near-duplicates.

    Links share 0.8 or more of their five-word shingles; they are looked for among texts with one of two
    fingerprints, over shingles of two words, within seven bits.
    """
    keyed = _keyed(docs)
    found = simhash.near_duplicates(keyed, id_col="key", width=2, bits=7, shingle_width=5, seeds=(42, 43))
    # Decided on keys alone; texts are read again for the rows that stay.
    said = stored(found.groupBy("key").agg(F.first("component_id").alias("first"), F.count("*").alias("n")).where("key != first or n > 1"), "groups")
    out = _joined(keyed, said.select(F.col("key").alias("other")), "left_anti").select("row.*")
    again = said.where("key = first").select(F.col("key").alias("other"))
    if again.isEmpty():
        return out
    return out.unionByName(_joined(keyed, again, "left_semi").dropDuplicates(["key"]).select("row.*"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    keyed = _keyed(docs)
    found = spaced_seeds.contaminated(keyed, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), id_col="key")
    return _joined(keyed, found.select(F.col("key").alias("other")).distinct(), "left_anti").select("row.*")


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced by a mark; ``n_chars`` follows the text."""
    keyed = _keyed(docs)
    found = secret_scan.secret_spans(keyed, id_col="key").where(F.size("spans") > 0).groupBy(F.col("_id").alias("other")).agg(F.first("spans").alias("spans"))
    text = F.when(F.col("spans").isNull(), F.col("text")).otherwise(secret_scan.redact(F.col("text"), F.col("spans")))
    rows = _joined(keyed, found, "left").select("row", text.alias("text"))
    n_chars = F.coalesce(F.length("text").cast("long"), F.col("row.n_chars"))
    changed = {"text": F.col("text"), "n_chars": n_chars}
    return rows.select(*[changed.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of the remaining documents goes in the packed sequences."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("secrets", secrets), ("pack", pack)]

#: XXH64 fingerprints and the tokenizer are beyond SQL; the tests compare each stage with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; stages hand over through Parquet in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = new_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
