"""Substring deduplication over a log-structured fingerprint index.

A window is ``width`` consecutive words. A word goes if a window that covers it,
word for word, also starts in a document with a smaller id.

1. Fingerprints: of the word grams inside a window the one with the smallest hash
   is its anchor, so equal windows have equal anchors, and about one place in
   twelve is an anchor. Documents of equal words are one class; only its smallest
   id goes on (all words of the others go, if there are enough for a window).
2. Index: anchors go into immutable runs, sorted and bucketed by hash. A new batch
   is written as a run, merge-joined with the older runs bucket by bucket (no
   shuffle, no sort), and runs beyond ``max_runs`` are merged into one. What comes
   back are the hashes that two documents share. A manifest lists the runs: an
   index kept by path takes further batches in later sessions.
3. Verification: only documents with a shared anchor are read again; the windows
   under those anchors get a hash of all their words, and window and anchor hash
   together (128 bits) say which windows are equal. The smallest document
   of each is found by aggregation, then every window learns whether it has an
   earlier one.

Scale: the index holds about 8 bytes in twelve words. Texts are shuffled once, to
meet their shared anchors; after that only documents with one are moved. Windows in
a third of all documents are pre-aggregated before they meet, and their occurrences
are joined with one row each, which AQE may split. Everything kept between steps
lies in the shared folder.

Defined results: null and blank texts have no words; a null id neither removes
words nor loses any; rows that share an id don't remove each other's words, and
equal rows get equal results; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import uuid
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from docflow.llm.arrow import lean, lists, slices
from docflow.llm.storage import new_path, stored
from docflow.llm.text import pick

WIDTH, GRAM = 50, 20
#: Bytes of text at a time.
CHUNK = 1 << 22
MANIFEST = "buckets int, width int, gram int, id_type string, runs array<string>, levels array<int>"
_ODD = np.random.default_rng(23).integers(1, 1 << 63, 4096, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def _grams(words: np.ndarray, width: int) -> np.ndarray:
    """Hash of the ``width`` words from each place on."""
    n = len(words) - width + 1
    out = np.full(max(n, 0), np.uint64(width), np.uint64)
    for k in range(width):
        out += words[k : k + len(out)] * _ODD[k % len(_ODD)] ** np.uint64(1 + k // len(_ODD))
    return _mixed(out)


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts, unchanged, and the number of words of each."""
    found = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    coded = found.flatten().dictionary_encode()
    codes, owner = coded.indices.to_numpy(), np.repeat(np.arange(len(texts)), np.diff(found.offsets.to_numpy()))
    table = np.array([xxhash.xxh64_intdigest(x) for x in coded.dictionary.to_pylist()], np.uint64)
    kept = (pc.binary_length(coded.dictionary).to_numpy() > 0)[codes] if len(codes) else np.zeros(0, bool)
    return (table[codes[kept]] if len(codes) else table), np.bincount(owner[kept], minlength=len(texts))


def anchors(words: np.ndarray, owner: np.ndarray, width: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First places of all windows, the places of their anchors, and the hashes of all grams."""
    hashes = _grams(words, gram)
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), hashes
    # Smallest hash over the grams of a window, leftmost first, by doubling.
    least, place, have, want = hashes, np.arange(len(hashes), dtype=np.int32), 1, width - gram + 1
    while have < want:
        step = min(have, want - have)
        right = least[step:] < least[:-step]
        least, place = np.where(right, least[step:], least[:-step]), np.where(right, place[step:], place[:-step])
        have += step
    start = np.flatnonzero(owner[:n] == owner[width - 1 :])
    return start, place[start].astype(np.int64), hashes


def _digest(text: str | None) -> str:
    return hashlib.sha256(b" ".join((text or "").encode("utf-8", "surrogatepass").split())).hexdigest()


def summaries(docs: DataFrame, width: int, gram: int) -> DataFrame:
    """``_id, _th, n_words, _sha, _anchors`` of every row of ``_id, _text``."""
    own = docs.select("_id", F.xxhash64("_text").alias("_th"), "_text")

    def run(batches):
        for batch in batches:
            for lo, hi in slices(batch.column(2), CHUNK):
                texts = batch.column(2).slice(lo, hi - lo)
                words, counts = word_hashes(texts)
                owner = np.repeat(np.arange(hi - lo), counts)
                _, place, hashes = anchors(words, owner, width, gram)
                place = np.unique(place)
                found = lists(pa.array(hashes[place].view(np.int64)), np.bincount(owner[place], minlength=hi - lo))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), pa.array(counts.astype(np.int64)), pa.array([_digest(t) for t in texts.to_pylist()]), found], ["_id", "_th", "n_words", "_sha", "_anchors"])

    return own.mapInArrow(lean(run), f"_id {own.schema['_id'].dataType.simpleString()}, _th bigint, n_words bigint, _sha string, _anchors array<bigint>")


@contextmanager
def in_order(spark: SparkSession):
    """While it lasts, plans take the order of runs from their files: a bucket is one sorted file, so a merge join sorts nothing again.

    A union of runs counts as dealt out anew: its scans may be read without their buckets.
    """
    wanted = {"spark.sql.legacy.bucketedTableScan.outputOrdering": "true", "spark.sql.unionOutputPartitioning": "false"}
    before = {name: spark.conf.get(name) for name in wanted}
    for name, value in wanted.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


class FingerprintIndex:
    """Sorted immutable runs of ``h, _id, _th``, bucketed by ``h``, below ``path``.

    A manifest lists the runs that count; it is written after a run is whole, so a job that breaks off leaves the
    index as it was. Whoever gives the ``path`` of an index opens it, in this session or a later one, with the settings
    it was made with. Without a path the index lies among the application's work tables. One writer at a time.

    Runs have levels: more than ``max_runs`` of one level are merged into one of the next, so of n batches an entry is
    written about log(n) times, and no run of another level is touched.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int | None = None, max_runs: int = 2, width: int = WIDTH, gram: int = GRAM):
        self.spark, self.max_runs = spark, max_runs
        self.path = (path or new_path(spark, "fingerprints")).rstrip("/")
        folder = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        self._fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.width, self.gram, self.version = width, gram, 0
        self.runs: list[str] = []
        self.levels: list[int] = []
        manifests = [v for v in self._names() if v.startswith("manifest-")]
        whole = [v for v in manifests if self._fs.exists(self._at(f"{v}/_SUCCESS"))]
        # Above all numbers: one that broke off keeps its own.
        self.used = max([int(v[9:]) for v in manifests], default=0)
        if whole:
            found = spark.read.schema(MANIFEST).json(f"{self.path}/{max(whole)}").first()
            self.buckets, self.width, self.gram, self.version, self.runs = found.buckets, found.width, found.gram, int(max(whole)[9:]), list(found.runs)
            self.levels = list(found.levels or [0] * len(self.runs))
            for run in self.runs:
                spark.sql(f"CREATE TABLE IF NOT EXISTS {run} (h BIGINT, _id {found.id_type}, _th BIGINT) USING parquet CLUSTERED BY (h) SORTED BY (h) INTO {self.buckets} BUCKETS LOCATION '{self.path}/{run}'")

    def _names(self) -> list[str]:
        return [f.getPath().getName() for f in self._fs.listStatus(self._at(""))] if self._fs.exists(self._at("")) else []

    def _at(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}".rstrip("/"))

    def _write(self, rows: DataFrame) -> str:
        name = f"fingerprints_{uuid.uuid4().hex}"
        rows.repartition(self.buckets, "h").sortWithinPartitions("h").write.format("parquet").bucketBy(self.buckets, "h").sortBy("h").option("path", f"{self.path}/{name}").saveAsTable(name)
        return name

    def _commit(self, runs: list[str], levels: list[int]) -> None:
        """Make ``runs`` the index; files of runs that no longer count go once the manifest is whole."""
        id_type = self.spark.table(runs[0]).schema["_id"].dataType.simpleString()
        values = {"buckets": F.lit(self.buckets), "width": F.lit(self.width), "gram": F.lit(self.gram), "id_type": F.lit(id_type), "runs": F.array(*[F.lit(r) for r in runs]), "levels": F.array(*[F.lit(n) for n in levels])}
        self.used += 1
        self.spark.range(1).select(*[v.alias(k) for k, v in values.items()]).coalesce(1).write.json(f"{self.path}/manifest-{self.used:08d}")
        gone, self.runs, self.levels = [r for r in self.runs if r not in runs], runs, levels
        old, self.version = self.version, self.used
        for run in gone:
            self.spark.sql(f"DROP TABLE IF EXISTS {run}")
            self._fs.delete(self._at(run), True)
        self._fs.delete(self._at(f"manifest-{old:08d}"), True)

    def clean(self) -> None:
        """Delete runs and manifests that a job which broke off has left; nobody else may be writing."""
        for name in self._names():
            if name.startswith(("fingerprints_", "manifest-")) and name not in [*self.runs, f"manifest-{self.version:08d}"]:
                self._fs.delete(self._at(name), True)

    def add(self, rows: DataFrame) -> DataFrame:
        """Add a batch as a run; returns the hashes ``h`` that its documents share with each other or with older ones."""
        new = self._write(rows.select("h", "_id", "_th"))
        batch = self.spark.table(new)
        found = [batch.groupBy("h").agg(F.min("_id").alias("a"), F.max("_id").alias("b")).where("a != b").select("h")]
        for run in self.runs:
            found.append(batch.select("h").join(self.spark.table(run).hint("merge"), "h", "left_semi"))
        shared = found[0]
        for other in found[1:]:
            shared = shared.unionByName(other)
        with in_order(self.spark):
            shared = stored(shared.distinct(), "shared")
        self._commit([*self.runs, new], [*self.levels, 0])
        level = 0
        while self.levels.count(level) > self.max_runs:
            self.compact(level)
            level += 1
        return shared

    def rows(self, runs: list[str] | None = None) -> DataFrame:
        runs = self.runs if runs is None else runs
        found = self.spark.table(runs[0])
        for run in runs[1:]:
            found = found.unionByName(self.spark.table(run))
        return found

    def compact(self, level: int | None = None) -> None:
        """Merge the runs of a level, by default all, into one of the next; equal entries of a hash become one."""
        merged = [r for r, n in zip(self.runs, self.levels, strict=True) if level is None or n == level]
        rest = [(r, n) for r, n in zip(self.runs, self.levels, strict=True) if r not in merged]
        with in_order(self.spark):
            # Dealt out by ``h`` first, equal entries meet there and the run is written as they lie: one shuffle.
            new = self._write(self.rows(merged).repartition(self.buckets, "h").distinct())
        self._commit([*[r for r, _ in rest], new], [*[n for _, n in rest], (max(self.levels) if level is None else level) + 1])

    def close(self, delete: bool = False) -> None:
        """Take the runs out of the session's catalog; their files stay unless ``delete``."""
        for run in self.runs:
            self.spark.sql(f"DROP TABLE IF EXISTS {run}")
        if delete:
            self._fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(self.path), True)
        self.runs = []

    def occurrences(self, shared: DataFrame) -> DataFrame:
        """Entries of the given hashes; one copy of each run is read, in its order."""
        found = None
        for run in self.runs:
            part = self.spark.table(run).join(shared, "h", "left_semi")
            found = part if found is None else found.unionByName(part)
        return found


def live_windows(live: DataFrame, width: int, gram: int) -> DataFrame:
    """``h, _id, _th, w, start, more``: for each shared anchor hash of a text its distinct windows, their first places, and all places of those that recur."""

    def run(batches):
        for batch in batches:
            shared = batch.column(3)
            for lo, hi in slices(batch.column(2), CHUNK):
                words, counts = word_hashes(batch.column(2).slice(lo, hi - lo))
                owner, first = np.repeat(np.arange(hi - lo), counts), np.cumsum(counts) - counts
                start, place, hashes = anchors(words, owner, width, gram)
                asked = shared.slice(lo, hi - lo)
                known = np.unique(asked.flatten().to_numpy(zero_copy_only=False).view(np.uint64))
                anchor = hashes[place]
                use = np.isin(anchor, known)
                start, anchor = start[use], anchor[use]
                if not len(start):
                    continue
                full, text = _grams(words, width)[start], owner[start]
                order = np.lexsort((start, full, anchor, text))
                start, anchor, full, text = (x[order] for x in (start, anchor, full, text))
                new_row = np.concatenate(([True], (text[1:] != text[:-1]) | (anchor[1:] != anchor[:-1])))
                new_window = new_row | np.concatenate(([True], full[1:] != full[:-1]))
                row, window = np.flatnonzero(new_row), np.flatnonzero(new_window)
                at = (start - first[text]).astype(np.int32)
                times = np.diff(np.append(window, len(start)))
                # Places of windows that stand once are not listed again.
                listed = np.repeat(times > 1, times)
                offsets = np.concatenate(([0], np.cumsum(np.where(times > 1, times, 0)))).astype(np.int32)
                more = pa.ListArray.from_arrays(pa.array(offsets), pa.array(at[listed]), mask=pa.array(times == 1))
                per_row = np.diff(np.append(np.flatnonzero(new_row[window]), len(window)))
                took = pa.array(text[row] + lo)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(anchor[row].view(np.int64)), batch.column(0).take(took), batch.column(1).take(took), lists(pa.array(full[window].view(np.int64)), per_row), lists(pa.array(at[window]), per_row), lists(more, per_row)],
                    ["h", "_id", "_th", "w", "start", "more"],
                )

    return live.select("_id", "_th", "_text", "_hs").mapInArrow(lean(run), f"h bigint, _id {live.schema['_id'].dataType.simpleString()}, _th bigint, w array<bigint>, start array<int>, more array<array<int>>")


def kept_words(rows: DataFrame, width: int) -> DataFrame:
    """``_id, _th, n_removed, _kept`` of texts with the first places ``_at`` of the windows to remove."""

    def run(batches):
        for batch in batches:
            removed, digests = [], []
            for text, at in zip(batch.column(2).to_pylist(), batch.column(3), strict=True):
                words = text.encode("utf-8", "surrogatepass").split()
                edge = np.zeros(len(words) + 1, np.int64)
                at = at.values.to_numpy()
                np.add.at(edge, at, 1)
                np.add.at(edge, at + width, -1)
                gone = np.cumsum(edge[:-1]) > 0
                removed.append(int(gone.sum()))
                digests.append(hashlib.sha256(b" ".join([words[k] for k in np.flatnonzero(~gone).tolist()])).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(removed, pa.int64()), pa.array(digests, pa.string())], ["_id", "_th", "n_removed", "_kept"])

    return rows.select("_id", "_th", "_text", "_at").mapInArrow(lean(run), f"_id {rows.schema['_id'].dataType.simpleString()}, _th bigint, n_removed bigint, _kept string")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, gram: int = GRAM, batches: int = 4, max_runs: int = 2, index: FingerprintIndex | None = None, history: DataFrame | None = None) -> DataFrame:
    """``id_col, n_words, n_removed, kept_sha256`` of every row; ids are numbers (see the module's docstring).

    The table is added to the index in ``batches`` by ranges of the id, as batches would arrive. Without an ``index``
    one is made for this call; with one, whose ``width`` and ``gram`` hold, ``docs`` are a new batch of it, and rows
    are returned for them only. ``history`` (same two columns) has the documents added before: those that share an
    anchor are read for verification, and one that isn't there removes nothing.
    """
    spark = docs.sparkSession
    mine = index is None
    index = index or FingerprintIndex(spark, max_runs=max_runs, width=width, gram=gram)
    width, gram = index.width, index.gram
    own = pick(docs, _id=id_col, _text=text_col)
    found = stored(summaries(own, width, gram), "summaries")
    firsts = found.where("_id is not null").groupBy("_sha").agg(F.min("_id").alias("_first"))
    # Keys of joins are turned around on both sides: an aggregate is then dealt out anew, and only a join of two
    # exchanges can be split where a key is hot.
    turned = firsts.select(F.reverse("_sha").alias("_ahs"), "_first")
    classed = stored(found.select("_id", "_th", "n_words", "_sha", F.reverse("_sha").alias("_ahs")).join(turned, "_ahs", "left").drop("_ahs"), "classes")

    # Copies have the anchors of their first document, which alone is indexed.
    first = found.join(classed.where("_id = _first").select("_id", "_th").distinct(), ["_id", "_th"], "left_semi").select("_id", "_th", F.explode(F.array_distinct("_anchors")).alias("h"))
    cuts = found.select(F.percentile_approx("_id", [k / batches for k in range(1, batches)], 1000)).first()[0] or []
    bounds = sorted(set(cuts))
    shared = None
    for low, high in zip([None, *bounds], [*bounds, None], strict=True):
        part = first
        if low is not None:
            part = part.where(F.col("_id") > low)
        if high is not None:
            part = part.where(F.col("_id") <= high)
        hashes = index.add(part)
        shared = hashes if shared is None else shared.unionByName(hashes)
    shared = stored(shared.distinct(), "shared")

    asked = index.occurrences(shared).groupBy("_id", "_th").agg(F.collect_set("h").alias("_hs"))
    known = own if history is None else own.unionByName(pick(history, _id=id_col, _text=text_col))
    texts = known.where("_id is not null").select("_id", F.xxhash64("_text").alias("_th"), "_text")
    with in_order(spark):
        live = stored(texts.join(asked, ["_id", "_th"]), "live")
    if mine:
        index.close(delete=True)
    windows = stored(live_windows(live, width, gram), "windows")
    # A window that recurs in one text is one row, so a repetitive text is no hot key.
    each = windows.select("h", "_id", "_th", F.explode(F.arrays_zip("w", "start", "more")).alias("x")).select("h", "_id", "_th", "x.*")
    earliest = each.groupBy("h", "w").agg(F.min("_id").alias("a"), F.max("_id").alias("b")).where("a != b").select("h", "w", "a")
    around = {"h": F.bitwise_not("h"), "w": F.bitwise_not("w")}
    later = each.withColumns(around).join(earliest.withColumns(around), ["h", "w"]).where("_id > a")
    starts = later.groupBy("_id", "_th").agg(F.flatten(F.collect_list(F.coalesce("more", F.array("start")))).alias("_at"))
    removed = kept_words(live.drop("_hs").join(starts, ["_id", "_th"]), width).dropDuplicates(["_id", "_th"])

    out = classed.join(removed, ["_id", "_th"], "left")
    copy = (F.col("_id") > F.col("_first")) & (F.col("n_words") >= width)
    return out.select(
        F.col("_id").alias(id_col), "n_words",
        F.when(copy, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copy, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("_kept", "_sha")).alias("kept_sha256"),
    )
