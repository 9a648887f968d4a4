"""Calls of the state that first places take."""

import glob
import hashlib
import random

import pandas as pd

import __spark_entry__ as entry
from docflow.sources import workspace
from docflow.streaming import stateful as S


class Held:
    """A state's variables in memory, counting calls."""

    def __init__(self):
        self.calls, self.values, self.one = 0, {}, None

    def getMapState(self, *_):
        return self

    def getValueState(self, *_):
        outer = self

        class Value:
            get = lambda self: outer.one
            update = lambda self, x: setattr(outer, "one", x)

        return Value()

    def getValue(self, key):
        self.calls += 1
        return self.values.get(key)

    def updateValue(self, key, value):
        self.calls += 1
        self.values[key] = value


def test_contents_of_a_batch_share_calls():
    rng, held, first, stored, seen = random.Random(1), Held(), {}, {}, 0
    work = S.FirstPlaces(None)
    work.init(held)
    for _ in range(3):
        rows = [(hashlib.sha1(str(rng.randrange(6000)).encode()).hexdigest(), rng.randrange(50), rng.choice([-(1 << 62), rng.randrange(9)]), 0) for _ in range(5000)]
        df = pd.DataFrame(rows, columns=["key", *S.ORDER]).assign(is_chunk=True, long_enough=True)
        df["payload"] = [f"{k} {p} {s} {t}" for k, p, s, t in rows]
        before = held.calls
        *chunks, last = work.handleInputRows(("d", 0), iter([df]), None)
        assert held.calls - before < 300
        for key, *place in rows:
            first[key] = min(first.get(key, tuple(place)), tuple(place))
        for payload in chunks[0]["payload"]:
            key, *place = payload.split()
            place = tuple(map(int, place))
            assert key not in stored or place < stored[key]
            stored[key] = place
        seen += len(rows)
        assert stored == first
        assert last[["chunks_before_filter", "deduped_out", "stored"]].values.tolist() == [[seen, seen - len(first), len(first)]]


def test_texts_of_a_micro_batch_lie_in_many_files(spark):
    def files():
        # The folder's path may be a URI.
        return {f for top in [workspace.session_dir(spark).removeprefix("file://")] for f in glob.glob(f"{top}/stream-*/in/*.parquet")}

    before = files()
    assert entry.queries()["stream_ingest_counters"](spark, "/root/testdata/sf0.001").count() > 0
    added = sorted(files() - before)
    assert len(added) >= 2 * spark.sparkContext.defaultParallelism
    assert len(glob.glob(f"{added[0].rsplit('/in/', 1)[0]}/out/batch=*")) <= 4
