import collections
import random
import re

import duckdb
import pyarrow as pa
import pytest

from docflow.llm import collocations as C
from docflow.llm.q_collocations import ORACLE, op11_phrase_collocations

SCHEMA = "doc_id bigint, text string, lang string, phrase string, f int, n string, size int"


def plain(rows, max_n=4, least=30, cover_pct=80, top=2000):
    counts, total = collections.defaultdict(collections.Counter), collections.Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(words)
            for n in range(1, max_n + 1):
                counts[lang].update(tuple(words[i : i + n]) for i in range(len(words) - n + 1))
    out = []
    for lang, f in counts.items():
        often = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        covered = {}
        for p, a in often.items():
            for n in range(2, len(p)):
                for i in range(len(p) - n + 1):
                    covered[p[i : i + n]] = max(covered.get(p[i : i + n], 0), a)
        found = []
        for p, a in often.items():
            score, k = min((2_000_000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
            if 100 * covered.get(p, 0) < cover_pct * a:
                found.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, left, right, total[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(found)[:top])]
    return sorted(out)


def run(spark, rows, **kw):
    df = spark.createDataFrame([(i, t, g, "x", 1, "y", 2) for i, (t, g) in enumerate(rows)], SCHEMA).repartition(3)
    return sorted(tuple(r) for r in C.collocations(df, **kw).collect())


def prose(seed, n=120, langs=("en", "de", None)):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(12)] + ["É", "Ünder", "İx", "a b", "𝕏"]
    fixed = ["New York City", "in order to", "w1 w2 w3 w4", "w1 w1 w1 w1 w1"]
    part = lambda: rng.choice(fixed) if rng.random() < 0.4 else rng.choice(words)
    return [(rng.choice(["", " ", "\t "]) + "".join(part() + rng.choice([" ", "  ", "\t", ", ", ".", "\n", "! "]) for _ in range(rng.randint(0, 60))), rng.choice(langs)) for _ in range(n)]


@pytest.mark.parametrize("kw", [{}, {"prune": False}, {"bits": 6}, {"block": 50}])
def test_equals_plain(spark, kw):
    rows = prose(1, 500)
    want = plain(rows)
    assert len(want) > 30
    assert run(spark, rows, **kw) == want


@pytest.mark.parametrize(("max_n", "least", "top"), [(2, 5, 3), (3, 10, 7), (5, 8, 1000), (1, 1, 10)])
def test_other_parameters(spark, max_n, least, top):
    rows = prose(2, 60)
    assert run(spark, rows, max_n=max_n, least=least, top=top) == plain(rows, max_n, least, top=top)


def test_nulls_empties_repeats_and_long_texts(spark):
    rows = [(None, "en"), ("", None), (" \t ", "en"), (".,;", "en"), ("One two. " * 40, "en"), ("One two. " * 40, "en"), ("x y " * 5000, None), ("und und", "und"), ("w" * 100_000, "en"), ("a b\r\nc\x0bd", "fr")]
    want = plain(rows)
    assert ("en", 1, "one two", 80, 80, 80, 161, 1_000_000) in want
    assert run(spark, rows) == want
    assert run(spark, rows, block=100) == want
    assert run(spark, []) == []
    assert run(spark, [(None, None)]) == []


def test_query_equals_plain_and_sql(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r.text, r.lang) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = op11_phrase_collocations(spark, sf)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = sorted(con.sql(f"SELECT {', '.join(got.columns)} FROM ({ORACLE})").fetchall())
    assert sorted(map(tuple, got.collect())) == want == plain(rows)


def test_blocks_are_cut_between_pieces():
    text = "aa bb. cc dd, ee ff; gg"
    for size in range(1, 30):
        assert [p.strip() for b in C.blocks(text, size) for p in re.split(C.BORDER, b) if p.strip()] == ["aa bb", "cc dd", "ee ff", "gg"]
    assert list(C.blocks("a b c d", 2)) == ["a b c d"]


def test_the_bitmap_has_no_false_negatives(spark):
    frequent = spark.createDataFrame([("en", f"w{i} v{i % 7}", 30) for i in range(500)], "lang string, phrase string, f bigint")
    bitmap = C.bitmap_of(frequent, 2, 12)
    text = ". ".join(f"w{i} v{i % 7} z" for i in range(500))
    found = pa.Table.from_batches(C.grams(pa.array([text]), pa.array(["en"]), [3], bitmap, 2, 12))
    every = pa.Table.from_batches(C.grams(pa.array([text]), pa.array(["en"]), [3], C.bitmap_of(spark.createDataFrame([("en", x, 30) for i in range(500) for x in (f"w{i} v{i % 7}", f"v{i % 7} z")], frequent.schema), 2, 12), 2, 12))
    assert len(every) == 500
    assert len(found) < 500
