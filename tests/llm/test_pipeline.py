import random

import corpus_pipeline as C
from tests.llm.test_quality_rules import plain_repeats, words
from tests.llm.test_simhash import by_shingles, edited
from tests.llm.test_spaced_seeds import plain as plain_leaks, tokens

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def staged(spark, docs, folder, tmp_path, last=len(C.STAGES)):
    out = []
    for k, (_, f) in enumerate(C.STAGES[:last]):
        f(spark, docs, folder).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        out.append(docs)
    return out


def test_stages_on_real_rows(spark, tmp_path):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    quality, near, clean, secret, packed = staged(spark, docs, folder, tmp_path)
    for df in (quality, near, clean, secret):
        assert df.columns == COLUMNS
    kept = {r.doc_id for r in quality.collect()}
    base = {d for d, r in rows.items() if len(words(r.text)) >= 50 and 100 * plain_repeats(r.text) <= 50 * len(words(r.text))}
    assert kept <= base and len(kept) > 0.9 * len(base)
    least = by_shingles([(d, rows[d].text) for d in sorted(kept)])
    unique = {r.doc_id for r in near.collect()}
    # One of each group stays; fingerprints may miss a near copy, one in ten at most.
    assert set(least.values()) <= unique <= kept
    assert len(unique - set(least.values())) <= 0.1 * (len(kept) - len(set(least.values())))
    items = [tuple(r) for r in spark.read.parquet(f"{folder}/benchmark.parquet").select("item_id", "text").collect()]
    leaks = {d for d, _ in plain_leaks([(d, tokens(rows[d].text)) for d in unique], items)}
    assert {r.doc_id for r in clean.collect()} == unique - leaks
    for r in secret.collect():
        assert (r.text == rows[r.doc_id].text) or "[SECRET]" in r.text
        assert r.n_chars == len(r.text)
    assert {r.doc_id for r in packed.collect()} == unique - leaks
    assert C.run(spark, folder).count() == packed.count()


def test_odd_rows(spark, tmp_path):
    rng = random.Random(1)
    text = lambda n: " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(n))
    a, b, c, d = text(80), text(90), text(70), text(75)
    secret = f"{d} password = abcdefghijklmnop end"
    rows = [(1, a, "en", "s", 5), (2, a, "en", "t", 5), (2, a, "en", "t", 5), (3, None, None, None, None), (4, "", "en", "s", 0), (None, b, "en", "s", 5), (None, b, "en", "s", 5), (5, c, "en", None, 5), (5, c, "en", None, 5), (6, secret, "en", "s", None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    out = staged(spark, docs, "/root/testdata/sf0.001", tmp_path)
    assert sorted((r.doc_id or -1 for r in out[0].collect())) == [-1, -1, 1, 2, 2, 5, 5, 6]
    assert sorted((r.doc_id or -1 for r in out[1].collect())) == [-1, 1, 5, 6]
    assert {r.doc_id: r.text for r in out[3].collect()}[6] == f"{d} [SECRET] end"
    assert out[4].count() == 4


def test_near_copies_go(spark):
    rng = random.Random(5)
    rows = []
    for g in range(20):
        words = [f"w{rng.randrange(10**5)}" for _ in range(200)]
        rows += [(2 * g, " ".join(words), "en", "s", 1), (2 * g + 1, edited(rng, words, 3), "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    kept = {r.doc_id for r in C.near_duplicates(spark, docs, "").collect()}
    # A near copy at 0.86 has no fingerprint near enough once in 50 times.
    assert kept >= {2 * g for g in range(20)} and len(kept) <= 21


def test_clashing_columns_and_long_texts(spark, tmp_path):
    folder = "/root/testdata/sf0.001"
    rng = random.Random(2)
    text = lambda n: " ".join(f"w{rng.randrange(10**7)}" for _ in range(n))
    leak = next(r.text for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect() if len(r.text.split()) >= 20)
    a, long = text(90), text(60000)
    texts = [a, a, f"{text(80)} {leak} {text(10)}", long, f"{text(80)} password = abcdefghijklmnop", None, "", "few words"]
    names = ["k", "_id", "_corpus_key", "key", "row", "other", "first", "n", "spans", "_spans", "_fp", "_node", "_g", "a", "b", "_th", "_text", "_host", "component_id", "a.b", "kept"]
    rows = [(k, t, "en", "s", None, *[f"{n}{k}" for n in names]) for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, " + ", ".join(f"`{n}` string" for n in names))
    out = staged(spark, docs, folder, tmp_path)
    assert all(df.columns == docs.columns for df in out[:4])
    assert [sorted(r.doc_id for r in df.collect()) for df in out[:4]] == [[0, 1, 2, 3, 4], [0, 2, 3, 4], [0, 3, 4], [0, 3, 4]]
    for r in out[3].collect():
        assert list(r[5:]) == [f"{n}{r.doc_id}" for n in names]
        assert r.text == (texts[r.doc_id] if r.doc_id != 4 else texts[4].replace("password = abcdefghijklmnop", "[SECRET]"))
    assert {r.doc_id for r in out[4].collect()} == {0, 3, 4}


def test_empty(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(0)
    assert [df.count() for df in staged(spark, docs, "/root/testdata/sf0.001", tmp_path)] == [0] * 5
