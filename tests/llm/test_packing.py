import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from docflow.llm import packing as P
from docflow.llm.q_packing import op3_best_fit_packing

PATH = public_tokenizers.path("word_bpe_49k.json")


def plain(texts):
    t = Tokenizer.from_file(PATH)
    return [[*t.encode(x or "", add_special_tokens=False).ids, 1] for x in texts]


def expected(rows):
    out = []
    for doc, ids in zip([r[0] for r in rows], plain([r[1] for r in rows]), strict=True):
        for p, s in enumerate(range(0, len(ids), 4096)):
            part = ids[s : s + 4096]
            out.append((doc, p, s, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    return sorted(out, key=repr)


def check(rows, got, slack=1):
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got), key=repr) == expected(rows)
    places = {}
    for r in got:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(places) <= max(1, -(-sum(r.length for r in got) // 4096)) * 1.01 + slack


def test_query_equals_plain_tokenizer(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    check(rows, op3_best_fit_packing(spark, "/root/testdata/sf0.01").collect())


def test_odd_texts(spark):
    texts = [None, "", "  \n", "It's we'll 'RE don't <|endoftext|> <|startoftext|>x", "É É ß İ Σς ǅ  nbsp em\x85nel\x1fus", "word. ., ..word ###. 1234 ４５ ½", "<|STARTOFTEXT|> <|endoftext|", "a<|startoftext|>b", "x" * 30000, "long text here " * 9000, "漢字かな " * 3000, "\U0001f600‍\U0001f600 á̧ b"]
    rows = [(k, t) for k, t in enumerate(texts)] + [(3, texts[3]), (None, "no id")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id bigint, text string, length string")
    check(rows, P.pack(df, PATH).collect())
    assert P.pack(df.limit(0), PATH).collect() == []
    whole = {r.sequence_id: r.ids for r in P.pack_ids(df, PATH).collect()}
    assert sorted(x for ids in whole.values() for x in ids) == sorted(x for ids in plain([t for _, t in rows]) for x in ids)


def test_equal_lengths_and_hot_length(spark):
    rows = [(k, "the " * 1000) for k in range(300)] + [(1000 + k, "the " * (k % 90)) for k in range(200)]
    check(rows, P.pack(spark.createDataFrame(rows, "doc_id bigint, text string"), PATH).collect(), slack=2)


def test_many_salts(spark, monkeypatch):
    monkeypatch.setattr(P, "RANKED", 7)
    rows = [(k, "the " * (k % 3)) for k in range(400)] + [(1000 + k, "the " * (k % 90)) for k in range(200)]
    check(rows, P.pack(spark.createDataFrame(rows, "doc_id bigint, text string"), PATH).collect(), slack=2)


def test_patterns_place_most_pieces():
    rng = np.random.default_rng(7)
    for n in (10000, 300000):
        counts = np.bincount(np.clip(rng.lognormal(6.3, 1, n), 1, 4096).astype(int), minlength=4097)
        have = P.Bins(counts, 4096, P.FIT_BINS)
        made = P.fitted(have, P.PATTERN_DOCS, 64)
        assert all(sum(lengths) == 4096 for lengths in made)
        assert sum(len(lengths) * k for lengths, k in made.items()) > 0.5 * n
        assert have.left.sum() == n - counts[4096] - sum(len(lengths) * k for lengths, k in made.items())


def test_plan_is_whole_and_close_to_the_bound():
    rng = np.random.default_rng(1)
    for n in (0, 1, 40, 5000, 200000):
        counts = np.bincount(np.clip(rng.lognormal(6, 1.3, n), 1, 4096).astype(int), minlength=4097)
        made = P.plan(counts, 4096)
        placed = np.zeros(4097, int)
        for k, lengths in made:
            assert k > 0 and sum(lengths) <= 4096
            np.add.at(placed, list(lengths), k)
        assert (placed == counts).all()
        bound = -(-int((counts * np.arange(4097)).sum()) // 4096)
        assert sum(k for k, _ in made) <= bound * 1.005 + 1


def test_nnls_equals_known_solution():
    rng = np.random.default_rng(2)
    a = rng.random((12, 30))
    b = a @ np.where(rng.random(30) < 0.2, rng.random(30), 0)
    x = P.nnls(a, b)
    assert (x >= 0).all() and np.abs(a @ x - b).max() < 1e-6
