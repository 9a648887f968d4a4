import random
import re

import numpy as np
import pytest
import xxhash

from docflow.llm import gray_index as G, shingles as X, simhash as S
from docflow.llm.q_simhash import op9_simhash_near_dedup

SCHEMA = "doc_id bigint, text string, _fp string"


def plain_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(ids, prints, bits=4):
    root = list(range(len(ids)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= bits:
                root[find(i)] = find(j)
    least = {}
    for i, d in enumerate(ids):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return [least.get(find(i)) for i in range(len(ids))]


def expected(rows):
    prints = [plain_print(t) for _, t in rows]
    return sorted(zip([d for d, _ in rows], [f"{p:016x}" for p in prints], plain_components([d for d, _ in rows], prints), strict=True), key=repr)


def test_query_equals_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    got = sorted((tuple(r) for r in op9_simhash_near_dedup(spark, "/root/testdata/sf0.01").collect()), key=repr)
    assert got == expected(rows)


def test_query_goes_through_the_index(spark):
    pruned = [spark.sparkContext.accumulator(0) for _ in range(8)]
    got = sorted(tuple(r) for r in op9_simhash_near_dedup(spark, "/root/testdata/sf0.1", pruned=pruned).collect())
    dealt = S.near_duplicates(spark.read.parquet("/root/testdata/sf0.1/documents.parquet")).collect()
    assert got == sorted(map(tuple, dealt))
    assert pruned[0].value > 0 and pruned[1].value > 0, pruned


def test_dealing_by_few_bits(spark):
    rng = random.Random(5)
    words = [f"w{k}" for k in range(400)]
    texts = [" ".join(rng.choice(words) for _ in range(60)) for _ in range(120)]
    texts += [t + " more" for t in texts[:40]]
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = S.near_duplicates(df, bits=10, block=16, group=32, fit=True).collect()
    want = plain_components([k for k, _ in rows], [plain_print(t) for t in texts], 10)
    assert len(set(want)) < len(want) and [r[2] for r in sorted(got)] == want


def test_values_take_as_many_bits_as_trees_need():
    assert [S.bits_to_agree(n, 1, 4096) for n in (0, 1, 4096, 4097, 8192, 8193, 1 << 24)] == [0, 0, 0, 1, 1, 2, 12]
    assert S.bits_to_agree(1 << 27, 2, 4096) == 8
    assert S.block_masks(4, 1, 0) == [0] and len(S.block_masks(4, 1, 3)) == 5 and all(m.bit_count() == 3 if m >= 0 else (m + (1 << 64)).bit_count() == 3 for m in S.block_masks(4, 1, 3))


def test_odd_rows(spark):
    rows = [(5, None), (3, ""), (9, " \t\n"), (None, "one two three"), (7, "One TWO three"), (7, "One TWO three"), (8, "Á a b\u001fc d e"), (1, "x " * 70000), (2, "x " * 70001), (None, "alone here for once, quite so")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA)
    got = sorted((tuple(r) for r in S.near_duplicates(df).collect()), key=repr)
    assert got == expected(rows)
    assert S.near_duplicates(df.limit(0)).collect() == []
    assert sorted((tuple(r) for r in S.near_duplicates(df, fit=True).collect()), key=repr) == got
    assert S.near_duplicates(df.limit(0), fit=True).collect() == []


def components_of(count, a, b):
    root = np.arange(count)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for x, y in zip(np.asarray(a).tolist(), np.asarray(b).tolist(), strict=True):
        x, y = find(x), find(y)
        root[max(x, y)] = min(x, y)
    return [find(k) for k in range(count)]


def clustered(rng, spread=7):
    prints = set(rng.integers(0, 1 << 63, 300).tolist())
    for centre in rng.integers(0, 1 << 63, 12).tolist():
        for _ in range(40):
            x = centre
            for b in rng.integers(0, 64, rng.integers(0, spread)).tolist():
                x ^= 1 << b
            prints.add(x)
            centre = x if rng.random() < 0.2 else centre
    return sorted(prints)


@pytest.mark.parametrize(("group", "block", "chunk"), [(1024, 8192, 1 << 15), (1024, 8, 64), (1, 8, 64)])
def test_links_lose_nothing(spark, monkeypatch, group, block, chunk):
    monkeypatch.setattr(S, "GROUP", group)
    monkeypatch.setattr(S, "CHUNK", chunk)
    prints = clustered(np.random.default_rng(3))
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    df = spark.createDataFrame([(p, p) for p in signed], "_fp0 bigint, _node bigint")
    place = {p: k for k, p in enumerate(signed)}
    found = S.links(df, 4, block).collect()
    assert components_of(len(prints), [place[r.a] for r in found], [place[r.b] for r in found]) == plain_components(list(range(len(prints))), prints)
    assert len(found) <= 20 * len(prints)


def in_order(prints):
    fps = np.array(prints, np.uint64)
    return fps[np.argsort(G.gray_ranks(fps))]


def test_index_equals_pairs():
    rng = np.random.default_rng(5)
    for bits in (0, 4, 9):
        parts = [in_order(clustered(rng)[: int(n)]) for n in (1, 2, 8, 9, 40, 700)]
        fps, tree = np.concatenate(parts), np.repeat(np.arange(len(parts)), [len(p) for p in parts])
        forest = G.Forest(tree, fps)
        roots = np.arange(len(forest.ones[-1]))
        search = G.Search(forest, bits)
        a, b = search.run(roots, roots)
        near = (np.bitwise_count(fps[:, None] ^ fps[None, :]) <= bits) & (tree[:, None] == tree[None, :])
        assert near[a, b].all()
        assert components_of(len(fps), a, b) == components_of(len(fps), *np.nonzero(near))
        # A forest has no link too many.
        assert len(a) == len(fps) - len(set(components_of(len(fps), a, b)))


def test_index_prunes_at_several_levels():
    fps = in_order(np.random.default_rng(8).integers(0, 1 << 64, 8192, dtype=np.uint64))
    forest = G.Forest(np.zeros(len(fps), np.int64), fps)
    search = G.Search(forest, 3)
    search.run(np.array([0]), np.array([0]))
    assert sum(n > 0 for n in search.pruned) >= 3
    # What is pruned is most of the work.
    leaves = len(forest.ones[0])
    assert search.pruned[0] + sum(n * G.FAN ** (2 * k) for k, n in enumerate(search.pruned) if k) > 0.3 * leaves * (leaves + 1) / 2


def test_index_links_whole_nodes_without_a_look(monkeypatch):
    monkeypatch.setattr(G.Search, "_leaves", lambda *_: pytest.fail("a leaf was opened"))
    fps = in_order([0xABCD0000 + k for k in range(16)] * 50)
    forest = G.Forest(np.zeros(len(fps), np.int64), fps)
    a, b = G.Search(forest, 4).run(np.array([0]), np.array([0]))
    assert set(components_of(len(fps), a, b)) == {0}


def shingles(text, width=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", text.lower())
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)} or {tuple(words)}


def by_shingles(rows):
    sets = [shingles(t) for _, t in rows]
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    return {d: rows[c][0] for (d, _), c in zip(rows, components_of(len(rows), [i for i, _ in pairs], [j for _, j in pairs]), strict=True)}


def edited(rng, words, edits):
    out = list(words)
    for p in rng.sample(range(len(out)), edits):
        out[p] = f"new{rng.randrange(10**6)}"
    return " ".join(out)


def test_verified_links(spark):
    rng = random.Random(4)
    rows = []
    for _ in range(12):
        words = [f"w{rng.randrange(10**5)}" for _ in range(200)]
        rows += [(len(rows) + k, edited(rng, words, k % 8)) for k in range(10)]
    rows += [(900, rows[0][1].upper()), (901, "few words"), (902, "Few  words"), (903, ""), (904, " ")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: r.component_id for r in S.near_duplicates(df, width=2, bits=7, shingle_width=5, seeds=(42, 43)).collect()}
    want = by_shingles(rows)
    # The fingerprints may part near copies, but nothing is linked that the shingles don't link.
    assert all(want[d] == want[got[d]] for d in want)
    assert sum(got[d] == want[d] for d in want) >= 0.95 * len(want)
    assert got[900] == 0 and got[902] == 901 and got[904] == 903


def test_sketch_agreement():
    rng = random.Random(6)
    missed = 0
    for _ in range(300):
        words = [f"w{rng.randrange(10**5)}".encode() for _ in range(300)]
        other = edited(rng, [w.decode() for w in words], 6).encode().split()
        x, y = X.shingle_set(words, 5), X.shingle_set(other, 5)
        if len(np.intersect1d(x, y)) >= 0.8 * len(np.union1d(x, y)):
            missed += 64 * X.SKETCH_WORDS - int(np.bitwise_count(X.sketch(x) ^ X.sketch(y)).sum()) < X.agreement(0.8)
    assert missed <= 3
