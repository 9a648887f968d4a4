import itertools
import random

import numpy as np
import pytest

from docflow.llm import spaced_seeds as S
from docflow.llm.q_decontamination import op10_benchmark_decontamination


def tokens(text):
    return [t for t in (w.strip(S.PUNCTUATION) for w in (text or "").lower().split()) if t]


def plain(docs, items, least=0.8, run=13, shift=8, details=False):
    """The rule of the docstring, over all diagonals that a seed hits, with chains by their recurrence."""
    found = {}
    for item, text in items:
        iw = tokens(text)
        family = [f for n, f in S.FAMILIES if n <= len(iw)][-1] if iw else ()
        for doc, dw in docs:
            places = {}
            for p, w in enumerate(dw):
                places.setdefault(w, []).append(p)
            diagonals = {}
            for i, w in enumerate(iw):
                for p in places.get(w, ()):
                    diagonals.setdefault(p - i, set()).add(i)
            hit = {o: m for o, m in diagonals.items() if any({s + k for k, c in enumerate(f) if c == "1"} <= m for f in family for s in range(len(iw) - len(f) + 1))}
            longest = max((sum(1 for _ in g) for m in hit.values() for on, g in itertools.groupby(range(len(iw)), m.__contains__) if on), default=0)
            most = 0
            for o in hit:
                pairs = sorted((i, i + x) for x, m in hit.items() if o <= x <= o + shift for i in m)
                if len({i for i, _ in pairs}) <= most:
                    continue
                size = {}
                for i, d in pairs:
                    size[i, d] = 1 + max((n for (j, e), n in size.items() if j < i and e < d), default=0)
                most = max([most, *size.values()])
            if iw and (most / len(iw) >= least or longest >= run):
                found[doc, item] = (len(iw), most, longest)
    return found if details else set(found)


def test_query_equals_brute_force(spark):
    folder = "/root/testdata/sf0.01"
    docs = [(r.doc_id, tokens(r.text)) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{folder}/benchmark.parquet").select("item_id", "text").collect()]
    got = op10_benchmark_decontamination(spark, folder).collect()
    assert {(r.doc_id, r.item_id) for r in got} == plain(docs, items) and got
    assert len(got) == len({(r.doc_id, r.item_id) for r in got})


@pytest.mark.parametrize("n", [*range(1, 26)])
def test_families_lose_nothing(n):
    """No way to change a fifth of the words hits all seeds. Longer items have a stretch of 15 to 25 words that is changed by a fifth at most."""
    family = [f for least, f in S.FAMILIES if least <= n][-1]
    seeds = np.array([sum(1 << (s + k) for k, c in enumerate(m) if c == "1") for m in family for s in range(n - len(m) + 1)])
    ways = itertools.combinations(range(n), n // 5)
    while block := list(itertools.islice(ways, 100000)):
        changed = np.bitwise_or.reduce(1 << np.array(block, np.int64).reshape(len(block), -1), axis=1)
        assert ((changed[:, None] & seeds) == 0).any(axis=1).all()


def test_short_items(spark):
    """Items of any length are found whole and, from five words on, with a fifth of their words changed."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    items = [(n, [word() for _ in range(n)]) for n in range(1, 24)]
    docs = []
    for n, item in items:
        docs.append((1000 * n, [word() for _ in range(5)] + item + [word()]))
        for k in range(n):
            gone = {k} if n < 10 else set(rng.sample(range(n), n // 5 + k % 2))
            docs.append((1000 * n + 1 + k, [word()] + [word() if i in gone else w for i, w in enumerate(item)]))
    df = spark.createDataFrame([(d, " ".join(w)) for d, w in docs], "doc_id bigint, text string")
    bench = spark.createDataFrame([(n, " ".join(w)) for n, w in items], "item_id bigint, text string")
    got = {(r.doc_id, r.item_id) for r in S.contaminated(df, bench).collect()}
    assert got == plain(docs, [(n, " ".join(w)) for n, w in items])
    assert {(1000 * n, n) for n in range(1, 24)} <= got and {(1000 * n + 1 + k, n) for n in range(5, 10) for k in range(n)} <= got


def test_substitutions_insertions_and_clean_documents(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    item = [word() for _ in range(40)]
    fill = lambda n: [word() for _ in range(n)]
    changed = [w if k % 9 else word() for k, w in enumerate(item)]
    inserted = item[:20] + ["extra"] + item[20:]
    half, bit = item[:20], item[5:16]
    docs = [(1, fill(30) + item + fill(5)), (2, fill(3) + [w.upper() + "," for w in changed]), (3, inserted + fill(9)), (4, fill(80)), (5, half + fill(50)), (6, item * 50), (10, fill(70000) + item), (9, fill(9) + bit + fill(40))]
    rows = [(d, " ".join(w), "x") for d, w in docs] + [(7, None, "x"), (8, "", "x"), (None, " ".join(item), None), (1, " ".join(fill(3) + item), "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, _w string")
    bench = spark.createDataFrame([(1, " ".join(item), 0), (2, "too short", 0), (5, " ".join(item[1:3]), 0), (3, None, 0), (4, " ".join(item[:6]), 0), (None, " ".join(item), 0)], "item_id bigint, text string, _iw int")
    got = S.contaminated(df, bench).collect()
    assert sorted(str(r.doc_id) for r in got if r.item_id == 1) == sorted(["1", "1", "2", "3", "5", "6", "10", "None"])
    assert sum(r.item_id is None for r in got) == 8
    assert {r.doc_id for r in got if r.item_id == 5} == {1, 2, 3, 5, 6, 10, None}
    assert {r.doc_id for r in got if r.item_id == 4} >= {1, 3, 5, 6}
    assert S.contaminated(df.limit(0), bench).collect() == [] and S.contaminated(df, bench.limit(0)).collect() == []


def test_pieces_far_apart_or_in_another_order_do_not_add_up(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    fill = lambda n: [word() for _ in range(n)]
    item = fill(30)
    docs = [
        (1, fill(9) + item[:7] + fill(900) + item[7:14] + fill(9)),
        (2, item[20:] + fill(50) + item[10:20] + fill(50) + item[:10]),
        (3, item[:12] + fill(5000) + item[12:24] + fill(60000) + item[24:]),
        (4, item[:12] + item[20:] + item[12:20]),
        (5, item[:10] + fill(3) + item[10:20] + fill(4) + item[20:]),
        (6, item[:11] + item[14:] + fill(5)),
        (7, item[:10] + fill(6) + item[10:20] + fill(6) + item[20:]),
        (8, fill(4) + item[:13] + fill(40) + item[13:25]),
    ]
    df = spark.createDataFrame([(d, " ".join(w)) for d, w in docs], "doc_id bigint, text string")
    bench = spark.createDataFrame([(1, " ".join(item))], "item_id bigint, text string")
    got = {(r.doc_id, r.item_id): (r.item_words, r.matched_words, r.longest_run) for r in S.contaminated(df, bench).collect()}
    assert got == plain(docs, [(1, " ".join(item))], details=True)
    assert got == {(5, 1): (30, 30, 10), (6, 1): (30, 27, 16), (8, 1): (30, 13, 13)}


def test_random_pieces_equal_plain(spark):
    """Small alphabet: many diagonals, repeats and chance hits."""
    rng = random.Random(12)
    items = [(n, " ".join(rng.choice("abcd") for _ in range(n))) for n in (3, 5, 6, 8, 10, 15, 20)]
    docs = []
    for k in range(60):
        words = [rng.choice("abcd") for _ in range(rng.randrange(60))]
        piece = rng.choice(items)[1].split()
        at, cut = rng.randrange(len(words) + 1), rng.randrange(len(piece))
        docs.append((k, words[:at] + piece[:cut] + [rng.choice("abcd")] * rng.randrange(3) + piece[cut:] + words[at:]))
    df = spark.createDataFrame([(d, " ".join(w)) for d, w in docs], "doc_id bigint, text string")
    got = {(r.doc_id, r.item_id): (r.item_words, r.matched_words, r.longest_run) for r in S.contaminated(df, spark.createDataFrame(items, "item_id bigint, text string")).collect()}
    assert got == plain(docs, items, details=True) and len(got) > 60


def test_stretches_lend_their_border():
    item = list(range(24))
    for start in (1015, 1020, 1023, 1024):
        found = [(start, np.array(item[:12])), (start + 8, np.array(item[12:]))]
        assert S.best_match(found, 24, 8) == (24, 12)
        assert S.best_match(found, 24, 7) == (12, 12)
