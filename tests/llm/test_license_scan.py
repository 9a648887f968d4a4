import itertools
import random
import re

from hypothesis import given, settings, strategies as st

from docflow.llm import license_scan as L
from docflow.llm.q_license_scan import op2_license_scan
from docflow.llm.spaced_seeds import PUNCTUATION


def tokens(text):
    return [t for t in (w.strip(PUNCTUATION) for w in (text or "").lower().split()) if t]


def test_query_finds_every_notice(spark):
    folder = "/root/testdata/sf0.01"
    rows = {r.doc_id: tokens(r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    got = op2_license_scan(spark, folder).collect()
    want = set()
    for name, text in L.TEMPLATES.items():
        t = tokens(text)
        for d, w in rows.items():
            want |= {(d, name, k) for k in range(len(w) - len(t) + 1) if w[k : k + len(t)] == t}
    assert want and want <= {(r.doc_id, r.license, r.start_word) for r in got}
    for r in got:
        assert r.coverage >= 0.8 and r.matched_words == round(r.coverage * r.template_words)
        if r.coverage == 1 and r.end_word - r.start_word == r.template_words:
            assert (r.doc_id, r.license, r.start_word) in want


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 30), unique=True, max_size=9))
def test_longest_increasing(values):
    got = L.increasing(values)
    assert got == sorted(got) and all(values[a] < values[b] for a, b in zip(got, got[1:], strict=False))
    best = max((len(c) for n in range(len(values) + 1) for c in itertools.combinations(values, n) if list(c) == sorted(c)), default=0)
    assert len(got) == best


def plain_align(a, b):
    """Recursive reference for the number of matches."""
    n = 0
    while a and b and a[0] == b[0]:
        a, b, n = a[1:], b[1:], n + 1
    while a and b and a[-1] == b[-1]:
        a, b, n = a[:-1], b[:-1], n + 1
    unique = [w for w in a if a.count(w) == 1 and b.count(w) == 1]
    if not unique:
        return n
    best = max((c for k in range(1, len(unique) + 1) for c in itertools.combinations(unique, k) if [b.index(w) for w in c] == sorted(b.index(w) for w in c)), key=len)
    return n, len(best)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 9), max_size=10), st.lists(st.integers(0, 9), max_size=10))
def test_alignment_is_increasing_and_keeps_anchors(a, b):
    pairs = L.align(a, b)
    assert all(a[x] == b[y] for x, y in pairs)
    assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:], strict=False))
    least = plain_align(a, b)
    assert len(pairs) >= (sum(least) if isinstance(least, tuple) else least)


def test_changed_licenses_and_clean_texts(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    fill = lambda n: " ".join(word() for _ in range(n))
    mit = L.TEMPLATES["MIT"].split()
    changed = " ".join(w if k % 12 else word() for k, w in enumerate(mit))
    inserted = " ".join(w + (" " + word() if k % 15 == 0 else "") for k, w in enumerate(mit))
    half = " ".join(mit[: len(mit) // 2])
    line = "Licensed under the Apache License, Version 2.0."
    rows = [(1, f"{fill(50)} {changed} {fill(20)}"), (2, inserted.upper()), (3, half + fill(90)), (4, fill(300)), (5, f"{line} {fill(30)} {line}\n{line}"), (6, None), (7, ""), (None, line), (8, (line + "\n") * 400), (8, (line + "\n") * 400), (9, "licensed under the license of the software for the public")]
    got = L.licenses(spark.createDataFrame([(*r, "clash") for r in rows], "doc_id bigint, text string, license string")).collect()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    assert {r.license for r in by[1]} == {"MIT"} == {r.license for r in by[2]}
    assert by[1][0].start_word >= 50 and by[1][0].coverage > 0.85
    assert not any(d in by for d in (3, 4, 6, 7, 9))
    assert [r.start_word for r in sorted(by[5], key=lambda r: r.start_word)] == [0, 37, 44] and len(by[None]) == 1 and len(by[8]) == 800
    assert L.licenses(spark.createDataFrame([], "doc_id bigint, text string")).collect() == []


def scanned(spark, texts):
    rows = L.licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()
    return [sorted((r.license, r.start_word, r.end_word, r.matched_words) for r in rows if r.doc_id == k) for k in range(len(texts))]


def test_insertions_small_changes_and_overlaps(spark):
    rng = random.Random(6)
    fill = lambda n: " ".join("".join(rng.choice("klmnopqrst") for _ in range(7)) for _ in range(n))
    mit = L.TEMPLATES["MIT"].split()
    n = len(tokens(L.TEMPLATES["MIT"]))
    fifth = " ".join(w + (" foreign" if k % 5 == 4 else "") for k, w in enumerate(mit))
    long = f"{fill(100000)} {L.TEMPLATES['ISC']} {fill(100000)}"
    got = scanned(spark, [fifth, "Released under an MIT License.", L.TEMPLATES["BSD-3-Clause"], L.TEMPLATES["BSD-2-Clause"], L.TEMPLATES["Apache-2.0-notice"], "Licensed under CC BY-SA 4.0.", long])
    assert [(x[0], x[3]) for x in got[0]] == [("MIT", n)]
    assert got[1] == [("MIT-line", 0, 5, 4)]
    assert [[x[0] for x in g] for g in got[2:]] == [["BSD-3-Clause"], ["BSD-2-Clause"], ["Apache-2.0-notice"], ["CC-BY-SA-4.0-short"], ["ISC"]]
    assert got[6][0][1] == 100000


def test_places_equal_alignment_everywhere():
    """Short texts of the template's words and others: what aligning every stretch finds, the scan finds."""
    rng = random.Random(7)
    template = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    words = template.split()
    for _ in range(300):
        text = [w for w in words if rng.random() > 0.12]
        for _ in range(rng.randrange(4)):
            text.insert(rng.randrange(len(text) + 1), rng.choice(["x", "y", "z"]))
        text = ["x"] * rng.randrange(6) + text + ["y"] * rng.randrange(6)
        scanner = L.Scanner({"t": template}, 0.8)
        hashes, _ = L.word_hashes(L.pa.array([" ".join(text)]))
        best = max(len(L.align(hashes[a:b].tolist(), scanner.words[0])) for a in range(len(text)) for b in range(a + 1, len(text) + 1))
        got = scanner.scan(hashes, [0])
        assert [x[3] for x in got] == ([best] if best >= 8 else [])


def test_templates_are_plain_text():
    assert all(re.fullmatch(r"[\x20-\x7e]+", t) for t in L.TEMPLATES.values())
