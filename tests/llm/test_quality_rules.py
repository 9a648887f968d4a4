import re
from collections import Counter

from docflow.llm.quality_rules import clean_texts, quality_rules


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def plain_repeats(text):
    w = words(text)
    seen = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    return len({p for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for p in (i, i + 1, i + 2)})


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash") for r in rows], "doc_id bigint, text string, source string, _h string")


def test_counts_equal_brute_force(spark):
    texts = [None, "", " \n\t", "a b", "a b c", "a b c a b c", "a a a a a", "x y z " * 30 + "end", "one\ntwo\none\n\n \none two # * $ <a>", "é ü \u001f b\x0bc\x0cd", "w " * 5000, "\U0001f600 b c \U0001f600 b c"]
    df = frame(spark, [(i, t, "s") for i, t in enumerate(texts)])
    for r in quality_rules(df).collect():
        t = texts[r.doc_id] or ""
        lines = [x for x in t.split("\n") if words(x)]
        n, rep = len(words(t)), plain_repeats(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, sum(map(len, words(t))), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), rep)
        assert r.base_failed == (n < 50 or 100 * rep > 50 * n)


def test_depleted_documents_go_and_copies_stay(spark):
    letters = lambda x: "".join(chr(97 + ord(c) % 26) for c in str(x))
    own = lambda i, n: " ".join(f"own{letters(i)}x{letters(k)}" for k in range(n))
    banner = " ".join(f"banner{letters(k)}" for k in range(80))
    rows = [(i, f"{own(i, 60)}\n{banner}  \n", "a") for i in range(8)]
    rows += [(100 + i, f"{own(i, 60)}\n{banner.upper()}\n{banner}", "b") for i in range(3)]
    rows += [(200 + i, f"{own('c', 90)}\n{own('d', 40)}", "a") for i in range(30)]
    rows += [(300, f"{own(300, 100)}\n{banner}", "a"), (301, own(301, 70), None), (301, own(301, 70), None), (None, own(302, 70), "a")]
    got = {}
    for r in quality_rules(frame(spark, rows)).collect():
        got.setdefault(r.doc_id, []).append((r.kept, r.removed_words))
    assert all(got[i] == [(False, 80)] for i in range(8))
    assert all(got[100 + i] == [(True, 0)] for i in range(3))
    assert all(got[200 + i] == [(True, 0)] for i in range(30))
    assert got[300] == [(True, 80)] and got[301] == [(True, 0)] * 2 and got[None] == [(True, 0)]
    cleaned = {r.doc_id: r.text for r in clean_texts(frame(spark, rows)).collect()}
    assert cleaned[0] == own(0, 60) + "\n" and cleaned[300] == own(300, 100) and cleaned[200] == rows[11][1]


def test_two_long_lines_shared_by_a_host_are_both_removed(spark):
    """The two longest lines and a short one stand on every page, so no page's longest other line is its own."""
    letters = lambda x: "".join(chr(97 + int(c)) for c in str(x))
    long = lambda name, n: " ".join(name + letters(k) for k in range(n))
    page = lambda i: f"home about contact\n{long('cookie', 80)}\n{long(f'own{letters(i)}x', 50)}\n{long('disclaimer', 60)}"
    rows = [(i, page(i), "a") for i in range(6)] + [(100 + i, page(i), "b") for i in range(5)] + [(200 + i, page(7), "c") for i in range(20)]
    got = {r.doc_id: (r.kept, r.removed_words) for r in quality_rules(frame(spark, rows)).collect()}
    assert got == {i: (False, 143) if i < 100 else (True, 0) for i, _, _ in rows}
    assert {r.text for r in clean_texts(frame(spark, rows[:6])).collect()} == {long(f"own{letters(i)}x", 50) for i in range(6)}


def test_empty(spark):
    assert quality_rules(frame(spark, []).limit(0)).collect() == []
