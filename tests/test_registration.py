import random

import pytest

from docflow.operators.registration import decided
from docflow.sources import sinks

SCHEMA = "id int, email string, username string, status string"


def plain(candidates, users):
    """One by one, in order."""
    emails, names = {e for e, _ in users}, {n for _, n in users}
    out = []
    for i, e, n in sorted(candidates, key=lambda c: (c[0] is None, c[0])):
        ok = (e is None or e not in emails) and (n is None or n not in names)
        if ok:
            emails |= {e} - {None}
            names |= {n} - {None}
        out.append((i, e, n, "created" if ok else "in_use"))
    return sorted(out, key=repr)


def run(spark, candidates, users):
    rows = spark.createDataFrame(candidates, "id int, email string, username string")
    known = spark.createDataFrame(users, "email string, username string")
    return sorted((tuple(r) for r in decided(rows, known, "id").collect()), key=repr)


@pytest.mark.parametrize("seed", range(4))
def test_equals_one_by_one(spark, seed):
    rng = random.Random(seed)
    value = lambda c, n: None if rng.random() < 0.05 else f"{c}{min(rng.randrange(n), rng.randrange(n))}"
    candidates = [(i, value("e", 40), value("n", 60)) for i in range(120)]
    rng.shuffle(candidates)
    users = [(f"e{rng.randrange(40)}", f"n{rng.randrange(60)}") for _ in range(4)] + [(None, None)]
    assert run(spark, candidates, users) == plain(candidates, users)


def test_two_with_one_email_and_one_with_a_known_name(spark):
    candidates = [(1, "a@x.y", "ann"), (2, "a@x.y", "bob"), (3, "b@x.y", "old"), (4, "b@x.y", "new")]
    got = run(spark, candidates, [("o@x.y", "old")])
    assert got == plain(candidates, [("o@x.y", "old")])
    # bob doesn't get ann's email, and who is out for a name keeps no email from others.
    assert [s for *_, s in got] == ["created", "in_use", "in_use", "created"]


def test_chain_hot_key_and_repeats(spark):
    chain = [(i, f"e{i // 2}", f"n{(i + 1) // 2}") for i in range(12)]
    assert run(spark, chain, []) == plain(chain, [])
    hot = [(i, "hot", f"n{i}") for i in range(50)] + [(100, "x", "n7"), (101, "y", "n0")]
    assert run(spark, hot, []) == plain(hot, [])
    assert sorted(s for *_, s in run(spark, [(1, "a", "b"), (1, "a", "b"), (None, "a", "b")], [])) == ["created", "in_use", "in_use"]


def test_none(spark):
    assert run(spark, [], []) == []
    assert run(spark, [(1, "a", "b")], [("a", "z")]) == [(1, "a", "b", "in_use")]


def test_register_stores_what_it_says(spark, tmp_path):
    path = str(tmp_path / "users")
    sinks.append(spark.createDataFrame([(0, "o@x.y", "old")], "id int, email string, username string"), path)
    users = spark.read.parquet(path)
    new = spark.createDataFrame([(1, "a@x.y", "ann"), (2, "a@x.y", "bob"), (3, "b@x.y", "old"), (4, "b@x.y", "new")], users.schema)
    got = sinks.register(new, users, path)
    assert sorted((r.id, r.status) for r in got.collect()) == [(1, "created"), (2, "in_use"), (3, "in_use"), (4, "created")]
    assert sorted(r.id for r in spark.read.parquet(path).collect()) == [0, 1, 4]
    # Said again after the append, nothing has changed.
    assert got.where("status = 'created'").count() == 2
    again = sinks.register(new, spark.read.parquet(path), path)
    assert {r.status for r in again.collect()} == {"in_use"} and spark.read.parquet(path).count() == 3
