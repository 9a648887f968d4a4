import random

from docflow.llm.components import components


def test_chains_stars_and_odd_links(spark):
    rng = random.Random(2)
    links = [(i, i + 1) for i in range(100, 160)] + [(500, k) for k in range(600, 700)] + [(7, 7), (None, 3), (4, None), (900, 901), (901, 900), (901, 902)]
    rng.shuffle(links)
    got = dict(tuple(r) for r in components(spark.createDataFrame(links, "a bigint, b bigint"), "a", "b").collect())
    want = {i: 100 for i in range(100, 161)} | {500: 500} | {k: 500 for k in range(600, 700)} | {900: 900, 901: 900, 902: 900}
    assert got == want


def test_empty(spark):
    assert components(spark.createDataFrame([], "a bigint, b bigint"), "a", "b").collect() == []
