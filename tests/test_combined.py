import random
from collections import Counter

import pytest

from docflow.operators import chunks
from docflow.operators.combined import running, split_combined
from docflow.schema import SplitConfig
from pyspark.sql import functions as F

COLUMNS = ["d", "p", "section", "part", "heading", "chunk_type", "content", "token_count", "chunk_id"]
SMALL = SplitConfig(max_tokens_single=30, chunk_size=40, overlap=12)


def both(spark, rows, cfg, bits):
    df = spark.createDataFrame(rows, "d string, p int, t string")
    whole = chunks.split_texts(chunks.combined_pages(df, "d", "p", "t"), "d", "p", "t", "recursive", cfg)
    got = split_combined(df.repartition(3), "d", "p", "t", cfg, bits)
    rows = lambda x: Counter(tuple(r[c] for c in COLUMNS) for r in x.collect())
    return rows(got), rows(whole)


def pages(seed, n=60, docs="abc"):
    rng = random.Random(seed)
    words = ["one", "two.", "three", "Draft", "12", "4567", "é", "x" * 9, "x" * 55, "Total:", "\xa0", "  "]
    line = lambda: rng.choice(["", " ", "Confidential", "77", "Sum of all:", "  1234 ", "# Head", "## Head two", "#", " ".join(rng.choice(words) for _ in range(rng.randint(1, 6)))])
    some = lambda: "\n".join(line() for _ in range(rng.choice([0, 1, 5, 30])))
    return [(rng.choice(docs), rng.choice([None, rng.randint(1, 40)]), rng.choice([None, some(), some(), some()])) for _ in range(n)]


@pytest.mark.parametrize("seed", range(4))
def test_equals_the_joined_text(spark, seed):
    got, want = both(spark, pages(seed), SMALL, 6)
    assert len(want) > 50
    assert got == want


def test_one_section_over_many_blocks(spark):
    rng = random.Random(7)
    rows = [("big", p, "\n".join("w" * rng.randint(1, 30) for _ in range(50))) for p in range(40)] + [("none", 1, "# only\n## heads"), ("one", 1, "a b " * 100), ("label", 1, "Sum:"), ("label", 2, " \n "), ("label", 3, "12345\nend"), (None, 1, "of no document")]
    got, want = both(spark, rows, SMALL, 6)
    assert got == want
    assert sum(c for x, c in got.items() if x[0] == "big") > 500
    assert {x[6] for x in got if x[0] == "label"} == {"Sum: 12345\nend"}


def test_default_settings(spark):
    rng = random.Random(8)
    rows = [("d", p, "\n".join(" ".join("abcdefg"[: rng.randint(1, 7)] for _ in range(rng.randint(1, 30))) for _ in range(80))) for p in range(30)]
    got, want = both(spark, rows, SplitConfig(), 10)
    assert got == want and len(want) > 100


def test_no_row_or_group_holds_a_document(spark):
    """One document of 40,000 lines: no stored row, and no group of lines in Python, comes near it."""
    text = "\n".join(f"line {i} of the page" for i in range(100))
    df = spark.range(400).select(F.lit("d").alias("d"), F.col("id").cast("int").alias("p"), F.lit(text).alias("t"))
    got = split_combined(df, "d", "p", "t", SMALL, 7)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan
    assert got.agg(F.max(F.length("content"))).first()[0] <= 40
    assert got.count() == 20_000
    with pytest.raises(ValueError, match="two chunks"):
        split_combined(df, "d", "p", "t", SMALL, 3)


def test_empty(spark):
    for rows in ([], [("d", 1, None)], [("d", 1, "\n \nDraft\n12")]):
        got, want = both(spark, rows, SMALL, 6)
        assert got == want and not got


def test_running_sums(spark):
    rng = random.Random(1)
    rows = [(rng.randrange(1 << 30), rng.randrange(3)) for _ in range(2000)]
    got = {r.m: r.s for r in running(spark.createDataFrame(rows, "m bigint, v int"), "m", 4, s=F.col("v").cast("long")).collect()}
    total, want = 0, {}
    for m, v in sorted(rows):
        total += v
        want[m] = total
    assert got == want
