import random
import re
import uuid

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from docflow.functions import ids, text as X
from docflow.operators import chunks, pages as P, splitting
from docflow.operators.span_chunks import packed, pages_with_spans, span_chunks
from docflow.schema import BBOX, LINE, SPAN, NodeSplitConfig, SplitConfig


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "t string").select(f(F.col("t")).alias("x")).first().x


@pytest.mark.parametrize(
    ("text", "cleaned"),
    [("  Confidential  \n\n  123  \nActual   text\n", "Actual text"), (None, ""), ("Draftsman draft", "Draftsman"), ("a\n\n\n\nb \t c", "a\nb c"), ("é \n٣\n", "é")],
)
def test_page_clean(spark, text, cleaned):
    assert one(spark, text, X.page_clean) == cleaned


@pytest.mark.parametrize(
    ("text", "cleaned"),
    [("Draft\n12\nTotal:\n 12345\n\n\nbody\t x ", "Total: 12345\nbody x"), ("CONFIDENTIAL\nkeep draft here", "keep draft here"), ("", ""), (None, ""), ("Label:\n12\nx", "Label:\nx")],
)
def test_boilerplate_clean(spark, text, cleaned):
    assert one(spark, text, X.boilerplate_clean) == cleaned


def test_counts_and_normalisation(spark):
    assert one(spark, " a  b\n", X.normalize) == "a b"
    assert one(spark, "This is four words", X.token_count) == int(4 * 1.3 + 18 * 0.2) and one(spark, "", X.token_count) == 1
    assert one(spark, " a  b ", X.word_count) == 2


def test_ids_are_version_5_uuids(spark):
    want = uuid.uuid5(uuid.NAMESPACE_URL, "doc-1|3||generic|some text").hex[:16]
    assert one(spark, "some   text", lambda t: ids.chunk_id(F.lit("doc-1"), F.lit(3), F.lit(None), F.lit("generic"), t)) == want
    assert one(spark, "é", lambda t: ids.page_id(t, F.lit(7))) == uuid.uuid5(uuid.NAMESPACE_URL, "é:7").hex[:16]
    same = one(spark, "x" * 160 + "a", lambda t: ids.chunk_id(F.lit("d"), F.lit(1), F.lit(None), F.lit("g"), t))
    assert same == one(spark, "x" * 160 + "b", lambda t: ids.chunk_id(F.lit("d"), F.lit(1), F.lit(None), F.lit("g"), t))


def test_headings(spark):
    got = one(spark, "# Title\n ## Sub \n#tag\n####### seven\n    # code\nx # y", X.headings)
    assert [(h.text, h.level) for h in got] == [("Title", 1), ("Sub", 0), ("tag", 1)]


def test_highlights(spark):
    row = spark.createDataFrame([("The Cat sat, cost \\E 5$.", "the cat CO cat $ \\E élan")], "c string, q string")
    assert row.select(X.highlights(F.col("c"), F.col("q")).alias("x")).first().x == ["the", "cat", "cat"]


def split(spark, text, mode="semantic", cfg=SplitConfig(), embed=None):  # noqa: B008
    df = spark.createDataFrame([("doc-1", 1, text)], "d string, p int, t string")
    return sorted(chunks.split_texts(df, "d", "p", "t", mode, cfg, embed).collect(), key=lambda r: (r.section, r.part))


def test_short_text_is_one_generic_chunk(spark):
    (row,) = split(spark, "This is a short paragraph that doesn't need splitting.")
    assert row.chunk_type == "generic" and row.heading is None and len(row.chunk_id) == 16


def test_heading_sections(spark):
    rows = split(spark, "# Title\nBody one\n\n## Subtitle\nBody two")
    assert [(r.heading, r.chunk_type, r.content) for r in rows] == [("Title", "hierarchical", "Body one"), ("Subtitle", "hierarchical", "Body two")]
    (row,) = split(spark, "# only\nbody")
    assert row.chunk_type == "generic" and row.content == "# only\nbody"
    assert [r.heading for r in split(spark, "intro\n# empty\n# b\nx")] == ["Introduction", "b"]


def test_legal_sections(spark):
    rows = split(spark, "§1 First.\n\n§2 Second.", mode="legal")
    assert [(r.heading, r.chunk_type) for r in rows] == [("§1", "legal"), ("§2", "legal")]
    assert [r.heading for r in split(spark, "pre § Ä1 x", mode="legal")] == ["§", "§Ä1"]


def test_long_text_is_split(spark):
    cfg = SplitConfig(chunk_size=200, overlap=50, max_tokens_single=100)
    rows = split(spark, "This sentence. " * 100, cfg=cfg)
    assert len(rows) > 1 and all("This sentence" in r.content and r.chunk_type == "recursive" for r in rows)
    cut = split(spark, "One two three four. " * 60 + "Other words entirely here now. " * 60, cfg=cfg, embed=splitting_embed)
    assert {r.chunk_type for r in cut} == {"semantic"} and len(cut) == 2


def splitting_embed(text):
    import numpy as np

    return np.array([1.0, 0.0]) if text.startswith("One") else np.array([0.0, 1.0])


@pytest.mark.parametrize("text", ["", "  \n\t ", None, "Draft\n12"])
def test_blank_texts_give_nothing(spark, text):
    assert split(spark, text) == []


def test_node_sections(spark):
    df = spark.createDataFrame([(1, "pre §7 seven §9 nine"), (2, "plain words " * 200), (3, " ")], "d int, t string")
    got = sorted(chunks.node_split(df, "d", "t", NodeSplitConfig()).collect(), key=lambda r: (r.d, r.section))
    assert [(r.section, r.content) for r in got if r.d == 1] == [("§1", "pre"), ("§2", "§7 seven"), ("§3", "§9 nine")]
    assert len([r for r in got if r.d == 2]) > 2 and {r.chunk_type for r in got if r.d == 2} == {"recursive"} and not [r for r in got if r.d == 3]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab .\n", max_size=300), st.integers(1, 40), st.integers(0, 20))
def test_recursive_split_properties(text, size, overlap):
    parts = splitting.recursive_split(text, size, overlap, SplitConfig().separators)
    assert all(0 < len(p) <= size and p in text for p in parts)
    assert set("".join(parts)) <= set(text)
    places = [text.find(p) for p in parts]
    assert "".join(re.sub(r"\s", "", p) for p in splitting.recursive_split(text, size, 0, SplitConfig().separators)) == re.sub(r"\s", "", text)
    assert all(p >= 0 for p in places)


def plain_pack(spans, limit, min_chars):
    """An independent model: cut into runs first, then resolve short runs."""
    runs, run = [], []
    for text, alone in [(t, splitting.estimate_tokens(t) > limit) for t in (s["text"].strip() for s in spans) if t]:
        if alone:
            runs += [("run", run), ("alone", [text])]
            run = []
        elif sum(map(splitting.estimate_tokens, run)) + splitting.estimate_tokens(text) > limit:
            runs.append(("run", run))
            run = [text]
        else:
            run.append(text)
    out = []
    for kind, texts in [*runs, ("run", run)]:
        joined = "\n".join(texts)
        if not texts:
            continue
        if kind == "alone" or len(joined) >= min_chars:
            out.append(joined)
        elif out and splitting.estimate_tokens(out[-1] + "\n" + joined) <= int(limit * 1.2):
            out[-1] += "\n" + joined
    return out


def random_pages(rng):
    """Pages of spans: null and blank ones among them, long and short, with and without a box."""
    text = lambda: "".join(rng.choice("ab c") for _ in range(rng.choice([0, 3, 10, 30, 90])))
    box = lambda: {c: float(rng.randrange(100)) for c in ("x", "y", "width", "height")}
    span = lambda: None if rng.random() < 0.05 else {"text": None if rng.random() < 0.03 else text(), "bbox": box() if rng.random() < 0.9 else None}
    return [[span() for _ in range(rng.choice([0, 1, 2, 3, 5, 8, 13, 40, 100]))] for _ in range(200)]


@pytest.mark.parametrize(("limit", "min_chars"), [(3, 0), (5, 4), (12, 9), (20, 30), (30, 12), (800, 80)])
def test_span_packing_equals_model(spark, limit, min_chars):
    pages = random_pages(random.Random(limit))
    df = spark.createDataFrame(list(enumerate(pages)), f"k int, s array<{SPAN.simpleString()}>")
    got = {r.k: [c.content for c in r.c] for r in df.select("k", packed(F.col("s"), SplitConfig(chunk_size=limit, min_chars=min_chars)).alias("c")).collect()}
    assert got == {k: plain_pack([{"text": s["text"] or ""} for s in spans if s], limit, min_chars) for k, spans in enumerate(pages)}


def test_span_packing_keeps_first_part_and_box(spark):
    box = lambda k: (float(k), 0.0, 1.0, 2.0 + k)
    spans = [("x", box(9)), ("word " * 8, box(1)), ("word " * 8, None), ("tail", box(3)), ("word " * 30, None), ("y", box(4))]
    df = spark.createDataFrame([("d", spans), ("d", spans), (None, []), ("e", None)], f"d string, s array<{SPAN.simpleString()}>").withColumn("p", F.lit(1))
    rows = span_chunks(df, "d", "p", "s", SplitConfig(chunk_size=18, min_chars=20)).orderBy("part").collect()
    line = ("word " * 8).strip()
    assert [r.content for r in rows[::2]] == [line, f"{line}\ntail", ("word " * 30).strip()] and len(rows) == 6
    assert {r.dropped_tails for r in rows} == {2} and [r.bbox and tuple(r.bbox) for r in rows[::2]] == [box(1), None, None]
    assert rows[2].token_count == rows[0].token_count and rows[2].chunk_id == rows[0].chunk_id


def test_span_packing_of_a_long_page(spark):
    df = spark.range(1).select(F.lit("d").alias("d"), F.lit(1).alias("p"), F.transform(F.sequence(F.lit(1), F.lit(20000)), lambda k: F.struct(F.concat(F.lit("word "), k.cast("string")).alias("text"), F.lit(None).cast(BBOX.simpleString()).alias("bbox"))).alias("s"))
    made = span_chunks(df, "d", "p", "s")
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "Arrow" not in plan and "Python" not in plan and "Exchange" not in plan
    assert [r.content for r in made.orderBy("part").collect()] == plain_pack([{"text": f"word {k}"} for k in range(1, 20001)], 800, 80)


def test_span_chunks_and_mixed_pages(spark):
    box = lambda k: {"x": 10.0, "y": 10.0 + 15 * k, "width": 50.0 + 10 * k, "height": 10.0}
    spans = [{"text": "First line of text", "bbox": box(0)}, {"text": "Second line", "bbox": box(1)}, {"text": " ", "bbox": box(2)}]
    schema = "d string, p string, s array<struct<text:string,bbox:struct<x:double,y:double,width:double,height:double>>>, t string"
    df = spark.createDataFrame([("doc", "1", spans, None), ("doc", "2", None, "Plain page"), ("doc", "x", None, "skipped"), ("doc", None, spans, None)], schema)
    cfg = SplitConfig(min_chars=10)
    rows = pages_with_spans(df, "d", "p", "s", "t", "recursive", cfg).collect()
    assert sorted((r.p, r.chunk_type) for r in rows) == [(1, "by_spans"), (2, "generic")]
    (row,) = span_chunks(df.where("p = '1'"), "d", "p", "s", cfg).collect()
    assert row.bbox.asDict() == {"x": 10.0, "y": 10.0, "width": 60.0, "height": 25.0} and row.content == "First line of text\nSecond line"
    assert len(pages_with_spans(df, "d", "p", "s", "t", "recursive", SplitConfig(min_chars=10, max_chunks=1)).collect()) == 1


def test_span_geometry(spark):
    lines = [(10.0, 100.0, 110.0, 130.0, " OK "), (0.0, 0.0, 10.0, 10.0, "  "), (0.0, 0.0, 0.0, 10.0, "flat"), (10.0, 20.0, 5.0, 30.0, "negative"), (0.0, 0.0, 5.0, 5.0, None)]
    df = spark.createDataFrame([(lines,), (None,), ([],)], f"l array<{LINE.simpleString()}>")
    got = [r.s for r in df.select(P.spans(F.col("l"), F.lit(1000.0)).alias("s")).collect()]
    assert [(s.text, s.bbox.x, s.bbox.y, s.bbox.width, s.bbox.height) for s in got[0]] == [("OK", 10.0, 870.0, 100.0, 30.0)] and got[1:] == [[], []]
    boxes = spark.createDataFrame([([("a", None)],), ([],)], f"s array<{SPAN.simpleString()}>")
    assert [r.b for r in boxes.select(P.union_bbox(F.col("s")).alias("b")).collect()] == [None, None]


def test_page_records(spark):
    rows = [("d", 1, "Hello  world", None), ("d", 2, " \n", None), ("d", 3, "", "scanned words"), ("d", 4, "Draft\n7", None)]
    df = spark.createDataFrame(rows, "d string, n int, own string, ocr string")
    records = P.page_records(df, "d", "n", "own", "ocr")
    got = {r.pageNumber: r for r in records.collect()}
    assert set(got) == {1, 3} and got[1].content == "Hello world" and got[1].wordCount == 2 and got[1].pageIndicator == "Page 1/4" and got[3].textSource == "ocr"
    assert P.extraction_summary(df, records, "d").first().asDict() == {"d": "d", "totalPages": 4, "pagesReturned": 2, "ocrUsed": True}


def test_ocr_meets_only_pages_without_text(spark):
    df = spark.createDataFrame([(1, "text", b"never"), (2, " ", b"image"), (3, None, b"broken"), (4, None, None)], "n int, own string, image binary")

    def engine(image):
        assert image != b"never"
        if image == b"broken":
            raise RuntimeError("engine failed")
        return image.decode()

    got = {r.n: r.recognised for r in P.recognise(df, "own", "image", engine).collect()}
    assert got == {1: None, 2: "image", 3: None, 4: None}


def test_combined_pages(spark):
    df = spark.createDataFrame([("d", 2, "two"), ("d", 1, "one"), ("d", 3, None), ("d", 4, ""), ("e", 1, None)], "d string, p int, t string")
    got = {r.d: (r.t, r.p) for r in chunks.combined_pages(df, "d", "p", "t").collect()}
    assert got == {"d": ("one\ntwo", None), "e": ("", None)}
