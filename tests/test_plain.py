"""The queries that SQL can't express, against plain Python over whole tables."""

import re
import uuid
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from docflow.operators import chunks, retrieval, sentences
from docflow.plugins import hash_embedding
from docflow.schema import NodeSplitConfig, SplitConfig
from tests.test_text import plain_pack

SF = "/root/testdata/sf0.001"
CFG = SplitConfig()


@pytest.fixture(scope="module")
def docs(spark):
    return [r.asDict() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]


def found(spark, name, *columns):
    return Counter(tuple(r[c] for c in columns) for r in entry.queries()[name](spark, SF).collect())


def tokens(text):
    return max(1, int(len(text.split()) * 1.3 + len(text) * 0.2))


def cleaned(text):
    text = re.sub(r"(?mi)^([^\n:]{2,}?:)\s*\n\s*(\d{3,})\s*$", r"\1 \2", text)
    text = re.sub(r"(?mi)^(?:\s*(?:Confidential|Draft|\d+)\s*)$", "", text)
    return "\n".join(x for line in re.sub(r"[ \t]+", " ", text).split("\n") if (x := line.rstrip()))


def by_size(text, size, overlap, separators):
    """Prefix sums over the parts: a chunk is the widest window that fits, the next one starts as far back as the overlap lets it."""
    k = next(i for i, s in enumerate(separators) if s in text)
    sep = separators[k]
    parts = list(text) if not sep else [p for p in re.split(f"(?={re.escape(sep)})", text) if p]
    if sep:
        # Separators that overlap themselves don't occur in the lookahead alone.
        first, *rest = text.split(sep)
        parts = [p for p in [first, *[sep + r for r in rest]] if p]
    out, run = [], []
    for part in [*parts, None]:
        if part is not None and len(part) <= size:
            run.append(part)
            continue
        ends = np.cumsum([0, *map(len, run)])
        a = b = 0
        while b < len(run):
            b = int(np.searchsorted(ends, ends[a] + size, "right")) - 1
            out.append("".join(run[a:b]).strip())
            if b < len(run):
                a = next(i for i in range(a, b + 1) if ends[b] - ends[i] <= overlap and ends[b + 1] - ends[i] <= size)
        run = []
        if part is not None:
            out += by_size(part, size, overlap, separators[k + 1 :])
    return [x for x in out if x]


def by_distance(text):
    sentences = [x for x in re.split(r"(?<=[.!?])\s+", text) if x.strip()]
    if len(sentences) < 2:
        return [text.strip()] if text.strip() else []
    cosine = lambda a, b: float(a @ b) / max(float(np.sqrt(a @ a)) * float(np.sqrt(b @ b)), 1e-12)
    away = [1 - cosine(hash_embedding(a), hash_embedding(b)) for a, b in zip(sentences, sentences[1:], strict=False)]
    place = 0.95 * (len(away) - 1)
    low = sorted(away)[int(place)]
    limit = low + (sorted(away)[min(int(place) + 1, len(away) - 1)] - low) * (place - int(place))
    out = [sentences[0]]
    for s, d in zip(sentences[1:], away, strict=True):
        if d > limit + 1e-12:
            out.append(s)
        else:
            out[-1] += " " + s
    return out


def sections(text, legal):
    if legal and "§" in text:
        return [("§" + re.match(r"§\s*(\w+)", x)[1] if re.match(r"§\s*\w", x) else "§", "legal", x) for p in re.split(r"(?=§\s*\w+)", text) if (x := p.strip())]
    out = [["Introduction", []]]
    for line in text.split("\n"):
        if m := re.match(r"^\s{0,3}#{1,6}\s*([^\n#].*?)\s*$", line):
            out.append([m[1], []])
        else:
            out[-1][1].append(line)
    out = [(h, "\n".join(lines)) for h, lines in out if lines]
    return [(h, "hierarchical", x.strip()) for h, x in out if x.strip()] if len(out) > 1 else [(None, "generic", text)]


def plain_chunks(document, page, text, mode):
    text = cleaned(text)
    out = []
    for section, (heading, kind, content) in enumerate(sections(text, mode == "legal") if text.strip() else []):
        parts = [content]
        if tokens(content) > CFG.max_tokens_single:
            parts = [x for x in (by_distance(content) if mode == "semantic" else by_size(content, CFG.chunk_size, CFG.overlap, CFG.separators))]
            kind = "semantic" if mode == "semantic" else "recursive"
        for part, x in enumerate(parts):
            if len(parts) == 1 or tokens(x) >= CFG.min_part_tokens:
                name = "|".join(" ".join(str("" if v is None else v).split()) for v in (document, page, heading, kind, x[:160]))
                out.append((document, page, section, part, heading, kind, x, tokens(x), uuid.uuid5(uuid.NAMESPACE_URL, name).hex[:16]))
    return out


COLUMNS = ["document_id", "page", "section", "part", "heading", "chunk_type", "content", "token_count", "chunk_id"]


def test_recursive_splits(spark, docs):
    assert found(spark, "recursive_split", "doc_id", "part", "content") == Counter((d["doc_id"], k, x) for d in docs for k, x in enumerate(by_size(d["text"], CFG.chunk_size, CFG.overlap, CFG.separators)))
    node = NodeSplitConfig()
    want = Counter((d["doc_id"], f"chunk-{k + 1}", x) for d in docs if d["text"].strip() for k, x in enumerate(by_size(d["text"].strip(), node.chunk_size, node.overlap, node.separators)))
    assert found(spark, "node_recursive_split", "doc_id", "section", "content") == want


def test_semantic_split(spark, docs):
    assert found(spark, "semantic_split", "doc_id", "part", "content") == Counter((d["doc_id"], k, x) for d in docs for k, x in enumerate(by_distance(d["text"])))


def test_semantic_split_once(spark, docs):
    want = Counter((d["doc_id"], k, x) for d in docs for k, x in enumerate(by_distance(d["text"])))
    assert found(spark, "semantic_split_once", "doc_id", "part", "content") == want


def test_every_distinct_sentence_is_embedded_once(spark):
    story = "One is here. Two is here! Other words altogether? Two is here! Three now."
    broken = "A word. It fails now. Another one. " * 40
    rows = [(1, story, True, "clash"), (2, story, True, "x"), (2, story, True, "x"), (3, f"{story} Broken off. End.", True, None), (4, " only one ", True, None), (5, "", True, None), (6, " \n", True, None), (7, None, True, None), (8, story, False, None), (None, story, None, None), (9, broken, True, None)]
    df = spark.createDataFrame(rows, "k int, content string, flag boolean, _t string").repartition(3)
    sent = spark.sparkContext.accumulator(0)

    def embed(sentences):
        if any("fails" in s for s in sentences):
            raise RuntimeError("no model")
        sent.add(len(sentences))
        return np.array([hash_embedding(s) for s in sentences])

    got = sentences.semantic_once(df, "content", CFG, embed, "flag", batch_size=1)
    assert got.columns == [*df.columns, "part", "instead"]
    want = Counter((k, p, x, extra, False) for k, t, flag, extra in rows if t is not None and k != 9 for p, x in enumerate(by_distance(t) if flag else [t]))
    want += Counter((9, p, x, None, True) for p, x in enumerate(by_size(broken, CFG.chunk_size, CFG.overlap, CFG.separators)))
    assert Counter((r.k, r.part, r.content, r["_t"], r.instead) for r in got.collect()) == want
    distinct = {s for _, t, flag, _ in rows if flag and t for s in re.split(r"(?<=[.!?])\s+", t) if s.strip() and "fails" not in s}
    assert got.count() == sum(want.values()) and sent.value == len(distinct)
    assert sentences.semantic_once(df.limit(0), "content", CFG, embed).collect() == []


def test_split_text(spark, docs):
    text = lambda d: {"en": f"§1 {d['text']} §2 end", "fr": f"# a\n{d['text']}\n# b\nend"}.get(d["lang"], d["text"])
    assert found(spark, "split_text", *COLUMNS) == Counter(x for d in docs for x in plain_chunks(d["source"], d["doc_id"] + 1, text(d), "legal"))


def test_pages_combined(spark, docs):
    joined = {}
    for d in sorted(docs, key=lambda d: d["doc_id"]):
        joined.setdefault(d["source"], []).append(d["text"])
    assert found(spark, "pages_combined", *COLUMNS) == Counter(x for s, texts in joined.items() for x in plain_chunks(s, None, "\n".join(t for t in texts if t), "recursive"))


def test_page_chunks_and_report(spark, docs):
    first = {}
    for d in docs:
        for x in plain_chunks(d["source"], d["doc_id"] + 1, d["text"], "semantic"):
            if len(x[6].strip()) >= 5:
                key = (d["source"], " ".join(x[6].split()))
                first[key] = min(first.get(key, x), x, key=lambda x: x[1:4])
    assert found(spark, "page_chunks", *COLUMNS) == Counter(first.values())
    count, pages = Counter(s for s, _ in first), Counter(d["source"] for d in docs if d["text"].strip())
    want = Counter((s, "success" if count[s] else "error", n, False, count[s], count[s], None if count[s] else "no_usable_chunks_after_split") for s, n in pages.items())
    assert found(spark, "ingest_report", "source", "status", "pages_processed", "ocr_used", "chunk_count", "stored", "reason") == want


def lines(d):
    """Lines that are spans: every seventh has no width and every eleventh no text."""
    return [x.strip() for i, x in enumerate(d["text"].split("\n")) if i % 11 != 10 and i % 7 != 6 and x.strip()]


def test_span_chunks(spark, docs):
    want = Counter((d["source"], d["doc_id"] + 1, x) for d in docs if d["lang"] != "en" for x in plain_pack([{"text": t} for t in lines(d)], CFG.chunk_size, CFG.min_chars))
    got = Counter((r.document_id, int(r.page), r.content) for r in entry.queries()["span_chunk"](spark, SF).collect())
    assert got == want
    text = Counter(x[:2] + (x[6],) for d in docs if d["lang"] == "en" or not lines(d) for x in plain_chunks(d["source"], d["doc_id"] + 1, d["text"], "semantic"))
    assert Counter((r.document_id, int(r.page), r.content) for r in entry.queries()["pages_with_spans"](spark, SF).collect()) == want + text


def test_failing_embedder_falls_back_to_separators(spark):
    text = "One sentence here. " * 400
    df = spark.createDataFrame([("d", 1, text), ("d", 2, "fails " + text)], "d string, p int, t string")

    def embed(sentence):
        if sentence.startswith("fails"):
            raise RuntimeError("no model")
        return hash_embedding(sentence)

    rows = chunks.split_texts(df, "d", "p", "t", embed=embed).collect()
    assert {r.chunk_type for r in rows if r.p == 1} == {"semantic"} and {r.chunk_type for r in rows if r.p == 2} == {"recursive"}
    assert Counter(r.content for r in rows if r.p == 2) == Counter(by_size(cleaned("fails " + text), CFG.chunk_size, CFG.overlap, CFG.separators))


def test_prompt(spark):
    df = spark.createDataFrame([("page {question}", "what {context}?"), (None, None)], "c string, q string")
    first, empty = (r.p for r in df.select(retrieval.prompt(F.col("c"), F.col("q")).alias("p")).collect())
    assert "Context:\npage {question}\n" in first and first.endswith("Question: what {context}?\n") and empty.endswith("Question: \n")
