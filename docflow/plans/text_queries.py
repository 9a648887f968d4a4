"""Queries over text functions, identifiers, pages and native chunkers.

``documents`` has no boilerplate, headings or paragraph signs of its own, so inputs
that exercise an operator are built from its columns, alike here and in the SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from docflow.functions import ids, text as X
from docflow.operators import chunks, combined, flow, ingest, pages as P, sentences, span_chunks
from docflow.operators.rows import passing, unnest
from docflow.plugins import hash_embeddings
from docflow.schema import IngestConfig, SplitConfig
from docflow.sources import workspace
from docflow.sources.files import document_pages, lines_of
from docflow.streaming import stateful

QUERIES: dict = {}
SQL: dict[str, str] = {}

#: SQL counterparts of the text functions (RE2 syntax) over a column that stands for ``@``.


class Sql(str):
    """SQL with ``@`` for its input."""

    def format(self, column: str) -> str:  # noqa: A003 - as str.format, but braces are the pattern's own
        return self.replace("@", column)


WORDS = Sql(r"list_filter(regexp_split_to_array(@, '[\s\p{Z}\v]+'), lambda x: x <> '')")
TOKENS = Sql(f"greatest(1, trunc(len({WORDS}) * 1.3::DOUBLE + length(@) * 0.2::DOUBLE)::INT)")
NORM = Sql(r"trim(regexp_replace(@, '[\s\p{Z}\v]+', ' ', 'g'), ' ')")
ID = Sql("(SELECT substr(h, 1, 12) || '5' || substr(h, 14, 3) FROM (SELECT sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode(@)) AS h))")
LSTRIP = Sql(r"regexp_replace(regexp_replace(@, '^[\s\p{Z}\v]+', ''), '[\s\p{Z}\v]+$', '')")
SQUEEZED = Sql(r"regexp_replace(regexp_replace(@, '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g')")
NO_WORDS = r"regexp_replace(@, '(?i)\b(?:Confidential|Draft)\b', '', 'g')"
PAGE_CLEAN = Sql(rf"array_to_string(list_filter(list_transform(string_split({SQUEEZED.format(NO_WORDS)}, chr(10)), lambda x: {LSTRIP.format('x')}), lambda x: x <> '' AND NOT regexp_full_match(x, '\p{{Nd}}+')), chr(10))")
NO_LINES = r"regexp_replace(regexp_replace(@, '(?mi)^([^\n:]{2,}?:)\s*\n\s*(\d{3,})\s*$', '\1 \2', 'g'), '(?mi)^(?:\s*(?:Confidential|Draft|\d+)\s*)$', '', 'g')"
BOILERPLATE = Sql(rf"array_to_string(list_filter(list_transform(string_split({SQUEEZED.format(NO_LINES)}, chr(10)), lambda x: regexp_replace(x, '[\s\p{{Z}}\v]+$', '')), lambda x: x <> ''), chr(10))")
HEADING = r"'^\s{0,3}#{1,6}\s*([^\n#].*?)\s*$'"


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return register


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _text(*parts) -> F.Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


D = F.col


@query("page_clean", f"SELECT doc_id, {PAGE_CLEAN.format('t')} AS cleaned FROM (SELECT doc_id, '  Confidential  ' || chr(10) || chr(10) || '  ' || doc_id || '  ' || chr(10) || text || repeat(chr(10), 4) AS t FROM documents)")
def page_clean(spark, sf_dir):
    t = _text("  Confidential  \n\n  ", D("doc_id"), "  \n", D("text"), "\n\n\n\n")
    return documents(spark, sf_dir).select("doc_id", X.page_clean(t).alias("cleaned"))


@query("boilerplate_clean", f"SELECT doc_id, {BOILERPLATE.format('t')} AS cleaned FROM (SELECT doc_id, 'Draft' || chr(10) || doc_id || chr(10) || 'Total:' || chr(10) || ' 12345' || repeat(chr(10), 3) || text || chr(9) || ' x ' AS t FROM documents)")
def boilerplate_clean(spark, sf_dir):
    t = _text("Draft\n", D("doc_id"), "\nTotal:\n 12345\n\n\n", D("text"), "\t x ")
    return documents(spark, sf_dir).select("doc_id", X.boilerplate_clean(t).alias("cleaned"))


@query("normalize_text", f"SELECT doc_id, {NORM.format('t')} AS normalized FROM (SELECT doc_id, '  ' || chr(160) || replace(text, ' ', ' ' || chr(8195)) || chr(9) AS t FROM documents)")
def normalize_text(spark, sf_dir):
    t = F.concat(F.lit("   "), F.replace("text", F.lit(" "), F.lit("  ")), F.lit("\t"))
    return documents(spark, sf_dir).select("doc_id", X.normalize(t).alias("normalized"))


@query("token_count", f"SELECT doc_id, {TOKENS.format('text')} AS tokens, len({WORDS.format('text')})::INT AS words, length(text)::INT AS chars FROM documents")
def token_count(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", X.token_count(D("text")).alias("tokens"), X.word_count(D("text")).alias("words"), F.length("text").alias("chars"))


CHUNK_NAME = f"source || '|' || (doc_id + 1) || '||generic|' || {NORM.format('substr(t, 1, 160)')}"


@query("chunk_id", f"SELECT doc_id, {ID.format(CHUNK_NAME)} AS chunk_id FROM (SELECT doc_id, source, text AS t FROM documents UNION ALL SELECT doc_id, source, text || ' a different tail' FROM documents)")
def chunk_id(spark, sf_dir):
    docs = documents(spark, sf_dir).select("doc_id", "source", "text")
    both = docs.unionByName(docs.withColumn("text", F.concat("text", F.lit(" a different tail"))))
    return both.select("doc_id", ids.chunk_id(D("source"), D("doc_id") + 1, F.lit(None), F.lit("generic"), D("text")).alias("chunk_id"))


@query("page_id", f"SELECT doc_id, {ID.format("source || ':' || (doc_id + 1)")} AS page_id FROM documents")
def page_id(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", ids.page_id(D("source"), D("doc_id") + 1).alias("page_id"))


MARKED = "text || chr(10) || '# ' || lang || chr(10) || source || chr(10) || '## ' || doc_id || chr(10) || 'end'"


def _marked() -> F.Column:
    return _text(D("text"), "\n# ", D("lang"), "\n", D("source"), "\n## ", D("doc_id"), "\nend")


@query(
    "page_headings",
    rf"""SELECT doc_id, pos - 1 AS pos, trim(regexp_extract(l, {HEADING}, 1)) AS heading, length(regexp_extract(l, '^(#*)', 1))::INT AS level
    FROM (SELECT doc_id, unnest(ls) AS l, generate_subscripts(ls, 1)::INT AS pos FROM (SELECT doc_id, list_filter(string_split({MARKED}, chr(10)), lambda x: regexp_matches(x, {HEADING})) AS ls FROM documents))""",
)
def page_headings(spark, sf_dir):
    return unnest(documents(spark, sf_dir), ["doc_id"], X.headings(_marked()), "pos", "h").select("doc_id", "pos", D("h.text").alias("heading"), "h.level")


@query(
    "page_record",
    f"""WITH p AS (SELECT source, (doc_id + 1)::INT AS n, CASE WHEN doc_id % 5 = 0 THEN '' ELSE text END AS own, CASE WHEN doc_id % 10 = 0 THEN text ELSE '' END AS ocr FROM documents),
    r AS (SELECT source, n, CASE WHEN trim(own) = '' AND trim(ocr) <> '' THEN 'ocr' ELSE 'text' END AS textSource, {PAGE_CLEAN.format("(CASE WHEN trim(own) <> '' THEN own ELSE ocr END)")} AS content, count(*) OVER (PARTITION BY source) AS total FROM p)
    SELECT source, n AS pageNumber, textSource, content, {ID.format("source || ':' || n")} AS pageId, len(list_filter(string_split(content, chr(10)), lambda x: regexp_matches(x, {HEADING})))::INT AS headings,
    len({WORDS.format('content')})::INT AS wordCount, length(content)::INT AS charCount, 'Page ' || n || '/' || total AS pageIndicator FROM r WHERE content <> ''""",
)
def page_record(spark, sf_dir):
    pages = documents(spark, sf_dir).select("source", (D("doc_id") + 1).cast("int").alias("n"), F.when(D("doc_id") % 5 == 0, "").otherwise(D("text")).alias("own"), F.when(D("doc_id") % 10 == 0, D("text")).otherwise("").alias("ocr"))
    return P.page_records(pages, "source", "n", "own", "ocr").withColumn("headings", F.size("headings"))


@query(
    "extraction_summary",
    """SELECT source, count(*) AS totalPages, count_if(text <> '' AND (doc_id % 5 <> 0 OR doc_id % 10 = 0))::BIGINT AS pagesReturned, coalesce(bool_or(doc_id % 10 = 0 AND text <> ''), false) AS ocrUsed FROM documents GROUP BY source""",
)
def extraction_summary(spark, sf_dir):
    pages = documents(spark, sf_dir).select("source", (D("doc_id") + 1).cast("int").alias("n"), F.when(D("doc_id") % 5 == 0, "").otherwise(D("text")).alias("own"), F.when(D("doc_id") % 10 == 0, D("text")).otherwise("").alias("ocr"))
    return P.extraction_summary(pages, P.page_records(pages, "source", "n", "own", "ocr"), "source")


@query(
    "page_text_source",
    "SELECT doc_id, CASE WHEN trim(own) <> '' THEN trim(own) ELSE trim(ocr) END AS text, CASE WHEN trim(own) = '' AND trim(ocr) <> '' THEN 'ocr' ELSE 'text' END AS source FROM (SELECT doc_id, CASE WHEN lang = 'en' THEN '  ' ELSE source END AS own, CASE WHEN doc_id % 3 = 0 THEN ' ' ELSE ' ' || lang || ' ' END AS ocr FROM documents)",
)
def page_text_source(spark, sf_dir):
    picked = P.page_text(F.when(D("lang") == "en", "  ").otherwise(D("source")), F.when(D("doc_id") % 3 == 0, " ").otherwise(_text(" ", D("lang"), " ")))
    return documents(spark, sf_dir).select("doc_id", picked.alias("p")).select("doc_id", "p.text", "p.source")


@query(
    "node_page_view",
    r"SELECT source, (doc_id + 1)::INT AS pageNumber, trim(regexp_replace(array_to_string(string_split(text, chr(10)), ' '), '\s+', ' ', 'g')) AS text, count(*) OVER (PARTITION BY source) AS totalPages, 'Page ' || (doc_id + 1) AS pageIndicator FROM documents",
)
def node_page_view(spark, sf_dir):
    pages = documents(spark, sf_dir).select("source", (D("doc_id") + 1).cast("int").alias("n"), F.split("text", "\n").alias("items"))
    return P.view_pages(pages, "source", "n", "items")


@query("page_number_cast", "SELECT doc_id, try_cast(n AS INT) AS n FROM (SELECT doc_id, CASE WHEN lang = 'en' THEN doc_id || 'x' WHEN lang = 'de' THEN NULL ELSE doc_id || '' END AS n FROM documents) WHERE try_cast(n AS INT) IS NOT NULL")
def page_number_cast(spark, sf_dir):
    rows = documents(spark, sf_dir).select("doc_id", F.when(D("lang") == "en", _text(D("doc_id"), "x")).when(D("lang") == "de", None).otherwise(_text(D("doc_id"))).alias("n"))
    return P.numbered(rows, "n")


LEGAL = "'Preamble ' || lang || ' §1 ' || text || ' § ' || doc_id || ' end'"


@query(
    "legal_split",
    rf"""SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1)::INT AS pos, '§' || regexp_extract(s, '§\s*([\p{{L}}\p{{N}}_]+)', 1) AS heading, s AS content
    FROM (SELECT doc_id, {LSTRIP.format('s')} AS s, pos FROM (SELECT doc_id, unnest(ps) AS s, generate_subscripts(ps, 1) AS pos FROM (SELECT doc_id, string_split(regexp_replace({LEGAL}, '(§\s*[\p{{L}}\p{{N}}_]+)', chr(1) || '\1', 'g'), chr(1)) AS ps FROM documents))) WHERE s <> ''""",
)
def legal_split(spark, sf_dir):
    t = _text("Preamble ", D("lang"), " §1 ", D("text"), " § ", D("doc_id"), " end")
    return unnest(documents(spark, sf_dir), ["doc_id"], chunks.legal_sections(t), "pos", "s").select("doc_id", "pos", "s.heading", "s.content")


@query(
    "heading_split",
    f"""WITH l AS (SELECT doc_id, unnest(ls) AS l, generate_subscripts(ls, 1) AS pos FROM (SELECT doc_id, string_split({MARKED}, chr(10)) AS ls FROM documents)),
    g AS (SELECT *, regexp_matches(l, {HEADING}) AS h, sum(regexp_matches(l, {HEADING})::INT) OVER (PARTITION BY doc_id ORDER BY pos) AS k FROM l),
    s AS (SELECT doc_id, k, coalesce(max(CASE WHEN h THEN regexp_extract(l, {HEADING}, 1) END), 'Introduction') AS heading, string_agg(CASE WHEN NOT h THEN l END, chr(10) ORDER BY pos) AS content, count_if(NOT h)::BIGINT AS n FROM g GROUP BY doc_id, k)
    SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1)::INT AS pos, heading, content FROM s WHERE n > 0""",
)
def heading_split(spark, sf_dir):
    return unnest(documents(spark, sf_dir), ["doc_id"], chunks.heading_sections(_marked()), "pos", "s").select("doc_id", "pos", "s.heading", "s.content")


@query(
    "one_heading_is_generic",
    f"SELECT doc_id, NULL::VARCHAR AS heading, 'generic' AS chunk_type, {BOILERPLATE.format("('# only' || chr(10) || text)")} AS content FROM documents",
)
def one_heading_is_generic(spark, sf_dir):
    cleaned = documents(spark, sf_dir).select("doc_id", X.boilerplate_clean(_text("# only\n", D("text"))).alias("t"))
    return cleaned.select("doc_id", F.explode(chunks.sections(D("t"), False)).alias("s")).select("doc_id", "s.*")


@query(
    "node_section_split",
    rf"""SELECT doc_id, section, s AS content FROM (SELECT doc_id, '§' || row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS section, {LSTRIP.format('s')} AS s
    FROM (SELECT doc_id, unnest(ps) AS s, generate_subscripts(ps, 1) AS pos FROM (SELECT doc_id, string_split(regexp_replace('pre §7 ' || text || ' §9 ' || source, '(§[0-9]+)', chr(1) || '\1', 'g'), chr(1)) AS ps FROM documents)) WHERE {LSTRIP.format('s')} <> '')
    WHERE {TOKENS.format('s')} BETWEEN 1 AND 8192""",
)
def node_section_split(spark, sf_dir):
    t = _text("pre §7 ", D("text"), " §9 ", D("source"))
    return documents(spark, sf_dir).select("doc_id", F.explode(chunks.node_sections(t)).alias("s")).select("doc_id", "s.section", "s.content")


SINGLE = f"""c AS (SELECT source, doc_id + 1 AS page, {BOILERPLATE.format('text')} AS content FROM documents),
    s AS (SELECT source, page, content, {TOKENS.format('content')} AS tokens FROM c WHERE {LSTRIP.format('content')} <> '')"""


@query(
    "single_chunk",
    f"""WITH {SINGLE}, f AS (SELECT * FROM s WHERE tokens <= 512 AND length({LSTRIP.format('content')}) >= 5),
    u AS (SELECT source, sha1(encode({NORM.format('content')})) AS k, arg_min(tokens, page) AS tokens, arg_min({ID.format(f"source || '|' || page || '||generic|' || {NORM.format('substr(content, 1, 160)')}")}, page) AS id FROM f GROUP BY 1, 2),
    p AS (SELECT source, count(*) AS pages, count_if(tokens > 512)::BIGINT AS to_split FROM s GROUP BY source),
    r AS (SELECT source, count(*) AS chunks, sum(tokens)::BIGINT AS tokens, min(id) AS first_id FROM u GROUP BY source)
    SELECT source, pages, to_split, coalesce(chunks, 0) AS chunks, coalesce(r.tokens, 0) AS tokens, first_id FROM p LEFT JOIN r USING (source)""",
)
def single_chunk(spark, sf_dir):
    """The flagship: all pages cleaned; those of one chunk chunked with ids, filtered and deduplicated per document, those for the splitter counted.

    A page is in ``to_split`` or among the candidates of ``chunks``, none is left out; ``page_chunks`` splits the long ones.
    """
    pages = document_pages(documents(spark, sf_dir))
    cleaned = passing(pages, ["document_id", "page"], X.boilerplate_clean(D("text")), "content", lambda t: X.strip(t) != "")
    rows = cleaned.withColumns({"heading": F.lit(None).cast("string"), "chunk_type": F.lit("generic"), "_long": X.token_count(D("content")) > SplitConfig().max_tokens_single})
    kept = ~D("_long") & ingest.long_enough(D("content"), IngestConfig().min_chars)
    key = F.when(kept, F.sha1(F.encode(X.normalize(D("content")), "UTF-8")))
    # One pass: pages without a key only count, and equal contents shrink before anything moves.
    made = chunks.with_identity(rows, "document_id", "page").groupBy("document_id", key.alias("_key"))
    by_content = made.agg(F.count("*").alias("n"), F.count_if("_long").alias("long"), F.min_by(F.struct("token_count", "chunk_id"), "page").alias("first"))
    first = lambda field: F.when(D("_key").isNotNull(), D(f"first.{field}"))
    return by_content.groupBy(D("document_id").alias("source")).agg(
        F.sum("n").alias("pages"), F.sum("long").alias("to_split"), F.count("_key").alias("chunks"), F.coalesce(F.sum(first("token_count")), F.lit(0)).cast("long").alias("tokens"), F.min(first("chunk_id")).alias("first_id"),
    )


LINES = "SELECT doc_id, unnest(ls) AS t, generate_subscripts(ls, 1) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)"


def _lines(spark, sf_dir) -> DataFrame:
    """Every line of every text, which are short and long."""
    found = documents(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "t"))
    return found.select("doc_id", (D("line") + 1).cast("long").alias("line"), "t")


@query("min_len_filter", f"SELECT doc_id, line, t FROM (SELECT doc_id, line, t || '  ' AS t FROM ({LINES})) WHERE length({LSTRIP.format('t')}) >= 25")
def min_len_filter(spark, sf_dir):
    return _lines(spark, sf_dir).withColumn("t", F.concat("t", F.lit("  "))).where(ingest.long_enough(D("t"), 25))


@query("min_token_filter", f"SELECT doc_id, line, t FROM ({LINES}) WHERE {TOKENS.format('t')} >= 12")
def min_token_filter(spark, sf_dir):
    return _lines(spark, sf_dir).where(X.token_count(D("t")) >= 12)


TWICE = "SELECT source, doc_id, text FROM documents UNION ALL SELECT source, doc_id + 1000000000, replace(text, ' ', '  ') FROM documents"


def _twice(spark, sf_dir) -> DataFrame:
    docs = documents(spark, sf_dir).select("source", "doc_id", "text")
    return docs.unionByName(docs.select("source", (D("doc_id") + 1000000000).alias("doc_id"), F.replace("text", F.lit(" "), F.lit("  ")).alias("text")))


@query("exact_dedupe", f"SELECT source, min(doc_id) AS doc_id, arg_min(text, doc_id) AS text FROM ({TWICE}) GROUP BY source, sha1(encode({NORM.format('text')}))")
def exact_dedupe(spark, sf_dir):
    return ingest.first_of_equal(_twice(spark, sf_dir), "source", "text", ["doc_id"])


@query(
    "ingest_counters",
    f"""WITH i AS ({TWICE}), c AS (SELECT source, unnest(string_split(text, chr(10))) AS t FROM i), p AS (SELECT source, t, length({LSTRIP.format('t')}) >= 5 AS ok FROM c WHERE {LSTRIP.format('t')} <> ''),
    s AS (SELECT source, count(*) AS inputs_seen, count_if({LSTRIP.format('t')} <> '')::BIGINT AS inputs_non_empty FROM c GROUP BY source),
    m AS (SELECT source, count(*) AS a, count_if(NOT ok)::BIGINT AS b, count_if(ok)::BIGINT - count(DISTINCT CASE WHEN ok THEN {NORM.format('t')} END) AS d, count(DISTINCT CASE WHEN ok THEN {NORM.format('t')} END) AS e FROM p GROUP BY source)
    SELECT source, inputs_seen, inputs_non_empty, coalesce(a, 0) AS chunks_before_filter, coalesce(b, 0) AS filtered_out, coalesce(d, 0) AS deduped_out, coalesce(e, 0) AS stored, CASE WHEN coalesce(e, 0) > 0 THEN 'success' ELSE 'error' END AS status FROM s LEFT JOIN m USING (source)""",
)
def ingest_counters(spark, sf_dir):
    """Every line of every text is an input, so some are blank, short or repeated."""
    inputs = _twice(spark, sf_dir).select("source", F.explode(F.split("text", "\n")).alias("t"))
    made = inputs.where(X.strip(D("t")) != "").withColumnRenamed("t", "content")
    return ingest.counters(inputs, made, "source", "t", "content")


@query(
    "stream_ingest_counters",
    f"""WITH s AS (SELECT source, count(*) AS inputs_seen, count_if({LSTRIP.format('text')} <> '')::BIGINT AS inputs_non_empty FROM documents GROUP BY source),
    p AS (SELECT source, t, length({LSTRIP.format('t')}) >= 5 AS ok FROM (SELECT source, unnest(string_split(text, chr(10))) AS t FROM documents) WHERE {LSTRIP.format('t')} <> ''),
    m AS (SELECT source, count(*) AS a, count_if(NOT ok)::BIGINT AS b, count_if(ok)::BIGINT - count(DISTINCT CASE WHEN ok THEN {NORM.format('t')} END) AS d, count(DISTINCT CASE WHEN ok THEN {NORM.format('t')} END) AS e FROM p GROUP BY source)
    SELECT source AS document_id, inputs_seen, inputs_non_empty, coalesce(a, 0) AS chunks_before_filter, coalesce(b, 0) AS filtered_out, coalesce(d, 0) AS deduped_out, coalesce(e, 0) AS stored, CASE WHEN coalesce(e, 0) > 0 THEN 'success' ELSE 'error' END AS status FROM s LEFT JOIN m USING (source)""",
)
def stream_ingest_counters(spark, sf_dir):
    """All documents as pages that arrive in four micro-batches, so each source comes in all of them; every line is a chunk."""
    stateful.settings(spark)
    top = workspace.new_path(spark, "stream")
    pages = document_pages(documents(spark, sf_dir)).select("document_id", "page", "text")
    # A file for each core and micro-batch: one task would split all of a single file's texts.
    files = spark.sparkContext.defaultParallelism
    pages.repartition(4 * files, "page").write.parquet(f"{top}/in")
    lines = lambda df: unnest(df, ["document_id", "page"], F.split("text", "\n"), "section", "content").where(X.strip(D("content")) != "").select("document_id", "page", "section", F.lit(0).alias("part"), "content")
    stream = spark.readStream.schema(pages.schema).option("maxFilesPerTrigger", files).parquet(f"{top}/in")
    run = stateful.into_folder(stream, f"{top}/out", embed=None, split=lines).option("checkpointLocation", f"{top}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    return stateful.stored_counters(spark, f"{top}/out")


@query("one_document_guard", "SELECT lang, count(DISTINCT source) AS documents, CASE WHEN count(DISTINCT source) > 1 THEN 'error' ELSE 'ok' END AS status FROM (SELECT lang, source FROM documents UNION ALL SELECT 'only ' || source, source FROM documents) GROUP BY lang")
def one_document_guard(spark, sf_dir):
    docs = documents(spark, sf_dir).select("lang", "source")
    return ingest.one_document(docs.unionByName(docs.select(_text("only ", D("source")).alias("lang"), "source")), "lang", "source")


SPANS = """l AS (SELECT doc_id, unnest(ls) AS t, generate_subscripts(ls, 1) - 1 AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)),
    s AS (SELECT doc_id, i, CASE WHEN i % 11 = 10 THEN '' ELSE trim(t) END AS t, 10::DOUBLE AS x, (1000 - (i * 12 + 10))::DOUBLE AS y, (CASE WHEN i % 7 = 6 THEN 0 ELSE length(t) END)::DOUBLE AS w, 10::DOUBLE AS h FROM l),
    k AS (SELECT * FROM s WHERE t <> '' AND w > 0)"""


@query("span_geometry", f"WITH {SPANS} SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1)::INT AS pos, t AS text, x, y, w AS width, h AS height FROM k")
def span_geometry(spark, sf_dir):
    found = unnest(documents(spark, sf_dir), ["doc_id"], P.spans(lines_of(D("text")), F.lit(1000.0)), "pos", "s")
    return found.select("doc_id", "pos", "s.text", "s.bbox.*")


@query("span_union_bbox", f"WITH {SPANS} SELECT doc_id, b.x AS x, b.y AS y, b.w AS width, b.h AS height FROM documents LEFT JOIN (SELECT doc_id, min(x) AS x, min(y) AS y, max(x + w) - min(x) AS w, max(y + h) - min(y) AS h FROM k GROUP BY doc_id) b USING (doc_id)")
def span_union_bbox(spark, sf_dir):
    found = documents(spark, sf_dir).select("doc_id", P.spans(lines_of(D("text")), F.lit(1000.0)).alias("s"))
    return found.select("doc_id", P.union_bbox(D("s")).alias("b")).select("doc_id", "b.*")


@query("metadata_merge", "SELECT doc_id, CASE WHEN lang = 'en' THEN 'own' ELSE 'given' END AS kept, 'given' AS overridden, lang AS other FROM documents")
def metadata_merge(spark, sf_dir):
    own = F.when(D("lang") == "en", F.create_map(F.lit("lang"), D("lang"), F.lit("filename"), F.lit("own"))).otherwise(F.create_map(F.lit("lang"), D("lang")))
    rows = documents(spark, sf_dir).select("doc_id", ingest.with_default(own, "filename", F.lit("given")).alias("a"), ingest.with_override(own, F.create_map(F.lit("filename"), F.lit("given"))).alias("b"))
    return rows.select("doc_id", D("a")["filename"].alias("kept"), D("b")["filename"].alias("overridden"), D("b")["lang"].alias("other"))


@query("zipped_chunks", "SELECT doc_id, unnest(ls) AS text, (generate_subscripts(ls, 1) - 1)::INT AS place FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)")
def zipped_chunks(spark, sf_dir):
    lines = F.split("text", "\n")
    both = documents(spark, sf_dir).select("doc_id", F.explode(ingest.zipped(lines, F.transform(lines, lambda _, i: i))).alias("z"))
    return both.select("doc_id", "z.text", D("z.metadata").alias("place"))


@query("full_text_fallback", "SELECT doc_id, CASE WHEN lang = 'en' THEN text ELSE lang END AS part FROM documents")
def full_text_fallback(spark, sf_dir):
    parts = F.when(D("lang") == "en", F.array().cast("array<string>")).otherwise(F.array("lang"))
    return documents(spark, sf_dir).select("doc_id", F.explode(chunks.full_text_fallback(parts, D("text"))).alias("part"))


@query("model_path", "SELECT doc_id, replace('org/' || lang || '/' || source, '/', '_') AS path FROM documents")
def model_path(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", X.model_directory(_text("org/", D("lang"), "/", D("source"))).alias("path"))


@query(
    "highlights",
    r"""WITH q AS (SELECT doc_id, text, regexp_extract_all(text, '[\p{L}\p{N}]+')[1:2] AS ws FROM documents)
    SELECT doc_id, array_to_string(list_filter([ws[1], translate(ws[2], 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ')], lambda w: regexp_matches(text, '(?i)(^|[^\p{L}\p{N}_])' || w || '($|[^\p{L}\p{N}_])')), '|') AS found FROM q""",
)
def highlights(spark, sf_dir):
    """Two words of each text, the second in capitals, and one that is in none."""
    found = F.regexp_extract_all("text", F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    question = F.concat_ws(" ", F.get(found, F.lit(0)), F.translate(F.get(found, F.lit(1)), "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"), F.lit("zzz?"))
    return documents(spark, sf_dir).select("doc_id", F.array_join(X.highlights(D("text"), question), "|").alias("found"))


@query("recursive_split")
def recursive_split(spark, sf_dir):
    return chunks.recursive(documents(spark, sf_dir).select("doc_id", D("text").alias("content")), "content", SplitConfig())


@query("node_recursive_split")
def node_recursive_split(spark, sf_dir):
    return chunks.node_split(documents(spark, sf_dir).select("doc_id", "text"), "doc_id", "text")


@query("semantic_split")
def semantic_split(spark, sf_dir):
    return chunks.semantic(documents(spark, sf_dir).select("doc_id", D("text").alias("content")), "content", SplitConfig()).drop("instead")


@query("semantic_split_once")
def semantic_split_once(spark, sf_dir):
    texts = documents(spark, sf_dir).select("doc_id", D("text").alias("content"))
    return sentences.semantic_once(texts, "content", SplitConfig(), hash_embeddings).drop("instead")


def _spanned(spark, sf_dir) -> DataFrame:
    return documents(spark, sf_dir).select(D("source").alias("document_id"), (D("doc_id") + 1).cast("string").alias("page"), F.when(D("lang") != "en", P.spans(lines_of(D("text")), F.lit(1000.0))).alias("spans"), "text")


@query("span_chunk")
def span_chunk(spark, sf_dir):
    return span_chunks.span_chunks(_spanned(spark, sf_dir), "document_id", "page", "spans").select("document_id", "page", "part", "content", "token_count", "chunk_id", "bbox.*", "dropped_tails")


@query("pages_with_spans")
def pages_with_spans(spark, sf_dir):
    return span_chunks.pages_with_spans(_spanned(spark, sf_dir), "document_id", "page", "spans", "text")


@query("pages_combined")
def pages_combined(spark, sf_dir):
    return combined.split_combined(document_pages(documents(spark, sf_dir)), "document_id", "page", "text")


@query("split_text")
def split_text(spark, sf_dir):
    pages = document_pages(documents(spark, sf_dir)).withColumn("text", F.when(D("lang") == "en", _text("§1 ", D("text"), " §2 end")).when(D("lang") == "fr", _text("# a\n", D("text"), "\n# b\nend")).otherwise(D("text")))
    return chunks.split_texts(pages, "document_id", "page", "text", "legal")


@query("chunk_cap", "SELECT source, doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id) <= 7")
def chunk_cap(spark, sf_dir):
    """At most seven chunks of each document: the cap is the feature."""
    return chunks.capped(documents(spark, sf_dir).select("source", "doc_id"), "source", ["doc_id"], 7)


@query("ingest_report")
def ingest_report(spark, sf_dir):
    """The report over all pages, long ones split. SQL has no splitter; the tests compare with plain Python."""
    docs = documents(spark, sf_dir)
    records = P.page_records(docs.select("source", (D("doc_id") + 1).cast("int").alias("n"), "text"), "source", "n", "text")
    made = flow.page_chunks(document_pages(docs), "document_id", "page", "text")
    return flow.ingest_report(records, made.select(D("document_id").alias("source")), "source")


@query("page_chunks")
def page_chunks(spark, sf_dir):
    """Pages through splitting, filters and deduplication."""
    return flow.page_chunks(document_pages(documents(spark, sf_dir)), "document_id", "page", "text")
