"""Queries over search, answers, users, conversations and the index."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from docflow.functions import text as X
from docflow.operators import catalog as C, registration, retrieval as R
from docflow.plans.text_queries import _text
from docflow.plugins import extractive_answer
from docflow.sources import generations, index, sinks, workspace

QUERIES: dict = {}
SQL: dict[str, str] = {}
D = F.col


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return register


def table(spark, sf_dir, name) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _vectors(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Queries, every row whose id is divisible by 20, and all rows."""
    rows = table(spark, sf_dir, "embeddings").select(D("vec_id").alias("id"), D("embedding").alias("vector"), "label")
    return rows.where("id % 20 = 0"), rows


DISTANCE = "list_sum(list_transform(list_zip(q.embedding, r.embedding), lambda p: (p[1]::DOUBLE - p[2]::DOUBLE) * (p[1]::DOUBLE - p[2]::DOUBLE)))"
KNN = f"""d AS (SELECT q.vec_id AS query_id, q.label AS query_label, r.vec_id AS row_id, r.label AS label, {DISTANCE} AS distance FROM embeddings q, embeddings r WHERE q.vec_id % 20 = 0),
    k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, row_id) AS rank FROM d QUALIFY rank <= 10)"""


def _found(spark, sf_dir) -> DataFrame:
    queries, rows = _vectors(spark, sf_dir)
    found = R.nearest(queries, rows, 10)
    labels = rows.select(D("id").alias("row_id"), "label")
    return found.join(labels, "row_id").join(queries.select(D("id").alias("query_id"), D("label").alias("query_label")), "query_id")


@query("knn_topk", f"WITH {KNN} SELECT query_id, row_id, round(distance, 4) AS distance, rank::INT AS rank FROM k")
def knn_topk(spark, sf_dir):
    return R.nearest(*_vectors(spark, sf_dir), 10).withColumn("distance", F.round("distance", 4))


@query(
    "knn_in_document",
    f"SELECT q.vec_id AS query_id, r.vec_id AS row_id, round({DISTANCE}, 4) AS distance, row_number() OVER (PARTITION BY q.vec_id ORDER BY {DISTANCE}, r.vec_id)::INT AS rank FROM embeddings q JOIN embeddings r USING (label) WHERE q.vec_id % 20 = 0 QUALIFY rank <= 10",
)
def knn_in_document(spark, sf_dir):
    return R.nearest(*_vectors(spark, sf_dir), None, within=("label", "label")).withColumn("distance", F.round("distance", 4))


@query("knn_filter_after_topk", f"WITH {KNN} SELECT query_id, row_id, rank::INT AS rank FROM k WHERE label = query_label")
def knn_filter_after_topk(spark, sf_dir):
    return _found(spark, sf_dir).where("label = query_label").select("query_id", "row_id", "rank")


FIRST4 = f"{KNN}, u AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS used_rank FROM k WHERE label = query_label QUALIFY used_rank <= 4)"


def _used(spark, sf_dir) -> DataFrame:
    return R.first_of_document(_found(spark, sf_dir), D("label") == D("query_label"), 4)


@query("knn_first4", f"WITH {FIRST4} SELECT query_id, row_id, used_rank::INT AS used_rank FROM u")
def knn_first4(spark, sf_dir):
    return _used(spark, sf_dir).select("query_id", "row_id", "used_rank")


def _passages(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(D("doc_id").alias("row_id"), "text", "source")
    return _used(spark, sf_dir).join(docs, "row_id")


@query("context_join", f"WITH {FIRST4} SELECT query_id, string_agg(text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY used_rank) AS context FROM u JOIN documents ON doc_id = row_id GROUP BY query_id")
def context_join(spark, sf_dir):
    return R.context(_passages(spark, sf_dir), "query_id", "used_rank", "text")


@query("answer_counters", f"WITH {FIRST4} SELECT query_id, count(*) AS chunksAnalyzed, (SELECT count(*) FROM u WHERE u.query_id = k.query_id) AS chunksUsed, CASE WHEN (SELECT count(*) FROM u WHERE u.query_id = k.query_id) > 0 THEN 'found' ELSE 'not_found' END AS status FROM k GROUP BY query_id")
def answer_counters(spark, sf_dir):
    return R.counted(_found(spark, sf_dir), _used(spark, sf_dir))


@query(
    "source_projection",
    f"WITH {FIRST4} SELECT query_id, source, text AS textMatch, 'Page ' || (row_id + 1) AS pageIndicator, 1::INT AS confidence, CASE WHEN regexp_matches(text, '(^|[^\\p{{L}}\\p{{N}}_])(?i:the)($|[^\\p{{L}}\\p{{N}}_])') THEN 'THE' ELSE '' END AS highlights FROM u JOIN documents ON doc_id = row_id",
)
def source_projection(spark, sf_dir):
    rows = _passages(spark, sf_dir).select("query_id", "source", "text", (D("row_id") + 1).alias("page"), F.lit("THE zzz?").alias("question"))
    return R.sources(rows, "text", "page", "question").select("query_id", "source", "textMatch", "pageIndicator", "confidence", F.array_join("highlights", "|").alias("highlights"))


@query("generated_answer", f"WITH {FIRST4} SELECT query_id, arg_min(text, used_rank) AS answer FROM u JOIN documents ON doc_id = row_id GROUP BY query_id")
def generated_answer(spark, sf_dir):
    """The default generator quotes the first passage; its JSON is parsed again."""
    rows = R.context(_passages(spark, sf_dir), "query_id", "used_rank", "text").withColumn("question", F.lit("?"))
    return R.answered(rows, "context", "question", extractive_answer).select("query_id", R.stored_answer(R.parse_answer(D("raw"))["contextAnswer"]).alias("answer"))


@query("answer_json_parse", "SELECT item_id, text AS contextAnswer, '' AS additionalInfo FROM benchmark")
def answer_json_parse(spark, sf_dir):
    raw = F.to_json(F.named_struct(F.lit("contextAnswer"), D("text"), F.lit("additionalInfo"), F.lit("")))
    return table(spark, sf_dir, "benchmark").select("item_id", R.parse_answer(raw).alias("a")).select("item_id", "a.*")


@query("answer_default", "SELECT conv_id, turn, CASE WHEN turn % 2 = 0 OR text = '' THEN 'No answer' ELSE text END AS answer FROM conversations")
def answer_default(spark, sf_dir):
    raw = F.when(D("turn") % 4 == 0, "").when(D("turn") % 2 == 0, None).otherwise(D("text"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", R.stored_answer(raw).alias("answer"))


@query("chat_history", "SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn)::INT AS place FROM conversations WHERE role IN ('user', 'assistant')")
def chat_history(spark, sf_dir):
    """Each conversation's shown messages with their place; places come from the grouped, ordered messages."""
    shown = C.by_document(C.history(table(spark, sf_dir, "conversations"), "role"), "conv_id", "turn", "role", "text")
    return shown.select("conv_id", F.posexplode("messages").alias("p", "m")).select("conv_id", D("m.at").alias("turn"), "m.role", D("m.content").alias("text"), (D("p") + 1).alias("place"))


@query("chat_grouped", "SELECT conv_id, count(*) AS messages, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS transcript FROM conversations GROUP BY conv_id")
def chat_grouped(spark, sf_dir):
    grouped = C.by_document(table(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "text")
    return grouped.select("conv_id", F.size("messages").cast("long").alias("messages"), F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit(": "), m["content"])), "\n").alias("transcript"))


@query("docs_with_owner", "SELECT o_orderkey, o_custkey, c_name, c_mktsegment FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def docs_with_owner(spark, sf_dir):
    users = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
    return C.with_owner(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), users, "o_custkey", "c_custkey").drop("c_custkey")


@query("docs_of_user", "SELECT o_orderkey, o_custkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_custkey = (SELECT max(o_custkey) FROM orders)")
def docs_of_user(spark, sf_dir):
    orders, users = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    return C.of_user(orders, users, "o_custkey", "c_custkey", orders.select(F.max("o_custkey")).scalar()).drop("c_custkey")


@query("document_of_owner", "SELECT o_orderkey, o_custkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_suppkey = o_custkey)")
def document_of_owner(spark, sf_dir):
    wanted = table(spark, sf_dir, "lineitem").select(D("l_orderkey").alias("id"), D("l_suppkey").alias("user_id"))
    return C.owned(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "o_orderkey", "o_custkey", wanted)


@query("document_delete", "SELECT o_orderkey, o_custkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_suppkey = o_custkey)")
def document_delete(spark, sf_dir):
    removed = table(spark, sf_dir, "lineitem").select(D("l_orderkey").alias("id"), D("l_suppkey").alias("user_id"))
    return C.without(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), removed, "o_orderkey", "o_custkey")


@query("user_unique_anti", "SELECT s_suppkey AS id, 'user' || s_suppkey || '@example.com' AS email, s_name AS username FROM supplier WHERE s_suppkey NOT IN (SELECT c_custkey * 3 FROM customer) AND s_name NOT IN (SELECT 'Supplier#' || lpad((c_custkey * 5)::VARCHAR, 9, '0') FROM customer)")
def user_unique_anti(spark, sf_dir):
    candidates = table(spark, sf_dir, "supplier").select(D("s_suppkey").alias("id"), _text("user", D("s_suppkey"), "@example.com").alias("email"), D("s_name").alias("username"))
    users = table(spark, sf_dir, "customer").select(_text("user", D("c_custkey") * 3, "@example.com").alias("email"), F.concat(F.lit("Supplier#"), F.lpad((D("c_custkey") * 5).cast("string"), 9, "0")).alias("username"))
    return C.unused(candidates, users).select("id", "email", "username")


REGISTER = """
WITH RECURSIVE c AS (SELECT o_orderkey AS id, 'u' || (o_custkey * 7 % 1201) || '@example.com' AS email, 'name_' || (o_orderkey * 31 % 907) AS username FROM orders),
u AS (SELECT 'u' || c_custkey * 5 || '@example.com' AS email, 'name_' || c_custkey * 11 AS username FROM customer),
r AS (SELECT id, email, username, FALSE AS got, email IN (SELECT email FROM u) OR username IN (SELECT username FROM u) AS out FROM c
  UNION ALL
  SELECT id, email, username, got, NOT got AND (bool_or(got) OVER (PARTITION BY email) OR bool_or(got) OVER (PARTITION BY username)) AS out
  FROM (SELECT id, email, username, id = min(id) OVER (PARTITION BY email) AND id = min(id) OVER (PARTITION BY username) AS got FROM r WHERE NOT got AND NOT out))
SELECT id, email, username, CASE WHEN bool_or(got) THEN 'created' ELSE 'in_use' END AS status FROM r GROUP BY ALL
"""


@query("user_register", REGISTER)
def user_register(spark, sf_dir):
    """Candidates that clash with users and with each other, by email and by name."""
    k = D("o_orderkey")
    candidates = table(spark, sf_dir, "orders").select(k.alias("id"), _text("u", D("o_custkey") * 7 % 1201, "@example.com").alias("email"), _text("name_", k * 31 % 907).alias("username"))
    users = table(spark, sf_dir, "customer").select(_text("u", D("c_custkey") * 5, "@example.com").alias("email"), _text("name_", D("c_custkey") * 11).alias("username"))
    return registration.decided(candidates, users, "id")


@query("mime_filter", "SELECT doc_id, mime FROM (SELECT doc_id, ['application/pdf', 'image/png', 'text/plain', 'text/html'][doc_id % 4 + 1] AS mime FROM documents) WHERE mime IN ('application/pdf', 'text/plain')")
def mime_filter(spark, sf_dir):
    kinds = F.array(*map(F.lit, ("application/pdf", "image/png", "text/plain", "text/html")))
    return table(spark, sf_dir, "documents").select("doc_id", F.get(kinds, (D("doc_id") % 4).cast("int")).alias("mime")).where(C.accepted_upload(D("mime")))


@query(
    "user_rules",
    r"""SELECT id, regexp_full_match(email, '[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}') AND length(email) <= 50 AS email_ok, regexp_full_match(username, '[a-zA-Z0-9_]{3,30}') AS username_ok,
    length(p) BETWEEN 8 AND 20 AND regexp_matches(p, '[a-z]') AND regexp_matches(p, '[A-Z]') AND regexp_matches(p, '[0-9]') AND regexp_matches(p, '[@$!%*?&]') AND regexp_full_match(p, '[A-Za-z0-9@$!%*?&]+') AS password_ok
    FROM (SELECT c_custkey AS id, CASE c_custkey % 3 WHEN 0 THEN replace(c_name, '#', '.') || '@example.com' WHEN 1 THEN c_name || '@example.com' ELSE repeat('a', 45) || '@ex.com' END AS email, CASE c_custkey % 5 WHEN 0 THEN c_name WHEN 1 THEN replace(c_name, '#', '_') WHEN 2 THEN repeat('ab_', (c_custkey % 13)::INT) WHEN 3 THEN 'u' || (c_custkey % 20) ELSE c_mktsegment END AS username,
    CASE c_custkey % 4 WHEN 0 THEN 'Abc1$' || c_custkey WHEN 1 THEN c_mktsegment || 'a1!' || c_custkey WHEN 2 THEN 'Abcdefg1#' ELSE 'Ab1!' || repeat('x', (c_custkey % 25)::INT) END AS p FROM customer)""",
)
def user_rules(spark, sf_dir):
    k = D("c_custkey")
    email = F.when(k % 3 == 0, F.concat(F.replace("c_name", F.lit("#"), F.lit(".")), F.lit("@example.com"))).when(k % 3 == 1, F.concat("c_name", F.lit("@example.com"))).otherwise("a" * 45 + "@ex.com")
    password = F.when(k % 4 == 0, _text("Abc1$", k)).when(k % 4 == 1, _text(D("c_mktsegment"), "a1!", k)).when(k % 4 == 2, "Abcdefg1#").otherwise(F.concat(F.lit("Ab1!"), F.repeat(F.lit("x"), (k % 25).cast("int"))))
    username = F.when(k % 5 == 0, D("c_name")).when(k % 5 == 1, F.replace("c_name", F.lit("#"), F.lit("_"))).when(k % 5 == 2, F.repeat(F.lit("ab_"), (k % 13).cast("int"))).when(k % 5 == 3, _text("u", k % 20)).otherwise(D("c_mktsegment"))
    rows = table(spark, sf_dir, "customer").select(k.alias("id"), email.alias("email"), username.alias("username"), password.alias("password"))
    return rows.select("id", C.valid_email(D("email")).alias("email_ok"), C.valid_username(D("username")).alias("username_ok"), C.valid_password(D("password")).alias("password_ok"))


@query("user_lookup", "SELECT id, username FROM (SELECT c_custkey AS id, c_name AS username, 'user' || c_custkey || '@example.com' AS email FROM customer) WHERE email = 'user7@example.com' OR username = (SELECT min(c_name) FROM customer)")
def user_lookup(spark, sf_dir):
    users = table(spark, sf_dir, "customer").select(D("c_custkey").alias("id"), D("c_name").alias("username"), _text("user", D("c_custkey"), "@example.com").alias("email"))
    return users.where((D("email") == "user7@example.com") | (D("username") == users.select(F.min("username")).scalar())).select("id", "username")


@query("jwt_payload", "SELECT c_custkey AS id, c_name AS username FROM customer")
def jwt_payload(spark, sf_dir):
    body = F.base64(F.encode(F.to_json(F.struct(D("c_custkey").alias("id"), D("c_name").alias("username"))), "UTF-8"))
    token = F.concat(F.lit("head."), F.rtrim(F.translate(body, "+/", "-_"), F.lit("=")), F.lit(".signature"))
    return table(spark, sf_dir, "customer").select(X.jwt_payload(token, "id bigint, username string").alias("p")).select("p.*")


@query("date_display", "SELECT o_orderkey, strftime(o_orderdate, '%-d %b %Y') AS shown FROM orders")
def date_display(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", X.date_display(D("o_orderdate")).alias("shown"))


@query("uploaded_at", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN o_orderdate ELSE TIMESTAMP '2000-01-01 00:00:00' END AS at FROM orders")
def uploaded_at(spark, sf_dir):
    created = F.when(D("o_orderstatus") == "F", D("o_orderdate"))
    return table(spark, sf_dir, "orders").select("o_orderkey", C.uploaded_at(created, F.lit("2000-01-01 00:00:00").cast("timestamp").cast(table(spark, sf_dir, "orders").schema["o_orderdate"].dataType)).alias("at"))


@query("question_trim", "SELECT item_id, trim('  ' || text || '  ') AS question FROM benchmark WHERE trim(text) <> ''")
def question_trim(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", F.trim(_text("  ", D("text"), "  ")).alias("question")).where("question != ''")


@query("index_roundtrip", "SELECT label::VARCHAR AS document_id, vec_id, 'org_model' AS embedding_model FROM embeddings WHERE label <> 3 UNION ALL SELECT '3', vec_id + 1000000, 'org_model' FROM embeddings WHERE label = 3 AND vec_id % 2 = 0")
def index_roundtrip(spark, sf_dir):
    """All vectors are stored; then one document is replaced by fewer rows, and the others stay."""
    path = workspace.new_path(spark, "index")
    rows = table(spark, sf_dir, "embeddings").select(D("label").alias("document_id"), "vec_id", "embedding")
    index.save(rows, path, "org/model")
    index.save(rows.where("document_id = 3 and vec_id % 2 = 0").withColumn("vec_id", D("vec_id") + 1000000), path, "org/model")
    return index.load(spark, path, "org/model").select(D("document_id").cast("string").alias("document_id"), "vec_id", "embedding_model")


@query("chunk_dump", "SELECT doc_id, text, source FROM documents")
def chunk_dump(spark, sf_dir):
    """Chunks as JSON lines, read back."""
    path = workspace.new_path(spark, "dump")
    sinks.dump_json(table(spark, sf_dir, "documents").select("doc_id", "text", "source"), path)
    return spark.read.schema("doc_id bigint, text string, source string").json(path)


@query(
    "index_generations",
    """WITH r AS (SELECT source, count(*) AS chunks, sum(n_chars)::BIGINT AS chars, min(doc_id) AS first FROM documents GROUP BY source)
    SELECT 'before' AS read, source AS document_id, chunks, chars FROM r
    UNION ALL SELECT 'after', source, chunks, CASE WHEN first % 2 = 0 THEN 2 * chars ELSE chars END FROM r WHERE source < (SELECT max(source) FROM r)""",
)
def index_generations(spark, sf_dir):
    """All documents stored; half of the sources replaced and the last removed while a reader has the first generation open."""
    root = workspace.new_path(spark, "generations")
    docs = table(spark, sf_dir, "documents").select(D("source").alias("document_id"), "doc_id", "n_chars")
    generations.save(docs, root, "org/model")
    before = generations.snapshot(spark, root).load("org/model")
    even = docs.groupBy("document_id").agg(F.min("doc_id").alias("first")).where("first % 2 = 0").select("document_id")
    generations.save(docs.join(even, "document_id", "left_semi").withColumn("n_chars", 2 * D("n_chars")), root, "org/model")
    generations.remove(spark, root, "org/model", docs.select(F.max("document_id").alias("document_id")))
    after = generations.snapshot(spark, root).load("org/model")
    counted = lambda rows, name: rows.groupBy(F.lit(name).alias("read"), "document_id").agg(F.count("*").alias("chunks"), F.sum("n_chars").alias("chars"))
    return counted(before, "before").unionByName(counted(after, "after"))
