"""Queries over what keeps records: registry rows, the index, sources, events, and retrieval as a whole."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.config import Retrieval, Settings
from docloom.functions import analysis
from docloom.operators import filters, index, providers, registry, retrieval
from docloom.schema import encoded
from docloom.session import stored, table
from docloom.sources import extract, urls

from .base import AS_OF, CALLER, DOCS_SQL, LINES_SQL, PRINTED, documents, in_file_order, line_chunks, query


def _conversations(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Sessions and messages in the registry's columns."""
    rows = table(spark, sf, "conversations")
    sessions = rows.select(F.col("conv_id").cast("string").alias("id")).distinct().select("id", F.lit("t").alias("title"), F.lit("o").alias("owner"), F.lit(0.0).alias("created_at"), F.lit(0.0).alias("updated_at"))
    none = F.lit(None)
    messages = rows.select(
        F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"), F.col("conv_id").cast("string").alias("session_id"), "role", F.col("text").alias("content"),
        none.cast("array<map<string,string>>").alias("sources"), none.cast("map<string,string>").alias("trace"), F.col("turn").cast("double").alias("created_at"),
    )
    return sessions, messages


@query("""SELECT conv_id::VARCHAR AS session_id, count(*) + 1 AS n, max(turn::DOUBLE) AS last_old, 99.0::DOUBLE AS newest FROM conversations GROUP BY conv_id""")
def message_insert(spark: SparkSession, sf: str) -> DataFrame:
    """A message more for each session, with derived ids, checked against the sessions."""
    sessions, old = _conversations(spark, sf)
    new = sessions.select(F.col("id").alias("session_id"), F.lit("user").alias("role"), F.lit("one more").alias("content"))
    rows = registry.inserted(old, new, "messages", F.lit(99.0), ("session_id", "content"), sessions)
    return rows.groupBy("session_id").agg(F.count_distinct("id").alias("n"), F.max(F.when(F.col("created_at") < 99, F.col("created_at"))).alias("last_old"), F.max("created_at").alias("newest"))


@query("""SELECT conv_id AS session_id, turn AS seq, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations QUALIFY n <= 3""")
def message_list(spark: SparkSession, sf: str) -> DataFrame:
    """The first three messages of every session."""
    rows = table(spark, sf, "conversations").select(F.col("conv_id").alias("session_id"), F.col("turn").alias("seq"))
    return registry.message_list(rows, 3).select("session_id", "seq", F.col("n").cast("long").alias("n"))


@query("SELECT o_orderkey AS id, o_orderpriority AS query FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 1000")
def case_list(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("query"), F.col("o_orderdate").alias("created_at"))
    return registry.case_list(rows).select("id", "query")


@query("SELECT o_orderkey AS id, o_orderpriority AS label, o_totalprice AS metrics, 1 AS n_cases, o_orderdate AS created_at FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 30")
def run_list(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "orders")
    return registry.run_list(rows.select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("label"), F.col("o_totalprice").alias("metrics"), F.lit(1).alias("n_cases"), F.col("o_orderdate").alias("created_at"), F.col("o_custkey").alias("details")))


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey IN (3, 32, 70, -1)")
def point_lookup(spark: SparkSession, sf: str) -> DataFrame:
    return registry.looked_up(table(spark, sf, "orders"), "o_orderkey", [3, 32, 70, -1]).select("o_orderkey", "o_totalprice")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey % 3 <> 1")
def delete_rows(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "orders").select("o_orderkey")
    return registry.without(rows, "o_orderkey", rows.where("o_orderkey % 3 = 1"))


@query("SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k, '{\"k\":' || json_extract_string(props, '$.k') || '}' AS again FROM events")
def json_columns(spark: SparkSession, sf: str) -> DataFrame:
    parsed = registry.json_decoded(table(spark, sf, "events").select("event_id", "props"), {"props": "struct<k:bigint>"})
    return registry.json_encoded(parsed.withColumn("k", F.col("props.k")), ("props",)).select("event_id", "k", F.col("props").alias("again"))


@query("SELECT o_orderkey, '{\"o_orderkey\":' || o_orderkey || CASE o_orderkey % 3 WHEN 0 THEN '' ELSE ',\"name\":\"' || o_orderpriority || '\"' END || CASE o_orderkey % 2 WHEN 0 THEN '' ELSE ',\"tags\":[\"x\"]' END || ',\"zero\":0}' AS row FROM orders")
def row_encode(spark: SparkSession, sf: str) -> DataFrame:
    """Nulls, empty texts and empty arrays are left out; 0 stays."""
    key = F.col("o_orderkey")
    rows = table(spark, sf, "orders").select(
        key, F.when(key % 3 == 0, F.when(key % 2 == 0, "")).otherwise(F.col("o_orderpriority")).alias("name"), F.when(key % 2 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("x"))).alias("tags"), F.lit(0).alias("zero"),
    )
    return rows.select("o_orderkey", encoded(rows).alias("row"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_quantity + CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END AS score FROM lineitem WHERE l_linestatus = 'O' AND l_quantity >= 10 AND NOT l_discount > 0.05""")
def bool_clauses(spark: SparkSession, sf: str) -> DataFrame:
    """must, filter, must_not and should, gathered by a chain of processors."""

    def restrict(term: str, clauses: filters.Clauses, context: filters.Context) -> str:
        clauses.must.append(F.col("l_linestatus") == term)
        clauses.filter.append(F.col("l_quantity") >= 10)
        return ""

    def exclude(term: str, clauses: filters.Clauses, context: filters.Context) -> str:
        clauses.must_not.append(F.col("l_discount") > 0.05)
        clauses.should.extend([F.col("l_quantity"), F.when(F.col("l_returnflag") == "R", 1.0)])
        return term

    clauses = filters.run_chain([restrict, exclude], "O", filters.Context())
    return clauses.apply(table(spark, sf, "lineitem")).select("l_orderkey", "l_linenumber", "l_partkey", "score")


@query("""SELECT page_id, CASE page_id % 11 WHEN 0 THEN 'html' WHEN 1 THEN 'html' WHEN 2 THEN 'pdf' WHEN 3 THEN 'md' WHEN 4 THEN 'txt' WHEN 5 THEN 'csv' WHEN 6 THEN 'json' WHEN 7 THEN 'docx' WHEN 8 THEN 'xlsx'
  ELSE CASE WHEN lower(regexp_extract(url_decode(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)', 1)), '[^/]\\.([^./]+)$', 1)) = '' THEN 'html' ELSE lower(regexp_extract(url_decode(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)', 1)), '[^/]\\.([^./]+)$', 1)) END END AS suffix FROM pages""")
def content_type_suffix(spark: SparkSession, sf: str) -> DataFrame:
    """Each known content type, with parameters and in capitals, one that isn't known, and none."""
    known = list(urls.CONTENT_TYPES)
    names = F.array(*[F.lit(f" {k.upper()}; charset=utf-8") for k in known], F.lit("application/unheard-of"))
    kind = F.get(names, (F.col("page_id") % 11).cast("int"))
    return table(spark, sf, "pages").select("page_id", urls.guessed_suffix(F.col("url"), kind).alias("suffix"))


@query("""SELECT l_orderkey, string_agg(CASE l_linestatus WHEN 'O' THEN '## ' ELSE '' END || 'part ' || l_partkey, chr(10) || chr(10) ORDER BY l_linenumber, l_partkey) FILTER (WHERE l_returnflag <> 'R') AS page FROM lineitem GROUP BY l_orderkey HAVING count(*) FILTER (WHERE l_returnflag <> 'R') > 0""")
def detector_results(spark: SparkSession, sf: str) -> DataFrame:
    """The results of a layout detector under all of their names, as markdown; those at one place are in the order of their rows in the table, those without a number come last."""
    label = F.when(F.expr(PRINTED), F.when(F.col("l_linestatus") == "O", "paragraph_title").otherwise("text")).otherwise("footer")
    number = F.coalesce(F.col("l_linenumber").cast("bigint"), F.lit(2**63 - 1))
    k, none, text = number % 3, F.lit(None).cast("string"), F.concat(F.lit(" part "), F.col("l_partkey").cast("string"))
    corner = F.array(F.col("l_partkey").cast("bigint"), number)
    empty = F.array().cast("array<bigint>")
    item = F.struct(
        F.when(k == 0, label).alias("label"), F.when(k == 0, none).otherwise(label).alias("type"), F.when(k == 0, text).otherwise("").alias("content"), F.when(k == 1, text).alias("text"),
        F.when(k == 2, F.struct(text.alias("html"))).alias("res"), F.when(k == 0, corner).otherwise(empty).alias("bbox"), F.when(k == 0, empty).otherwise(corner).alias("box"),
    )
    pages = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(in_file_order(item).alias("items"), F.count_if(F.expr(PRINTED)).alias("n")).where("n > 0")
    return pages.select("l_orderkey", F.nullif(extract.layout_markdown(extract.blocks_of_results(F.col("items"))), F.lit("")).alias("page"))


@query("""WITH q AS (SELECT item_id AS query_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS term FROM benchmark), s AS (SELECT term, 'same' || (length(term) % 3) AS synonym FROM q WHERE length(term) > 6)
  SELECT query_id, term FROM q WHERE term IN ('the', 'and') OR length(term) > 4 UNION SELECT query_id, synonym FROM q JOIN s USING (term)""")
def synonym_terms(spark: SparkSession, sf: str) -> DataFrame:
    """Terms of more than six letters have a synonym."""
    q = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.explode(analysis.terms("text", ())).alias("term")).where("term IN ('the', 'and') OR length(term) > 4")
    known = q.where("length(term) > 6").select("term", F.concat(F.lit("same"), (F.length("term") % 3).cast("string")).alias("synonym")).distinct()
    return analysis.with_synonyms(q, known)


@query(f"""WITH {DOCS_SQL}, {LINES_SQL}, old AS (SELECT doc_id, count(*) AS n FROM lines WHERE doc_id % 7 <> 0 GROUP BY doc_id)
  SELECT d.doc_id, CASE WHEN d.doc_id % 6 = 0 AND d.doc_id % 4 <> 2 AND d.doc_id % 5 <> 0 THEN 2 ELSE coalesce(n, 0) END AS n_chunks, CASE WHEN d.doc_id % 6 <> 0 THEN NULL WHEN d.doc_id % 4 = 2 THEN 'no such document' WHEN d.doc_id % 5 = 0 THEN 'its source gives nothing' ELSE 'indexed' END AS result
  FROM docs d LEFT JOIN old ON old.doc_id = d.doc_id""")
def reindex_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Every sixth document is asked for; some aren't registered, the source has lost others, the rest come back with two chunks."""
    docs = documents(spark, sf).select("doc_id")
    old = line_chunks(spark, sf).select("doc_id", "chunk_index", "snippet").where("doc_id % 7 <> 0")
    known = docs.where("doc_id % 4 <> 2").withColumn("file_path", F.lit("/x"))
    two = F.explode(F.array(F.lit(0), F.lit(1))).alias("chunk_index")
    new, results = index.reindexed(old, known, docs.where("doc_id % 6 = 0"), lambda r: r.where("doc_id % 5 <> 0"), lambda f: f.select("doc_id", two).withColumn("snippet", F.lit("new")))
    counts = new.groupBy("doc_id").agg(F.count("*").alias("n_chunks"))
    result = results.select("doc_id", F.coalesce("error", "status").alias("result"))
    return docs.join(counts, "doc_id", "left").join(result, "doc_id", "left").select("doc_id", F.coalesce("n_chunks", F.lit(0)).alias("n_chunks"), "result")


def _vector_rows(spark: SparkSession, sf: str) -> DataFrame:
    v = F.col("embedding")
    return table(spark, sf, "embeddings").select(
        F.when(F.col("vec_id") % 10 != 3, F.concat(F.lit("v:"), F.col("vec_id").cast("string"))).alias("chunk_uid"), F.when(F.col("vec_id") % 7 == 0, F.slice(v, 1, 5)).when(F.col("vec_id") % 7 == 1, F.array().cast("array<float>")).otherwise(v).alias("semantic_vector"),
        F.lit("new").alias("snippet"), F.lit("new").alias("text_to_index"),
    )


@query("""SELECT CASE WHEN vec_id % 10 <> 3 THEN 'v:' || vec_id END AS chunk_uid, CASE WHEN vec_id % 10 = 3 THEN 'no chunk_uid' ELSE 'vector of 5 dimensions, not 64' END AS error FROM embeddings WHERE vec_id % 10 = 3 OR vec_id % 7 = 0""")
def bulk_errors(spark: SparkSession, sf: str) -> DataFrame:
    return index.refused(_vector_rows(spark, sf), 64)


@query("""SELECT 'v:' || vec_id AS chunk_uid, CASE WHEN vec_id % 10 <> 3 AND vec_id % 7 <> 0 THEN 'new' ELSE 'old' END AS snippet FROM embeddings WHERE vec_id % 2 = 0 OR (vec_id % 10 <> 3 AND vec_id % 7 <> 0)""")
def bulk_upsert(spark: SparkSession, sf: str) -> DataFrame:
    """Rows by chunk_uid; those that can't be stored leave the old ones as they are."""
    old = table(spark, sf, "embeddings").where("vec_id % 2 = 0").select(F.concat(F.lit("v:"), F.col("vec_id").cast("string")).alias("chunk_uid"), F.col("embedding").alias("semantic_vector"), F.lit("old").alias("snippet"), F.lit("old").alias("text_to_index"))
    return index.upserted_rows(old, _vector_rows(spark, sf), 64).select("chunk_uid", "snippet")


@query("""SELECT query_id, event, count(*) AS n FROM (SELECT conv_id * 100 + turn AS query_id, role = 'system' AS failed, length(text) AS len, unnest(['session', 'trace', 'delta', 'sources', 'message', 'done', 'error']) AS event FROM conversations)
  CROSS JOIN (SELECT unnest(generate_series(1, 10000)) AS k) WHERE CASE event WHEN 'delta' THEN NOT failed AND k <= greatest(1, ceil(len / 200.0)) WHEN 'error' THEN failed AND k = 1 WHEN 'session' THEN k = 1 WHEN 'trace' THEN k = 1 ELSE NOT failed AND k = 1 END GROUP BY query_id, event""")
def answer_events(spark: SparkSession, sf: str) -> DataFrame:
    """Turns as answers, those of the system as failures."""
    text = lambda x: F.lit(x).cast("string")
    rows = table(spark, sf, "conversations").select(
        (F.col("conv_id") * 100 + F.col("turn")).alias("query_id"), F.when(F.col("role") != "system", F.coalesce("text", F.lit(""))).alias("answer"), text("s").alias("session_id"), text("{}").alias("trace"), text("[]").alias("sources"),
        F.lit(None).cast("array<string>").alias("warnings"), text("m").alias("message_id"),
    )
    return providers.events_of(rows).groupBy("query_id", "event").agg(F.count("*").alias("n"))


def _cases(spark: SparkSession, sf: str) -> DataFrame:
    """Cases of orders: what was retrieved are the parts of their lines, what is expected the file names of those that weren't returned."""
    lines = table(spark, sf, "lineitem")
    known = table(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("doc_id"), F.concat(F.lit("p"), F.col("p_partkey").cast("string"), F.lit(".md")).alias("file_name"), F.lit("").alias("file_path"), F.lit(0).alias("indexed_at"))
    found = lines.select(F.col("l_orderkey").alias("query_id"), F.col("l_linenumber").alias("rank"), F.col("l_partkey").cast("string").alias("doc_id"))
    wanted = F.collect_set(F.when(F.col("l_returnflag") == "N", F.concat(F.lit("p"), F.col("l_partkey").cast("string"), F.lit(".md"))))
    cases = lines.groupBy(F.col("l_orderkey").alias("case_id")).agg(F.array_sort(wanted).alias("expected_docs"))
    return retrieval.run_cases(cases, found, known, (1, 3))


_RUN_SQL = """r AS (SELECT l_orderkey AS case_id, l_partkey AS p, row_number() OVER (PARTITION BY l_orderkey ORDER BY min(l_linenumber), l_partkey::VARCHAR) AS r FROM lineitem GROUP BY l_orderkey, l_partkey),
  ex AS (SELECT DISTINCT l_orderkey AS case_id, l_partkey AS p FROM lineitem WHERE l_returnflag = 'N'), ne AS (SELECT case_id, count(*) AS n FROM ex GROUP BY case_id),
  h AS (SELECT r.case_id, r, ex.p IS NOT NULL AS hit FROM r LEFT JOIN ex ON ex.case_id = r.case_id AND ex.p = r.p),
  m AS (SELECT case_id, coalesce(n, 0) AS n, round(CASE WHEN coalesce(n, 0) > 0 THEN count(*) FILTER (WHERE hit AND r <= 1) / n ELSE 0 END, 4) AS r1, round(CASE WHEN coalesce(n, 0) > 0 THEN count(*) FILTER (WHERE hit AND r <= 3) / n ELSE 0 END, 4) AS r3,
    round(count(*) FILTER (WHERE hit AND r <= 1) / count(*) FILTER (WHERE r <= 1), 4) AS p1, round(count(*) FILTER (WHERE hit AND r <= 3) / count(*) FILTER (WHERE r <= 3), 4) AS p3, round(coalesce(1.0 / min(CASE WHEN hit THEN r END), 0.0), 4) AS mrr FROM h LEFT JOIN ne USING (case_id) GROUP BY case_id, n)"""


@query(f"WITH {_RUN_SQL} SELECT case_id, unnest(['recall@1', 'recall@3', 'precision@1', 'precision@3', 'mrr']) AS metric, unnest([r1, r3, p1, p3, mrr]) AS value FROM m")
def run_cases(spark: SparkSession, sf: str) -> DataFrame:
    return _cases(spark, sf).where(~F.col("metric").startswith("ndcg")).select("case_id", "metric", "value")


@query(f"WITH {_RUN_SQL}, a AS (SELECT unnest(['recall@1', 'recall@3', 'precision@1', 'precision@3', 'mrr']) AS metric, unnest([avg(r1), avg(r3), avg(p1), avg(p3), avg(mrr)]) AS value, count(*)::INT AS n_cases FROM m) SELECT 'nightly' AS label, metric, round(value, 4) AS value, n_cases, '50' AS top_k FROM a")
def evaluation_run(spark: SparkSession, sf: str) -> DataFrame:
    """A whole run as the row that is saved, its averages unfolded."""
    run = retrieval.run_row(stored(_cases(spark, sf), "cases"), "nightly", F.lit(1.0))
    flat = run.select("label", F.explode("metrics").alias("metric", "value"), "n_cases", F.col("config")["retrieval.top_k"].alias("top_k"))
    return flat.where(~F.col("metric").startswith("ndcg"))


@query(f"WITH {_RUN_SQL} SELECT case_id::VARCHAR AS case_id, r1, mrr FROM m")
def evaluation_details(spark: SparkSession, sf: str) -> DataFrame:
    """What each case of a run got, as rows of their own."""
    details = retrieval.run_details(_cases(spark, sf), "nightly", F.lit(1.0))
    return details.select("case_id", F.col("metrics")["recall@1"].alias("r1"), F.col("metrics")["mrr"].alias("mrr"))


def _retrieved(spark: SparkSession, sf: str, settings: Settings) -> tuple[DataFrame, DataFrame]:
    """Lines of documents as chunks, five to a context; items ask for one kind of document, some for documents before a date."""
    blank = F.lit("")
    chunks = line_chunks(spark, sf).join(documents(spark, sf).select("doc_id", "document_type"), "doc_id").select(
        "doc_id", F.concat_ws(":", F.col("doc_id").cast("string"), F.col("chunk_index").cast("string")).alias("chunk_uid"), "chunk_index", "file_name", blank.alias("file_url"), "document_type", "acl_principals", "snippet",
        F.col("snippet").alias("text_to_index"), "page_no", "section_id", "context_id", "format", blank.alias("header1"), blank.alias("header2"), F.lit(None).cast("array<float>").alias("semantic_vector"),
        F.timestamp_seconds(F.unix_timestamp(F.lit(AS_OF).cast("timestamp")) - (F.col("doc_id") % 400) * 86400).alias("last_modified_date"),
    )
    kind = F.when(F.col("item_id") % 2 == 0, " filetype:de").otherwise(" type:en,es")
    asked = F.concat(F.lit("q"), F.col("item_id").cast("string"), kind, F.when(F.col("item_id") % 4 == 1, " before:2023-06-30").otherwise(""))
    queries = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), asked.alias("query"))
    return retrieval.retrieve(queries, stored(chunks, "chunks"), F.lit(AS_OF).cast("timestamp"), settings, list(CALLER), "semantic_only")


_SEEN_SQL = f"""{DOCS_SQL}, {LINES_SQL}, c AS (SELECT lines.doc_id, chunk_index, chunk_index // 5 AS ctx, document_type, lines.doc_id || ':' || chunk_index AS uid, round(pow(0.5, pow((lines.doc_id % 400) / 180.0, 2)), 9) AS score,
    TIMESTAMP '{AS_OF}' - to_days((lines.doc_id % 400)::INT) AS d FROM lines JOIN docs USING (doc_id) WHERE lines.principal IN ('public', 'user:u3', 'group:de')),
  hit AS (SELECT item_id AS query_id, c.*, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, uid) AS r FROM benchmark JOIN c ON CASE item_id % 2 WHEN 0 THEN document_type = 'de' ELSE document_type IN ('en', 'es') END AND (item_id % 4 <> 1 OR d < TIMESTAMP '2023-07-01') QUALIFY r <= 50),
  ten AS (SELECT * FROM hit WHERE r <= 10), par AS (SELECT query_id, doc_id, ctx, min(r) AS f, row_number() OVER (PARTITION BY query_id ORDER BY min(r)) AS p FROM ten GROUP BY query_id, doc_id, ctx QUALIFY p <= 6)"""


@query(f"""WITH {_SEEN_SQL} SELECT item_id AS query_id, coalesce(a.n, 0) AS n_raw, coalesce(b.n, 0) AS n_reranked, coalesce(e.n, 0) AS n_parents FROM benchmark
  LEFT JOIN (SELECT query_id, count(*) AS n FROM hit GROUP BY query_id) a ON a.query_id = item_id LEFT JOIN (SELECT query_id, count(*) AS n FROM ten GROUP BY query_id) b ON b.query_id = item_id LEFT JOIN (SELECT query_id, count(*) AS n FROM par GROUP BY query_id) e ON e.query_id = item_id""")
def retrieval_trace(spark: SparkSession, sf: str) -> DataFrame:
    """How many rows each stage of retrieval has left: filters of each query, top 50, top 10, six parents."""
    return _retrieved(spark, sf, Settings())[1]


@query(f"WITH {_SEEN_SQL} SELECT query_id, p AS rank, doc_id, ctx::INT AS context_id FROM par")
def retrieved_parents(spark: SparkSession, sf: str) -> DataFrame:
    return _retrieved(spark, sf, Settings())[0].select("query_id", F.col("rank").cast("long").alias("rank"), "doc_id", "context_id")


@query(f"WITH {_SEEN_SQL} SELECT query_id, r AS rank, uid AS chunk_uid, score, round(score / max(score) OVER (PARTITION BY query_id), 6) AS normalized_score, false AS is_parent FROM hit WHERE r <= 6")
def retrieved_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Without parents: the first six candidates as they are."""
    found = _retrieved(spark, sf, Settings(retrieval=Retrieval(return_parent=False)))[0]
    return found.select("query_id", F.col("rank").cast("long").alias("rank"), "chunk_uid", "score", "normalized_score", "is_parent")


@query("SELECT user_id AS query_id, count(*) AS n, count(*) FILTER (WHERE event_type <> 'error') AS ok, 5.0::DOUBLE AS created_at FROM events GROUP BY user_id")
def request_log(spark: SparkSession, sf: str) -> DataFrame:
    """Events as requests, logged; a null outcome is a failure."""
    rows = table(spark, sf, "events").select(
        F.col("user_id").alias("query_id"), F.col("event_type").alias("query"), F.when(F.col("event_type") != "error", True).alias("ok"), F.col("value").cast("long").alias("latency_ms"),
        F.create_map(F.lit("search"), F.lit(1)).alias("stages"), F.lit(3).alias("n_candidates"), "event_id",
    )
    logged = retrieval.request_rows(rows, "search", F.lit(5.0)).withColumn("k", F.lit(1))
    ids = rows.select(F.xxhash64(F.lit("search"), "query_id", F.lit("5.0")).alias("id"), "query_id").distinct()
    return logged.join(ids, "id").groupBy("query_id").agg(F.count("*").alias("n"), F.count_if("ok").alias("ok"), F.max("created_at").alias("created_at"))

