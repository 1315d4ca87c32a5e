"""Queries over the registry, the index and evaluation runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.operators import evaluation, filters, index, registry
from docloom.session import table

from .base import AS_OF, DOCS_SQL, documents, line_chunks, query


def _sessions(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").groupBy(F.col("conv_id").alias("id")).agg(F.max("turn").alias("updated_at")).withColumn("owner", F.concat(F.lit("u"), (F.col("id") % 5).cast("string"))).withColumn("title", F.lit("t"))


def _messages(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("conv_id").alias("session_id"), F.col("turn").alias("seq"), "role", F.col("text").alias("content")
    )


@query("""SELECT conv_id AS id, max(turn) AS updated_at, count(*) AS n_messages FROM conversations WHERE conv_id % 5 = 1 GROUP BY conv_id ORDER BY updated_at DESC, id LIMIT 50""")
def session_list(spark: SparkSession, sf: str) -> DataFrame:
    return registry.session_list(_sessions(spark, sf), _messages(spark, sf), F.col("owner") == "u1").select("id", "updated_at", "n_messages")


@query("""SELECT conv_id AS id, max(turn) + CASE WHEN conv_id = 3 THEN 100 ELSE 0 END AS updated_at, CASE WHEN conv_id = 3 THEN 'new' ELSE 't' END AS title FROM conversations GROUP BY conv_id""")
def session_rename(spark: SparkSession, sf: str) -> DataFrame:
    return registry.renamed(_sessions(spark, sf), F.lit(3), F.lit("new"), F.col("updated_at") + 100).select("id", "updated_at", "title")


@query("""SELECT * FROM (SELECT conv_id AS id, 't' AS title FROM conversations GROUP BY conv_id UNION SELECT -i, 'a new session' FROM (SELECT unnest([1, 2, 3]) AS i))""")
def session_ensure(spark: SparkSession, sf: str) -> DataFrame:
    old = _sessions(spark, sf).select("id", "title", "owner", F.lit(0.0).alias("created_at"), F.col("updated_at").cast("double").alias("updated_at"))
    wanted = spark.range(1, 4).select((-F.col("id")).alias("id")).unionByName(old.select("id"))
    return registry.ensured(old, wanted, F.lit("a new session"), F.lit(1.0)).select("id", "title")


@query("""SELECT conv_id AS session_id, turn AS seq, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS k FROM conversations) WHERE k <= 6""")
def history_last_n(spark: SparkSession, sf: str) -> DataFrame:
    return registry.history(_messages(spark, sf), 3).select("session_id", "seq", F.col("n").cast("long").alias("n"))


@query("""SELECT 'sessions' AS kind, count(DISTINCT conv_id) AS n FROM conversations WHERE conv_id % 3 <> 0 UNION ALL SELECT 'messages', count(*) FROM conversations WHERE conv_id % 3 <> 0
  UNION ALL SELECT 'feedback', count(*) FROM conversations WHERE conv_id % 3 <> 0 AND role = 'assistant'""")
def cascade_delete(spark: SparkSession, sf: str) -> DataFrame:
    m = _messages(spark, sf)
    s, f = _sessions(spark, sf), m.where("role = 'assistant'").select(F.col("id").alias("message_id"), F.lit("up").alias("rating"))
    left = registry.without_sessions(s, m, f, s.where("id % 3 = 0").select("id"))
    out = None
    for name, rows in zip(("sessions", "messages", "feedback"), left, strict=True):
        one = rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("kind"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def _feedback(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "labels").select(F.col("doc_id").alias("id"), F.when(F.col("quality") == 1, "up").otherwise("down").alias("rating"), (F.col("doc_id") % 97).alias("created_at"))
    return registry.checked_feedback(rows)


@query("""SELECT r AS rating, count(doc_id) AS n FROM (SELECT unnest(['up', 'down']) AS r) LEFT JOIN labels ON r = CASE quality WHEN 1 THEN 'up' ELSE 'down' END GROUP BY r""")
def feedback_summary(spark: SparkSession, sf: str) -> DataFrame:
    return registry.feedback_summary(_feedback(spark, sf))


@query("SELECT doc_id AS id, doc_id % 97 AS created_at FROM labels WHERE quality = 0 ORDER BY created_at DESC, id LIMIT 20")
def feedback_list(spark: SparkSession, sf: str) -> DataFrame:
    return registry.feedback_list(_feedback(spark, sf), "down", 20).select("id", "created_at")


@query(f"""WITH {DOCS_SQL} SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'v2' ELSE 'v1' END AS version, CASE WHEN doc_id % 4 = 0 THEN doc_id % 11 ELSE doc_id % 7 END AS n_chunks FROM docs
  UNION ALL SELECT doc_id + 1000000000, 'v2', doc_id % 11 FROM docs WHERE doc_id % 4 = 0""")
def document_upsert(spark: SparkSession, sf: str) -> DataFrame:
    docs = documents(spark, sf).select("doc_id")
    stored = docs.select("doc_id", F.lit("v1").alias("version"), (F.col("doc_id") % 7).alias("n_chunks"), F.lit(0).alias("indexed_at"))
    every = docs.where("doc_id % 4 = 0")
    new = every.unionByName(every.select((F.col("doc_id") + 1000000000).alias("doc_id")))
    new = new.select("doc_id", F.explode(F.array(F.lit(1), F.lit(2))).alias("indexed_at")).select(
        "doc_id", F.concat(F.lit("v"), F.col("indexed_at").cast("string")).alias("version"), (F.col("doc_id") % 1000000000 % 11).alias("n_chunks"), "indexed_at"
    )
    return registry.upserted(stored, new, "doc_id", "indexed_at").select("doc_id", "version", "n_chunks")


@query(f"WITH {DOCS_SQL} SELECT doc_id, file_name FROM docs WHERE file_name ILIKE '%src1%' ORDER BY doc_id DESC LIMIT 25 OFFSET 10")
def document_page(spark: SparkSession, sf: str) -> DataFrame:
    found = documents(spark, sf).where(filters.like_keyword("src1", F.col("file_name"))).select("doc_id", "file_name")
    return registry.page(found, [F.desc("doc_id")], 25, 10)


def _registry(spark: SparkSession, sf: str) -> DataFrame:
    return documents(spark, sf).select("doc_id", F.size(F.split("text", "\n")).alias("n_chunks"), F.when(F.col("doc_id") % 17 == 0, "failed").otherwise("indexed").alias("status"))


@query("SELECT count(*) AS documents, sum(len(string_split(text, chr(10))))::BIGINT AS chunks, count(*) FILTER (WHERE doc_id % 17 = 0) AS failed FROM documents")
def document_stats(spark: SparkSession, sf: str) -> DataFrame:
    return registry.document_stats(_registry(spark, sf))


@query("SELECT doc_id, text FROM documents WHERE doc_id % 10 <> 3")
def delete_documents(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return index.without_documents(docs, docs.where("doc_id % 10 = 3"))


@query(f"""SELECT count(*) AS requests, count(*) FILTER (WHERE event_type <> 'error') AS success, trunc(avg(trunc(value)))::BIGINT AS avg_ms, max(trunc(value))::BIGINT AS max_ms, round(count(*) FILTER (WHERE event_type = 'error') / count(*), 4) AS error_rate
  FROM events WHERE ts >= TIMESTAMP '{AS_OF}' - INTERVAL 240 HOURS""")
def request_metrics(spark: SparkSession, sf: str) -> DataFrame:
    as_of = F.lit(AS_OF).cast("timestamp_ntz")
    log = table(spark, sf, "events").where(filters.within(F.col("ts"), as_of, 240)).select((F.col("event_type") != "error").alias("ok"), F.col("value").cast("long").alias("latency_ms"))
    return registry.request_metrics(log)


@query(f"WITH {DOCS_SQL} SELECT count(*) AS chunks, count(DISTINCT doc_id) AS documents FROM (SELECT doc_id, unnest(string_split(text, chr(10))) FROM docs)")
def index_stats(spark: SparkSession, sf: str) -> DataFrame:
    return index.index_stats(line_chunks(spark, sf))


@query(f"WITH {DOCS_SQL} SELECT document_type, count(*) AS n FROM docs GROUP BY document_type ORDER BY n DESC, document_type LIMIT 20")
def index_by_type(spark: SparkSession, sf: str) -> DataFrame:
    return index.by_type(documents(spark, sf))


def _delta(spark: SparkSession, sf: str) -> DataFrame:
    """Stored: all but every seventh, every fifth with another hash."""
    docs = documents(spark, sf).select("doc_id", "content_hash", F.length("text").alias("n_chars"))
    stored = docs.where("doc_id % 7 <> 0").select("doc_id", F.when(F.col("doc_id") % 5 == 0, "old").otherwise(F.col("content_hash")).alias("content_hash"))
    return index.delta(stored, docs)


@query(f"WITH {DOCS_SQL} SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'new' WHEN doc_id % 5 = 0 THEN 'changed' ELSE 'unchanged' END AS state FROM docs")
def delta_classify(spark: SparkSession, sf: str) -> DataFrame:
    return _delta(spark, sf).select("doc_id", "state")


@query("""WITH i AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'new' WHEN doc_id % 5 = 0 THEN 'changed' ELSE 'unchanged' END AS state, doc_id % 13 = 0 AS bad, (doc_id % 9) AS n FROM documents),
  s AS (SELECT *, CASE WHEN state = 'unchanged' THEN 'skipped' WHEN bad OR n = 0 THEN 'failed' ELSE 'indexed' END AS status FROM i)
  SELECT count(*) FILTER (WHERE status = 'indexed') AS indexed, count(*) FILTER (WHERE status = 'skipped') AS skipped, count(*) FILTER (WHERE status = 'failed') AS failed, sum(CASE WHEN status = 'indexed' THEN n ELSE 0 END)::BIGINT AS total_chunks FROM s""")
def ingest_status_summary(spark: SparkSession, sf: str) -> DataFrame:
    items = _delta(spark, sf).withColumn("error", F.when(F.col("doc_id") % 13 == 0, "broken")).withColumn("n_chunks", F.col("doc_id") % 9)
    return index.ingest_summary(index.ingest_status(items))


@query(f"""WITH {DOCS_SQL} SELECT doc_id, count(*) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS s FROM docs WHERE doc_id % 6 <> 0 UNION ALL SELECT doc_id, 'new' FROM docs WHERE doc_id % 6 = 0) GROUP BY doc_id""")
def index_upsert(spark: SparkSession, sf: str) -> DataFrame:
    chunks = line_chunks(spark, sf).select("doc_id", "chunk_index", "snippet")
    new = documents(spark, sf).where("doc_id % 6 = 0").select("doc_id", F.lit(0).alias("chunk_index"), F.lit("new").alias("snippet"))
    return index.upserted_chunks(chunks, new).groupBy("doc_id").agg(F.count("*").alias("n"))


def _cases(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as cases: parts in the order of lines are what was retrieved; parts of lines that were not returned are expected."""
    lines = table(spark, sf, "lineitem")
    retrieved = F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))), lambda x: x["l_partkey"])
    return lines.groupBy(F.col("l_orderkey").alias("case_id")).agg(retrieved.alias("retrieved"), F.array_sort(F.collect_set(F.when(F.col("l_returnflag") == "N", F.col("l_partkey")))).alias("expected"))


_CASES_SQL = """lines AS (SELECT l_orderkey AS case_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS r, l_partkey AS p FROM lineitem),
  ex AS (SELECT DISTINCT l_orderkey AS case_id, l_partkey AS p FROM lineitem WHERE l_returnflag = 'N'), ne AS (SELECT case_id, count(*) AS n FROM ex GROUP BY case_id),
  hits AS (SELECT lines.case_id, r, lines.p, ex.p IS NOT NULL AS hit FROM lines LEFT JOIN ex ON ex.case_id = lines.case_id AND ex.p = lines.p),
  m AS (SELECT hits.case_id, coalesce(n, 0) AS n, %s FROM hits LEFT JOIN ne USING (case_id) GROUP BY hits.case_id, n)"""
_RECALL = "CASE WHEN coalesce(n, 0) > 0 THEN count(DISTINCT CASE WHEN hit AND r <= {k} THEN p END) / n ELSE 0.0 END"


@query(f"WITH {_CASES_SQL % (_RECALL.format(k=3) + ' AS rec, count(*) FILTER (WHERE hit AND r <= 3) / count(*) FILTER (WHERE r <= 3) AS prec')} SELECT case_id, round(rec, 4) AS recall, round(prec, 4) AS prec FROM m")
def recall_precision(spark: SparkSession, sf: str) -> DataFrame:
    r, e = F.col("retrieved"), F.col("expected")
    return _cases(spark, sf).select("case_id", F.round(evaluation.recall_at(r, e, 3), 4).alias("recall"), F.round(evaluation.precision_at(r, e, 3), 4).alias("prec"))


@query(f"WITH {_CASES_SQL % 'coalesce(1.0 / min(CASE WHEN hit THEN r END), 0.0) AS mrr'} SELECT case_id, round(mrr, 4) AS mrr FROM m")
def mrr(spark: SparkSession, sf: str) -> DataFrame:
    return _cases(spark, sf).select("case_id", F.round(evaluation.reciprocal_rank(F.col("retrieved"), F.col("expected")), 4).alias("mrr"))


@query(f"""WITH {_CASES_SQL % 'sum(CASE WHEN hit AND r <= 3 THEN 1.0 / log2(r + 1) ELSE 0.0 END) AS dcg'}, ideal AS (SELECT k, sum(1.0 / log2(k2 + 1)) AS v FROM (SELECT unnest([1, 2, 3]) AS k) JOIN (SELECT unnest([1, 2, 3]) AS k2) ON k2 <= k GROUP BY k)
  SELECT case_id, round(CASE WHEN n > 0 THEN dcg / v ELSE 0.0 END, 4) AS ndcg FROM m LEFT JOIN ideal ON k = least(n, 3)""")
def ndcg(spark: SparkSession, sf: str) -> DataFrame:
    return _cases(spark, sf).select("case_id", F.round(evaluation.ndcg_at(F.col("retrieved"), F.col("expected"), 3), 4).alias("ndcg"))


def _values(spark: SparkSession, sf: str) -> DataFrame:
    return evaluation.per_case(_cases(spark, sf), (1, 5))


_VALUES_SQL = f"""{_CASES_SQL % (_RECALL.format(k=1) + ' AS r1, ' + _RECALL.format(k=5) + ' AS r5, count(*) FILTER (WHERE hit AND r <= 1) / count(*) FILTER (WHERE r <= 1) AS p1, count(*) FILTER (WHERE hit AND r <= 5) / count(*) FILTER (WHERE r <= 5) AS p5, coalesce(1.0 / min(CASE WHEN hit THEN r END), 0.0) AS mrr')},
  vals AS (SELECT case_id, unnest(['recall@1', 'recall@5', 'precision@1', 'precision@5', 'mrr']) AS metric, unnest([round(r1, 4), round(r5, 4), round(p1, 4), round(p5, 4), round(mrr, 4)]) AS value FROM m)"""


@query(f"WITH {_VALUES_SQL} SELECT metric, round(avg(value), 4) AS value FROM vals GROUP BY metric")
def macro_average(spark: SparkSession, sf: str) -> DataFrame:
    return evaluation.macro_average(_values(spark, sf).where(~F.col("metric").startswith("ndcg")))


@query(f"""WITH {_VALUES_SQL}, b AS (SELECT metric, round(avg(value), 4) AS v FROM vals WHERE case_id % 2 = 0 AND metric <> 'mrr' GROUP BY metric), a AS (SELECT metric, round(avg(value), 4) AS v FROM vals WHERE case_id % 2 = 1 AND metric <> 'recall@1' GROUP BY metric)
  SELECT coalesce(a.metric, b.metric) AS metric, coalesce(b.v, 0.0) AS before, coalesce(a.v, 0.0) AS after, round(coalesce(a.v, 0.0) - coalesce(b.v, 0.0), 4) AS delta, coalesce(a.v, 0.0) < coalesce(b.v, 0.0) - 1e-9 AS regressed FROM a FULL JOIN b ON a.metric = b.metric""")
def run_compare(spark: SparkSession, sf: str) -> DataFrame:
    v = _values(spark, sf).where(~F.col("metric").startswith("ndcg"))
    return evaluation.compare(evaluation.macro_average(v.where("case_id % 2 = 0 AND metric <> 'mrr'")), evaluation.macro_average(v.where("case_id % 2 = 1 AND metric <> 'recall@1'")))


@query(f"WITH {_VALUES_SQL} SELECT case_id, value FROM vals WHERE metric = 'recall@5' ORDER BY value, case_id LIMIT 5")
def worst_cases(spark: SparkSession, sf: str) -> DataFrame:
    return evaluation.worst(_values(spark, sf), 5).select("case_id", "value")


@query("""SELECT o_custkey AS id, o_orderpriority AS label FROM (SELECT * FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 100) WHERE o_orderpriority = '1-URGENT' AND o_orderkey <> 7 ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 1""")
def previous_run(spark: SparkSession, sf: str) -> DataFrame:
    runs = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("created_at"), F.col("o_orderpriority").alias("label"), "o_custkey")
    return evaluation.previous_run(runs, "1-URGENT", "7").select(F.col("o_custkey").alias("id"), "label")


@query(f"""WITH {DOCS_SQL}, ids AS (SELECT doc_id // 10 AS case_id, doc_id AS pos, CASE doc_id % 4 WHEN 0 THEN file_name WHEN 1 THEN file_path WHEN 2 THEN 'd' || (doc_id - 2) ELSE 'unknown ' || (doc_id % 20) END AS id FROM docs),
  r AS (SELECT case_id, pos, coalesce('d' || x.doc_id, id) AS d FROM ids LEFT JOIN docs x ON id IN (x.file_name, x.file_path, 'd' || x.doc_id)), f AS (SELECT case_id, d, min(pos) AS pos FROM r GROUP BY case_id, d)
  SELECT case_id, string_agg(d, ',' ORDER BY pos) AS doc_ids FROM f GROUP BY case_id""")
def alias_normalise(spark: SparkSession, sf: str) -> DataFrame:
    docs = documents(spark, sf)
    name = lambda c: F.concat(F.lit("d"), c.cast("string"))
    d = F.col("doc_id")
    written = F.when(d % 4 == 0, F.col("file_name")).when(d % 4 == 1, F.col("file_path")).when(d % 4 == 2, name(d - 2)).otherwise(F.concat(F.lit("unknown "), (d % 20).cast("string")))
    ids = docs.select(F.floor(d / 10).alias("case_id"), d.alias("pos"), written.alias("id"))
    known = docs.select(name(d).alias("doc_id"), "file_name", "file_path", F.lit(0).alias("indexed_at"))
    return evaluation.resolved(ids, known).select("case_id", F.array_join("doc_ids", ",").alias("doc_ids"))


@query()
def approx_documents(spark: SparkSession, sf: str) -> DataFrame:
    return index.approx_documents(line_chunks(spark, sf))
