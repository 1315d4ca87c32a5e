"""Queries of retrieval and generation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions import acl
from docloom.functions.analysis import terms
from docloom.functions.vectors import cosine
from docloom.operators import filters, generation, lexicon, parents, retrieval, scoring, vector_index
from docloom.session import stored, table

from .base import AS_OF, CALLER, DOCS_SQL, EVERY, LINES_SQL, QUERIES_SQL, STOP_SQL, benchmark_queries, documents, line_chunks, query, terms_sql

# the SQL engine counts edits of bytes: one letter of ASCII stands for each accented one
_PLAIN = "translate(%s, 'áâäàçèéêëíîñóôöúûüß', 'ABCDEFGHIJKLMNOPQRS')"
_CALLER_SQL = "(" + ", ".join(f"'{p}'" for p in CALLER) + ")"


def _field_sql(p: str, text: str) -> str:
    """Postings of a field of the visible documents, lengths, totals and frequencies, under names that begin with p."""
    return f"""{p}post AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, {terms_sql(text)} AS term FROM docs WHERE principal IN {_CALLER_SQL}) WHERE term NOT IN {STOP_SQL} GROUP BY doc_id, term),
  {p}dl AS (SELECT doc_id, sum(tf) AS dl FROM {p}post GROUP BY doc_id), {p}tot AS (SELECT count(*) AS n, avg(dl) AS a FROM {p}dl), {p}df AS (SELECT term, count(*) AS df FROM {p}post GROUP BY term)"""


_IDF = "ln(1 + (n - df + 0.5) / (df + 0.5))"


def _match_sql(p: str, name: str, asked: str) -> str:
    """BM25 of a field for the terms (query_id, term, weight) of `asked`."""
    return f"""{name} AS (SELECT query_id, {p}post.doc_id AS doc_id, sum(weight * {_IDF} * tf / (tf + 1.2 * (0.25 + 0.75 * dl / a))) AS bm25
    FROM {p}post JOIN {asked} USING (term) JOIN {p}df USING (term) JOIN {p}dl USING (doc_id) CROSS JOIN {p}tot GROUP BY query_id, {p}post.doc_id)"""


_POST_SQL = _field_sql("", "text")
_TERMS_SQL = f"qt AS (SELECT DISTINCT query_id, term, 1.0 AS weight FROM (SELECT query_id, {terms_sql('query')} AS term FROM queries) WHERE term NOT IN {STOP_SQL})"
_BM25_SQL = f"{_POST_SQL}, {QUERIES_SQL}, {_TERMS_SQL}, {_match_sql('', 'bm', 'qt')}"


def _near_sql(p: str, name: str) -> str:
    """(term, match, distance) of the queries' terms and a field's terms within the edits."""
    d = f"damerau_levenshtein({_PLAIN % 'q.term'}, {_PLAIN % 'v.term'})"
    return f"""{name} AS (SELECT q.term, v.term AS match, {d}::INT AS distance FROM (SELECT DISTINCT term FROM qt) q JOIN (SELECT term FROM {p}df) v
    ON abs(length(q.term) - length(v.term)) <= CASE WHEN length(q.term) <= 2 THEN 0 WHEN length(q.term) <= 5 THEN 1 ELSE 2 END AND {d} <= CASE WHEN length(q.term) <= 2 THEN 0 WHEN length(q.term) <= 5 THEN 1 ELSE 2 END)"""


def _fuzzy_sql(p: str) -> str:
    weights = f"{p}fw AS (SELECT query_id, match AS term, sum(1 - distance / least(length(term), length(match))) AS weight FROM qt JOIN {p}near USING (term) GROUP BY query_id, match)"
    return f"{_near_sql(p, p + 'near')}, {weights}, {_match_sql(p, p + 'fz', p + 'fw')}"


def _list_sql(text: str) -> str:
    return f"list_filter(regexp_extract_all(lower({text}), '[\\p{{L}}\\p{{N}}]+'), lambda x: x NOT IN {STOP_SQL})"


def _phrase_sql(docs: str, phrases: str) -> str:
    """ph: query_id, doc_id, n, freq of the phrases (query_id, t: list of terms) in the documents (doc_id, text)."""
    return f"""dpos AS (SELECT doc_id, unnest(t) AS term, generate_subscripts(t, 1) - 1 AS pos FROM (SELECT doc_id, {_list_sql('text')} AS t FROM {docs})),
  qpos AS (SELECT query_id, len(t) AS nt, unnest(t) AS term, generate_subscripts(t, 1) - 1 AS i FROM {phrases}),
  met AS (SELECT query_id, nt, doc_id, i, pos, late, pos - i - late AS start FROM qpos JOIN dpos USING (term) CROSS JOIN (SELECT unnest([0, 1, 2]) AS late)),
  firsts AS (SELECT query_id, nt, doc_id, start, i, min(late) AS late FROM met GROUP BY ALL),
  occ AS (SELECT query_id, doc_id, start, max(late) AS late FROM firsts GROUP BY query_id, nt, doc_id, start HAVING count(*) = nt AND min(late) = 0 AND count(DISTINCT start + i + late) = nt),
  ph AS (SELECT query_id, doc_id, count(*) AS n, sum(1 / (1 + late)) AS freq FROM occ GROUP BY query_id, doc_id)"""


@query(f"WITH {DOCS_SQL} SELECT doc_id, principal FROM docs WHERE principal IN {_CALLER_SQL}")
def acl_visible_docs(spark: SparkSession, sf: str) -> DataFrame:
    return acl.visible(documents(spark, sf), CALLER).select("doc_id", F.element_at("acl_principals", 1).alias("principal"))


@query(f"WITH {DOCS_SQL} SELECT caller, count(*) AS n FROM docs JOIN (SELECT 'u' || n AS caller, unnest(['public', 'user:u' || n, 'group:' || CASE n % 2 WHEN 0 THEN 'en' ELSE 'fr' END]) AS p FROM (SELECT unnest([0, 1, 2, 3, 4]) AS n)) ON p = principal GROUP BY caller")
def acl_batch(spark: SparkSession, sf: str) -> DataFrame:
    callers = spark.range(5).select(F.concat(F.lit("u"), F.col("id").cast("string")).alias("caller"), F.array(F.when(F.col("id") % 2 == 0, "en").otherwise("fr")).alias("groups"))
    callers = callers.select("caller", acl.principals_of(F.col("caller"), F.col("groups"), F.array().cast("array<string>")).alias("principals"))
    return acl.visible_to_each(documents(spark, sf), callers, "doc_id").groupBy("caller").agg(F.count("*").alias("n"))


@query("""SELECT doc_id, regexp_replace(left(text, 20), '\\s+', ' ', 'g') = regexp_replace(left(text, 20), '\\s+', ' ', 'g') AS ok, CASE doc_id % 3 WHEN 0 THEN 'csv,xls,xlsm,xlsx' WHEN 1 THEN 'htm,html,pdf' ELSE '' END AS types,
  CASE doc_id % 2 WHEN 0 THEN DATE '2024-02-01' END AS date_from, DATE '2024-12-31' AS date_to FROM documents""")
def inline_filter_parse(spark: SparkSession, sf: str) -> DataFrame:
    types = F.when(F.col("doc_id") % 3 == 0, " filetype:excel").when(F.col("doc_id") % 3 == 1, " Type: web,pdf").otherwise("")
    dates = F.concat(F.when(F.col("doc_id") % 2 == 0, " after:2024-01-01 since:2024-02-01").otherwise(""), F.lit(" before:2024-12-31"))
    head = F.regexp_replace(F.left("text", F.lit(20)), r"\s+", " ")
    docs = table(spark, sf, "documents").select("doc_id", head.alias("head"), F.concat(head, types, dates).alias("q"))
    p = filters.parsed_query("q")
    return docs.select("doc_id", (p["term"] == F.trim("head")).alias("ok"), F.array_join(p["file_types"], ",").alias("types"), p["date_from"].alias("date_from"), p["date_to"].alias("date_to"))


@query("""WITH q AS (SELECT doc_id, left(text, length(text) // 2) || CASE doc_id % 3 WHEN 0 THEN ' filetype:excel,PDF ' WHEN 1 THEN ' Type: web,pdf ' ELSE ' ' END || substr(text, length(text) // 2 + 1)
    || CASE doc_id % 2 WHEN 0 THEN ' after:2024-01-01 since:2024-02-01' ELSE '' END || ' before:2024-12-31' AS q FROM documents),
  found AS (SELECT doc_id, q, list_filter(flatten(list_transform(regexp_extract_all(q, '(?i)\\b(?:filetype|type|ext)\\s*:\\s*([A-Za-z0-9,]+)', 1), lambda t: string_split(lower(t), ','))), lambda t: t <> '') AS named,
    regexp_extract_all(q, '(?i)\\b(?:after|since)\\s*:\\s*(\\d{4}-\\d{2}-\\d{2})', 1) AS since, regexp_extract_all(q, '(?i)\\b(?:before|until)\\s*:\\s*(\\d{4}-\\d{2}-\\d{2})', 1) AS until FROM q)
  SELECT doc_id, trim(regexp_replace(regexp_replace(q, '(?i)\\b(?:(?:filetype|type|ext)\\s*:\\s*[A-Za-z0-9,]+|(?:after|since|before|until)\\s*:\\s*\\d{4}-\\d{2}-\\d{2})', ' ', 'g'), '\\s+', ' ', 'g')) AS term,
    array_to_string(list_sort(list_distinct(flatten(list_transform(named, lambda t: CASE t WHEN 'excel' THEN ['xlsx', 'xls', 'xlsm', 'csv'] WHEN 'word' THEN ['docx', 'doc'] WHEN 'doc' THEN ['docx', 'doc'] WHEN 'web' THEN ['html', 'htm']
      WHEN 'ppt' THEN ['pptx', 'ppt'] WHEN 'text' THEN ['txt', 'md', 'markdown'] WHEN 'markdown' THEN ['md', 'markdown'] ELSE [t] END)))), ',') AS types, since[-1]::DATE AS date_from, until[-1]::DATE AS date_to FROM found""")
def inline_filter_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Whole texts as queries, with filters in their middle and at their end besides any of their own."""
    half = F.floor(F.length("text") / 2).cast("int")
    types = F.when(F.col("doc_id") % 3 == 0, " filetype:excel,PDF ").when(F.col("doc_id") % 3 == 1, " Type: web,pdf ").otherwise(" ")
    dates = F.concat(F.when(F.col("doc_id") % 2 == 0, " after:2024-01-01 since:2024-02-01").otherwise(""), F.lit(" before:2024-12-31"))
    q = F.concat(F.substring("text", F.lit(1), half), types, F.substring("text", half + 1, F.length("text")), dates)
    p = filters.parsed_query("q")
    return table(spark, sf, "documents").select("doc_id", q.alias("q")).select("doc_id", p["term"].alias("term"), F.array_join(p["file_types"], ",").alias("types"), p["date_from"].alias("date_from"), p["date_to"].alias("date_to"))


@query(f"WITH {DOCS_SQL} SELECT doc_id, document_type FROM docs WHERE document_type IN ('de', 'en') AND source NOT IN ('src0', 'src3')")
def file_type_filter(spark: SparkSession, sf: str) -> DataFrame:
    return documents(spark, sf).where(filters.of_types(F.col("document_type"), include=("en", "de"))).where(filters.of_types(F.col("source"), exclude=("src0", "src3"))).select("doc_id", "document_type")


@query("SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate >= TIMESTAMP '1995-03-01' AND o_orderdate < TIMESTAMP '1996-03-01'")
def date_range_filter(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").where(filters.in_dates(F.col("o_orderdate"), "1995-03-01", "1996-02-29")).select("o_orderkey", "o_orderdate")


@query("SELECT o_orderkey, round(pow(0.5, pow(abs(epoch(o_orderdate) - epoch(TIMESTAMP '1998-08-02')) / 86400.0 / 180.0, 2)), 6) AS decay FROM orders")
def time_decay_score(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select("o_orderkey", F.round(scoring.time_decay(F.col("o_orderdate").cast("timestamp"), F.lit("1998-08-02").cast("timestamp")), 6).alias("decay"))


@query(f"WITH {DOCS_SQL}, {_POST_SQL} SELECT term, count(*) AS df, sum(tf)::BIGINT AS tf FROM post GROUP BY term")
def term_postings(spark: SparkSession, sf: str) -> DataFrame:
    post = scoring.postings(acl.visible(documents(spark, sf), CALLER), "doc_id", "text")
    return post.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("tf"))


#: Indexes of the session, by folder and rows; a search reads the one that an earlier search has made.
_INDEXES: dict[tuple[str, str, str], lexicon.Lexicon] = {}


def _index(spark: SparkSession, sf: str, rows: str) -> lexicon.Lexicon:
    """The stored index of all documents' texts, or of the texts and names of those that CALLER sees."""
    key = (spark.sparkContext.applicationId, sf, rows)
    if key not in _INDEXES:
        if rows == "all":
            _INDEXES[key] = lexicon.session_index(table(spark, sf, "documents"), "doc_id", ("text",))
        else:
            _INDEXES[key] = lexicon.session_index(acl.visible(documents(spark, sf), CALLER), "doc_id", ("text", "file_name"))
    return _INDEXES[key]


def _benchmark_terms(spark: SparkSession, sf: str) -> DataFrame:
    return benchmark_queries(spark, sf).select("query_id", F.explode(terms("query")).alias("term"))


_TOP_SQL = f"WITH {DOCS_SQL}, {_BM25_SQL} SELECT query_id, doc_id, round(bm25, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(bm25, 9) DESC, doc_id) AS rank FROM bm) WHERE rank <= 10"


@query(_TOP_SQL)
def bm25_topk(spark: SparkSession, sf: str) -> DataFrame:
    best = _index(spark, sf, "visible").bm25_best(_benchmark_terms(spark, sf), "text", 10)
    return best.select("query_id", "doc_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query(_TOP_SQL)
def bm25_early_topk(spark: SparkSession, sf: str) -> DataFrame:
    """The same, from groups of documents whose bounds come up to the k-th score."""
    best, _ = _index(spark, sf, "visible").top_k(_benchmark_terms(spark, sf), "text", 10)
    return best.select("query_id", "doc_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query(f"WITH {DOCS_SQL}, {_BM25_SQL} SELECT query_id, count(*) AS postings, true AS fewer FROM post JOIN qt USING (term) GROUP BY query_id")
def bm25_early_reads(spark: SparkSession, sf: str) -> DataFrame:
    """Postings of the queries' terms, and whether the early search read no more than those."""
    _, counts = _index(spark, sf, "visible").top_k(_benchmark_terms(spark, sf), "text", 10)
    return counts.select("query_id", "postings", (F.col("read") <= F.col("postings")).alias("fewer"))


@query(f"""{_TOP_SQL.replace('SELECT query_id, doc_id, round(bm25, 6) AS score, rank FROM', ', top AS (SELECT query_id, doc_id, rank FROM', 1)}),
  wanted AS (SELECT DISTINCT item_id AS case_id, doc_id FROM benchmark JOIN documents ON doc_id % 41 = item_id % 41), sizes AS (SELECT case_id, count(*) AS n FROM wanted GROUP BY case_id),
  hit AS (SELECT t.query_id AS case_id, t.rank AS r, w.doc_id IS NOT NULL AS good FROM top t LEFT JOIN wanted w ON w.case_id = t.query_id AND w.doc_id = t.doc_id),
  m AS (SELECT s.case_id, round(count(*) FILTER (WHERE good AND r <= 3) / any_value(n), 4) AS r3, round(count(*) FILTER (WHERE good) / any_value(n), 4) AS r10,
    round(coalesce(count(*) FILTER (WHERE good AND r <= 3) / nullif(count(r) FILTER (WHERE r <= 3), 0), 0.0), 4) AS p3, round(coalesce(count(*) FILTER (WHERE good) / nullif(count(r), 0), 0.0), 4) AS p10,
    round(coalesce(1.0 / min(CASE WHEN good THEN r END), 0.0), 4) AS mrr FROM sizes s LEFT JOIN hit h ON h.case_id = s.case_id GROUP BY s.case_id)
SELECT case_id, unnest(['recall@3', 'recall@10', 'precision@3', 'precision@10', 'mrr']) AS metric, unnest([r3, r10, p3, p10, mrr]) AS value FROM m""")
def run_cases_retrieved(spark: SparkSession, sf: str) -> DataFrame:
    """Items as cases, evaluated by what the index finds for them; expected are file names."""
    docs = documents(spark, sf)
    known = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "file_name", "file_path", F.lit(0).alias("indexed_at"))
    best, _ = _index(spark, sf, "visible").top_k(_benchmark_terms(spark, sf), "text", 10)
    found = best.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("doc_id").cast("string").alias("doc_id"))
    wanted = docs.select("file_name", (F.col("doc_id") % 41).alias("m")).join(F.broadcast(table(spark, sf, "benchmark").select(F.col("item_id").alias("case_id"), (F.col("item_id") % 41).alias("m"))), "m")
    cases = wanted.groupBy("case_id").agg(F.collect_set("file_name").alias("expected_docs"))
    return retrieval.run_cases(cases, found, known, (3, 10)).where(~F.col("metric").startswith("ndcg")).select("case_id", "metric", "value")


_RENEWED_SQL = """renewed AS (SELECT doc_id, CASE doc_id % 100 WHEN 7 THEN 'edited ' || text ELSE text END AS text FROM documents WHERE doc_id % 100 <> 13)"""


@query(f"""WITH {_RENEWED_SQL}, t AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, {terms_sql('text')} AS term FROM renewed) WHERE term NOT IN {STOP_SQL} GROUP BY doc_id, term)
  SELECT term, count(*) AS df, sum(tf)::BIGINT AS tf FROM t GROUP BY term""")
def index_renewed(spark: SparkSession, sf: str) -> DataFrame:
    """Terms of an index after an upsert of one document in a hundred, a delete of another, and a merge of its segments."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    index = lexicon.session_index(docs, "doc_id", ("text",))
    index = index.add(docs.where("doc_id % 100 = 7").withColumn("text", F.concat(F.lit("edited "), "text")))
    index = index.remove(docs.where("doc_id % 100 = 13")).merged()
    return index.postings("text").groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("tf"))


@query(f"WITH {DOCS_SQL}, {_POST_SQL}, {QUERIES_SQL}, {_TERMS_SQL}, {_near_sql('', 'near')} SELECT query_id, term, match, distance FROM qt JOIN near USING (term)")
def fuzzy_terms(spark: SparkSession, sf: str) -> DataFrame:
    return _index(spark, sf, "visible").fuzzy_terms(_benchmark_terms(spark, sf), "text")


_TRIPLES_SQL = f"trip AS (SELECT item_id * 10000 + k AS query_id, t[k:k + 2] AS t FROM (SELECT item_id, t, unnest(generate_series(1, len(t) - 2)) AS k FROM (SELECT item_id, {_list_sql('text')} AS t FROM benchmark)))"


@query(f"WITH {_TRIPLES_SQL}, {_phrase_sql('documents', 'trip')} SELECT query_id, doc_id, n, round(freq, 6) AS freq FROM ph")
def phrase_slop(spark: SparkSession, sf: str) -> DataFrame:
    """All runs of three terms of all items as phrases."""
    t = table(spark, sf, "benchmark").select("item_id", terms("text").alias("t")).where("size(t) > 2").select("item_id", "t", F.explode(F.sequence(F.lit(1), F.size("t") - 2)).alias("k"))
    phrases = t.select((F.col("item_id") * 10000 + F.col("k")).alias("query_id"), F.array_join(F.slice("t", F.col("k"), 3), " ").alias("query"))
    return _index(spark, sf, "all").phrases(phrases, "text").select("query_id", "doc_id", "n", F.round("freq", 6).alias("freq"))


@query(f"WITH {DOCS_SQL} SELECT doc_id, file_name FROM docs WHERE file_name ILIKE '%SRC1%' OR file_path ILIKE '%SRC1%'")
def filename_match(spark: SparkSession, sf: str) -> DataFrame:
    return documents(spark, sf).where(filters.like_keyword("SRC1", F.col("file_name"), F.col("file_path"))).select("doc_id", "file_name")


def _cos_sql(a: str, b: str) -> str:
    d = lambda x, y: f"list_sum(list_transform(list_zip({x}, {y}), lambda p: p[1]::DOUBLE * p[2]::DOUBLE))"
    return f"({d(a, b)} / (sqrt({d(a, a)}) * sqrt({d(b, b)})))"


def _knn_sql(where: str = "") -> str:
    return f"""s AS (SELECT q.vec_id AS query_id, v.vec_id, {_cos_sql('q.embedding', 'v.embedding')} AS c FROM embeddings q JOIN embeddings v ON q.vec_id % {EVERY} = 0 {where}),
  k AS (SELECT query_id, vec_id, c, row_number() OVER (PARTITION BY query_id ORDER BY round(c, 9) DESC, vec_id) AS rank FROM s)"""


def _vectors(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    e = table(spark, sf, "embeddings")
    return e.where(F.col("vec_id") % EVERY == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qvec")), e.select("vec_id", F.col("embedding").alias("vec"), "label")


@query(f"WITH {_knn_sql()} SELECT query_id, vec_id, round(c, 6) AS similarity, rank FROM k WHERE rank <= 10")
def knn_topk(spark: SparkSession, sf: str) -> DataFrame:
    q, v = _vectors(spark, sf)
    return _rounded(scoring.knn(q, v, "vec_id", 10))


def _rounded(found: DataFrame) -> DataFrame:
    return found.select("query_id", "vec_id", F.round("similarity", 6).alias("similarity"), F.col("rank").cast("long").alias("rank"))


@query(f"WITH {_knn_sql()} SELECT query_id, vec_id, round(c, 6) AS similarity, rank FROM k WHERE rank <= 10")
def knn_native(spark: SparkSession, sf: str) -> DataFrame:
    q, v = _vectors(spark, sf)
    return _rounded(scoring.knn_native(q, v, "vec_id", 10))


_TIES_SQL = f"""t AS (SELECT vec_id * 3 + k AS vec_id, embedding FROM (SELECT vec_id, embedding, unnest([0, 1, 2]) AS k FROM embeddings) UNION ALL SELECT vec_id * -1 - 1, embedding[1:60] FROM embeddings UNION ALL SELECT vec_id * -1 - 1000000, NULL FROM embeddings),
  s AS (SELECT q.vec_id AS query_id, v.vec_id, {_cos_sql('q.embedding', 'v.embedding')} AS c FROM embeddings q JOIN t v ON q.vec_id % {EVERY} = 0 AND len(v.embedding) = len(q.embedding))"""


@query(f"WITH {_TIES_SQL} SELECT query_id, vec_id, round(c, 6) AS similarity, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(c, 9) DESC, vec_id) AS rank FROM s) WHERE rank <= 10")
def knn_ties(spark: SparkSession, sf: str) -> DataFrame:
    """Every vector three times, so that ranks are full of ties, besides shorter vectors and nulls."""
    q, v = _vectors(spark, sf)
    again = v.select("vec_id", "vec", F.explode(F.array(*map(F.lit, (2, 0, 1)))).alias("k")).select((F.col("vec_id") * 3 + F.col("k")).alias("vec_id"), "vec")
    short = v.select((-F.col("vec_id") - 1).alias("vec_id"), F.slice("vec", 1, 60).alias("vec"))
    none = v.select((-F.col("vec_id") - 1000000).alias("vec_id"), F.lit(None).cast("array<float>").alias("vec"))
    return _rounded(scoring.knn(q, again.unionByName(short).unionByName(none), "vec_id", 10))


@query(f"WITH {_knn_sql('AND v.label IN (1, 3, 5)')} SELECT query_id, vec_id, round(c, 6) AS similarity, rank FROM k WHERE rank <= 10")
def knn_prefilter_acl(spark: SparkSession, sf: str) -> DataFrame:
    """The filter comes before the top-k, so each query has all its neighbours from what may be seen."""
    q, v = _vectors(spark, sf)
    return _rounded(scoring.knn(q, v.where(F.col("label").isin(1, 3, 5)), "vec_id", 10))


_VECTORS: dict[tuple[str, str], vector_index.VectorIndex] = {}


def _vector_index(spark: SparkSession, sf: str) -> vector_index.VectorIndex:
    """The stored index of all vectors, their labels as principals."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _VECTORS:
        rows = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").alias("vec"), F.array(F.col("label").cast("string")).alias("acl_principals"), F.lit("md").alias("document_type"), F.lit(0.0).alias("seconds"))
        _VECTORS[key] = vector_index.session_index(rows, "vec_id")
    return _VECTORS[key]


def _label_queries(spark: SparkSession, sf: str) -> DataFrame:
    """Every 50th vector, each asking among two labels of its own."""
    n = F.col("vec_id")
    may = F.array((n % 7).cast("string"), ((n + 3) % 10).cast("string"))
    return table(spark, sf, "embeddings").where(n % EVERY == 0).select(
        n.alias("query_id"), F.col("embedding").alias("qvec"), may.alias("_principals"), F.array().cast("array<string>").alias("_file_types"), F.lit(None).cast("date").alias("_date_from"), F.lit(None).cast("date").alias("_date_to"),
    )


_OWN_LABELS = "AND v.label::VARCHAR IN ((q.vec_id % 7)::VARCHAR, ((q.vec_id + 3) % 10)::VARCHAR)"


@query(f"WITH {_knn_sql(_OWN_LABELS)} SELECT query_id, vec_id, round(c, 6) AS similarity, rank FROM k WHERE rank <= 10")
def ann_exact_topk(spark: SparkSession, sf: str) -> DataFrame:
    """The index of vectors with all of its lists, each query with rights of its own."""
    index = _vector_index(spark, sf)
    return _rounded(index.search(_label_queries(spark, sf), 10, len(index.centres)))


@query(f"WITH {_knn_sql(_OWN_LABELS)} SELECT query_id, count(*) AS n, true AS audited FROM k WHERE rank <= 10 GROUP BY query_id")
def ann_topk(spark: SparkSession, sf: str) -> DataFrame:
    """As many of the nearest lists as the audit asked for: each query gets as many vectors as exact search has, and the recall that the index was made with is enough."""
    index = _vector_index(spark, sf)
    found = index.search(_label_queries(spark, sf), 10)
    return found.groupBy("query_id").agg(F.count("*").alias("n")).withColumn("audited", F.lit(index.content["recall"] >= vector_index.RECALL))


_ASKS_NEW = " OR ".join(f"contains(lower(query), '{w}')" for w in scoring.RECENCY_WORDS)
_NAMED_SQL = "queries AS (SELECT item_id AS query_id, text || ' src' || (item_id % 5) || CASE item_id % 3 WHEN 0 THEN ' latest' ELSE '' END AS query FROM benchmark)"


def _hybrid_sql(lexical: bool, vector: bool, k: int = 10) -> str:
    values = [f"SELECT query_id, doc_id, CASE WHEN {_ASKS_NEW} THEN 2 ELSE 1 END * pow(0.5, pow((doc_id % 400) / 180.0, 2)) AS value FROM queries CROSS JOIN docs WHERE principal IN {_CALLER_SQL}"]
    ctes = [DOCS_SQL, _NAMED_SQL, _TERMS_SQL]
    if lexical:
        ctes += [_field_sql("", "text"), _match_sql("", "bm", "qt"), _fuzzy_sql(""), _field_sql("f", "file_name"), _match_sql("f", "fbm", "qt"), _fuzzy_sql("f")]
        ctes += [f"vis AS (SELECT doc_id, text FROM docs WHERE principal IN {_CALLER_SQL})", f"asked AS (SELECT query_id, {_list_sql('query')} AS t FROM queries)", _phrase_sql("vis", "asked")]
        ctes += [f"pidf AS (SELECT query_id, sum({_IDF}) AS idf FROM (SELECT query_id, unnest(t) AS term FROM asked) JOIN df USING (term) CROSS JOIN tot GROUP BY query_id)"]
        ctes += ["pb AS (SELECT query_id, ph.doc_id AS doc_id, idf * freq / (freq + 1.2 * (0.25 + 0.75 * dl / a)) AS bm25 FROM ph JOIN dl USING (doc_id) JOIN pidf USING (query_id) CROSS JOIN tot)"]
        values += [f"SELECT query_id, doc_id, {w} * bm25 FROM {t}" for t, w in (("bm", 1.0), ("fz", 0.5), ("pb", 1.5), ("fbm", 2.0), ("ffz", 1.0))]
    if vector:
        ctes += [f"""s AS (SELECT q.vec_id AS query_id, v.vec_id AS doc_id, {_cos_sql('q.embedding', 'v.embedding')} AS c FROM embeddings q JOIN queries ON query_id = q.vec_id CROSS JOIN embeddings v JOIN docs ON docs.doc_id = v.vec_id AND principal IN {_CALLER_SQL}),
  kk AS (SELECT query_id, doc_id, (1 + c) / 2 AS value FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(c, 9) DESC, doc_id) AS r FROM s) WHERE r <= {k})"""]
        values += ["SELECT query_id, doc_id, value FROM kk"]
    total = f"f AS (SELECT query_id, doc_id, round(sum(value), 9) AS score FROM ({' UNION ALL '.join(values)}) GROUP BY query_id, doc_id)"
    top = "top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM f)"
    return f"""WITH {', '.join([*ctes, total, top])} SELECT query_id, doc_id, round(score, 6) AS score, round(score / max(score) OVER (PARTITION BY query_id), 6) AS normalized_score, rank FROM top WHERE rank <= {k}"""


def _named_queries(spark: SparkSession, sf: str) -> DataFrame:
    """Items as queries that name a source, so that file names match; every third asks for what is new. Those whose id is a vector's have that vector."""
    name = F.concat("text", F.lit(" src"), (F.col("item_id") % 5).cast("string"), F.when(F.col("item_id") % 3 == 0, " latest").otherwise(""))
    items = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), name.alias("query"))
    return items.join(table(spark, sf, "embeddings").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qvec")), "query_id", "left")


def _dated(spark: SparkSession, sf: str) -> DataFrame:
    """Visible documents with dates and vectors: that with their id, if there is one."""
    date = F.timestamp_seconds(F.unix_timestamp(F.lit(AS_OF).cast("timestamp")) - (F.col("doc_id") % 400) * 86400)
    docs = acl.visible(documents(spark, sf), CALLER).select("doc_id", "text", "file_name", date.alias("last_modified_date"))
    return docs.join(table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vec")), "doc_id", "left")


def _hybrid(spark: SparkSession, sf: str, mode: str) -> DataFrame:
    index = None if mode == "semantic_only" else _index(spark, sf, "visible")
    found = retrieval.hybrid(_named_queries(spark, sf), stored(_dated(spark, sf), "rows"), "doc_id", F.lit(AS_OF).cast("timestamp"), 10, mode, index=index)
    return scoring.normalised(found).select("query_id", "doc_id", F.round("score", 6).alias("score"), "normalized_score", F.col("rank").cast("long").alias("rank"))


@query(_hybrid_sql(True, True))
def hybrid_topk(spark: SparkSession, sf: str) -> DataFrame:
    """Words, words with typing errors, phrases, file names, vectors and time decay."""
    return _hybrid(spark, sf, "hybrid")


@query(_hybrid_sql(True, False))
def keyword_only_topk(spark: SparkSession, sf: str) -> DataFrame:
    return _hybrid(spark, sf, "keyword_only")


@query(_hybrid_sql(False, True))
def semantic_only_topk(spark: SparkSession, sf: str) -> DataFrame:
    return _hybrid(spark, sf, "semantic_only")


_CALLERS_SQL = f"""asking AS (SELECT item_id * 100 + n AS query_id, item_id, text || ' src' || (item_id % 5) AS query, n AS caller, CASE n % 3 WHEN 0 THEN ['en', 'de'] WHEN 1 THEN ['fr', 'en'] ELSE ['de', 'en', 'es', 'fr'] END AS kinds, n % 3 = 2 AS any_kind,
    DATE '2023-02-01' + (item_id * 7 % 300)::INT AS low, CASE n % 2 WHEN 0 THEN DATE '2023-02-01' + (item_id * 7 % 300 + 30 + n)::INT END AS high FROM benchmark, range(26) r(n)),
  queries AS (SELECT item_id AS query_id, text || ' src' || (item_id % 5) AS query FROM benchmark), every AS (SELECT * EXCLUDE (principal), list(principal) AS principals FROM docs GROUP BY ALL)"""


def _callers_sql(k: int = 10) -> str:
    docs = DOCS_SQL
    fields = [f.replace(f"FROM docs WHERE principal IN {_CALLER_SQL}", "FROM every") for f in (_field_sql("", "text"), _field_sql("f", "file_name"))]
    may = """list_has_any(principals, ['public', 'user:u' || (caller % 10), 'group:' || CASE caller % 2 WHEN 0 THEN 'en' ELSE 'fr' END]) AND (any_kind OR list_contains(kinds, document_type))
    AND day >= low AND (high IS NULL OR day < high + INTERVAL 1 DAY)"""
    ctes = [docs, _CALLERS_SQL, _TERMS_SQL, fields[0], _match_sql("", "bm", "qt"), _fuzzy_sql(""), fields[1], _match_sql("f", "fbm", "qt"), _fuzzy_sql("f")]
    ctes += [f"asked AS (SELECT query_id, {_list_sql('query')} AS t FROM queries)", _phrase_sql("every", "asked")]
    ctes += [f"pidf AS (SELECT query_id, sum({_IDF}) AS idf FROM (SELECT query_id, unnest(t) AS term FROM asked) JOIN df USING (term) CROSS JOIN tot GROUP BY query_id)"]
    ctes += ["pb AS (SELECT query_id, ph.doc_id AS doc_id, idf * freq / (freq + 1.2 * (0.25 + 0.75 * dl / a)) AS bm25 FROM ph JOIN dl USING (doc_id) JOIN pidf USING (query_id) CROSS JOIN tot)"]
    words = " UNION ALL ".join(f"SELECT query_id, doc_id, {w} * bm25 AS value FROM {t}" for t, w in (("bm", 1.0), ("fz", 0.5), ("pb", 1.5), ("fbm", 2.0), ("ffz", 1.0)))
    ctes += [f"words AS (SELECT query_id AS item_id, doc_id, sum(value) AS value FROM ({words}) GROUP BY ALL)"]
    ctes += [f"dated AS (SELECT *, TIMESTAMP '{AS_OF}' - to_days((doc_id % 400)::INT) AS day, pow(0.5, pow((doc_id % 400) / 180.0, 2)) AS decay FROM every)"]
    ctes += [f"seen AS (SELECT a.query_id, a.item_id, d.doc_id, d.decay FROM asking a JOIN dated d ON {may})"]
    ctes += [f"""s AS (SELECT q.query_id, q.doc_id, {_cos_sql('e.embedding', 'v.embedding')} AS c FROM seen q JOIN embeddings e ON e.vec_id = q.item_id JOIN embeddings v ON v.vec_id = q.doc_id)"""]
    ctes += [f"kk AS (SELECT query_id, doc_id, (1 + c) / 2 AS value FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(c, 9) DESC, doc_id) AS r FROM s) WHERE r <= {k})"]
    score = "round(coalesce(w.value, 0) + coalesce(kk.value, 0) + q.decay, 9)"
    return f"""WITH {', '.join(ctes)}, f AS (SELECT q.query_id, q.doc_id, {score} AS score FROM seen q LEFT JOIN words w ON w.item_id = q.item_id AND w.doc_id = q.doc_id LEFT JOIN kk ON kk.query_id = q.query_id AND kk.doc_id = q.doc_id)
SELECT query_id, doc_id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM f) WHERE rank <= {k}"""


@query(_callers_sql())
def callers_topk(spark: SparkSession, sf: str) -> DataFrame:
    """Every item asked by 26 callers with their own principals, kinds of documents and dates, more than a thousand different sets, in one plan: words, typing errors, phrases, names, vectors and time decay."""
    n = F.col("caller")
    day = F.expr("date_add(DATE '2023-02-01', CAST(item_id * 7 % 300 AS INT))")
    asking = table(spark, sf, "benchmark").select("item_id", "text", F.explode(F.sequence(F.lit(0), F.lit(25))).alias("caller")).select(
        (F.col("item_id") * 100 + n).alias("query_id"), "item_id", F.concat("text", F.lit(" src"), (F.col("item_id") % 5).cast("string")).alias("query"),
        F.array(F.lit("public"), F.concat(F.lit("user:u"), (n % 10).cast("string")), F.when(n % 2 == 0, "group:en").otherwise("group:fr")).alias("_principals"),
        F.when(n % 3 == 0, F.array(F.lit("en"), F.lit("de"))).when(n % 3 == 1, F.array(F.lit("fr"), F.lit("en"))).otherwise(F.array().cast("array<string>")).alias("_file_types"),
        day.alias("_date_from"), F.when(n % 2 == 0, F.date_add(day, (F.lit(30) + n).cast("int"))).alias("_date_to"),
    )
    vectors = table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vec"))
    asking = asking.join(vectors.select(F.col("doc_id").alias("item_id"), F.col("vec").alias("qvec")), "item_id", "left").drop("item_id")
    date = F.timestamp_seconds(F.unix_timestamp(F.lit(AS_OF).cast("timestamp")) - (F.col("doc_id") % 400) * 86400)
    rows = documents(spark, sf).select("doc_id", "text", "file_name", "document_type", "acl_principals", date.alias("last_modified_date")).join(vectors, "doc_id", "left")
    found = retrieval.hybrid(stored(asking, "asking"), stored(rows, "rows"), "doc_id", F.lit(AS_OF).cast("timestamp"), 10)
    return found.select("query_id", "doc_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query("SELECT user_id AS query_id, event_id, round(value / CASE WHEN max(value) OVER (PARTITION BY user_id) > 0 THEN max(value) OVER (PARTITION BY user_id) ELSE 1.0 END, 6) AS normalized_score FROM events")
def normalize_scores(spark: SparkSession, sf: str) -> DataFrame:
    return scoring.normalised(table(spark, sf, "events").select(F.col("user_id").alias("query_id"), "event_id", F.col("value").alias("score"))).select("query_id", "event_id", "normalized_score")


def _turns(spark: SparkSession, sf: str) -> DataFrame:
    """Turns as candidates: of each conversation, in the order of turns."""
    return table(spark, sf, "conversations").select(
        F.col("conv_id").alias("query_id"), F.col("turn").alias("rank"), F.col("text").alias("snippet"), F.concat(F.lit("turn"), F.col("turn").cast("string"), F.lit(".md")).alias("file_name"),
        F.lit("http://t").alias("file_url"), F.col("role").alias("header1"), F.lit("").alias("header2"), (F.col("turn") + 1).cast("int").alias("page_no"),
        F.first("text").over(_conv()).alias("query"), F.round(1.0 / (F.col("turn") + 1), 6).alias("normalized_score"), F.lit(None).cast("double").alias("rerank_score"),
    )


def _conv():
    from pyspark.sql import Window

    return Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)


_T = f"(list_distinct(list_filter(regexp_extract_all(lower(%s), '[\\p{{L}}\\p{{N}}]+'), lambda x: x NOT IN {STOP_SQL})))"


@query(f"""WITH t AS (SELECT conv_id AS query_id, turn, text, first_value(text) OVER (PARTITION BY conv_id ORDER BY turn) AS q FROM conversations),
  r AS (SELECT query_id, turn, CASE WHEN len({_T % 'q'}) > 0 THEN len(list_intersect({_T % 'q'}, {_T % 'text'})) / len({_T % 'q'}) ELSE 0.0 END AS s FROM t)
  SELECT query_id, turn, round(s, 6) AS rerank_score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, turn) AS rank FROM r) WHERE rank <= 3""")
def overlap_rerank(spark: SparkSession, sf: str) -> DataFrame:
    rows = _turns(spark, sf).withColumn("turn", F.col("rank"))
    return scoring.rerank(rows, 3).select("query_id", "turn", F.round("rerank_score", 6).alias("rerank_score"), F.col("rank").cast("long").alias("rank"))


@query("""WITH h AS (SELECT l_orderkey AS query_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber) AS rank, l_suppkey % 3 AS p, l_linenumber, l_extendedprice AS score, CASE WHEN l_quantity > 25 THEN l_quantity ELSE 0 END AS rr FROM lineitem),
  b AS (SELECT *, row_number() OVER (PARTITION BY query_id, p ORDER BY CASE WHEN rr <> 0 THEN rr ELSE score END DESC, rank) AS n, min(rank) OVER (PARTITION BY query_id, p) AS f FROM h)
  SELECT query_id, p AS doc_id, l_linenumber, parent_rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY f) AS parent_rank FROM b WHERE n = 1) WHERE parent_rank <= 2""")
def parent_dedup(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window

    order = Window.partitionBy("l_orderkey").orderBy(F.desc("l_extendedprice"), "l_linenumber")
    hits = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("query_id"), F.row_number().over(order).alias("rank"), (F.col("l_suppkey") % 3).alias("doc_id"), F.lit(0).alias("section_id"), F.lit(0).alias("context_id"),
        "l_linenumber", F.col("l_extendedprice").alias("score"), F.when(F.col("l_quantity") > 25, F.col("l_quantity")).otherwise(0.0).alias("rerank_score"),
    )
    return parents.distinct_parents(hits, 2).select("query_id", "doc_id", "l_linenumber", F.col("parent_rank").cast("long").alias("parent_rank"))


@query(f"""WITH {DOCS_SQL}, {LINES_SQL}, c AS (SELECT doc_id, chunk_index, chunk_index // 5 AS ctx, regexp_replace(snippet, '^\\s+|\\s+$', '', 'g') AS s, snippet FROM lines),
  n AS (SELECT doc_id, ctx, count(*) AS n FROM c GROUP BY doc_id, ctx), h AS (SELECT doc_id, chunk_index AS at, ctx, snippet AS own FROM c)
  SELECT h.doc_id, h.at AS chunk_index, CASE WHEN n.n > 1 THEN coalesce(string_agg(CASE WHEN c.s <> '' THEN c.s END, chr(10) ORDER BY c.chunk_index), '') ELSE any_value(own) END AS snippet,
    CASE WHEN n.n > 1 THEN min(c.chunk_index) + 1 ELSE h.at + 1 END AS page_no, n.n > 1 AS is_parent
  FROM h JOIN n USING (doc_id, ctx) JOIN c ON c.doc_id = h.doc_id AND c.ctx = h.ctx AND abs(c.chunk_index - h.at) <= 1 GROUP BY h.doc_id, h.at, n.n""")
def sibling_window_rejoin(spark: SparkSession, sf: str) -> DataFrame:
    chunks = line_chunks(spark, sf)
    hits = chunks.select(F.lit(0).alias("query_id"), *parents.PARENT, "chunk_index", "page_no", "snippet")
    return parents.passages(hits, chunks, 1).select("doc_id", F.col("chunk_index").cast("long").alias("chunk_index"), "snippet", F.col("page_no").cast("long").alias("page_no"), "is_parent")


_COST = "(CASE WHEN length(text) = 0 THEN 0 ELSE greatest(1, trunc(length(left(text, 400)) / 3.5)::INT) END + 30)"


@query(f"""WITH t AS (SELECT conv_id AS query_id, turn, {_COST} AS cost, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n, sum({_COST}) OVER (PARTITION BY conv_id ORDER BY turn) AS upto FROM conversations)
  SELECT query_id, turn, cost::INT AS cost FROM t WHERE n = 1 OR upto <= 500""")
def pack_budget(spark: SparkSession, sf: str) -> DataFrame:
    return generation.packed(_turns(spark, sf), 1000, 400).select("query_id", F.col("rank").alias("turn"), "cost")


@query("""WITH t AS (SELECT conv_id AS query_id, turn, '[' || row_number() OVER (PARTITION BY conv_id ORDER BY turn) || '] turn' || turn || '.md' || chr(10) || 'Location: ' || role || ' · p.' || (turn + 1) || chr(10) || 'Content:' || chr(10) || CASE WHEN length(text) > 120 THEN left(text, 120) || '…' ELSE text END AS line FROM conversations)
  SELECT query_id, string_agg(line, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY turn) AS context FROM t GROUP BY query_id""")
def context_block(spark: SparkSession, sf: str) -> DataFrame:
    return generation.context_blocks(_turns(spark, sf), 120)


def _answers(spark: SparkSession, sf: str) -> DataFrame:
    """Turns with citations put in: one of every number, a pair, one out of range, one repeated."""
    number = F.concat(F.lit(" ["), (F.col("turn") % 4 + 1).cast("string"), F.lit("]"))
    return table(spark, sf, "conversations").select("conv_id", "turn", F.concat("text", number, F.lit(" and [2, 1] or [9] and"), number).alias("answer"))


@query("""SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN '1,2' WHEN 1 THEN '2,1' WHEN 2 THEN '3,2,1' ELSE '2,1' END AS cited FROM conversations""")
def parse_citations(spark: SparkSession, sf: str) -> DataFrame:
    return _answers(spark, sf).select("conv_id", "turn", F.array_join(generation.citations(F.col("answer"), F.lit(3)), ",").alias("cited"))


@query("""SELECT conv_id AS query_id, turn, 'turn' || turn || '.md' AS file_name, left(text, 500) AS snippet, round(1.0 / (turn + 1), 4) AS score FROM conversations WHERE turn IN (1, 2)""")
def build_sources(spark: SparkSession, sf: str) -> DataFrame:
    answers = table(spark, sf, "conversations").groupBy(F.col("conv_id").alias("query_id")).agg(F.lit("yes [2] and [1, 2] and [77]").alias("answer")).withColumn("cited", generation.citations(F.col("answer"), F.lit(9)))
    found = generation.sources(answers.withColumn("cited", F.transform("cited", lambda c: c.cast("long"))), _turns(spark, sf))
    return found.select("query_id", F.col("rank").alias("turn"), "file_name", "snippet", "score")


@query(f"""SELECT a.vec_id AS query_id, round(max({_cos_sql('a.embedding', 'b.embedding')}), 4) + 0 AS support, max({_cos_sql('a.embedding', 'b.embedding')}) < 0.45 AS weak FROM embeddings a JOIN embeddings b ON b.vec_id IN (a.vec_id + 1, a.vec_id + 2) GROUP BY a.vec_id""")
def attribution_support(spark: SparkSession, sf: str) -> DataFrame:
    """Each vector as a sentence that cites the next two."""
    e = table(spark, sf, "embeddings")
    cited = e.select(F.col("vec_id").alias("query_id"), F.lit(0).alias("sentence_no"), F.explode(F.array(F.lit(1), F.lit(2))).alias("rank"))
    own = e.select(F.col("vec_id").alias("query_id"), F.lit(0).alias("sentence_no"), F.col("embedding").alias("vec"))
    other = e.select(F.explode(F.array(F.lit(1), F.lit(2))).alias("rank"), "vec_id", F.col("embedding").alias("vec")).select((F.col("vec_id") - F.col("rank")).alias("query_id"), "rank", "vec")
    return generation.support(cited, own, other, 0.45).select("query_id", "support", "weak")


@query("""WITH k AS (SELECT conv_id, turn, role || ': ' || left(text, 500) AS line, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations WHERE role IN ('user', 'assistant'))
  SELECT conv_id AS session_id, string_agg(line, chr(10) ORDER BY turn) AS transcript FROM k WHERE n <= 6 GROUP BY conv_id""")
def rewrite_transcript(spark: SparkSession, sf: str) -> DataFrame:
    turns = table(spark, sf, "conversations").select(F.col("conv_id").alias("session_id"), F.col("turn").alias("seq"), "role", F.col("text").alias("content"))
    return generation.rewrite_transcript(turns)


@query("""SELECT conv_id, len(h) AS n_history, h[1] AS first_old FROM (SELECT conv_id, list_reverse(list_reverse(array_agg(text ORDER BY turn))[1:6]) AS h FROM conversations GROUP BY conv_id)""")
def assembled_messages(spark: SparkSession, sf: str) -> DataFrame:
    h = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))), lambda x: F.struct(x["role"].alias("role"), x["text"].alias("content")))
    rows = table(spark, sf, "conversations").groupBy("conv_id").agg(h.alias("h"))
    m = generation.assembled(F.col("h"), "Answer from the material.", F.lit("question"))
    return rows.select("conv_id", (F.size(m) - 2).cast("long").alias("n_history"), F.element_at(m, 2)["content"].alias("first_old"))


@query(f"SELECT vec_id, round({_cos_sql('embedding', 'list_reverse(embedding)')}, 6) AS c FROM embeddings")
def cosine_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select("vec_id", F.round(cosine(F.col("embedding"), F.reverse("embedding")), 6).alias("c"))
