"""Queries over the chunker, on texts made of order lines so that SQL can say what its chunks are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.operators import chunking, index, parents
from docloom.session import table

from .base import query

#: Pieces of four rows, or of two lines: sizes count lines, and tables have pieces twice as large.
_BY_LINES = chunking.ChunkOptions(chunk_size=2, context_size=20, size="lines")


def _joined(order: str, line: str, gap: str = "\n") -> Column:
    return F.array_join(F.sort_array(F.collect_list(F.struct(order, line)))[line], gap)


def _numbered(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window

    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_returnflag", "l_quantity")
    return table(spark, sf, "lineitem").withColumn("n", F.row_number().over(order))


_ROWS_SQL = "SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_returnflag, l_quantity) AS n FROM lineitem"


def _table_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """The lines of each order as a table that is chunked."""
    row = F.concat(F.lit("| "), F.col("l_partkey").cast("string"), F.lit(" | "), "l_returnflag", F.lit(" |"))
    rows = _numbered(spark, sf).withColumn("line", row)
    text = F.concat(F.lit("| part | flag |\n| --- | --- |\n"), _joined("n", "line"))
    return chunking.chunk_documents(rows.groupBy(F.col("l_orderkey").alias("doc_id")).agg(text.alias("text")), _BY_LINES)


@query(f"""SELECT l_orderkey, ((n - 1) // 4)::BIGINT AS piece, 'table' AS format, '<th>| part | flag |</th>' || chr(10) || string_agg('| ' || l_partkey || ' | ' || l_returnflag || ' |', chr(10) ORDER BY n) AS text
  FROM ({_ROWS_SQL}) GROUP BY l_orderkey, (n - 1) // 4""")
def table_header_propagation(spark: SparkSession, sf: str) -> DataFrame:
    return _table_chunks(spark, sf).select(F.col("doc_id").alias("l_orderkey"), F.col("chunk_index").cast("long").alias("piece"), "format", "text")


@query(f"""SELECT l_orderkey, '| part | flag |' || chr(10) || '| --- | --- |' || chr(10) || string_agg('| ' || l_partkey || ' | ' || l_returnflag || ' |', chr(10) ORDER BY n) AS whole FROM ({_ROWS_SQL}) GROUP BY l_orderkey""")
def table_rejoin(spark: SparkSession, sf: str) -> DataFrame:
    chunks = _table_chunks(spark, sf)
    pieces = F.sort_array(F.collect_list(F.struct("chunk_index", "text")))["text"]
    return chunks.groupBy(F.col("doc_id").alias("l_orderkey")).agg(pieces.alias("pieces")).select("l_orderkey", parents.rejoined_table(F.col("pieces")).alias("whole"))


#: A line is long where the quantity is large, so that some chunks are short and some are not.
_LINE_SQL = "'part ' || l_partkey || repeat(' word', l_quantity::INT // 4)"

_MERGE_SQL = f"""l AS (SELECT l_orderkey AS doc_id, CASE WHEN n <= 3 THEN 0 ELSE 1 END AS s, n, {_LINE_SQL} AS line FROM ({_ROWS_SQL})),
  withhead AS (SELECT doc_id, s, n, line FROM l UNION ALL SELECT DISTINCT doc_id, s, 0, CASE s WHEN 0 THEN '# First' ELSE '# Second' END FROM l),
  placed AS (SELECT *, (row_number() OVER (PARTITION BY doc_id, s ORDER BY n) - 1) // 2 AS piece FROM withhead),
  pieces AS (SELECT doc_id, s, piece, string_agg(line, chr(10) ORDER BY n) AS t FROM placed GROUP BY doc_id, s, piece),
  runs AS (SELECT doc_id, s, list(t ORDER BY piece) AS a, s = max(s) OVER (PARTITION BY doc_id) AS is_last FROM pieces GROUP BY doc_id, s),
  walk AS (SELECT doc_id, s, a, is_last, 1::BIGINT AS i, []::VARCHAR[] AS done FROM runs
    UNION ALL SELECT doc_id, s, a, is_last, CASE WHEN short AND i < len(a) THEN i + 2 ELSE i + 1 END,
      CASE WHEN short AND i < len(a) THEN list_append(done, a[i] || CASE WHEN regexp_matches(a[i + 1], '^[A-Za-z0-9]') THEN ' ' ELSE '' END || a[i + 1])
        WHEN short AND NOT is_last AND len(done) > 0 THEN list_append(done[:len(done) - 1], done[-1] || CASE WHEN regexp_matches(a[i], '^[A-Za-z0-9]') THEN ' ' ELSE '' END || a[i]) ELSE list_append(done, a[i]) END
      FROM (SELECT *, greatest(1, trunc(length(a[i]) / 3.5)::INT) <= 20 AS short FROM walk WHERE i <= len(a))),
  merged AS (SELECT doc_id, s, unnest(done) AS text, generate_subscripts(done, 1) AS k FROM walk WHERE i > len(a))"""


def _line_documents(spark: SparkSession, sf: str) -> DataFrame:
    """An order's first three lines under one heading, the others under another."""
    rows = _numbered(spark, sf).withColumn("line", F.concat(F.lit("part "), F.col("l_partkey").cast("string"), F.expr("repeat(' word', cast(floor(l_quantity / 4) AS int))"))).withColumn("s", (F.col("n") > 3).cast("int"))
    parts = rows.groupBy("l_orderkey", "s").agg(_joined("n", "line").alias("body")).withColumn("section", F.concat(F.when(F.col("s") == 0, "# First\n").otherwise("# Second\n"), "body"))
    return parts.groupBy(F.col("l_orderkey").alias("doc_id")).agg(_joined("s", "section").alias("text"))


@query(f"""WITH RECURSIVE {_MERGE_SQL} SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY s, k) - 1 AS chunk_index, CASE s WHEN 0 THEN 'First' ELSE 'Second' END AS header1, s AS section_id, s AS context_id, 'text' AS format, text FROM merged""")
def short_chunk_merge(spark: SparkSession, sf: str) -> DataFrame:
    """Sections, contexts with their headings, pieces of two lines, and short ones joined to the next or, at a context's end, to the one before."""
    chunks = chunking.chunk_documents(_line_documents(spark, sf), _BY_LINES)
    return chunks.select("doc_id", F.col("chunk_index").cast("long").alias("chunk_index"), "header1", "section_id", "context_id", "format", "text")


@query(f"""WITH l AS (SELECT l_orderkey AS doc_id, n, 'part ' || l_partkey || ' of line ' || n || repeat(' word' || n, 20) AS line FROM ({_ROWS_SQL}) UNION ALL SELECT DISTINCT l_orderkey, 0, 'order ' || l_orderkey || repeat(' word', 20) FROM lineitem)
  SELECT doc_id, (n // 2)::BIGINT AS chunk_index, string_agg(line, chr(10) ORDER BY n) AS text, (n // 4 + 1)::BIGINT AS page_no FROM l GROUP BY doc_id, n // 2, n // 4""")
def chunk_page_numbers(spark: SparkSession, sf: str) -> DataFrame:
    """A line for the order and its lines, in pages of four and chunks of two, so that each chunk is whole on a page."""
    number = F.col("n").cast("string")
    lines = _numbered(spark, sf).select("l_orderkey", "n", F.concat(F.lit("part "), F.col("l_partkey").cast("string"), F.lit(" of line "), number, F.repeat(F.concat(F.lit(" word"), number), 20)).alias("line"))
    first = lines.select("l_orderkey").distinct().select("l_orderkey", F.lit(0).alias("n"), F.concat(F.lit("order "), F.col("l_orderkey").cast("string"), F.repeat(F.lit(" word"), 20)).alias("line"))
    rows = lines.unionByName(first).withColumn("page", F.floor(F.col("n") / 4))
    pages = rows.groupBy("l_orderkey", "page").agg(_joined("n", "line").alias("body"))
    docs = pages.groupBy(F.col("l_orderkey").alias("doc_id")).agg(_joined("page", "body").alias("text"), F.sort_array(F.collect_list(F.struct("page", "body")))["body"].alias("pages"))
    chunks = chunking.chunk_documents(docs, _BY_LINES)
    return chunks.select("doc_id", F.col("chunk_index").cast("long").alias("chunk_index"), "text", F.col("page_no").cast("long").alias("page_no"))


@query(f"""WITH RECURSIVE {_MERGE_SQL}, c AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY s, k) - 1 AS i, s, text FROM merged)
  SELECT doc_id || ':' || i AS chunk_uid, text AS snippet, CASE WHEN doc_id % 2 = 0 THEN 'public' ELSE 'group:odd' END AS acl FROM c""")
def chunk_index_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks as rows to store: keys, and public where a document has no principals."""
    principals = F.when(F.col("doc_id") % 2 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("group:odd")))
    chunks = chunking.chunk_documents(_line_documents(spark, sf), _BY_LINES).withColumnRenamed("text", "snippet").withColumn("acl_principals", principals)
    return index.index_rows(chunks).select("chunk_uid", "snippet", F.array_join("acl_principals", ",").alias("acl"))
