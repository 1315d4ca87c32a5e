"""Registration of queries with their SQL, and the tables as the entities that the operators work on."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions.text import content_hash
from docloom.session import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

#: The caller of the queries that filter by principals.
CALLER = ("public", "user:u3", "group:de")
AS_OF = "2024-01-31 00:00:00"
#: Vectors whose id is divisible by this are the queries of vector searches; all items of `benchmark` are those of the others.
EVERY = 50


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def documents(spark: SparkSession, sf: str) -> DataFrame:
    """documents as registry rows: every third is public, every third its language group's, the others a user's."""
    acl = (
        F.when(F.col("doc_id") % 3 == 0, F.array(F.lit("public"))).when(F.col("doc_id") % 3 == 1, F.array(F.concat(F.lit("group:"), "lang")))
        .otherwise(F.array(F.concat(F.lit("user:u"), (F.col("doc_id") % 10).cast("string"))))
    )
    return table(spark, sf, "documents").select(
        "doc_id", "text", F.concat_ws("", "source", F.lit("_"), F.col("doc_id").cast("string"), F.lit(".md")).alias("file_name"),
        F.concat_ws("", F.lit("/data/"), "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("file_path"),
        F.col("lang").alias("document_type"), acl.alias("acl_principals"), "source", content_hash("text").alias("content_hash"),
    )


#: The same in SQL, for a WITH clause.
DOCS_SQL = """docs AS (SELECT doc_id, text, source || '_' || doc_id || '.md' AS file_name, '/data/' || source || '/' || doc_id || '.md' AS file_path, lang AS document_type, source,
  CASE doc_id % 3 WHEN 0 THEN 'public' WHEN 1 THEN 'group:' || lang ELSE 'user:u' || (doc_id % 10) END AS principal, sha256(text) AS content_hash FROM documents)"""

#: Lines that pages of lineitem show; a line without a flag isn't one.
PRINTED = "l_returnflag <> 'R'"


def in_file_order(each: Column) -> Column:
    """collect_list of a column of a table that is read from files, in the order of its rows there, whatever order a shuffle brings them in. Of each row the place in its file goes along."""
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"), each.alias("each"))
    ordered = F.array_sort(F.collect_list(place), lambda a, b: F.when((a["file"] < b["file"]) | ((a["file"] == b["file"]) & (a["row"] < b["row"])), -1).otherwise(1))
    return F.transform(ordered, lambda x: x["each"])


def line_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of documents as chunks; five in a row are a context."""
    lines = documents(spark, sf).select("doc_id", "file_name", "acl_principals", F.posexplode(F.split("text", "\n")).alias("chunk_index", "snippet"))
    return lines.withColumn("section_id", F.lit(0)).withColumn("context_id", F.floor(F.col("chunk_index") / 5).cast("int")).withColumn("page_no", (F.col("chunk_index") + 1).cast("int")).withColumn("format", F.lit("text"))


LINES_SQL = """lines AS (SELECT doc_id, principal, file_name, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS chunk_index, unnest(string_split(text, chr(10))) AS snippet FROM docs)"""


def terms_sql(text: str) -> str:
    """The terms of a text in SQL (the tables have no CJK and no full-width characters)."""
    return f"unnest(regexp_extract_all(lower({text}), '[\\p{{L}}\\p{{N}}]+'))"


STOP_SQL = (
    "('a','an','and','are','as','at','be','but','by','for','if','in','into','is','it','no','not','of','on','or','such','that','the','their','then','there','these','they','this','to','was','will','with')"
)


def benchmark_queries(spark: SparkSession, sf: str) -> DataFrame:
    """query_id, query: the benchmark's items."""
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


QUERIES_SQL = "queries AS (SELECT item_id AS query_id, text AS query FROM benchmark)"
