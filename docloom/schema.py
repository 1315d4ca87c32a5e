"""Types of the persistent tables and the contract between writers and readers."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _struct(ddl: str) -> T.StructType:
    return T._parse_datatype_string(ddl)


PUBLIC = "public"
FORMATS = ("text", "table", "heading", "appendix")
RATINGS = ("up", "down")
STATUSES = ("indexed", "skipped_unchanged", "failed")

#: The chunk table: a row for each stored chunk. Key: chunk_uid.
CHUNKS = (
    "doc_id string, chunk_uid string, chunk_index int, file_name string, file_path string, file_url string, document_type string, "
    "last_modified_date timestamp, content_hash string, text_to_index string, snippet string, semantic_vector array<float>, page_no int, section_id int, "
    "context_id int, header1 string, header2 string, format string, acl_principals array<string>, metadata map<string,string>, indexed_at timestamp"
)

#: Registry tables; their names and columns are fixed values.
TABLES = {
    "sessions": "id string, title string, owner string, created_at double, updated_at double",
    "messages": "id string, session_id string, role string, content string, sources array<map<string,string>>, trace map<string,string>, created_at double",
    "feedback": "id string, message_id string, session_id string, rating string, comment string, query string, answer string, created_at double",
    "documents": "doc_id string, file_name string, file_path string, file_url string, document_type string, content_hash string, n_chunks int, acl array<string>, source_kind string, ocr_pages array<int>, status string, error string, indexed_at double",
    "eval_cases": "id string, query string, expected_docs array<string>, note string, tags array<string>, created_at double",
    "eval_runs": "id string, label string, config map<string,string>, metrics map<string,double>, details array<map<string,string>>, n_cases int, created_at double",
    "request_log": "id bigint, kind string, query string, ok boolean, latency_ms bigint, stages map<string,bigint>, n_candidates int, created_at double",
}

#: What retrieval reads; everything else of a chunk is written only. Fixed values.
READ_FIELDS = (
    "text_to_index", "file_name", "semantic_vector", "snippet", "acl_principals", "document_type", "last_modified_date", "doc_id", "section_id", "context_id",
    "chunk_index", "chunk_uid", "page_no", "header1", "header2", "format", "file_url", "file_path", "content_hash", "metadata",
)
WRITE_ONLY = ("indexed_at",)

#: What a reader gets for a field that a row doesn't have.
DEFAULTS = {
    "file_name": "", "file_path": "", "file_url": "", "document_type": "", "snippet": "", "page_no": 1, "section_id": 0, "context_id": 0, "chunk_index": 0,
    "header1": "", "header2": "", "format": "text",
}


def chunk_type() -> T.StructType:
    return _struct(CHUNKS)


def verify_contract(stored: T.StructType, read_fields: Iterable[str] = READ_FIELDS) -> None:
    """Raises ValueError naming every field that is read, or belongs to a chunk, and isn't stored (the write-only ones may be missing)."""
    have = set(stored.fieldNames())
    unread = sorted(set(read_fields) - have)
    unwritten = sorted(set(chunk_type().fieldNames()) - set(WRITE_ONLY) - have)
    if unread or unwritten:
        raise ValueError(f"not stored but read: {unread}; not stored but part of a chunk: {unwritten}")


def with_dims_guard(chunks: DataFrame, dims: int, column: str = "semantic_vector") -> DataFrame:
    """Fails when a row whose vector isn't null or empty has another length than dims."""
    wrong = F.col(column).isNotNull() & ~F.size(column).isin(0, dims)
    message = F.concat(F.lit(f"{column} has "), F.size(column).cast("string"), F.lit(f" dimensions, not {dims}"))
    return chunks.withColumn(column, F.when(wrong, F.raise_error(message).cast(chunks.schema[column].dataType)).otherwise(F.col(column)))


def decoded(rows: DataFrame) -> DataFrame:
    """Rows as readers see them: defaults for what is missing, the indexed text where a snippet is, score 0 for null."""
    out = rows
    for name, value in DEFAULTS.items():
        if name in rows.columns:
            out = out.withColumn(name, F.coalesce(F.col(name), F.lit(value)))
    if {"snippet", "text_to_index"} <= set(rows.columns):
        out = out.withColumn("snippet", F.when(F.col("snippet") == "", F.coalesce("text_to_index", F.lit(""))).otherwise(F.col("snippet")))
    if "score" in rows.columns:
        out = out.withColumn("score", F.coalesce("score", F.lit(0.0)))
    return out


def encoded(rows: DataFrame) -> Column:
    """A row as JSON without keys that hold null, an empty text, array or map. 0 stays."""
    fields = []
    for f in rows.schema:
        c = F.col(f.name)
        if isinstance(f.dataType, T.StringType):
            c = F.when(c != "", c)
        elif isinstance(f.dataType, T.ArrayType | T.MapType):
            c = F.when(F.size(c) > 0, c)
        fields.append(c.alias(f.name))
    return F.to_json(F.struct(*fields), {"ignoreNullFields": "true"})
