"""Web pages as rows, from a table of what was fetched: url, content_type, content, error."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions.text import content_hash, doc_id_of

#: Suffixes of content types.
CONTENT_TYPES = {
    "text/html": "html",
    "application/xhtml+xml": "html",
    "application/pdf": "pdf",
    "text/markdown": "md",
    "text/plain": "txt",
    "text/csv": "csv",
    "application/json": "json",
    "application/vnd.openxmlformats-officedocument.wordprocessingml.document": "docx",
    "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet": "xlsx",
}
NAME_CHARS = 80


def url_path(url: Column) -> Column:
    """The path of a URL, decoded, without query and fragment."""
    return F.try_url_decode(F.replace(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1), F.lit("+"), F.lit("%2B")))


def url_host(url: Column) -> Column:
    return F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)


def guessed_suffix(url: Column, content_type: Column) -> Column:
    """By the content type, else the path's own suffix, else html."""
    kind = F.lower(F.trim(F.element_at(F.split(F.coalesce(content_type, F.lit("")), ";"), 1)))
    known = F.create_map(*[F.lit(x) for pair in CONTENT_TYPES.items() for x in pair])
    own = F.lower(F.regexp_extract(url_path(url), r"[^/]\.([^./]+)$", 1))
    return F.coalesce(F.try_element_at(known, kind), F.nullif(own, F.lit("")), F.lit("html"))


def safe_name(url: Column, suffix: Column) -> Column:
    """A file name of the path's last part, else the host, else page; other characters than letters, digits, . _ - and Chinese become dashes."""
    last = F.regexp_extract(url_path(url), r"([^/]+)/*$", 1)
    stem = F.regexp_replace(last, r"(?<=.)\.[^.]*$", "")
    stem = F.coalesce(F.nullif(stem, F.lit("")), F.nullif(url_host(url), F.lit("")), F.lit("page"))
    clean = F.regexp_replace(F.regexp_replace(stem, r"[^A-Za-z0-9._\x{4E00}-\x{9FFF}-]+", "-"), "^-+|-+$", "")
    return F.concat(F.coalesce(F.nullif(F.left(clean, F.lit(NAME_CHARS)), F.lit("")), F.lit("page")), F.lit("."), suffix)


def described(pages: DataFrame, suffixes: tuple[str, ...], most_mb: int = 100, acl: tuple[str, ...] = ("public",)) -> DataFrame:
    """The columns of a document for each page that came, has a known suffix and isn't empty or too large."""
    suffix = guessed_suffix(F.col("url"), F.col("content_type"))
    rows = pages.withColumn("document_type", suffix).where(F.col("error").isNull() & F.col("document_type").isin(*suffixes))
    rows = rows.where((F.octet_length("content") > 0) & (F.octet_length("content") <= most_mb * 1024 * 1024))
    name = safe_name(F.col("url"), F.col("document_type"))
    return rows.select(
        doc_id_of("url").alias("doc_id"), name.alias("file_name"), F.col("url").alias("file_path"), F.col("url").alias("file_url"), "document_type",
        content_hash("content").alias("content_hash"), F.array(*map(F.lit, acl)).alias("acl_principals"), F.lit("url").alias("source_kind"), "content",
    )
