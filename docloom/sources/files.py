"""Files as rows: a recursive scan with the names that are passed over, sizes, and what is derived from a path."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions.text import content_hash, doc_id_of, strip

#: Folders that are never entered.
SKIPPED_DIRS = (".git", ".svn", "node_modules", "__pycache__", ".venv", "venv", ".idea", ".vscode", ".pytest_cache")
#: Suffixes that there are extractors for.
SUFFIXES = (
    "md", "markdown", "mdx", "html", "htm", "txt", "log", "rst", "csv", "json", "yaml", "yml", "docx", "xlsx", "xlsm", "pdf",
)
MOST_MB = 100


def _last(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def suffix_of(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"\.([^./]+)$", 1))


def scan(spark: SparkSession, root: str, suffixes: tuple[str, ...] = SUFFIXES, most_mb: int = MOST_MB) -> DataFrame:
    """path, modificationTime, length, content of the files under root that are read; a missing root is an error when the scan is planned. Content is read only if it is used."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return files.where(accepted(F.col("path"), F.col("length"), suffixes, most_mb))


def accepted(path: Column, length: Column, suffixes: tuple[str, ...] = SUFFIXES, most_mb: int = MOST_MB) -> Column:
    """A known suffix, no skipped folder anywhere in the path, no hidden or lock file, neither empty nor too large."""
    name = _last(path)
    folders = F.slice(F.split(path, "/"), F.lit(1), F.greatest(F.lit(0), F.size(F.split(path, "/")) - 1))
    inside = F.arrays_overlap(folders, F.array(*map(F.lit, SKIPPED_DIRS)))
    return suffix_of(name).isin(*suffixes) & ~inside & ~name.startswith(".") & ~name.startswith("~$") & (length > 0) & (length <= most_mb * 1024 * 1024)


def described(files: DataFrame, root: str = "", acl: tuple[str, ...] = ("public",)) -> DataFrame:
    """The columns of a document for each file; content stays."""
    bare = F.regexp_replace("path", "^[a-z0-9]+:/*(?=/)", "")
    return files.select(
        doc_id_of(bare).alias("doc_id"), _last(bare).alias("file_name"), bare.alias("file_path"), F.concat(F.lit("file://"), bare).alias("file_url"),
        suffix_of(_last(bare)).alias("document_type"), F.col("modificationTime").alias("last_modified_date"), content_hash("content").alias("content_hash"),
        F.array(*map(F.lit, acl)).alias("acl_principals"), F.lit("local").alias("source_kind"),
        F.create_map(F.lit("relative_path"), strip(F.regexp_replace(bare, "^" + root.rstrip("/") + "/", ""))).alias("extras"), "content",
    )
