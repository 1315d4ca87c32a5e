"""Sources of documents: anything that gives described rows. Local files and web pages are two."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.config import Settings
from docloom.operators.chunking import ChunkOptions
from docloom.operators.index import delta
from docloom.streaming.ingest import chunked

from . import files, urls

#: What a fetcher gives for each URL: content_type, content, final URL; it raises where there is nothing to be had.
Fetch = Callable[[str], tuple[str, bytes, str]]


class Source(Protocol):
    def rows(self, spark: SparkSession) -> DataFrame:
        """doc_id, file_name, file_path, file_url, document_type, content_hash, acl_principals, source_kind, content and, where known, last_modified_date and extras."""
        ...


@dataclass(frozen=True)
class LocalSource:
    """Files under a folder, or one file."""

    root: str
    acl: tuple[str, ...] = ("public",)
    most_mb: int = files.MOST_MB

    def rows(self, spark: SparkSession) -> DataFrame:
        return files.described(files.scan(spark, self.root, most_mb=self.most_mb), self.root, self.acl)


@dataclass(frozen=True)
class UrlSource:
    """Web pages. The fetcher runs in tasks and follows redirects; a page that it can't have is left out, as are those that are too large or of no known kind."""

    addresses: tuple[str, ...]
    fetch: Fetch
    acl: tuple[str, ...] = ("public",)
    most_mb: int = files.MOST_MB

    def pages(self, spark: SparkSession) -> DataFrame:
        """url, content_type, content, error. The url stays the one that was asked for, as documents are known by it."""
        import pandas as pd

        fetch = self.fetch

        def run(batches):
            for b in batches:
                out = []
                for url in b["url"]:
                    try:
                        kind, content, _ = fetch(url)
                        out.append((url, kind, content, None))
                    except Exception as e:  # noqa: BLE001  a page that fails is a row that says so
                        out.append((url, None, None, f"{type(e).__name__}: {e}"[:1000]))
                yield pd.DataFrame(out, columns=["url", "content_type", "content", "error"])

        asked = spark.createDataFrame([(u,) for u in dict.fromkeys(self.addresses)], "url string")
        return asked.repartition(max(1, min(len(self.addresses), spark.sparkContext.defaultParallelism))).mapInPandas(run, "url string, content_type string, content binary, error string")

    def rows(self, spark: SparkSession) -> DataFrame:
        found = urls.described(self.pages(spark), files.SUFFIXES, self.most_mb, self.acl)
        return found.withColumn("last_modified_date", F.lit(None).cast("timestamp")).withColumn("extras", F.lit(None).cast("map<string,string>"))


def chunk_options(settings: Settings | None = None) -> ChunkOptions:
    own = (settings or Settings()).chunking
    return ChunkOptions(own.chunk_size, own.context_size, ignore_sections=tuple(own.ignore_sections), chunk_overlap=own.chunk_overlap, context_overlap=own.context_overlap)


def ingested(spark: SparkSession, source: Source, stored: DataFrame | None = None, settings: Settings | None = None, force: bool = False) -> DataFrame:
    """Rows of the index for what a source has that `stored` (doc_id, content_hash) doesn't have, or has otherwise; for all of it if forced."""
    found = source.rows(spark)
    if stored is not None:
        wanted = delta(stored, found.select("doc_id", "content_hash"), force).where("state <> 'unchanged'").select("doc_id")
        found = found.join(wanted, "doc_id", "left_semi")
    return chunked(found, chunk_options(settings))


def ingest_path(spark: SparkSession, root: str, acl: tuple[str, ...] = ("public",), **options) -> DataFrame:
    return ingested(spark, LocalSource(root, acl), **options)


def ingest_urls(spark: SparkSession, addresses: tuple[str, ...], fetch: Fetch, acl: tuple[str, ...] = ("public",), **options) -> DataFrame:
    return ingested(spark, UrlSource(tuple(addresses), fetch, acl), **options)
