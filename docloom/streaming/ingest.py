"""Incremental ingest: files that arrive become chunk rows, batch after batch."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from docloom.operators.chunking import ChunkOptions, chunk_documents
from docloom.operators.index import delta, index_rows
from docloom.operators.versions import BucketTable
from docloom.operators.versions import versions as table_versions
from docloom.session import broadcast_if_small, stored
from docloom.sources import extract, files

#: Buckets of a table of chunks; paths that are read at a time.
BUCKETS, PATHS = 64, 10_000
FILE_SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def chunked(described: DataFrame, options: ChunkOptions | None = None) -> DataFrame:
    """Described files (see sources.files) to rows of the chunk table, without vectors; files that can't be read have none."""
    texts = extract.extract(described).where("error IS NULL").select("doc_id", "text", "pages")
    chunks = chunk_documents(texts, options)
    meta = described.select("doc_id", "file_name", "file_path", "file_url", "document_type", "last_modified_date", "content_hash", "acl_principals", F.col("extras").alias("metadata"))
    rows = chunks.withColumnRenamed("text", "snippet").withColumn("text_to_index", F.col("snippet")).join(meta, "doc_id")
    return index_rows(rows).withColumn("semantic_vector", F.array().cast("array<float>")).withColumn("indexed_at", F.col("last_modified_date"))


def replaced(table: BucketTable | None, spark: SparkSession, target: str, versions: DataFrame, rows: Callable[[DataFrame], DataFrame], buckets: int = BUCKETS) -> BucketTable:
    """The table of chunks at target after versions (doc_id, content_hash, last_modified_date, and what `rows` needs) came in.

    Of several versions of a document the newest counts. One whose hash is that of the stored chunks is passed over; of the others, rows() makes the new chunks, which take the place of all that the document had, also if there are none. Only
    the buckets of changed documents are written, and the table's next version has all of it or nothing; a batch that comes again finds its documents as they are and writes nothing.
    """
    newest = versions.groupBy("doc_id").agg(F.max_by(F.struct(*versions.columns), F.struct("last_modified_date", "content_hash")).alias("v")).select("v.*")
    if table is None:
        return BucketTable.create(rows(newest), target, "doc_id", buckets, ("chunk_index",))
    changed = stored(delta(table.read(), newest.select("doc_id", "content_hash")).where("state <> 'unchanged'").select("doc_id"), "changed")
    if changed.isEmpty():
        return table
    return table.replace(changed, rows(newest.join(broadcast_if_small(changed), "doc_id", "left_semi")))


def opened(spark: SparkSession, target: str) -> BucketTable | None:
    return BucketTable.open(spark, target) if table_versions(spark, target) else None


def refresh(spark: SparkSession, root: str, target: str, options: ChunkOptions | None = None, remove_missing: bool = False) -> BucketTable | None:
    """Looks at the names and times of all files under root and reads those that are in the table at target with another time, as a stream of files passes over a path that it has seen. With remove_missing, documents without a file go."""
    table = opened(spark, target)
    if table is None:
        return None
    known = table.read().groupBy("doc_id").agg(F.max("last_modified_date").alias("_then"))
    listed = stored(files.scan(spark, root).select("path", "modificationTime", "length"), "listed")  # no content
    there = files.described(listed.withColumn("content", F.lit(None).cast("binary")), root).select("doc_id", "file_path", "last_modified_date")
    newer = there.join(known, "doc_id").where("last_modified_date <> _then").select("doc_id")
    newer = stored(newer, "newer")
    if not newer.isEmpty():
        paths = there.join(broadcast_if_small(newer), "doc_id", "left_semi").select("file_path")
        for some in blocks_of(paths, PATHS):
            table = replaced(table, spark, target, files.described(spark.read.format("binaryFile").load(some), root), lambda new: chunked(new, options))
    if remove_missing:
        gone = known.join(there.select("doc_id"), "doc_id", "left_anti").select("doc_id")
        table = table if gone.isEmpty() else table.remove(gone)
    return table


def blocks_of(paths: DataFrame, most: int) -> Iterator[list[str]]:
    """Paths by blocks, so that the driver, which has to name files to read them, holds one block."""
    n = -(-paths.count() // most)
    for block in range(n):
        found = [r.file_path for r in paths.where(F.pmod(F.xxhash64("file_path"), F.lit(n)) == block).collect()]
        if found:
            yield found


def ingest_stream(spark: SparkSession, root: str, target: str, checkpoint: str, options: ChunkOptions | None = None, max_files: int = 1000) -> StreamingQuery:
    """Reads what there is under root and not yet read, puts its chunks into the table at target (see replaced()), and ends. The checkpoint remembers which files were read; files that changed since are read again first.

    The table has one version of each document, whatever checkpoint is used, and a batch that is run again changes nothing.
    """
    refresh(spark, root, target, options)
    stream = (
        spark.readStream.format("binaryFile").schema(FILE_SCHEMA).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", max_files).load(root)
    )

    def write(batch: DataFrame, number: int) -> None:
        new = files.described(batch.where(files.accepted(F.col("path"), F.col("length"))), root)
        replaced(opened(batch.sparkSession, target), batch.sparkSession, target, new, lambda some: chunked(some, options))

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_chunks(spark: SparkSession, target: str) -> DataFrame:
    """The chunks of the table's last version."""
    return BucketTable.open(spark, target).read()
