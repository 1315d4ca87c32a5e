"""The chunk table as an index: rows to store, deltas, deletes, upserts and statistics."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions.acl import acl_or_public
from docloom.functions.text import chunk_uid
from docloom.schema import chunk_type, verify_contract

STATUS_ORDER = ("indexed", "skipped_unchanged", "failed")


def index_rows(chunks: DataFrame) -> DataFrame:
    """Chunks with their document's columns as rows to store: key, public where there is no acl, snippet as it is."""
    return chunks.withColumn("chunk_uid", chunk_uid("doc_id", "chunk_index")).withColumn("acl_principals", acl_or_public(F.col("acl_principals")))


def delta(stored: DataFrame, incoming: DataFrame, force: bool = False) -> DataFrame:
    """incoming: doc_id, content_hash. Adds state: new, changed or unchanged, by the hash of the document's newest stored chunk (indexed_at, if there is such a column); forced ones are never unchanged."""
    order = F.struct(*["indexed_at"] * ("indexed_at" in stored.columns), "content_hash")
    hashes = stored.groupBy("doc_id").agg(F.max_by("content_hash", order).alias("_old"))
    same = F.lit(False) if force else F.col("_old") == F.col("content_hash")
    return incoming.join(hashes, "doc_id", "left").withColumn("state", F.when(F.col("_old").isNull(), "new").when(same, "unchanged").otherwise("changed")).drop("_old")


def ingest_status(items: DataFrame) -> DataFrame:
    """items: doc_id, state, n_chars (of the extracted text), n_chunks, error (null without). Adds status and the error that the registry keeps."""
    error = (
        F.when(F.col("state") == "unchanged", F.lit(None))
        .when(F.col("error").isNotNull(), F.col("error")).when(F.col("n_chars") == 0, F.lit("no text")).when(F.col("n_chunks") == 0, F.lit("no chunks"))
    )
    failed = (F.col("state") != "unchanged") & (F.col("error").isNotNull() | (F.col("n_chars") == 0) | (F.col("n_chunks") == 0))
    status = F.when(F.col("state") == "unchanged", "skipped_unchanged").when(failed, "failed").otherwise("indexed")
    return items.withColumn("status", status).withColumn("error", F.left(error.cast("string"), F.lit(1000)))


def ingest_summary(results: DataFrame) -> DataFrame:
    count = lambda s: F.coalesce(F.sum(F.when(F.col("status") == s, 1).otherwise(0)), F.lit(0)).cast("long")
    chunks = F.coalesce(F.sum(F.when(F.col("status") == "indexed", F.col("n_chunks")).otherwise(0)), F.lit(0)).cast("long")
    return results.agg(count("indexed").alias("indexed"), count("skipped_unchanged").alias("skipped"), count("failed").alias("failed"), chunks.alias("total_chunks"))


def without_documents(chunks: DataFrame, gone: DataFrame) -> DataFrame:
    return chunks.join(gone.select("doc_id").distinct(), "doc_id", "left_anti")


def upserted_chunks(stored: DataFrame, new: DataFrame) -> DataFrame:
    """The table with the documents of `new` replaced by their new chunks: stale ones of a document that has become shorter go too."""
    return without_documents(stored, new).unionByName(new, allowMissingColumns=True)


def write_index(chunks: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Stores chunks, sorted by document in each file so that a document's rows lie together and file statistics prune. To replace a table, write to a new path and swap: the one being read can't be overwritten."""
    verify_contract(chunks.schema)
    chunks.sortWithinPartitions("doc_id", "chunk_index").write.mode(mode).parquet(path)


def write_bucketed(chunks: DataFrame, name: str, buckets: int, by: str = "doc_id") -> None:
    """Stores chunks as a table in buckets of a key: joins and sums by that key, with another table in as many buckets of it, need no shuffle."""
    verify_contract(chunks.schema)
    chunks.write.mode("overwrite").bucketBy(buckets, by).sortBy(by, "chunk_index").format("parquet").saveAsTable(name)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    out = spark.read.parquet(path)
    verify_contract(out.schema)
    return out


def index_stats(chunks: DataFrame) -> DataFrame:
    """chunks, documents: exact. approx_documents is for tables too large for that."""
    return chunks.agg(F.count("*").alias("chunks"), F.count_distinct("doc_id").alias("documents"))


def approx_documents(chunks: DataFrame, rsd: float = 0.02) -> DataFrame:
    return chunks.agg(F.approx_count_distinct("doc_id", rsd).alias("documents"))


def by_type(chunks: DataFrame, most: int = 20) -> DataFrame:
    return chunks.groupBy("document_type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "document_type").limit(most)


def ingest_failures(results: DataFrame, most: int = 20) -> DataFrame:
    """doc_id, error of the first failed items, by doc_id."""
    return results.where("status = 'failed'").orderBy("doc_id").limit(most).select("doc_id", "error")


def refused(rows: DataFrame, dims: int) -> DataFrame:
    """chunk_uid, error (300 characters) of rows that can't be stored: without a key, or with a vector of another length. The others can."""
    n = F.coalesce(F.size("semantic_vector"), F.lit(0))
    error = F.when(F.col("chunk_uid").isNull(), F.lit("no chunk_uid")).when(~n.isin(0, dims), F.concat(F.lit("vector of "), n.cast("string"), F.lit(f" dimensions, not {dims}")))
    return rows.select("chunk_uid", F.left(error, F.lit(300)).alias("error")).where("error IS NOT NULL")


def upserted_rows(stored: DataFrame, new: DataFrame, dims: int) -> DataFrame:
    """The table with rows replaced by chunk_uid, whichever of `new` can be stored; of a repeated key, the row with the larger snippet counts. What is refused is in refused()."""
    n = F.coalesce(F.size("semantic_vector"), F.lit(0))
    good = new.where(F.col("chunk_uid").isNotNull() & n.isin(0, dims))
    one = good.groupBy("chunk_uid").agg(F.max_by(F.struct(*good.columns), F.struct("snippet", "text_to_index")).alias("row")).select("row.*")
    return stored.join(one.select("chunk_uid"), "chunk_uid", "left_anti").unionByName(one, allowMissingColumns=True)


def deleted(chunks: DataFrame, documents: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Index and registry without the documents in gone (doc_id)."""
    return without_documents(chunks, gone), without_documents(documents, gone)


def reindexed(stored: DataFrame, documents: DataFrame, wanted: DataFrame, fetch: Callable[[DataFrame], DataFrame], chunk: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(index, results): documents wanted (doc_id) are read and chunked again, whatever their hash. fetch gets their registry rows and gives described files; chunk gives rows of the index.

    results: doc_id, status, error. A document that isn't registered, or of which its source gives nothing, fails and keeps the chunks it has; so does one without chunks.
    """
    asked = wanted.select("doc_id").distinct()
    records = documents.join(asked, "doc_id", "left_semi")
    files = fetch(records)
    new = chunk(files)
    state = (
        asked.join(records.select("doc_id", F.lit(True).alias("known")), "doc_id", "left").join(files.select("doc_id", F.lit(True).alias("read")).distinct(), "doc_id", "left")
        .join(new.groupBy("doc_id").agg(F.count("*").alias("n_chunks")), "doc_id", "left")
    )
    error = F.when(F.col("known").isNull(), "no such document").when(F.col("read").isNull(), "its source gives nothing").when(F.col("n_chunks").isNull(), "no chunks")
    results = state.select("doc_id", F.when(error.isNull(), "indexed").otherwise("failed").alias("status"), error.alias("error"), F.coalesce("n_chunks", F.lit(0)).alias("n_chunks"))
    return upserted_chunks(stored, new), results


def ping(spark: SparkSession, path: str) -> bool:
    """Whether the table at path can be read. Never raises."""
    try:
        read_index(spark, path)
    except Exception:  # noqa: BLE001  whatever it is, the answer is no
        return False
    return True


def ensured_index(spark: SparkSession, path: str, dims: int) -> DataFrame:
    """The table at path, made empty if there is none. One whose rows have vectors of another length is an error."""
    if not ping(spark, path):
        spark.createDataFrame([], chunk_type()).write.mode("errorifexists").parquet(path)
    out = read_index(spark, path)
    wrong = out.where(F.size("semantic_vector") > 0).where(F.size("semantic_vector") != dims).select(F.size("semantic_vector").alias("n")).limit(1).collect()
    if wrong:
        raise ValueError(f"the index has vectors of {wrong[0].n} dimensions, not {dims}")
    return out


def dropped_index(spark: SparkSession, path: str) -> bool:
    """Deletes the table at path; whether there was one."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def index_body(dims: int, name: str = "chunks") -> str:
    """The table as a statement: its columns, how it is stored, and the vector's length and measure as properties."""
    columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in chunk_type())
    return f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet TBLPROPERTIES ('vector.dims' = '{dims}', 'vector.measure' = 'cosine', 'key' = 'chunk_uid')"
