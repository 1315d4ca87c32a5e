"""Queries that run a stream to its end. Its state and what it writes are in the shared folder, so nothing of it depends on one machine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.operators.chunking import chunk_documents
from docloom.session import shared_path, table
from docloom.streaming import ingest

from .base import query


@query("SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def stream_counts(spark: SparkSession, sf: str) -> DataFrame:
    """events as a stream of files, counted by type: the counts after the last batch."""
    counts = _files(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("n"))
    path = shared_path(spark, "counts")

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(path)

    run = counts.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", shared_path(spark, "counts-state")).trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(counts.schema).parquet(path)


@query()
def stream_ingest(spark: SparkSession, sf: str) -> DataFrame:
    """Documents that arrive as files are chunked as they come; the chunks are files too."""
    chunks = chunk_documents(_files(spark, sf, "documents").select("doc_id", "text"))
    path = shared_path(spark, "chunks")
    run = chunks.writeStream.format("parquet").outputMode("append").option("checkpointLocation", shared_path(spark, "chunks-state")).option("path", path).trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(chunks.schema).parquet(path)


@query("SELECT doc_id, md5(CASE WHEN doc_id % 10 = 3 THEN 'second version of ' || text ELSE text END) AS content_hash, 1::BIGINT AS n FROM documents WHERE doc_id % 10 <> 4")
def stream_replaces(spark: SparkSession, sf: str) -> DataFrame:
    """Documents stream into a table; every tenth comes again with another text, another tenth goes, and the first stream is run again under a new checkpoint. Of each document the last version is there, once."""
    target = shared_path(spark, "replaced")

    def run(text: Column, since: int, only: Column) -> None:
        hashed = _files(spark, sf, "documents").where(only).select("doc_id", text.alias("text"), F.md5(text).alias("content_hash"), F.timestamp_seconds(F.lit(since)).alias("last_modified_date"))

        def write(batch: DataFrame, number: int) -> None:
            ingest.replaced(ingest.opened(spark, target), spark, target, batch, lambda new: new.withColumn("chunk_index", F.lit(0)).withColumn("indexed_at", F.col("last_modified_date")))

        hashed.writeStream.foreachBatch(write).option("checkpointLocation", shared_path(spark, "replaced-state")).trigger(availableNow=True).start().awaitTermination()

    run(F.col("text"), 1, F.lit(True))
    run(F.concat(F.lit("second version of "), "text"), 2, F.col("doc_id") % 10 == 3)
    run(F.col("text"), 1, F.col("doc_id") % 10 != 3)  # nothing new
    last = ingest.opened(spark, target).remove(table(spark, sf, "documents").where("doc_id % 10 = 4"))
    return last.read().groupBy("doc_id", "content_hash").agg(F.count("*").alias("n"))


def _files(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.readStream.schema(table(spark, sf, name).schema).parquet(f"{sf}/{name}.parquet*")
