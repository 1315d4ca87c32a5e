"""A corpus from documents to token files, in five stages.

Each stage takes (spark, docs, sf_dir), works on all rows that the one before kept and gives a DataFrame; it is written
as Parquet and read again as the next stage's docs. All but the last return the columns of documents.

Stages that take rows away decide by row, which is known by its doc_id and a hash of its text: where an id has several texts, each
is judged by itself. Null ids, and null and empty texts, are like any others. No rows give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.llm import decontaminate, minhash, mixing, quality, tokenfile
from docloom.llm.common import table, written

#: Of a row of docs, two hashes of 64 bits; a null hashes to a number too.
KEY = ("key_of_id", "key_of_text")


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.struct("*").alias("row"), F.xxhash64("doc_id").alias("key_of_id"), F.xxhash64("text").alias("key_of_text"))


def _judged(docs: DataFrame) -> DataFrame:
    """What an operator gets: doc_id, text and the KEY that it carries through."""
    return _keyed(docs).select("row.doc_id", "row.text", *KEY)


def _keep(docs: DataFrame, decided: DataFrame) -> DataFrame:
    """Rows of docs whose KEY is among the decided ones; all their columns stay."""
    return _keyed(docs).join(decided.select(*KEY), list(KEY), "left_semi").select("row.*")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text is predicted to have quality 1; learns from the labelled documents among docs. Repeated rows are judged alike, so all of them stay or go."""
    scored = quality.quality_scores(_judged(docs), table(spark, sf_dir, "labels"), KEY)
    return _keep(docs, scored.where("predicted = 1"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates, at the similarity of op9: that with the smallest doc_id (of several such, one text, by its hash).

    Of rows equal in doc_id and text, one stays, whatever their other columns are (by a hash of those). Texts without words are in no group: each id keeps its own.
    """
    found = minhash.near_duplicates(_judged(docs), carry=KEY).where("kept")
    first = found.where("component IS NOT NULL").groupBy("component").agg(F.min(F.struct(*KEY)).alias("key")).select("key.*")
    stay = written(first.unionByName(found.where("component IS NULL").select(*KEY).distinct()), "unique")
    # a window that keeps one row takes the others away before the shuffle, too; what is left is dealt by KEY as the join needs it
    plain = [f.name for f in docs.schema if f.dataType.simpleString() in ("string", "bigint", "int", "double", "boolean", "date", "timestamp")]
    once = Window.partitionBy(*KEY).orderBy(F.xxhash64(*[F.col(f"row.{c}") for c in plain]))
    rows = _keyed(docs).withColumn("n", F.row_number().over(once)).where("n = 1")
    return rows.join(stay, list(KEY), "left_semi").select("row.*")


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows in whose text no window of a benchmark item occurs."""
    found = decontaminate.decontaminate(_judged(docs), table(spark, sf_dir, "benchmark"), carry=KEY)
    return _keep(docs, found.where("NOT contaminated"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as many times as the mix of sources takes it."""
    return mixing.mix(docs)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every row, read back from the token file."""
    return tokenfile.read_documents(tokenfile.write_segments(docs, tokenfile.tokenizer_path()))


STAGES = [
    ("quality classifier", quality_stage),
    ("MinHash near-dedup", near_duplicate_stage),
    ("benchmark decontamination", decontamination_stage),
    ("mixing sources", mixing_stage),
    ("token-ID output", token_stage),
]

#: A discriminant's scores, hash-seeded draws and a tokenizer have no SQL; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = written(docs, f"stage{i}")
    return docs
