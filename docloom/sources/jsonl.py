"""Evaluation cases as lines of JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "query string, expected_docs array<string>, expected array<string>, note string, tags array<string>"


def parsed_cases(text: DataFrame) -> DataFrame:
    """value: a line. query, expected_docs, note, tags of those that are JSON with a query; blank lines, comments and the rest are passed over."""
    line = F.trim(F.col("value"))
    row = F.from_json(line, SCHEMA, {"mode": "PERMISSIVE"})
    rows = text.where((line != "") & ~line.startswith("#")).select(row.alias("r")).select("r.*").where("trim(query) <> ''")
    empty = F.array().cast("array<string>")
    return rows.select(
        F.trim("query").alias("query"), F.coalesce(F.when(F.size("expected_docs") > 0, F.col("expected_docs")), F.col("expected"), empty).alias("expected_docs"),
        F.coalesce("note", F.lit("")).alias("note"), F.coalesce("tags", empty).alias("tags"),
    )


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    return parsed_cases(spark.read.text(path))


def case_lines(cases: DataFrame) -> DataFrame:
    """value: a line for each case, its four keys, characters as they are."""
    return cases.select(F.to_json(F.struct("query", "expected_docs", "note", "tags"), {"ignoreNullFields": "false"}).alias("value"))


def write_cases(cases: DataFrame, path: str) -> None:
    case_lines(cases).write.mode("overwrite").text(path)
