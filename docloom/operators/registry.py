"""Sessions, messages, feedback, documents and request logs as DataFrames: reads, and rewrites that give the new table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.functions.text import stable_id
from docloom.schema import RATINGS, TABLES


def session_list(sessions: DataFrame, messages: DataFrame, owner: Column | None = None, limit: int | None = 50) -> DataFrame:
    """Sessions with n_messages, the newest first."""
    counts = messages.groupBy(F.col("session_id").alias("id")).agg(F.count("*").alias("n_messages"))
    own = sessions if owner is None else sessions.where(owner)
    out = own.join(counts, "id", "left").withColumn("n_messages", F.coalesce("n_messages", F.lit(0).cast("long"))).orderBy(F.desc("updated_at"), "id")
    return out if limit is None else out.limit(limit)


def renamed(sessions: DataFrame, session_id: Column, title: Column, now: Column) -> DataFrame:
    hit = F.col("id") == session_id
    return sessions.withColumn("title", F.when(hit, title).otherwise(F.col("title"))).withColumn("updated_at", F.when(hit, now).otherwise(F.col("updated_at")))


def history(messages: DataFrame, turns: int) -> DataFrame:
    """The last 2 * turns messages of every session, numbered from 1 in the order of time."""
    own = Window.partitionBy("session_id")
    last = messages.withColumn("_n", F.row_number().over(own.orderBy(F.desc("seq")))).where(F.col("_n") <= 2 * turns).drop("_n")
    return last.withColumn("n", F.row_number().over(own.orderBy("seq")))


def ensured(sessions: DataFrame, wanted: DataFrame, title: Column, now: Column, owner: str = "anonymous") -> DataFrame:
    """Sessions and, for wanted ids (id) that they don't have, new ones."""
    new = wanted.select("id").distinct().join(sessions, "id", "left_anti")
    made = new.select("id", F.left(title, F.lit(30)).alias("title"), F.lit(owner).alias("owner"), now.alias("created_at"), now.alias("updated_at"))
    return sessions.unionByName(made, allowMissingColumns=True)


def without_sessions(sessions: DataFrame, messages: DataFrame, feedback: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three tables without the sessions in gone (id), their messages and the feedback on those."""
    lost = messages.join(gone.select(F.col("id").alias("session_id")), "session_id", "left_semi")
    return (
        sessions.join(gone, "id", "left_anti"),
        messages.join(gone.select(F.col("id").alias("session_id")), "session_id", "left_anti"),
        feedback.join(lost.select(F.col("id").alias("message_id")), "message_id", "left_anti"),
    )


def without(rows: DataFrame, key: str, gone: DataFrame) -> DataFrame:
    return rows.join(gone.select(key), key, "left_anti")


def feedback_list(feedback: DataFrame, rating: str | None = None, limit: int = 100) -> DataFrame:
    own = feedback if rating is None else feedback.where(F.col("rating") == rating)
    return own.orderBy(F.desc("created_at"), "id").limit(limit)


def feedback_summary(feedback: DataFrame) -> DataFrame:
    """rating, n for every rating, 0 where there is none."""
    kinds = feedback.sparkSession.createDataFrame([(r,) for r in RATINGS], "rating string")
    counts = feedback.groupBy("rating").agg(F.count("*").alias("n"))
    return kinds.join(counts, "rating", "left").select("rating", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def checked_feedback(feedback: DataFrame) -> DataFrame:
    """Fails on a rating that there isn't."""
    ok = F.coalesce(F.col("rating").isin(*RATINGS), F.lit(False))
    return feedback.withColumn("rating", F.when(ok, F.col("rating")).otherwise(F.raise_error(F.concat(F.lit("no such rating: "), F.coalesce("rating", F.lit("null")))).cast("string")))


def upserted(stored: DataFrame, new: DataFrame, key: str, order: str) -> DataFrame:
    """All columns of a key's row come from its newest new row, if there is one."""
    latest = new.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))).where("_n = 1").drop("_n")
    return stored.join(latest.select(key), key, "left_anti").unionByName(latest)


def page(rows: DataFrame, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    return rows.orderBy(*order).offset(offset).limit(limit)


def document_stats(documents: DataFrame) -> DataFrame:
    return documents.agg(
        F.count("*").alias("documents"), F.coalesce(F.sum("n_chunks"), F.lit(0)).cast("long").alias("chunks"),
        F.coalesce(F.sum(F.when(F.col("status") != "indexed", 1).otherwise(0)), F.lit(0)).cast("long").alias("failed"),
    )


def request_metrics(log: DataFrame) -> DataFrame:
    """requests, success, avg_ms (cut to a whole number), max_ms, error_rate (4 places); zeros for no rows."""
    n, ok = F.count("*"), F.coalesce(F.sum(F.col("ok").cast("int")), F.lit(0))
    return log.agg(
        n.alias("requests"), ok.cast("long").alias("success"), F.coalesce(F.avg("latency_ms"), F.lit(0.0)).cast("long").alias("avg_ms"),
        F.coalesce(F.max("latency_ms"), F.lit(0)).cast("long").alias("max_ms"), F.when(n > 0, F.round((n - ok) / n, 4)).otherwise(0.0).alias("error_rate"),
    )


def looked_up(rows: DataFrame, key: str, values: list) -> DataFrame:
    """The rows of given keys; the filter reaches the scan."""
    return rows.where(F.col(key).isin(*values)) if values else rows.limit(0)


def message_list(messages: DataFrame, most: int = 200) -> DataFrame:
    """The first `most` messages of every session, numbered from 1 in the order of time."""
    order = Window.partitionBy("session_id").orderBy("seq")
    return messages.withColumn("n", F.row_number().over(order)).where(F.col("n") <= most)


def case_list(cases: DataFrame, limit: int = 1000) -> DataFrame:
    """Evaluation cases, the oldest first."""
    return cases.orderBy("created_at", "id").limit(limit)


def run_list(runs: DataFrame, limit: int = 30) -> DataFrame:
    """Evaluation runs without their details, the newest first."""
    return runs.orderBy(F.desc("created_at"), "id").limit(limit).select("id", "label", "metrics", "n_cases", "created_at")


#: Columns that have to be there, and what they refer to: (column, table, its key). Fixed values.
REQUIRED = {
    "sessions": ("id", "title", "owner"), "messages": ("id", "session_id", "role", "content"), "feedback": ("id", "message_id", "rating"), "documents": ("doc_id", "file_name", "status"),
    "eval_cases": ("id", "query"), "eval_runs": ("id",), "request_log": ("kind",),
}
REFERENCES = {"messages": ("session_id", "sessions", "id"), "feedback": ("message_id", "messages", "id")}


def checked_present(rows: DataFrame, table: str) -> DataFrame:
    """Fails on a null in a required column."""
    out = rows
    for c in REQUIRED[table]:
        kind = rows.schema[c].dataType
        out = out.withColumn(c, F.when(F.col(c).isNull(), F.raise_error(F.lit(f"{table}.{c} is null")).cast(kind)).otherwise(F.col(c)))
    return out


def checked_reference(rows: DataFrame, table: str, parents: DataFrame) -> DataFrame:
    """Fails on a row that refers to nothing in the table that it belongs to."""
    column, of, key = REFERENCES[table]
    known = parents.select(F.col(key).alias("_known")).distinct()
    joined = rows.join(known, F.col(column) == F.col("_known"), "left")
    message = F.concat(F.lit(f"{table}.{column} refers to no row of {of}: "), F.coalesce(F.col(column).cast("string"), F.lit("null")))
    ok = F.when(F.col("_known").isNull(), F.raise_error(message).cast(rows.schema[column].dataType)).otherwise(F.col(column))
    return joined.withColumn(column, ok).drop("_known")


def inserted(stored: DataFrame, new: DataFrame, table: str, now: Column, by: tuple[str, ...], parents: DataFrame | None = None) -> DataFrame:
    """stored with the rows of `new` put in. Columns of the table that `new` doesn't have are null, but for ids, derived from the columns `by` and the time, and created_at and updated_at, the time. Constraints are checked."""
    made = new
    fields = T._parse_datatype_string(TABLES[table]).fields
    for f in fields:
        if f.name not in new.columns:
            value = stable_id(F.lit(table), *by, now.cast("string")) if f.name == "id" and f.dataType == T.StringType() else now if f.name in ("created_at", "updated_at") else F.lit(None)
            made = made.withColumn(f.name, value.cast(f.dataType))
    made = checked_present(made.select(*[F.col(f.name).cast(f.dataType) for f in fields]), table)
    if table == "feedback":
        made = checked_feedback(made)
    if table in REFERENCES and parents is not None:
        made = checked_reference(made, table, parents)
    return stored.unionByName(made.select(*stored.columns))


def json_encoded(rows: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """Arrays, maps and structs as JSON text; null stays null."""
    return rows.withColumns({c: F.to_json(c) for c in columns})


def json_decoded(rows: DataFrame, types: dict[str, str]) -> DataFrame:
    """JSON text as the given types; what is no such JSON is null."""
    return rows.withColumns({c: F.from_json(c, t) for c, t in types.items()})
