"""Retrieval for a table of queries: filters, hybrid score, top-k, reranking, parents; and what is built on it: prompts, request logs, evaluation runs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.config import Settings, snapshot
from docloom.functions.text import stable_id
from docloom.session import broadcast_if_small, stored

from . import evaluation, filters, generation, parents, scoring
from .lexicon import Lexicon, session_index

#: The score of a reranker that keeps the order.
KEEP_ORDER = 0.0


def hybrid(
    queries: DataFrame, rows: DataFrame, key: str, as_of: Column, k: int, mode: str = "hybrid", text: str = "text", name: str = "file_name", date: str = "last_modified_date",
    vector: str = "vec", bm25_weight: float = 1.0, vector_weight: float = 1.0, places: int = 9, index: Lexicon | None = None,
) -> DataFrame:
    """query_id, key, score, rank: the k best rows of each query. queries: query_id, query and, for vectors, qvec (null where none could be had); rows: key, text, name, date, vector.

    The score is the sum of the mode's parts. Time decay is a part of every row's, so every row matches. But rows found by nothing else are in the order of their dates for any query: only the k newest can be among its
    best. So decay is added to the rows that words or vectors found, and the k newest are put beside them; nothing is computed for all pairs of queries and rows. Scores are to `places`, ties go by key.

    If queries have the columns filters.OWN, each gets only what it may see and asks for; rows then have acl_principals and document_type, too. All queries are one plan, whatever their filters: what words find is filtered as it is
    joined with its dates, before it is ranked; vectors and newest rows are filtered in the tasks that rank them. Frequencies and lengths of words are those of all rows. index: of text and name, if there is one; else both are split here.
    """
    parts = scoring.MODES[mode]
    own = [c for c in filters.OWN if c in queries.columns]
    attributes = ["acl_principals", "document_type"] if own else []
    weighted = queries.select("query_id", scoring.decay_weight(F.col("query")).alias("weight"), *own)
    weighted = stored(weighted.withColumn("_set", filters.set_number(*own)) if own else weighted, "weights")
    found: list[DataFrame] = []
    seconds = F.unix_timestamp(date).cast("double").alias("seconds")
    dated = rows.select(key, scoring.time_decay(F.col(date), as_of).alias("decay"), *attributes, *[F.col(date).alias("_date"), seconds] * bool(own))
    admitted = filters.admits(F.col("acl_principals"), F.col("document_type"), F.col("_date")) if own else F.lit(True)
    if "vector" in parts and "qvec" in queries.columns:
        near = scoring.knn(queries.select("query_id", "qvec", *own), rows.select(key, F.col(vector).alias("vec"), *attributes, *[seconds] * bool(own)), key, k)
        found.append(near.select("query_id", key, scoring.knn_score(F.col("similarity"), vector_weight).alias("value")))
    if "lexical" in parts:
        # a text that many ask is scored once; what each of them may see of it is told as they are ranked
        index = index or session_index(rows.select(key, text, name), key, (text, name))
        plain = queries.withColumn("query", F.coalesce("query", F.lit("")))
        texts = stored(plain.groupBy("query").agg(F.min("query_id").alias("text_id")), "texts")
        asked = stored(plain.select("query_id", "query").join(texts, "query").select("query_id", "text_id").join(weighted.select("query_id", "weight", *own), "query_id"), "asked")
        weights, phrases = index.lexical_weights(texts, text, name, bm25_weight)
        return index.best(weights, k, places, asked, dated.select(key, "decay", *attributes, *["seconds"] * bool(own)), stored(found[0], "near") if found else None, phrases)
    newest = []
    for w in (1.0, 2.0):
        scores = dated.withColumn("score", F.round(F.lit(w) * F.col("decay"), places))
        best = scoring.newest(scores, weighted.where(F.col("weight") == w), key, k) if own else scores.orderBy(F.desc("score"), key).limit(k)
        newest.append(best.select(*["_set"] * bool(own), key, F.lit(w).alias("weight"), "score"))
    recent = broadcast_if_small(weighted).join(reduce(DataFrame.unionByName, newest), ["weight", *["_set"] * bool(own)]).select("query_id", key, "score")
    if not found:
        return scoring.top_k(recent, key, k)
    scored = stored(reduce(DataFrame.unionByName, found).groupBy("query_id", key).agg(F.sum("value").alias("value")), "scored")
    hits = scored.join(dated, key).join(broadcast_if_small(weighted), "query_id")
    hits = hits.where(admitted).select("query_id", key, F.round(F.col("value") + F.col("weight") * F.col("decay"), places).alias("score"))
    rest = recent.join(scored.select("query_id", key), ["query_id", key], "left_anti")
    return scoring.top_k(hits.unionByName(rest), key, k)


def retrieve(
    queries: DataFrame, chunks: DataFrame, as_of: Column, settings: Settings | None = None, principals: list[str] | None = None, mode: str = "hybrid", scorer: Column | float | None = None, index: Lexicon | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(candidates, trace). queries: query_id, query, qvec if there are vectors, principals (array) if callers differ; chunks: the columns of schema.READ_FIELDS.

    Inline filters of a query are taken out of it and hold for what it gets, as do its caller's principals: those of its own column, else `principals`; null sees all. Rows that a caller may not see never come out, nor do they
    stand around hits. Any number of callers and filters is one job. The candidates (query_id, rank and the
    chunk's columns, score, normalized_score, rerank_score, is_parent) are reranked by `scorer`, a column of query and snippet or a number; without one, or for a single candidate, they keep their order and have
    no rerank_score. Then they give way to their parents, or, if settings.retrieval.return_parent is off, the first max_context_docs stay. trace: query_id, n_raw, n_reranked, n_parents. index: see hybrid().
    """
    own = (settings or Settings()).retrieval
    caller = F.col("principals") if "principals" in queries.columns else F.lit(None).cast("array<string>") if principals is None else F.array(*map(F.lit, principals))
    parsed = filters.parsed_query("query")
    asked = queries.select(
        "query_id", parsed["term"].alias("query"), *["qvec"] * ("qvec" in queries.columns), F.array_sort(F.array_distinct(caller)).alias("_principals"), *[parsed[c].alias(f"_{c}") for c in ("file_types", "date_from", "date_to")],
    )
    asked = stored(asked.withColumn("_caller", filters.set_number("_principals")), "queries")
    found = hybrid(asked, chunks, "chunk_uid", as_of, own.top_k, mode, "text_to_index", "file_name", "last_modified_date", "semantic_vector", own.bm25_weight, own.vector_weight, index=index)
    raw = stored(scoring.normalised(found), "hits")
    seen = ["doc_id", "section_id", "context_id", "chunk_index", "page_no", "format", "snippet", "header1", "header2", "file_name", "file_url"]
    full = raw.join(chunks.select("chunk_uid", *seen), "chunk_uid").join(broadcast_if_small(queries.select("query_id", "query")), "query_id")
    alone = raw.groupBy("query_id").agg(F.count("*").alias("n_raw"))
    if scorer is None:
        ranked = full.where(F.col("rank") <= own.rerank_top_n).withColumn("rerank_score", F.lit(None).cast("double"))
    else:
        by = F.lit(float(scorer)) if isinstance(scorer, int | float) else scorer
        ranked = scoring.rerank(full, own.rerank_top_n, by).join(broadcast_if_small(alone), "query_id")
        ranked = ranked.withColumn("rerank_score", F.when(F.col("n_raw") > 1, F.col("rerank_score"))).drop("n_raw")
    ranked = stored(ranked.drop("query"), "reranked")
    if own.return_parent:
        callers = asked.select("query_id", "_caller", "_principals")
        best = stored(parents.distinct_parents(ranked, own.max_context_docs).join(broadcast_if_small(callers.drop("_principals")), "query_id"), "best")
        # around the hits of a caller stands what that caller may see
        around = best.select("_caller", *parents.PARENT).distinct().join(callers.select("_caller", "_principals").dropDuplicates(["_caller"]), "_caller")
        visible = chunks.join(broadcast_if_small(around), list(parents.PARENT)).where(F.col("_principals").isNull() | F.arrays_overlap("acl_principals", "_principals"))
        out = parents.passages(best, visible, own.parent_window, by=("_caller",)).drop("rank", "_caller").withColumnRenamed("parent_rank", "rank")
    else:
        out = ranked.where(F.col("rank") <= own.max_context_docs).withColumn("is_parent", F.lit(False))
    out = stored(out, "candidates")
    count = lambda df, name: df.groupBy("query_id").agg(F.count("*").alias(name))
    trace = queries.select("query_id").join(alone, "query_id", "left").join(count(ranked, "n_reranked"), "query_id", "left").join(count(out, "n_parents"), "query_id", "left").fillna(0)
    return out, trace


def prepared(queries: DataFrame, candidates: DataFrame, trace: DataFrame, system: str, settings: Settings | None = None) -> DataFrame:
    """query_id, messages, n_packed, context_tokens and the trace's columns: what goes to a model. queries: query_id, query, history (array of role, content; may be null)."""
    own = (settings or Settings()).generation
    packed = generation.packed(candidates, own.context_budget_tokens, own.max_candidate_chars)
    sums = packed.groupBy("query_id").agg(F.count("*").alias("n_packed"), F.sum("cost").alias("context_tokens"))
    blocks = generation.context_blocks(packed, own.max_candidate_chars, queries)
    user = F.concat(F.col("context"), F.lit("\n\n"), F.col("query"))
    rows = queries.join(blocks, "query_id").join(sums, "query_id", "left").join(trace, "query_id", "left").fillna(0, ["n_packed", "context_tokens"])
    return rows.select("query_id", generation.assembled(F.col("history"), system, user).alias("messages"), "n_packed", "context_tokens", *[c for c in trace.columns if c != "query_id"])


def request_rows(requests: DataFrame, kind: str, now: Column) -> DataFrame:
    """Rows of the request log. requests: query_id, query, ok, latency_ms, stages (map), n_candidates; a null ok is a failure."""
    return requests.select(
        F.xxhash64(F.lit(kind), "query_id", now.cast("string")).alias("id"), F.lit(kind).alias("kind"), F.left("query", F.lit(500)).alias("query"), F.coalesce("ok", F.lit(False)).alias("ok"),
        F.coalesce("latency_ms", F.lit(0)).cast("bigint").alias("latency_ms"), F.col("stages").cast("map<string,bigint>").alias("stages"), F.coalesce("n_candidates", F.lit(0)).cast("int").alias("n_candidates"),
        now.cast("double").alias("created_at"),
    )


def run_cases(cases: DataFrame, candidates: DataFrame, documents: DataFrame, ks: tuple[int, ...] = evaluation.KS) -> DataFrame:
    """case_id, retrieved, expected (document ids), metric, value of every case. cases: case_id, expected_docs (ids, names or paths); candidates: query_id (the case's), rank, doc_id; documents: as evaluation.resolved() takes them.

    A case without candidates, as one that failed, has zeros.
    """
    name = candidates.select(F.col("query_id").alias("case_id"), F.col("rank").alias("pos"), F.col("doc_id").cast("string").alias("id"))
    wanted = cases.select("case_id", F.posexplode("expected_docs").alias("pos", "id"))
    none = F.array().cast("array<string>")
    both = (
        cases.select("case_id").join(evaluation.resolved(name, documents).withColumnRenamed("doc_ids", "retrieved"), "case_id", "left")
        .join(evaluation.resolved(wanted, documents).withColumnRenamed("doc_ids", "expected"), "case_id", "left")
        .select("case_id", F.coalesce("retrieved", none).alias("retrieved"), F.coalesce("expected", none).alias("expected"))
    )
    return both.join(evaluation.per_case(both, ks), "case_id")


def run_id(label: str, now: Column) -> Column:
    return stable_id(F.lit(label), now.cast("string"))


def run_row(results: DataFrame, label: str, now: Column, settings: Settings | None = None) -> DataFrame:
    """A run as one row of eval_runs: macro averages, the settings, the number of cases. results: as run_cases() gives. What each case got is a table of its own, run_details(), so the row doesn't grow with the cases; its details are empty."""
    config = F.create_map(*[F.lit(x) for pair in snapshot(settings or Settings()).items() for x in pair])
    means = evaluation.macro_average(results.select("case_id", "metric", "value")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("metric", "value")))).alias("metrics"))
    cases = results.select("case_id").distinct().agg(F.count("*").cast("int").alias("n_cases"))
    details = F.array().cast("array<map<string,string>>").alias("details")
    return means.join(cases).select(run_id(label, now).alias("id"), F.lit(label).alias("label"), config.alias("config"), "metrics", details, "n_cases", now.cast("double").alias("created_at"))  # one row each


def run_details(results: DataFrame, label: str, now: Column) -> DataFrame:
    """run_id, case_id, retrieved, metrics (map): a row for each case of a run."""
    case = results.groupBy("case_id", "retrieved").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("metric", "value")))).alias("metrics"))
    return case.select(run_id(label, now).alias("run_id"), F.col("case_id").cast("string").alias("case_id"), "retrieved", "metrics")


def save_run(run: DataFrame, path: str, details: DataFrame | None = None, details_path: str | None = None) -> None:
    """Appends a run to the table at path, what its cases got first, if given, to that at details_path. A run without cases is refused."""
    if run.where("n_cases > 0").isEmpty():
        raise ValueError("there are no cases")
    if details is not None and details_path is not None:
        details.write.mode("append").parquet(details_path)
    run.write.mode("append").parquet(path)

