"""What surrounds a language model: packing, prompts, citations and their verification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions.text import LIMITS, heuristic_tokens, sentences
from docloom.functions.vectors import cosine

#: Tokens kept for the rest of the prompt, the least that is left for the context, and what a candidate costs besides its text.
RESERVED, LEAST, OVERHEAD = 800, 500, 30
HISTORY = 6
CITATION = r"\[(\d+(?:\s*[,，]\s*\d+)*)\]"


def packed(candidates: DataFrame, budget: int, max_chars: int) -> DataFrame:
    """candidates: query_id, rank, snippet, and more. Keeps the longest run from rank 1 that fits into the budget, and rank 1 always. Adds cost."""
    cost = heuristic_tokens(F.left("snippet", F.lit(max_chars))) + OVERHEAD
    upto = F.sum("cost").over(Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    first = F.min("rank").over(Window.partitionBy("query_id"))
    return (
        candidates.withColumn("cost", cost).withColumn("_upto", upto).withColumn("_first", first)
        .where((F.col("_upto") <= max(budget - RESERVED, LEAST)) | (F.col("rank") == F.col("_first"))).drop("_upto", "_first")
    )


def formatted(number: Column, max_chars: int, untitled: str = "untitled", place: str = "Location: ", body: str = "Content:") -> Column:
    """A candidate (file_name, header1, header2, page_no, snippet) as it stands in a prompt."""
    text = F.when(F.length("snippet") > max_chars, F.concat(F.left("snippet", F.lit(max_chars)), F.lit("…"))).otherwise(F.coalesce("snippet", F.lit("")))
    title = F.concat(F.lit("["), number.cast("string"), F.lit("] "), F.coalesce(F.nullif(F.col("file_name"), F.lit("")), F.lit(untitled)))
    heading = F.coalesce(F.nullif(F.col("header2"), F.lit("")), F.nullif(F.col("header1"), F.lit("")))
    where = F.concat_ws(" · ", heading, F.when(F.col("page_no") > 0, F.concat(F.lit("p."), F.col("page_no").cast("string"))))
    return F.concat_ws("\n", title, F.when(where != "", F.concat(F.lit(place), where)), F.concat(F.lit(body + "\n"), text))


def context_blocks(candidates: DataFrame, max_chars: int, queries: DataFrame | None = None, nothing: str = "No matching material was found.") -> DataFrame:
    """query_id, context: candidates numbered by rank, between rules. Queries without any get the hint that there is nothing."""
    order = Window.partitionBy("query_id").orderBy("rank")
    lines = candidates.withColumn("_n", F.row_number().over(order)).select("query_id", "_n", formatted(F.col("_n"), max_chars).alias("_line"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", "_line"))), lambda x: x["_line"]), "\n\n---\n\n")
    out = lines.groupBy("query_id").agg(joined.alias("context"))
    if queries is not None:
        out = queries.select("query_id").distinct().join(out, "query_id", "left").withColumn("context", F.coalesce("context", F.lit(nothing)))
    return out


def assembled(history: Column, system: str, user: Column, most: int = HISTORY) -> Column:
    """The messages of a request: the system's, the last `most` of the history (array of role, content), the user's."""
    message = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    old = F.coalesce(history, F.array().cast("array<struct<role:string,content:string>>"))
    last = F.slice(old, F.greatest(F.lit(1), F.size(old) - most + 1), F.lit(most))
    return F.concat(F.array(message("system", F.lit(system))), last, F.array(message("user", user)))


def citations(answer: Column, n: Column) -> Column:
    """Numbers cited in an answer, 1 to n, in the order of their first appearance."""
    groups = F.regexp_extract_all(answer, F.lit(CITATION), F.lit(1))
    numbers = F.flatten(F.transform(groups, lambda g: F.transform(F.split(g, r"\s*[,，]\s*"), lambda x: x.try_cast("int"))))
    return F.array_distinct(F.filter(numbers, lambda x: (x >= 1) & (x <= n)))


def sources(answers: DataFrame, candidates: DataFrame) -> DataFrame:
    """answers: query_id, cited (array); candidates: query_id, rank, file_name, file_url, page_no, snippet, normalized_score, rerank_score. A row for each cited candidate, in the order of citation (seq from 0)."""
    cited = answers.select("query_id", F.posexplode("cited").alias("seq", "rank"))
    return cited.join(candidates, ["query_id", "rank"]).select(
        "query_id", "seq", "rank", "file_name", "file_url", "page_no", F.left("snippet", F.lit(LIMITS["snippet"])).alias("snippet"),
        F.round(F.coalesce("rerank_score", "normalized_score"), 4).alias("score"),
    )


def cited_sentences(answers: DataFrame) -> DataFrame:
    """query_id, sentence_no, sentence, rank: each sentence with each number that it cites. answers: query_id, answer, n."""
    each = answers.select("query_id", "n", F.posexplode(sentences("answer")).alias("sentence_no", "sentence"))
    return each.select("query_id", "sentence_no", "sentence", F.explode(citations(F.col("sentence"), F.col("n"))).alias("rank"))


def support(cited: DataFrame, sentence_vectors: DataFrame, candidate_vectors: DataFrame, threshold: float) -> DataFrame:
    """query_id, sentence_no, support (the highest cosine to what the sentence cites, 4 places), weak (below the threshold). Vectors: query_id, sentence_no, vec and query_id, rank, vec. Sentences without vectors drop out."""
    s = sentence_vectors.withColumnRenamed("vec", "svec")
    c = candidate_vectors.withColumnRenamed("vec", "cvec")
    both = cited.join(s, ["query_id", "sentence_no"]).join(c, ["query_id", "rank"])
    best = both.groupBy("query_id", "sentence_no").agg(F.max(cosine(F.col("svec"), F.col("cvec"))).alias("_best"))
    return best.select("query_id", "sentence_no", F.round("_best", 4).alias("support"), (F.col("_best") < threshold).alias("weak"))


def rewrite_transcript(turns: DataFrame, most: int = 6, chars: int = 500) -> DataFrame:
    """turns: session_id, seq, role, content. session_id, transcript: the last `most` user and assistant turns, cut, a line each."""
    kept = turns.where(F.col("role").isin("user", "assistant"))
    last = Window.partitionBy("session_id").orderBy(F.desc("seq"))
    line = F.concat(F.col("role"), F.lit(": "), F.left("content", F.lit(chars)))
    rows = kept.withColumn("_n", F.row_number().over(last)).where(F.col("_n") <= most).select("session_id", "seq", line.alias("line"))
    return rows.groupBy("session_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "line"))), lambda x: x["line"]), "\n").alias("transcript"))


def rewritten(original: Column, answer: Column, most: int = 300) -> Column:
    """The first line of a model's rewrite without quotes; the original if that is null, empty or too long."""
    line = F.regexp_replace(F.trim(F.element_at(F.split(F.trim(answer), "\n"), 1)), "^[\"'“”‘’「」]+|[\"'“”‘’「」]+$", "")
    return F.when((F.length(line) > 0) & (F.length(line) <= most), line).otherwise(original)
