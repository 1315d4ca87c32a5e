"""From chunk hits to the passages around them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions.text import strip

PARENT = ("doc_id", "section_id", "context_id")
#: Siblings that are looked at, by chunk_index.
SIBLINGS = 50

_TH = r"(?s)^<th>(.*?)</th>\s*\n?"


def propagated_header(piece: Column) -> Column:
    """The header that was put before a table's piece; an empty text without one."""
    return strip(F.regexp_extract(piece, _TH, 1))


def without_header(piece: Column) -> Column:
    return F.regexp_replace(piece, _TH, "")


def rejoined_text(pieces: Column) -> Column:
    """Stripped pieces that aren't empty, a line each."""
    return F.concat_ws("\n", F.filter(F.transform(pieces, strip), lambda p: p != ""))


def rejoined_table(pieces: Column) -> Column:
    """One table of pieces: the first header there is, a separator unless the rows begin with one, and all rows."""
    headers = F.filter(F.transform(pieces, propagated_header), lambda h: h != "")
    header = F.coalesce(F.get(headers, F.lit(0)), F.lit(""))
    body = rejoined_text(F.transform(pieces, without_header))
    columns = F.greatest(F.lit(1), F.length(header) - F.length(F.replace(header, F.lit("|"))) - 1)
    separator = F.concat(F.lit("|"), F.array_join(F.array_repeat(F.lit(" --- "), columns), "|"), F.lit("|"))
    has = body.rlike(r"^\|[\s:-]+\|")
    return F.when(header == "", body).when(has, F.concat_ws("\n", header, body)).otherwise(F.concat_ws("\n", header, separator, body))


def distinct_parents(hits: DataFrame, most: int) -> DataFrame:
    """hits: query_id, rank, score, rerank_score (may be null), PARENT, and more. Keeps the best hit of each parent, the parents in the order in which they first appear, at most `most` a query.

    The best has the highest rerank_score, or score where that is null or 0; the earlier one of equals. Adds parent_rank.
    """
    value = F.coalesce(F.when(F.col("rerank_score") != 0, F.col("rerank_score")), F.col("score"))
    own = Window.partitionBy("query_id", *PARENT)
    best = (
        hits.withColumn("_first", F.min("rank").over(own))
        .withColumn("_n", F.row_number().over(own.orderBy(value.desc(), "rank"))).where("_n = 1").drop("_n")
    )
    order = Window.partitionBy("query_id").orderBy("_first")
    return best.withColumn("parent_rank", F.row_number().over(order)).where(F.col("parent_rank") <= most).drop("_first")


def siblings(chunks: DataFrame, most: int | None = SIBLINGS, by: tuple[str, ...] = ()) -> DataFrame:
    """Adds pos (from 0) and n_siblings to the first `most` chunks (None: all) of each parent, for each value of `by`."""
    own = Window.partitionBy(*by, *PARENT).orderBy("chunk_index")
    first = chunks.withColumn("pos", F.row_number().over(own) - 1)
    first = first if most is None else first.where(F.col("pos") < most)
    return first.withColumn("n_siblings", F.count("*").over(Window.partitionBy(*by, *PARENT)))


def passages(hits: DataFrame, chunks: DataFrame, window: int, most: int | None = SIBLINGS, by: tuple[str, ...] = ()) -> DataFrame:
    """hits: query_id, PARENT, chunk_index, and more. Adds snippet (the hit and `window` siblings on both sides; all of them if it isn't positive), page_no (their smallest) and is_parent.

    A hit that isn't among the siblings counts as the middle one. With one sibling or none, the hit's own snippet and page stay. One join fetches all siblings of all hits.
    by: columns of both that tell whose siblings they are, where callers see different ones.
    """
    place = [*by, *PARENT, "chunk_index"]
    near = siblings(chunks.select(*place, "page_no", "format", "snippet"), most, by).withColumnRenamed("chunk_index", "_index")
    # what is around a hit depends on its place only, so hits at the same one share it
    both = hits.select(*place).distinct().join(near, [*by, *PARENT])
    middle = F.coalesce(F.max(F.when(F.col("_index") == F.col("chunk_index"), F.col("pos"))).over(Window.partitionBy(*place)), F.floor(F.col("n_siblings") / 2))
    if window > 0:
        both = both.withColumn("_middle", middle).where(F.abs(F.col("pos") - F.col("_middle")) <= window)
    pieces = F.transform(F.array_sort(F.collect_list(F.struct("pos", "snippet"))), lambda x: x["snippet"])
    grouped = both.groupBy(*place).agg(
        pieces.alias("_pieces"), F.min("page_no").alias("_page"), F.max("n_siblings").alias("_n"), F.bool_and(F.col("format") == "table").alias("_table")
    )
    joined = hits.join(grouped, place, "left").select(*[F.col(c) for c in hits.columns], "_pieces", "_page", "_n", "_table")
    whole = F.col("_n") > 1
    text = F.when(F.col("_table"), rejoined_table(F.col("_pieces"))).otherwise(rejoined_text(F.col("_pieces")))
    return (
        joined.withColumn("snippet", F.when(whole, text).otherwise(F.col("snippet"))).withColumn("page_no", F.when(whole, F.col("_page")).otherwise(F.col("page_no")))
        .withColumn("is_parent", F.coalesce(whole, F.lit(False))).drop("_pieces", "_page", "_n", "_table")
    )
