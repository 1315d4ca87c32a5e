"""Retrieval quality: recall, precision, MRR, nDCG, averages, comparison of runs, alias resolution."""

from __future__ import annotations

from functools import reduce
from itertools import accumulate
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KS = (1, 3, 5, 10)


def _top(retrieved: Column, k: int) -> Column:
    return F.slice(retrieved, F.lit(1), F.lit(k))


def recall_at(retrieved: Column, expected: Column, k: int) -> Column:
    """Expected ids among the first k, by expected ids; 0 without any."""
    want = F.array_distinct(expected)
    return F.when(F.size(want) > 0, F.size(F.array_intersect(_top(retrieved, k), want)) / F.size(want)).otherwise(0.0)


def hits(retrieved: Column, expected: Column) -> Column:
    """Of each place, whether an expected id is there. To be made once where several metrics are, as a function of each place isn't compiled."""
    return F.transform(retrieved, lambda r: F.coalesce(F.array_contains(expected, r), F.lit(False)))


def precision_at(retrieved: Column, expected: Column, k: int, found: Column | None = None) -> Column:
    """Expected ids among the first k, by how many there are of those; 0 without any. found: hits(), if they are there."""
    top = _top(hits(retrieved, expected) if found is None else found, k)
    return F.when(F.size(top) > 0, F.size(F.array_remove(top, False)) / F.size(top)).otherwise(0.0)


def reciprocal_rank(retrieved: Column, expected: Column, found: Column | None = None) -> Column:
    place = F.array_position(hits(retrieved, expected) if found is None else found, True)
    return F.when(place > 0, 1.0 / place).otherwise(0.0)


#: Places of which ndcg_at() writes out the sum, which is compiled then.
WRITTEN_OUT = 32


def ndcg_at(retrieved: Column, expected: Column, k: int, found: Column | None = None) -> Column:
    """Binary gains, 1 / log2(place + 1); an id that is there again counts again."""
    found = hits(retrieved, expected) if found is None else found
    most = F.greatest(F.lit(1), F.least(F.size(F.array_distinct(expected)), F.lit(k)))
    if k <= WRITTEN_OUT:
        gain = [1.0 / F.log2(F.lit(i + 1.0)) for i in range(1, k + 1)]
        got = reduce(add, [F.when(F.get(found, F.lit(i)), g).otherwise(0.0) for i, g in enumerate(gain)])
        return F.when(F.size(expected) > 0, got / F.element_at(F.array(*accumulate(gain, add)), most)).otherwise(0.0)
    gains = F.transform(_top(found, k), lambda h, i: F.when(h, 1.0 / F.log2(i + F.lit(2))).otherwise(0.0))
    ideal = F.transform(F.sequence(F.lit(1), most), lambda i: 1.0 / F.log2(i + F.lit(1)))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(expected) > 0, total(gains) / total(ideal)).otherwise(0.0)


def metrics(retrieved: Column, expected: Column, ks: tuple[int, ...] = KS, found: Column | None = None) -> dict[str, Column]:
    """By name, 4 places. found: hits(), if they are there."""
    out = {f"recall@{k}": recall_at(retrieved, expected, k) for k in ks}
    out |= {f"{n}@{k}": f(retrieved, expected, k, found) for n, f in (("precision", precision_at), ("ndcg", ndcg_at)) for k in ks}
    return {name: F.round(c, 4) for name, c in (out | {"mrr": reciprocal_rank(retrieved, expected, found)}).items()}


def per_case(cases: DataFrame, ks: tuple[int, ...] = KS) -> DataFrame:
    """cases: case_id, retrieved, expected. case_id, metric, value."""
    cases = cases.select("case_id", "retrieved", "expected", hits(F.col("retrieved"), F.col("expected")).alias("found"))
    own = metrics(F.col("retrieved"), F.col("expected"), ks, F.col("found"))
    pairs = F.array(*[F.struct(F.lit(n).alias("metric"), c.alias("value")) for n, c in own.items()])
    return cases.select("case_id", F.explode(pairs).alias("p")).select("case_id", "p.metric", "p.value")


def macro_average(values: DataFrame) -> DataFrame:
    """metric, value: the mean over the cases, 4 places."""
    return values.groupBy("metric").agg(F.round(F.avg("value"), 4).alias("value"))


def compare(before: DataFrame, after: DataFrame) -> DataFrame:
    """metric, before, after, delta, regressed of two runs (metric, value); a metric that a run doesn't have is 0."""
    b, a = before.select("metric", F.col("value").alias("before")), after.select("metric", F.col("value").alias("after"))
    both = b.join(a, "metric", "full_outer").fillna(0.0, ["before", "after"])
    return both.withColumn("delta", F.round(F.col("after") - F.col("before"), 4)).withColumn("regressed", F.col("after") < F.col("before") - 1e-9)


def resolved(ids: DataFrame, documents: DataFrame) -> DataFrame:
    """ids: case_id, pos, id (a doc_id, file name or path); documents: doc_id, file_name, file_path, indexed_at.

    case_id, doc_ids: each id once, in the order of first appearance; unknown ones as they are, null and empty ones dropped. A name of several documents is the newest's.
    """
    names = documents.select(
        "doc_id", "indexed_at", F.explode(F.array(F.struct(F.lit(0).alias("kind"), F.col("doc_id").alias("name")), F.struct(F.lit(1).alias("kind"), F.col("file_name").alias("name")), F.struct(F.lit(2).alias("kind"), F.col("file_path").alias("name")))).alias("n")
    ).select("doc_id", "indexed_at", "n.kind", "n.name").where("name <> ''")
    best = names.groupBy("name").agg(F.max_by("doc_id", F.struct("indexed_at", "doc_id")).alias("doc_id"))
    found = ids.where("id <> ''").join(best, ids["id"] == best["name"], "left").select("case_id", "pos", F.coalesce("doc_id", "id").alias("doc_id"))
    first = found.groupBy("case_id", "doc_id").agg(F.min("pos").alias("pos"))
    return first.groupBy("case_id").agg(F.sort_array(F.collect_list(F.struct("pos", "doc_id")))["doc_id"].alias("doc_ids"))


def worst(values: DataFrame, n: int, metric: str = "recall@5") -> DataFrame:
    """The n cases with the smallest values, the smaller case_id first among equals."""
    return values.where(F.col("metric") == metric).orderBy("value", "case_id").limit(n)


def previous_run(runs: DataFrame, label: str, run_id: str, most: int = 100) -> DataFrame:
    """The newest other run with the label among the last `most`."""
    last = runs.orderBy(F.desc("created_at"), F.desc("id")).limit(most)
    return last.where((F.col("label") == label) & (F.col("id") != run_id)).orderBy(F.desc("created_at"), F.desc("id")).limit(1)
