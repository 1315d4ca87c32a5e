"""Mixing of sources to target weights, with copies chosen by hash-seeded Bernoulli draws."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import written

#: The weights of the sources in code-point order, null last, repeating; the share of all words that the mix takes; the most a source is repeated.
WEIGHTS, SHARE, MOST = (3, 1, 2), 1.5, 2.0
#: Seeds of the draws, and how near, as a share of the target, what a source takes has to come to it for a seed to do.
SEEDS, NEAR = 64, 0.02


def word_count(column: str) -> Column:
    r"""Number of `[^\x20\x09-\x0D]+` in a text; 0 for null."""
    return F.coalesce(F.regexp_count(column, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def ranked(sizes: DataFrame) -> DataFrame:
    """Adds place, 0 and on, in the order of the sources by code point, null last. Sources are dealt out by ranges and counted by range, so no task ranks them all."""
    ranges = written(sizes.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("range", F.spark_partition_id()), "sources")
    upto = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    before = ranges.groupBy("range").agg(F.count("*").alias("n")).select("range", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("before"))
    own = Window.partitionBy("range").orderBy(F.col("source").asc_nulls_last())
    return ranges.withColumn("at", F.row_number().over(own) - 1).join(before, "range").select(*sizes.columns, (F.col("before") + F.col("at")).alias("place"))


def source_targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """sizes: source, source_size, a row for each source. Adds target.

    Each source gets level * weight words, or most * its size if that is less; the level makes the sum share * all sizes. It is
    found as the text says: share out by weight, stop those above their limit, share out the excess again until none is above. Every round is one sum
    over the sources and each but the last stops at least one; as all below the new level stop at once, there are few rounds.
    """
    weight = F.element_at(F.array(*map(F.lit, map(float, weights))), (F.col("place") % len(weights) + 1).cast("int"))
    held = written(ranked(sizes).withColumn("weight", weight).withColumn("limit", F.col("source_size") * F.lit(float(most))), "limits")
    total = held.agg(F.sum("source_size")).first()[0] or 0
    level, stopped = 0.0, None
    while True:
        above = F.col("weight") * F.lit(level) >= F.col("limit") if stopped is not None else F.lit(False)
        got = held.agg(
            F.sum(F.when(above, F.col("limit")).otherwise(0.0)), F.sum(F.when(above, 0.0).otherwise(F.col("weight"))), F.count_if(above)
        ).first()
        if not got[1] or got[2] == stopped:
            break
        stopped, level = got[2], max(0.0, share * total - got[0]) / got[1]
    return held.select("source", "source_size", F.least(F.col("weight") * F.lit(level), F.col("limit")).alias("target"))


def draw(seed: int | Column) -> Column:
    """Of a document, by its doc_id: in [0, 1), with 2^-52 steps."""
    return F.shiftrightunsigned(F.xxhash64("doc_id", seed if isinstance(seed, Column) else F.lit(seed)), 12) / F.lit(float(1 << 52))


def with_plan(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """rows with their source's plan in a struct `plan`. Spark broadcasts the plan while its size is below the session's limit; beyond, a source that is large is split by adaptive execution."""
    p = plan.select(F.col("source").alias("_of"), F.struct(*plan.columns).alias("plan"))
    return rows.join(p, F.col("source").eqNullSafe(F.col("_of"))).drop("_of")


def source_plan(rows: DataFrame, seeds: int = SEEDS, near: float = NEAR, **options) -> DataFrame:
    """rows: doc_id, source, size. By source: source_size, target, whole (copies of each document), fraction (of one more) and the seed of its draws.

    The seed is 0 for a source of which it takes words as near to the target as `near` says, as it does of any large one. Small sources with long documents often miss: of those, the first of `seeds` seeds that comes
    so near counts, the nearest if none does. Sums are combined before they are shuffled, so a source with a third of all rows is like any other.
    """
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    plan = written(source_targets(sizes, **options).withColumn("whole", F.floor(rate)).withColumn("fraction", rate - F.floor(rate)), "mix-plan")

    def misses(these: DataFrame, numbers: range) -> DataFrame:
        """source and, for each seed, how far what it takes is from the target, as a share of it."""
        took = [F.sum(F.when(draw(k) < F.col("plan.fraction"), F.col("size")).otherwise(0)).alias(f"t{k}") for k in numbers]
        sums = with_plan(rows, these).groupBy("source").agg(*took)
        off = lambda k: F.abs(F.col(f"t{k}") + F.col("plan.whole") * F.col("plan.source_size") - F.col("plan.target")) / F.greatest(F.col("plan.target"), F.lit(1.0))
        return with_plan(sums, these).select("source", F.array(*[F.struct(off(k).alias("off"), F.lit(k).alias("seed")) for k in numbers]).alias("tried"))

    missed = written(misses(plan, range(1)).where(F.get("tried", F.lit(0))["off"] > near).select("source"), "mix-missed")
    if seeds < 2 or missed.isEmpty():
        return plan.withColumn("seed", F.lit(0))
    again = plan.join(missed.select(F.col("source").alias("_of")), F.col("source").eqNullSafe(F.col("_of")), "left_semi")
    first = F.get(F.filter("tried", lambda t: t["off"] <= near), F.lit(0))["seed"]
    found = misses(again, range(seeds)).select(F.col("source").alias("_of"), F.coalesce(first, F.array_min("tried")["seed"]).alias("seed"))
    chosen = plan.join(found, F.col("source").eqNullSafe(F.col("_of")), "left").drop("_of")
    return written(chosen.withColumn("seed", F.coalesce("seed", F.lit(0))), "mix-seeds")


def copies() -> Column:
    """Of a row that has its plan."""
    return F.col("plan.whole") + (draw(F.col("plan.seed")) < F.col("plan.fraction")).cast("long")


def mixed_rows(docs: DataFrame, **options) -> DataFrame:
    """How often the mix takes each document. docs: doc_id, source, size (words); the other columns are dropped.

    A source's rate is target / size. Each of its documents is taken floor(rate) times, and once more if its draw, a hash of doc_id and the source's seed, is
    below the fraction. Nothing is sorted or gathered by source.

    Returns doc_id, source, size, source_size, target, copies, taken. Null sources are one source, the last. Rows with the same doc_id
    get the same draw; a null doc_id is an id like any other. Documents without words are taken floor(rate) or one more times too, as 0 words. A source without words has the target 0 and the rate 0.
    Very long documents count whole: one is taken or not. No rows give no rows.
    """
    rows = written(docs.select("doc_id", "source", F.col("size").cast("long").alias("size")), "mix-rows")
    out = with_plan(rows, source_plan(rows, **options))
    return out.select("doc_id", "source", "size", "plan.source_size", "plan.target", copies().alias("copies")).withColumn("taken", F.col("size") * F.col("copies"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mixed corpus: the columns of docs, each row as many times as it is taken (see mixed_rows); sizes are words of the text. Texts aren't shuffled while the plan is small enough to be broadcast."""
    plan = source_plan(written(docs.select("doc_id", "source", word_count("text").alias("size")), "mix-rows"), **options)
    rows = docs.select("doc_id", "source", F.struct("*").alias("row"))
    taken = with_plan(rows, plan).select("row", copies().alias("n")).where("n > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("n").cast("int")))).select("row.*")


def op10_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mixed_rows(docs.select("doc_id", "source", word_count("text").alias("size"))).drop("source")
