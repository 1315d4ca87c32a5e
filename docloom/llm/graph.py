"""Connected components by contraction of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """The smallest id reachable from each end of the edges.

    edges: a long, b long, in any order and with repeats; self-loops and nulls are ignored.
    Returns id long, component long, for every id that has an edge to another.

    Each round points every node at its smallest neighbour or itself, follows the pointers until they end,
    and replaces the ends of the edges by what they point to. Any node that has a smaller neighbour
    vanishes; one without has only larger neighbours, which all vanish, so at least half of the nodes go in two rounds. Pointers only ever lead to smaller ids,
    so the last one standing is the smallest of its component. Both steps are equi-joins on long keys and sums
    combined before the shuffle; nothing is gathered for a node, however many neighbours it has.
    """
    spark = edges.sparkSession
    now = written(
        edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges"
    )
    labels: DataFrame | None = None
    for _ in range(max_rounds):
        if now.isEmpty():
            break
        # smallest neighbour or itself: b's is at most a; a's can be larger than a, so a itself counts
        both = now.select(F.col("b").alias("id"), F.col("a").alias("to")).union(now.select(F.col("a").alias("id"), F.col("a").alias("to")))
        point = written(both.groupBy("id").agg(F.min("to").alias("to")), "point")
        while True:
            jump = written(
                point.join(point.select(F.col("id").alias("to"), F.col("to").alias("next")), "to", "left")
                .select("id", F.coalesce("next", "to").alias("next"), (F.coalesce("next", "to") < F.col("to")).alias("moved")),
                "jump",
            )
            point = jump.select("id", F.col("next").alias("to"))
            if jump.where("moved").isEmpty():
                break
        a = point.select(F.col("id").alias("a"), F.col("to").alias("ta"))
        b = point.select(F.col("id").alias("b"), F.col("to").alias("tb"))
        now = written(
            now.join(a, "a").join(b, "b").where("ta <> tb")
            .select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).distinct(),
            "edges",
        )
        if labels is None:
            labels = point
        else:
            labels = written(
                labels.join(point.select(F.col("id").alias("to"), F.col("to").alias("next")), "to", "left")
                .select("id", F.coalesce("next", "to").alias("to")),
                "labels",
            )
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    if labels is None:
        return spark.createDataFrame([], "id long, component long")
    return labels.select("id", F.col("to").alias("component"))
