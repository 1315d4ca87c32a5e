"""Shards by a consistent-hash ring with virtual nodes and bounded loads.

The ring is cut into `cells` equal cells. Each shard owns `vnodes` virtual nodes, each at the start of a
cell; each document is at the cell of its id's hash and belongs to the first virtual node at or after it, clockwise.
Shards have fixed room: their rooms differ by one at most and add up to the number of rows. Walking the ring clockwise from its start, in the
order of (hash, doc_id), a row whose shard is full continues clockwise to the next virtual node of a shard with
room. So the law is `rows`: counts are at most one apart, whatever the ids are, and only what overflows moves away from its owner.

Only the row counts per cell (at most `cells` rows, a parameter that doesn't grow with the data) reach the driver. There the walk turns into
segments: ranks a..b of a cell go to one shard, from one slot on. They are at most cells + shards + vnodes * shards, so they are
broadcast. Rows are ranked inside their cell. The rest are DataFrame functions; there is no Python on the executors.
"""

from __future__ import annotations

from bisect import bisect_left

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import written

SHARDS, VNODES, CELLS = 40, 64, 1 << 14


def ring_nodes(spark: SparkSession, shards: int, vnodes: int = VNODES, cells: int = CELLS) -> list[tuple[int, int]]:
    """(cell, shard) of all virtual nodes, sorted. A shard's nodes don't depend on how many others there are."""
    nodes = (
        spark.range(shards, numPartitions=1).select(F.col("id").alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(vnodes - 1))).alias("v"))
        .select(F.pmod(F.xxhash64(F.lit("node"), "shard", "v"), F.lit(cells)).alias("cell"), "shard")
    )
    return sorted((r.cell, r.shard) for r in nodes.collect())


def segments(counts: dict[int, int], nodes: list[tuple[int, int]], shards: int) -> list[tuple[int, int, int, int, int]]:
    """(cell, first rank, last rank + 1, shard, slot of the first) for the rows of all cells, by the walk described above."""
    total = sum(counts.values())
    room = [total // shards + (s < total % shards) for s in range(shards)]
    used = [0] * shards
    places = [c for c, _ in nodes]
    after = list(range(len(nodes) + 1))  # the next node at or after i whose shard may have room; paths are shortened as they are walked

    def open_from(i: int) -> int:
        seen = []
        while i < len(nodes) and (after[i] != i or used[nodes[i][1]] >= room[nodes[i][1]]):
            seen.append(i)
            i = after[i] if after[i] != i else i + 1
        for j in seen:
            after[j] = i
        return i

    out = []
    for cell in sorted(counts):
        left, rank, at = counts[cell], 0, bisect_left(places, cell)
        while left:
            at = open_from(at)
            if at == len(nodes):  # past the ring's end: go on from its start; some shard has room, as rooms add up to the total
                at = open_from(0)
            shard = nodes[at][1]
            n = min(left, room[shard] - used[shard])
            out.append((cell, rank, rank + n, shard, used[shard]))
            used[shard] += n
            rank += n
            left -= n
    return out


def shard_documents(docs: DataFrame, shards: int = SHARDS, vnodes: int = VNODES, cells: int = CELLS) -> DataFrame:
    """Adds nothing to the texts and deals all rows into shards 0 .. shards - 1 under the law `rows`.

    docs: doc_id, text; other columns, whatever their names, are ignored.
    Returns doc_id, size (UTF-8 bytes of the text plus 16; null has none), text_crc32 (unsigned, of the UTF-8 bytes; 0 for null and
    empty), law 'rows', shard, slot (gapless from 0 in each shard), home_shard (the owner on the ring before overflow), grown_shard (null: only the law `key` has one).

    A null doc_id counts as an id of its own; rows with equal ids are ranked by crc and size, and those equal in
    all of these are interchangeable. No rows give no rows. Groups of equal texts don't matter: rows are placed by id.
    """
    spark = docs.sparkSession
    text = F.col("text").cast("binary")
    rows = docs.select(
        F.col("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 16).alias("size"),
        F.coalesce(F.crc32(text), F.lit(0).cast("long")).alias("text_crc32"),
        F.xxhash64(F.lit("key"), "doc_id").alias("at"),
    ).withColumn("cell", F.pmod(F.col("at"), F.lit(cells)).cast("int"))
    rows = written(rows, "shard-rows")
    counts = {r.cell: r["count"] for r in rows.groupBy("cell").count().collect()}  # at most `cells` rows
    nodes = ring_nodes(spark, shards, vnodes, cells)
    cut = spark.createDataFrame(
        segments(counts, nodes, shards), "cell int, rank_from long, rank_to long, shard int, slot_from long"
    )
    places = [c for c, _ in nodes]
    home = spark.createDataFrame(
        [(c, nodes[bisect_left(places, c) % len(nodes)][1]) for c in counts], "cell int, home_shard int"
    )
    cut = cut.join(F.broadcast(home), "cell")
    order = Window.partitionBy("cell").orderBy("at", F.col("doc_id").asc_nulls_first(), "text_crc32", "size")
    ranked = rows.withColumn("rank", F.row_number().over(order).cast("long") - 1)
    r, c = ranked.alias("r"), F.broadcast(cut.alias("c"))
    return r.join(
        c, (F.col("r.cell") == F.col("c.cell")) & (F.col("rank") >= F.col("rank_from")) & (F.col("rank") < F.col("rank_to"))
    ).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard",
        (F.col("slot_from") + F.col("rank") - F.col("rank_from")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), "home_shard",
    )


def op4_ring_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
