"""A stored index of vectors: lists around centres, with what rights and filters need inside of the lists.

Centres are found by k-means of a bounded sample; every vector is in the list of its nearest centre. A search goes through the lists in the order of their centres' nearness to the query, `probes` of them and then twice as many as before, until
the query has k vectors that it may see and asks for, or no list is left. With all lists as probes it is exact. The recall against exact search, and the probes that it takes, are measured when the index is made and kept with it.

Lists and queries meet through a shuffle, in blocks of both, so neither a list with a third of all vectors nor a list that all queries want is one task's, and no query goes through the driver.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.session import broadcast_if_small, map_batches, shared_path, stored

from . import filters, scoring, versions

#: Vectors that centres are found from; lists at most, and vectors of a list that are wished for; rounds of k-means.
SAMPLE, MOST_LISTS, PER_LIST, ROUNDS = 20_000, 4096, 256, 8
#: Vectors and queries that meet in a task at a time.
BLOCK, QUERIES = 4096, 1024
#: Queries of an audit, and the recall that it asks for.
AUDIT, RECALL = 200, 0.95


def centres_of(vectors: np.ndarray, n: int, rounds: int = ROUNDS, seed: int = 5) -> np.ndarray:
    """Centres of length 1, by k-means of vectors of length 1. A centre that nothing is near to stays where it is."""
    rng = np.random.default_rng(seed)
    centres = vectors[rng.choice(len(vectors), min(n, len(vectors)), replace=False)]
    for _ in range(rounds):
        near = np.concatenate([(vectors[i : i + 4096] @ centres.T).argmax(1) for i in range(0, len(vectors), 4096)])
        sums = np.zeros_like(centres)
        np.add.at(sums, near, vectors)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(norm > 0, sums / np.maximum(norm, 1e-300), centres)
    return centres


@dataclass(frozen=True)
class VectorIndex:
    """An index at a path. Rows: key, vec, and where queries have filters acl_principals, document_type and seconds."""

    spark: SparkSession
    path: str
    content: dict = field(repr=False)
    centres: np.ndarray = field(repr=False)

    @classmethod
    def create(cls, rows: DataFrame, path: str, key: str, recall: float = RECALL, per_list: int = PER_LIST) -> VectorIndex:
        """Vectors that are null, of length 0 or another length than the first of the sample, or hold what is no number are near to nothing and not stored."""
        spark = rows.sparkSession
        usable = F.col("vec").isNotNull() & (F.size("vec") > 0) & ~F.exists("vec", lambda x: x.isNull() | F.isnan(x.cast("double"))) & F.exists("vec", lambda x: x != 0)
        good = rows.where(usable & F.col(key).isNotNull())
        sample = good.select("vec", F.xxhash64(key).alias("h")).orderBy("h").limit(SAMPLE).collect()  # a bounded sample, the same whenever it is drawn
        dims = len(sample[0].vec) if sample else 0
        units = scoring._units([r.vec for r in sample if len(r.vec) == dims]) if sample else np.zeros((0, 1))
        n = good.count()
        centres = centres_of(units, min(MOST_LISTS, max(1, n // per_list))) if len(units) else units
        held = spark.sparkContext.broadcast(centres)
        schema = good.where(F.size("vec") == dims).schema

        def listed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                yield b.assign(list=(scoring._units(b["vec"].tolist()) @ held.value.T).argmax(1)) if len(b) else b.assign(list=0)

        ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
        name = f"lists/{uuid.uuid4().hex}"
        assigned = map_batches(good.where(F.size("vec") == dims), listed, f"{ddl}, list int", (key,))
        counts = stored(assigned, "assigned")
        sizes = counts.groupBy("list").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
        block = F.pmod(F.xxhash64(key), F.col("blocks")).cast("int")
        dealt = counts.join(broadcast_if_small(sizes), "list").withColumn("block", block).drop("blocks").repartitionByRange("list", "block", key)
        dealt.sortWithinPartitions("list", "block", key).write.parquet(f"{path}/{name}")
        content = {"key": key, "name": name, "schema": spark.read.parquet(f"{path}/{name}").schema.json(), "blocks": {str(r["list"]): r.blocks for r in sizes.collect()}, "n": n, "dims": dims, "probes": 1, "recall": None}
        index = cls(spark, path, content, centres)
        if len(units):
            index = index._audited(recall)
        versions.commit(spark, path, 0, {**index.content, "centres": centres.tolist()})
        return index

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> VectorIndex:
        content = versions.manifest(spark, path, 0)
        return cls(spark, path, content, np.array(content.pop("centres")))

    @property
    def key(self) -> str:
        return self.content["key"]

    def read(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{self.content['name']}")

    def _audited(self, least: float) -> VectorIndex:
        """Doubles the probes until AUDIT of the vectors, as queries, find the share `least` of their ten nearest."""
        rows = self.read()
        asked = stored(rows.orderBy(F.xxhash64(F.col(self.key), F.lit(1))).limit(AUDIT).select(F.col(self.key).alias("query_id"), F.col("vec").alias("qvec")), "audit")
        want = stored(scoring.knn(asked, rows.select(self.key, "vec"), self.key, 10).select("query_id", self.key), "audit-exact")
        total, probes = want.count(), 1
        while True:
            index = VectorIndex(self.spark, self.path, {**self.content, "probes": probes}, self.centres)
            found = index.search(asked, 10).join(want, ["query_id", self.key], "left_semi").count()
            if found >= least * total or probes >= len(self.centres):
                return VectorIndex(self.spark, self.path, {**index.content, "recall": found / total if total else 1.0}, self.centres)
            probes = min(2 * probes, len(self.centres))

    def _wanted(self, queries: DataFrame, first: int, last: int) -> DataFrame:
        """queries with a row for each of the lists number first .. last - 1 in their order, and each block of it."""
        centres, blocks, kind = self.spark.sparkContext.broadcast(self.centres), self.content["blocks"], queries.schema["query_id"].dataType.simpleString()

        def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                order = np.argsort(-(scoring._units(b["qvec"].tolist()) @ centres.value.T), axis=1, kind="stable")[:, first:last]
                out = [(q, int(x), k) for q, row in zip(b["query_id"], order, strict=True) for x in row for k in range(blocks.get(str(x), 0))]
                yield pd.DataFrame(out, columns=["query_id", "list", "block"])

        return map_batches(queries.select("query_id", "qvec"), near, f"query_id {kind}, list int, block int", ("query_id",)).join(queries, "query_id")

    def search(self, queries: DataFrame, k: int, probes: int | None = None) -> DataFrame:
        """query_id, key, similarity, rank of the k nearest that are found. queries: query_id, qvec and, if wished, filters.OWN."""
        own = [c for c in filters.OWN if c in queries.columns]
        attributes = ["acl_principals", "document_type", "seconds"] if own else []
        usable = F.col("qvec").isNotNull() & (F.size("qvec") == self.content["dims"]) & ~F.exists("qvec", lambda x: x.isNull() | F.isnan(x.cast("double")))
        left = stored(queries.where(usable).select("query_id", "qvec", *own), "ann-queries")
        rows = self.read().select("list", "block", self.key, "vec", *attributes)
        order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), self.key)
        found: DataFrame | None = None
        first, last = 0, min(probes or self.content["probes"], len(self.centres))
        while first < len(self.centres):
            got = self._met(self._wanted(left, first, last), rows, k, bool(own))
            found = stored((got if found is None else found.unionByName(got)).withColumn("r", F.row_number().over(order)).where(F.col("r") <= k).drop("r"), "ann-found")
            first, last = last, min(2 * last, len(self.centres))
            enough = found.groupBy("query_id").agg(F.count("*").alias("n")).where(F.col("n") >= k).select("query_id")
            left = stored(left.join(enough, "query_id", "left_anti"), "ann-left")
            if left.isEmpty():
                break
        if found is None:
            found = self._met(left.limit(0).withColumns({"list": F.lit(0), "block": F.lit(0)}), rows, k, bool(own))
        return found.withColumn("rank", F.row_number().over(order))

    def _met(self, wanted: DataFrame, rows: DataFrame, k: int, filtered: bool) -> DataFrame:
        """query_id, key, similarity: the k nearest of each query in each block that it wants."""
        wanted = stored(wanted, "ann-wanted")
        parts = wanted.groupBy("list", "block").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("parts"))
        parts = broadcast_if_small(stored(parts, "ann-parts"))
        asked = wanted.join(parts, ["list", "block"]).withColumn("part", F.pmod(F.xxhash64("query_id"), F.col("parts")).cast("int")).drop("parts")
        own = rows.join(parts, ["list", "block"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
        kinds, key = (wanted.schema["query_id"].dataType.simpleString(), rows.schema[self.key].dataType.simpleString()), self.key

        def nearest(q: pd.DataFrame, v: pd.DataFrame) -> pd.DataFrame:
            v = v.sort_values(key)
            s = np.round(scoring._units(v["vec"].tolist()) @ scoring._units(q["qvec"].tolist()).T, scoring.PLACES)
            if filtered:
                masks = filters.Masks(r for _, r in q.iterrows())
                s[~masks.bits(v)[masks.of].T] = np.nan
            top = np.argsort(np.where(np.isnan(s), np.inf, -s), axis=0, kind="stable")[:k]
            out = pd.DataFrame({"query_id": np.repeat(q["query_id"].to_numpy()[None, :], len(top), 0).ravel(), key: v[key].to_numpy()[top].ravel(), "similarity": np.take_along_axis(s, top, 0).ravel()})
            return out.dropna(subset="similarity")

        by = ["list", "block", "part"]
        both = asked.groupBy(*by).cogroup(own.groupBy(*by))
        return both.applyInPandas(lambda q, v: nearest(q, v) if len(q) and len(v) else pd.DataFrame({"query_id": [], key: [], "similarity": []}), f"query_id {kinds[0]}, `{key}` {kinds[1]}, similarity double")


def session_index(rows: DataFrame, key: str, recall: float = RECALL) -> VectorIndex:
    """An index of rows in the shared folder, for as long as the session."""
    return VectorIndex.create(rows, shared_path(rows.sparkSession, "vectors"), key, recall)
