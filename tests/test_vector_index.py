"""The index of vectors against exact search, with rights and filters inside of its lists."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.operators import scoring, vector_index

PRINCIPALS = ["public", "user:a", "user:rare"]


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(1)
    middle = rng.normal(size=(12, 6))
    data = [(i, (middle[i % 12] + 0.3 * rng.normal(size=6)).tolist(), [PRINCIPALS[2 if i % 97 == 0 else i % 2]], "md" if i % 3 else "pdf", float(i)) for i in range(1500)]
    data += [(2000, None, ["public"], "md", 1.0), (2001, [0.0] * 6, ["public"], "md", 1.0), (2002, [1.0] * 4, ["public"], "md", 1.0), (2003, [float("nan")] * 6, ["public"], "md", 1.0)]
    return spark.createDataFrame(data, "key long, vec array<double>, acl_principals array<string>, document_type string, seconds double").repartition(4).cache()


@pytest.fixture(scope="module")
def index(rows, tmp_path_factory):
    return vector_index.VectorIndex.create(rows, str(tmp_path_factory.mktemp("vectors")), "key", per_list=50)


def queries(spark, rows, n=30):
    return rows.where("key < 1500 AND key % 50 = 7").select(F.col("key").alias("query_id"), F.col("vec").alias("qvec")).limit(n)


def got(df):
    return sorted((r.query_id, r["rank"], r.key, round(r.similarity, 9)) for r in df.collect())


def test_recall_is_measured_and_kept(spark, index):
    again = vector_index.VectorIndex.open(spark, index.path)
    assert index.content["recall"] >= vector_index.RECALL and again.content["recall"] == index.content["recall"] and again.content["probes"] == index.content["probes"]
    assert np.allclose(again.centres, index.centres) and index.content["probes"] < len(index.centres)


def test_all_lists_are_exact(spark, rows, index, monkeypatch):
    monkeypatch.setattr(vector_index, "QUERIES", 4)  # several blocks of queries
    q = queries(spark, rows)
    exact = got(scoring.knn(q, rows.where("key < 1500"), "key", 10))
    assert got(index.search(q, 10, len(index.centres))) == exact
    found = {(a, c) for a, _, c, _ in got(index.search(q, 10))}
    assert len(found & {(a, c) for a, _, c, _ in exact}) >= 0.9 * len(exact)


def test_filters_widen_the_search(spark, rows, index):
    """A caller who may see few vectors gets k of them, if there are as many, from however many lists."""
    own = queries(spark, rows).select("*", F.array(F.lit("user:rare")).alias("_principals"), F.array(F.lit("md")).alias("_file_types"), F.lit(None).cast("date").alias("_date_from"), F.lit(None).cast("date").alias("_date_to"))
    few = rows.where("key < 1500 AND key % 97 = 0 AND key % 3 <> 0")
    n = few.count()
    assert got(index.search(own, n + 3)) == got(scoring.knn(own.select("query_id", "qvec"), few, "key", n + 3))
    every = own.withColumn("_file_types", F.array().cast("array<string>"))
    assert got(index.search(every, 5, len(index.centres))) == got(scoring.knn(every.select("query_id", "qvec"), rows.where("key < 1500 AND key % 97 = 0"), "key", 5))
    by = {}
    for q, _, key, _ in got(index.search(own, 3)):
        by.setdefault(q, []).append(key)
    assert all(len(v) == 3 and all(k % 97 == 0 and k % 3 for k in v) for v in by.values()) and len(by) == own.count()


def test_no_vectors_and_odd_queries(spark, rows, index, tmp_path):
    odd = spark.createDataFrame([(1, None), (2, [1.0]), (3, [float("nan")] * 6)], "query_id long, qvec array<double>")
    assert index.search(odd, 3).count() == 0
    empty = vector_index.VectorIndex.create(rows.limit(0), str(tmp_path / "none"), "key")
    assert empty.search(odd, 3).count() == 0
