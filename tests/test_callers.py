"""Queries with rights and filters of their own, any number of them in one job."""

import random
from datetime import date

import numpy as np
from pyspark.sql import functions as F

from docloom.config import Retrieval, Settings
from docloom.operators import filters, retrieval, scoring

from .test_retrieval import as_of, chunk_rows

PRINCIPALS = ["public", "user:a", "user:b", "group:x"]


def asked(spark, rows):
    return spark.createDataFrame(rows, "query_id int, query string, principals array<string>, qvec array<double>")


def test_each_caller_sees_its_own(spark):
    rng = np.random.default_rng(1)
    acl = [[PRINCIPALS[i % 4]] for i in range(40)]
    chunks = chunk_rows(spark, [f"travel report number{i}" for i in range(40)], rng.normal(size=(40, 4)).tolist(), acl, ["pdf", "md"] * 20)
    rows = [(k, f"travel report{' type:pdf' if k % 2 else ''}", None if k % 5 == 4 else ["public"] + PRINCIPALS[1 : 1 + k % 4], rng.normal(size=4).tolist()) for k in range(150)]
    queries = asked(spark, rows)
    for mode in scoring.MODES:
        out, trace = retrieval.retrieve(queries, chunks, as_of(), Settings(retrieval=Retrieval(top_k=30, max_context_docs=30, rerank_top_n=30)), mode=mode)
        got = {}
        for r in out.collect():
            got.setdefault(r.query_id, set()).add(int(r.doc_id[1:]))
        for k, q, own, _ in rows:
            want = {i for i in range(40) if (own is None or acl[i][0] in own) and ("pdf" not in q or i % 2 == 0)}
            assert got.get(k, set()) == want if len(want) <= 30 else len(got[k]) == 30 and got[k] <= want, (mode, k)


def test_what_stands_around_a_hit_is_visible_to_its_caller(spark):
    """One document whose middle chunk is another's."""
    chunks = chunk_rows(spark, ["one", "two", "three"], acl=[["public"], ["user:b"], ["public"]]).withColumn("chunk_index", F.substring("doc_id", 2, 1).cast("int")).withColumn("doc_id", F.lit("d"))
    chunks = chunks.withColumn("chunk_uid", F.concat(F.lit("d:"), F.col("chunk_index").cast("string")))
    queries = spark.createDataFrame([(1, "one", ["public"]), (2, "one", ["public", "user:b"]), (3, "one", None), (4, "one", [])], "query_id int, query string, principals array<string>")
    got = {r.query_id: r.snippet for r in retrieval.retrieve(queries, chunks, as_of())[0].collect()}
    assert got == {1: "one\nthree", 2: "one\ntwo\nthree", 3: "one\ntwo\nthree"}


def test_different_sets_have_different_numbers(spark):
    rows = [(None, None), ([], None), (None, []), ([], []), (["a"], ["b"]), (["a", "b"], []), ([], ["a", "b"]), (["ab"], []), ([None], []), (["a", None], ["b"])]
    df = spark.createDataFrame(rows, "p array<string>, t array<string>")
    assert df.select(filters.set_number("p", "t")).distinct().count() == len(rows)


def test_masks_are_the_predicate(spark):
    rng = random.Random(2)
    days = [None, date(2024, 1, 1), date(2024, 1, 5)]
    rows = [(i, rng.choice([None, [], ["a"], ["a", "b"], ["c"]]), rng.choice([None, "md", "pdf"]), rng.choice([None, 1704067199, 1704067200, 1704499199, 1704499200, -5])) for i in range(60)]
    queries = [(k, rng.choice([None, [], ["a"], ["b", "c"]]), rng.choice([None, [], ["md"], ["md", "pdf", "x"]]), rng.choice(days), rng.choice(days)) for k in range(60)]
    r = spark.createDataFrame(rows, "key int, acl array<string>, kind string, s long").withColumn("at", F.timestamp_seconds("s"))
    q = spark.createDataFrame(queries, "query_id int, _principals array<string>, _file_types array<string>, _date_from date, _date_to date")
    want = {(x.query_id, x.key) for x in r.crossJoin(q).where(filters.admits(F.col("acl"), F.col("kind"), F.col("at"))).select("query_id", "key").collect()}
    own = q.collect()
    masks = filters.Masks(own)
    batch = r.select("key", F.col("acl").alias("acl_principals"), F.col("kind").alias("document_type"), F.col("s").cast("double").alias("seconds")).toPandas()
    bits = masks.bits(batch)[masks.of]
    assert {(own[a].query_id, int(batch["key"][b])) for a, b in zip(*np.nonzero(bits), strict=True)} == want and len(masks.numbers) < 60


def test_newest_and_nearest_with_filters_in_blocks(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=3).tolist(), [PRINCIPALS[i % 4]], "md", float(i), float(rng.integers(0, 5))) for i in range(80)]
    v = spark.createDataFrame(rows, "key long, vec array<double>, acl_principals array<string>, document_type string, seconds double, score double").repartition(3)
    own = [(k, rng.normal(size=3).tolist(), [PRINCIPALS[k % 4]], None, None, None) for k in range(20)]
    q = spark.createDataFrame(own, "query_id long, qvec array<double>, _principals array<string>, _file_types array<string>, _date_from date, _date_to date")
    for most in (3, 1000):
        got = {}
        for r in scoring.knn(q, v, "key", 4, most).collect():
            got.setdefault(r.query_id, []).append((r["rank"], r.key))
        for k, vec, p, *_ in own:
            unit = lambda x: np.array(x) / np.linalg.norm(x)
            best = sorted((-round(float(unit(r[1]) @ unit(vec)), 9), r[0]) for r in rows if r[2] == p)[:4]
            assert [x for _, x in sorted(got[k])] == [i for _, i in best]
        found = {}
        for r in scoring.newest(v, q.withColumn("_set", F.col("query_id") % 4), "key", 4, most).collect():
            found.setdefault(r["_set"], []).append((r["rank"], r.key))
        for s in range(4):
            assert [x for _, x in sorted(found[s])] == [i for _, i in sorted((-r[5], r[0]) for r in rows if r[2] == [PRINCIPALS[s]])[:4]]
