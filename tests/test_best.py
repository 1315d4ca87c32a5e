"""Documents scored group by group: the same as sums over rows, in parts, through upserts and deletes, and without pairs of queries and documents in any shuffle."""

import pyarrow as pa
from pyspark.sql import functions as F

from docloom.operators import lexicon, retrieval, scoring

from .test_lexicon import asked, documents, rounded  # noqa: F401


def test_best_is_the_best_of_lexical(spark, tmp_path, asked, monkeypatch):  # noqa: F811
    rows = documents(spark, 1, range(300))
    index = lexicon.Lexicon.create(rows, str(tmp_path / "index"), "doc_id", ("text", "name"), group=16, file=500)
    index = index.add(documents(spark, 2, range(280, 320))).remove(rows.where("doc_id % 10 = 3"))
    full = scoring.stored(index.lexical(asked, "text", "name"), "full")
    want = rounded(scoring.top_k(full.select("query_id", "doc_id", F.round("value", 9).alias("score")), "doc_id", 4), "query_id", "doc_id", "score", "rank")
    weights, phrases = index.lexical_weights(asked.withColumnRenamed("query_id", "text_id"), "text", "name")
    monkeypatch.setattr(lexicon, "QUERIES", 3)
    found = index.best(weights, 4, phrases=phrases)
    assert rounded(found, "query_id", "doc_id", "score", "rank") == want and want
    plan = found._jdf.queryExecution().toString()
    assert "Aggregate" not in plan  # pairs of queries and documents were summed up in a shuffle


def test_hybrid_makes_no_table_of_pairs(spark, asked, monkeypatch):  # noqa: F811
    rows = documents(spark, 3, range(60)).withColumnRenamed("name", "file_name").withColumn("last_modified_date", F.expr("timestamp_seconds(1700000000 - doc_id * 86400)")).withColumn("vec", F.lit(None).cast("array<float>"))
    kept = []
    monkeypatch.setattr(retrieval, "stored", lambda df, name: kept.append(name) or scoring.stored(df, name))
    found = retrieval.hybrid(asked, rows, "doc_id", F.lit("2023-11-20").cast("timestamp"), 3, "keyword_only")
    assert [r.n for r in found.groupBy("query_id").agg(F.count("*").alias("n")).collect()] == [3] * 8
    assert "scored" not in kept and "lexical" not in kept  # each had a row for each query and document with a word


def test_blocks_are_joined_where_they_meet():
    """merged() shuffled nested blocks twice, to join and to order them; they are now joined in their order, also over batches."""
    rows = [("text", "a", 0, [5, 2], [1, 2], [9, 8], [4, 0, 3]), ("text", "a", 0, [3], [1], [7], [6]), ("text", "a", 1, [], [], [], []), ("text", "b", 0, [1], [1], [3], [2]), ("text", "b", 0, [0], [2], [4], [1, 1])]
    kinds = [pa.string(), pa.string(), pa.int64(), pa.list_(pa.int64()), *[pa.list_(pa.int32())] * 3]
    names = ["field", "term", "grp", "keys", "tfs", "dls", "places"]
    for size in (1, 2, 5):
        batches = [pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows[i : i + size], strict=True), kinds, strict=True)], names) for i in range(0, 5, size)]
        got = [r for b in lexicon.joined_blocks(iter(batches)) for r in b.to_pylist()]
        assert [(r["term"], r["grp"], r["n"], r["max_tf"], r["min_dl"]) for r in got] == [("a", 0, 3, 2, 7), ("b", 0, 2, 2, 3)]
        assert [[(d["key"], d["tf"], d["dl"], d["places"]) for d in r["docs"]] for r in got] == [[(2, 2, 8, [0, 3]), (3, 1, 7, [6]), (5, 1, 9, [4])], [(0, 2, 4, [1, 1]), (1, 1, 3, [2])]]
    assert not list(lexicon.joined_blocks(iter([])))


def test_lost_documents_go_as_blocks_meet():
    """Blocks were filtered and joined as nested rows; they stay flat arrays, and their ranges go along."""
    rows = [("text", "a", 0, 0, [2, 5], [2, 1], [8, 9], [0, 3, 4], [5]), ("text", "a", 0, 0, [3], [1], [7], [6], None), ("text", "a", 1, 0, [4], [1], [2], [1], [4]), ("text", "b", 0, 1, [0, 1], [2, 1], [4, 3], [1, 1, 2], None)]
    kinds = [pa.string(), pa.string(), pa.int64(), pa.int32(), pa.list_(pa.int64()), *[pa.list_(pa.int32())] * 3, pa.list_(pa.int64())]
    names = ["field", "term", "grp", "span", "keys", "tfs", "dls", "places", "lost"]
    for size in (1, 2, 4):
        batches = [pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows[i : i + size], strict=True), kinds, strict=True)], names) for i in range(0, 4, size)]
        got = [tuple(r.values()) for b in lexicon.met_blocks(iter(batches)) for r in b.to_pylist()]
        assert got == [("text", "a", 0, 0, 2, 2, 7, [2, 3], [2, 1], [8, 7], [0, 3, 6]), ("text", "b", 0, 1, 2, 2, 3, [0, 1], [2, 1], [4, 3], [1, 1, 2])]


def test_groups_grow_and_blocks_are_written_once(spark, tmp_path, monkeypatch):
    """An index was written as blocks before it was put in order, and its groups had 128 documents however many there were."""
    monkeypatch.setattr(lexicon, "GROUP", 2)
    monkeypatch.setattr(lexicon, "LARGEST", 40)
    monkeypatch.setattr(lexicon, "GROUPS", 10)
    monkeypatch.setattr(lexicon, "shared_path", None)
    rows = spark.createDataFrame([(i, f"w{i % 90} x{i % 7} w{i % 11}") for i in range(300)], "doc_id long, text string")
    index = lexicon.Lexicon.create(rows, str(tmp_path / "index"), "doc_id", ("text",), file=100)
    assert (index.content["group"], index.content["groups"]) == (30, 10)
    files = {f[3]: f[1:3] for f in index.content["segments"][0]["files"]}
    assert len(files) == len(index.content["bounds"]) + 1 > 3
    for name, (low, high) in files.items():  # a file holds what its range says, in order
        found = [r.term for r in spark.read.parquet(f"{tmp_path}/index/{index.content['segments'][0]['name']}/blocks/{name}").collect()]
        assert found == sorted(found) and all(low <= t and (high is None or t <= high) for t in found)
    again = index.add(rows.where("doc_id < 20")).remove(spark.createDataFrame([(25,)], "doc_id long")).merged()
    want = scoring.postings(rows.where("doc_id <> 25"), "doc_id", "text").select("doc_id", "term", "tf", "dl")
    assert sorted(map(tuple, again.postings("text").collect())) == sorted(map(tuple, want.collect()))


def test_merge_deals_groups_anew(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"w{i % 90} x{i % 7} w{i % 11} x{i % 7}") for i in range(60)], "doc_id long, text string")
    index = lexicon.Lexicon.create(rows.where("doc_id < 8"), str(tmp_path / "index"), "doc_id", ("text",), group=4, file=30)
    index = index.add(rows.where("doc_id >= 6")).remove(spark.createDataFrame([(25,)], "doc_id long")).merged()
    assert index.content["groups"] == 15 and len(index.content["bounds"]) > 1 and len(index.content["segments"]) == 1
    want = scoring.postings(rows.where("doc_id <> 25"), "doc_id", "text").select("doc_id", "term", "tf", "dl")
    assert sorted(map(tuple, index.postings("text").collect())) == sorted(map(tuple, want.collect()))
    found = index.phrases(spark.createDataFrame([(1, "x3 w3 x3")], "query_id int, query string"), "text", 0)
    assert sorted(r.doc_id for r in found.collect()) == [i for i in range(60) if i != 25 and i % 7 == 3 and i % 11 == 3]
