"""The stored index against scores made from texts, through upserts, deletes and merges; what its searches read; versions and their conflicts."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from docloom.operators import lexicon, retrieval, scoring, versions

WORDS = "red blue house report travel plan 漢字 漢字学 leaf leaves stone the of market garden window painter".split()


def documents(spark, seed, ids):
    rng = random.Random(seed)
    rows = [(i, " ".join(rng.choice(WORDS[: rng.randint(3, len(WORDS))]) for _ in range(rng.randint(0, 60))), f"{rng.choice(WORDS)}_{i % 7}.md") for i in ids]
    return spark.createDataFrame(rows, "doc_id long, text string, name string")


@pytest.fixture(scope="module")
def asked(spark):
    queries = [(1, "red house"), (2, "the travel report of market"), (3, "漢字学 garden"), (4, "gardan windw"), (5, "nothing known"), (6, "stone stone plan"), (7, "of the"), (8, "leaf_3")]
    return spark.createDataFrame(queries, "query_id int, query string")


def rounded(df, *names):
    return sorted(tuple(round(v, 8) if isinstance(v, float) else v for v in r) for r in df.select(*names).collect())


def same(index, rows, queries):
    words = scoring.stored(queries.select("query_id", F.explode(lexicon.terms("query")).alias("term")), "asked")
    post = scoring.stored(scoring.postings(rows, "doc_id", "text"), "post")
    names = ("query_id", "doc_id", "bm25")
    want = rounded(scoring.bm25(post, words, "doc_id"), *names)
    assert rounded(index.bm25(words, "text"), *names) == want and want
    assert rounded(index.postings("text"), "doc_id", "term", "tf", "dl") == rounded(post, "doc_id", "term", "tf", "dl")
    assert rounded(index.phrases(queries, "text"), "query_id", "doc_id", "n", "freq") == rounded(scoring.phrase_matches(rows, queries, post, "doc_id", "text"), "query_id", "doc_id", "n", "freq")
    assert rounded(index.lexical(queries, "text", "name"), "query_id", "doc_id", "value") == rounded(scoring.lexical(rows, queries, "doc_id", "text", "name"), "query_id", "doc_id", "value")
    full = scoring.top_k(index.bm25(words, "text").select("query_id", "doc_id", F.round("bm25", 9).alias("score")), "doc_id", 5)
    best, counts = index.top_k(words, "text", 5)
    assert rounded(best, "query_id", "doc_id", "score", "rank") == rounded(full, "query_id", "doc_id", "score", "rank")
    assert all(r.read <= r.postings for r in counts.collect())


def test_index_follows_its_documents(spark, asked, tmp_path):
    first = documents(spark, 1, range(150))
    index = lexicon.Lexicon.create(first, str(tmp_path / "index"), "doc_id", ("text", "name"), group=16)
    new = documents(spark, 2, range(120, 180))
    index = index.add(new)
    rows = first.where("doc_id < 120").unionByName(new)
    index = index.remove(spark.createDataFrame([(5,), (130,), (999,)], "doc_id long"))
    rows = rows.where("doc_id NOT IN (5, 130)")
    index = index.add(documents(spark, 3, [5, 7]))
    rows = rows.where("doc_id <> 7").unionByName(documents(spark, 3, [5, 7]))
    same(index, rows, asked)
    index = index.merged()
    assert len(index.content["segments"]) == 1 and not index.content["gone"]
    same(lexicon.Lexicon.open(spark, str(tmp_path / "index")), rows, asked)
    assert rounded(lexicon.Lexicon.open(spark, str(tmp_path / "index"), 0).postings("name"), "doc_id", "term", "tf", "dl") == rounded(scoring.postings(first, "doc_id", "name"), "doc_id", "term", "tf", "dl")


def test_second_writer_is_refused(spark, tmp_path):
    index = lexicon.Lexicon.create(documents(spark, 1, range(9)), str(tmp_path / "index"), "doc_id", ("text",))
    index.add(documents(spark, 2, [3]))
    with pytest.raises(versions.Conflict):
        index.remove(documents(spark, 2, [4]))
    assert lexicon.Lexicon.open(spark, str(tmp_path / "index")).version == 1
    assert not [p for p in (tmp_path / "index" / "manifests").iterdir() if p.name.endswith(".tmp")]


def test_searches_read_no_text_and_few_files(spark, asked, tmp_path):
    rows = documents(spark, 1, range(200))
    index = lexicon.Lexicon.create(rows, str(tmp_path / "index"), "doc_id", ("text", "name"), group=16, file=40)
    term = spark.createDataFrame([("window",)], "term string")
    files = index.files(term, "text")
    assert 0 < len(files) < len({f for _, _, _, f in index.content["segments"][0]["files"]})
    read = index.bm25(term.withColumn("query_id", F.lit(1)), "text").inputFiles()
    assert read and all("/index/segments/" in f and "/blocks/" in f or "/docloom-asked" in f for f in read)
    for df in (index.phrases(asked, "text"), index.lexical(asked, "text", "name"), index.top_k(term.withColumn("query_id", F.lit(1)), "text", 3)[0]):
        assert not [f for f in df.inputFiles() if "/index/" in f and "/segments/" not in f and "/gone/" not in f]


def test_top_k_reads_less(spark, tmp_path):
    """Where a few groups have the documents that matter, the others are not read."""
    rng = random.Random(3)
    rows = [(i, " ".join(["common"] * rng.randint(1, 2) + ["filler"] * 30 + (["rare"] * 5 if i % 101 == 0 else []))) for i in range(1200)]
    index = lexicon.Lexicon.create(spark.createDataFrame(rows, "doc_id long, text string"), str(tmp_path / "index"), "doc_id", ("text",), group=8)
    words = spark.createDataFrame([(1, "rare"), (1, "common"), (2, "rare")], "query_id int, term string")
    best, counts = index.top_k(words, "text", 5)
    full = scoring.top_k(index.bm25(words, "text").select("query_id", "doc_id", F.round("bm25", 9).alias("score")), "doc_id", 5)
    assert rounded(best, "query_id", "doc_id", "score", "rank") == rounded(full, "query_id", "doc_id", "score", "rank")
    by = {r.query_id: r for r in counts.collect()}
    assert by[1].read < by[1].postings / 4


def test_occurrences_by_definition():
    rng = random.Random(5)
    for _ in range(300):
        doc = [rng.choice("abc") for _ in range(rng.randint(1, 12))]
        phrase = [rng.choice("abc") for _ in range(rng.randint(1, 3))]
        places = {t: [i for i, x in enumerate(doc) if x == t] for t in "abc"}
        if not all(places[t] for t in phrase):
            continue
        n = freq = 0
        for start in range(-3, len(doc)):
            late = [next((p - start - i for p in places[t] if 0 <= p - start - i <= 2), None) for i, t in enumerate(phrase)]
            if None not in late and 0 in late and len({start + i + x for i, x in enumerate(late)}) == len(phrase):
                n, freq = n + 1, freq + 1 / (1 + max(late))
        got = lexicon.occurrences([(i, np.array(places[t])) for i, t in enumerate(phrase)], 2)
        assert got[0] == n and abs(got[1] - freq) < 1e-12


def test_all_phrases_in_a_group_at_once():
    rng = random.Random(3)
    schema = pa.schema([("seg", pa.string()), ("query_id", pa.int64()), ("k", pa.string()), ("n", pa.int64()), ("freq", pa.float64()), ("dl", pa.int32())])
    for _ in range(60):
        slop = rng.randrange(3)
        docs = {f"d{k}": [rng.choice("abcd") for _ in range(rng.randrange(1, 14))] for k in range(6)}
        phrases = [(i, [rng.choice("abcd") for _ in range(rng.randrange(1, 5))]) for i in range(8)]
        rows, want = [], {}
        for t in sorted({t for _, p in phrases for t in p}):
            places = {k: [i for i, x in enumerate(d) if x == t] for k, d in docs.items() if t in d}
            if places:
                deltas = [y for x in places.values() for y in np.diff(x, prepend=0).tolist()]
                rows.append({"seg": "s", "grp": 0, "term": t, "keys": list(places), "tfs": [len(x) for x in places.values()], "dls": [len(docs[k]) for k in places], "places": deltas})
        for q, p in phrases:
            for k, d in docs.items():
                if set(p) <= set(d):
                    n, freq = lexicon.occurrences([(i, np.array([j for j, x in enumerate(d) if x == t])) for i, t in enumerate(p)], slop)
                    if n:
                        want[q, k] = (n, round(freq, 9), len(d))
        batches = [pa.RecordBatch.from_pylist(rows[:1]), pa.RecordBatch.from_pylist(rows[1:])] if len(rows) > 1 else [pa.RecordBatch.from_pylist(rows)]
        found = [r for b in lexicon.Phrases(phrases, slop).rows(iter(batches), "k", schema) for r in b.to_pylist()]
        assert {(r["query_id"], r["k"]): (r["n"], round(r["freq"], 9), r["dl"]) for r in found} == want and len(found) == len(want)


def test_no_documents(spark, asked, tmp_path):
    index = lexicon.Lexicon.create(spark.createDataFrame([], "doc_id long, text string, name string"), str(tmp_path / "index"), "doc_id", ("text", "name"))
    words = asked.select("query_id", F.explode(lexicon.terms("query")).alias("term"))
    assert index.bm25(words, "text").count() == 0 and index.lexical(asked, "text", "name").count() == 0 and index.top_k(words, "text", 3)[0].count() == 0
    assert index.add(documents(spark, 1, range(5))).totals("text").n_docs > 0


# --- tables in buckets


def test_upserts_copy_only_their_buckets(spark, tmp_path):
    path = str(tmp_path / "table")
    rows = spark.range(2000).select(F.col("id").alias("doc_id"), F.lit("old").alias("text"))
    table = versions.BucketTable.create(rows, path, "doc_id", 64)
    reader = table.read()
    new = spark.createDataFrame([(3, "new"), (3, "newer"), (5000, "new")], "doc_id long, text string")
    later = table.upsert(new)
    touched = {str(r.b) for r in new.select(table.bucket().alias("b")).distinct().collect()}
    assert set(map(str, later.content["written"])) == touched and len(touched) <= 2
    assert {b: f for b, f in later.content["files"].items() if b not in touched} == {b: f for b, f in table.content["files"].items() if b not in touched}
    assert later.read().count() == 2002 and {r.text for r in later.of([3]).collect()} == {"new", "newer"} and len(later.of([3]).inputFiles()) == 1
    assert reader.count() == 2000 and reader.where("text <> 'old'").count() == 0  # an older version's reader goes on
    with pytest.raises(versions.Conflict):
        table.remove(new)
    last = versions.BucketTable.open(spark, path).remove(spark.createDataFrame([(3,), (4,)], "doc_id long"))
    assert last.read().count() == 1999 and last.version == 2
    assert versions.expire(spark, path) > 0 and versions.versions(spark, path) == [2] and versions.BucketTable.open(spark, path).read().count() == 1999


def test_null_keys_are_keys(spark, tmp_path):
    table = versions.BucketTable.create(spark.createDataFrame([(None, "a"), (1, "b")], "doc_id long, text string"), str(tmp_path / "t"), "doc_id", 4)
    got = table.upsert(spark.createDataFrame([(None, "c")], "doc_id long, text string")).read().collect()
    assert sorted((r.doc_id is None, r.text) for r in got) == [(False, "b"), (True, "c")]
