"""Retrieval as a whole, evaluation runs, sources, the registry's constraints and the index's life, by small examples."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.config import Retrieval, Settings
from docloom.operators import chunking, index, providers, registry, retrieval, scoring
from docloom.schema import chunk_type
from docloom.sources import base, extract



def as_of():
    return F.lit("2024-06-01").cast("timestamp")


def chunk_rows(spark, texts, vectors=None, acl=None, kinds=None):
    rows = []
    for i, t in enumerate(texts):
        rows.append((f"d{i}", f"d{i}:0", 0, f"file{i}.md", "", f"http://x/{i}", (kinds or ["md"] * len(texts))[i], "h", t, t, (vectors or [[]] * len(texts))[i], 1, 0, 0, "", "", "text", (acl or [["public"]] * len(texts))[i], {}))
    names = [f for f in chunk_type().fieldNames() if f not in ("last_modified_date", "indexed_at")]
    kinds_ = {f.name: f.dataType.simpleString() for f in chunk_type()}
    df = spark.createDataFrame([dict(zip(names, (r[0], r[1], r[2], r[3], r[4], r[5], r[6], r[7], r[8], r[9], r[10], r[11], r[12], r[13], r[14], r[15], r[16], r[17], r[18]), strict=True)) for r in rows], ", ".join(f"{n} {kinds_[n]}" for n in names))
    return df.withColumn("last_modified_date", F.lit("2024-05-01").cast("timestamp")).withColumn("indexed_at", F.lit(None).cast("timestamp"))


def asked(spark, *queries):
    return spark.createDataFrame(list(enumerate(queries)), "query_id int, query string")


def best(result):
    return {r.query_id: r.doc_id for r in result[0].where("rank = 1").collect()}


def test_each_lexical_clause_finds(spark):
    texts = ["annual leave and holidays", "expense report for travel", "the red house on a hill", "house red paint", "nothing of interest", "more of nothing"]
    chunks = chunk_rows(spark, texts)
    found = best(retrieval.retrieve(asked(spark, "holidays", "expence reprot", "red house", "file4", "filw5"), chunks, as_of(), mode="keyword_only"))
    assert found == {0: "d0", 1: "d1", 2: "d2", 3: "d4", 4: "d5"}  # a word, two typing errors (one an exchange), the phrase in its order, a file's name, the name with an error


def test_rows_of_others_never_surface(spark):
    rng = np.random.default_rng(0)
    secret = rng.normal(size=8).tolist()
    vectors = [secret, *rng.normal(size=(9, 8)).tolist()]
    chunks = chunk_rows(spark, [f"text {i}" for i in range(10)], vectors, [["user:boss"]] + [["public"]] * 9)
    queries = spark.createDataFrame([(1, "text 0", secret)], "query_id int, query string, qvec array<double>")
    for mode in scoring.MODES:
        got = retrieval.retrieve(queries, chunks, as_of(), principals=["public", "user:me"], mode=mode)[0].collect()
        assert got and "d0" not in {r.doc_id for r in got}
        assert best(retrieval.retrieve(queries, chunks, as_of(), principals=["user:boss"], mode=mode)) == {1: "d0"}


def test_filters_degradation_and_trace(spark):
    chunks = chunk_rows(spark, [f"report number {i}" for i in range(30)], kinds=["pdf", "xlsx", "md"] * 10)
    out, trace = retrieval.retrieve(asked(spark, "report filetype:excel", "report type:pdf after:2025-01-01", "report"), chunks, as_of(), Settings(retrieval=Retrieval(top_k=20, rerank_top_n=8, max_context_docs=3)))
    assert {r.query_id: tuple(r)[1:] for r in trace.collect()} == {0: (10, 8, 3), 1: (0, 0, 0), 2: (20, 8, 3)}
    assert {int(r.doc_id[1:]) % 3 for r in out.where("query_id = 0").collect()} == {1}
    assert all(r.score > 0 and 0 < r.normalized_score <= 1 for r in out.collect())  # no vectors: words and dates alone


def test_rerank_and_its_absence(spark):
    chunks = chunk_rows(spark, ["alpha beta", "alpha", "beta beta alpha gamma"])
    q = asked(spark, "alpha beta")
    order = lambda scorer: [(r.doc_id, r.rerank_score) for r in retrieval.retrieve(q, chunks, as_of(), scorer=scorer)[0].orderBy("rank").collect()]
    plain = order(None)
    assert [s for _, s in plain] == [None] * 3
    assert order(retrieval.KEEP_ORDER) == [(d, 0.0) for d, _ in plain]
    assert order(F.length("snippet").cast("double"))[0] == ("d2", 21.0)
    alone = retrieval.retrieve(q, chunks.limit(1), as_of(), scorer=1.0)[0].first()
    assert alone.rerank_score is None  # one candidate is not reranked


def test_parents_or_chunks(spark):
    chunks = chunk_rows(spark, ["one", "two", "three"]).withColumn("chunk_index", F.substring("doc_id", 2, 1).cast("int")).withColumn("doc_id", F.lit("d"))
    chunks = chunks.withColumn("chunk_uid", F.concat(F.lit("d:"), F.col("chunk_index").cast("string")))
    got = retrieval.retrieve(asked(spark, "two"), chunks, as_of())[0].collect()
    assert len(got) == 1 and got[0].snippet == "one\ntwo\nthree" and got[0].is_parent
    got = retrieval.retrieve(asked(spark, "two"), chunks, as_of(), Settings(retrieval=Retrieval(return_parent=False)))[0].orderBy("rank").collect()
    assert len(got) == 3 and got[0].snippet == "two" and not any(r.is_parent for r in got)


def test_prompts(spark):
    chunks = chunk_rows(spark, ["the answer is blue", "another text"])
    q = asked(spark, "answer")
    out, trace = retrieval.retrieve(q, chunks, as_of())
    queries = q.withColumn("history", F.expr("array(named_struct('role', 'user', 'content', 'before'))")).unionByName(spark.createDataFrame([(9, "nothing is there for this", None)], "query_id int, query string, history array<struct<role:string,content:string>>"))
    got = {r.query_id: r for r in retrieval.prepared(queries, out, trace, "be brief").collect()}
    assert [m.role for m in got[0].messages] == ["system", "user", "user"] and "the answer is blue" in got[0].messages[-1].content and got[0].messages[-1].content.endswith("answer")
    assert (got[0].n_packed, got[0].n_raw) == (2, 2) and got[0].context_tokens > 60
    assert (got[9].n_packed, got[9].context_tokens) == (0, 0) and "No matching material" in got[9].messages[-1].content


def test_runs_are_saved(spark, tmp_path):
    cases = spark.createDataFrame([(1, ["a.md"]), (2, ["b"])], "case_id int, expected_docs array<string>")
    found = spark.createDataFrame([(1, 1, "a"), (1, 2, "b")], "query_id int, rank int, doc_id string")
    known = spark.createDataFrame([("a", "a.md", "/a.md", 1), ("b", "b.md", "/b.md", 1)], "doc_id string, file_name string, file_path string, indexed_at int")
    results = retrieval.run_cases(cases, found, known, (1,))
    run = retrieval.run_row(results, "x", F.lit(7.0))
    retrieval.save_run(run, str(tmp_path / "runs"), retrieval.run_details(results, "x", F.lit(7.0)), str(tmp_path / "details"))
    got = spark.read.parquet(str(tmp_path / "runs")).first()
    assert got.metrics["recall@1"] == 0.5 and got.metrics["mrr"] == 0.5 and got.n_cases == 2 and got.config["retrieval.top_k"] == "50"
    details = spark.read.parquet(str(tmp_path / "details")).collect()
    assert {d.case_id: (d.run_id, d.retrieved, d.metrics["recall@1"]) for d in details} == {"1": (got.id, ["a", "b"], 1.0), "2": (got.id, [], 0.0)} and got.details == []
    with pytest.raises(ValueError):
        retrieval.save_run(retrieval.run_row(retrieval.run_cases(cases.limit(0), found, known), "x", F.lit(7.0)), str(tmp_path / "runs"))


# --- scores


def test_knn_like_native_on_ties(spark):
    rng = np.random.default_rng(1)
    base_ = rng.normal(size=(5, 6))
    rows = [(k, base_[rng.integers(0, 5)].tolist()) for k in rng.permutation(60).tolist()] + [(100, None), (101, [1.0, 2.0]), (102, [0.0] * 6), (103, [float("nan")] * 6), (104, [1.0, None, 0.0, 0.0, 0.0, 0.0])]
    v = spark.createDataFrame(rows, "key long, vec array<double>").repartition(5)
    q = spark.createDataFrame([(1, base_[0].tolist()), (2, base_[3].tolist()), (3, None), (4, [3.0, 4.0]), (5, [0.0] * 6)], "query_id int, qvec array<double>")
    get = lambda df: sorted((r.query_id, r["rank"], r.key, r.similarity) for r in df.collect())
    a, b = get(scoring.knn(q, v, "key", 7)), get(scoring.knn_native(q.where("qvec IS NOT NULL"), v.where("vec IS NOT NULL AND key <> 104"), "key", 7))
    assert a == b and {r[0] for r in a} == {1, 2, 4, 5}
    three = spark.createDataFrame([(9, [1.0, 0.0]), (8, [1.0, 0.0]), (1, [1.0, 0.0])], "key long, vec array<double>").coalesce(1)
    assert [r[2] for r in get(scoring.knn(spark.createDataFrame([(1, [1.0, 0.0])], "query_id int, qvec array<double>"), three, "key", 2))] == [1, 8]


def brute_distance(a, b):
    """With exchanges of neighbours, between which letters may stand."""
    last, d = {}, {}
    most = len(a) + len(b)
    d[-1, -1] = most
    for i in range(len(a) + 1):
        d[i, -1], d[i, 0] = most, i
    for j in range(len(b) + 1):
        d[-1, j], d[0, j] = most, j
    for i in range(1, len(a) + 1):
        col = 0
        for j in range(1, len(b) + 1):
            row, at = last.get(b[j - 1], 0), col
            if a[i - 1] == b[j - 1]:
                cost, col = 0, j
            else:
                cost = 1
            d[i, j] = min(d[i - 1, j - 1] + cost, d[i, j - 1] + 1, d[i - 1, j] + 1, d[row - 1, at - 1] + (i - row - 1) + 1 + (j - at - 1))
        last[a[i - 1]] = i
    return d[len(a), len(b)]


def test_nearest_are_held_in_bounds():
    rng = np.random.default_rng(1)
    for strings in (False, True):
        near, rows = scoring._Nearest(3, 4), []
        for _ in range(30):
            keys = rng.permutation(1000)[:20].astype(str).astype(object) if strings else rng.permutation(1000)[:20]
            s = np.round(rng.random((20, 3)), 1)
            s[rng.random((20, 3)) < 0.2] = np.nan
            near.add(keys, s)
            rows += [(q, -s[i, q], keys[i]) for i in range(20) for q in range(3) if s[i, q] == s[i, q]]
            assert near.many <= 2 * 3 * 4
        want = [r for q in range(3) for r in sorted(r for r in rows if r[0] == q)[:4]]
        assert [(q, -x, key) for q, key, x in zip(*near.sorted(), strict=True)] == want


def test_few_pairs_are_sorted(spark):
    """All pairs are 200,000; what comes to the ranks of knn_native() are those up to the bounds."""
    rng = np.random.default_rng(2)
    v = spark.createDataFrame([(i, [float(x) for x in rng.normal(size=4)]) for i in range(4000)], "key long, vec array<float>")
    q = v.where("key % 80 = 0").select(F.col("key").alias("query_id"), F.col("vec").alias("qvec"))
    found = scoring.knn_native(q, v, "key", 3)
    assert "bound" in found._jdf.queryExecution().optimizedPlan().toString()
    get = lambda df: sorted((r.query_id, r["rank"], r.key, r.similarity) for r in df.collect())
    assert get(found) == get(scoring.knn(q, v, "key", 3))


def test_fuzzy_terms_brute_force(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abc") for _ in range(rng.randint(1, 8)))
    asked_, known = sorted({word() for _ in range(60)} | {"reersh", "abcdef", "aabbcc"}), sorted({word() for _ in range(400)} | {"erresh", "badcef", "bacdfe", "ababcc"})
    got = {(r.term, r.match): r.distance for r in scoring.fuzzy_terms(spark.createDataFrame([(w,) for w in known], "term string"), spark.createDataFrame([(1, w) for w in asked_], "query_id int, term string")).collect()}
    edits = lambda w: 0 if len(w) <= 2 else 1 if len(w) <= 5 else 2
    want = {(a, b): d for a in asked_ for b in known if (d := brute_distance(a, b)) <= edits(a)}
    assert got == want


def test_phrases_brute_force(spark):
    rng = random.Random(3)
    docs = [(i, " ".join(rng.choice(["ka", "lo", "mi", "tu"]) for _ in range(rng.randint(0, 25)))) for i in range(60)]
    phrases = [(1, "ka"), (2, "ka lo"), (3, "lo lo"), (4, "ka lo mi"), (5, "tu ka tu mi"), (6, "ka never"), (7, "")]
    rows = spark.createDataFrame(docs, "key int, text string")
    got = {(r.query_id, r.key): (r.n, round(r.freq, 9)) for r in scoring.phrase_matches(rows, spark.createDataFrame(phrases, "query_id int, query string"), scoring.postings(rows, "key", "text"), "key", "text").collect()}
    want = {}
    for q, phrase in phrases:
        terms = phrase.split()
        for key, text in docs:
            words, n, freq = text.split(), 0, 0.0
            for start in range(-3, len(words)):
                near = [next((late for late in range(3) if 0 <= start + i + late < len(words) and words[start + i + late] == t), None) for i, t in enumerate(terms)]
                if terms and None not in near and min(near) == 0 and len({start + i + late for i, late in enumerate(near)}) == len(terms):
                    n, freq = n + 1, freq + 1 / (1 + max(near))
            if n:
                want[q, key] = (n, round(freq, 9))
    assert got == want


# --- sources


def test_pages_are_fetched(spark):
    def fetch(url):
        if "gone" in url:
            raise OSError("404")
        return ("text/html; charset=utf-8", b"<h1>T</h1><p>body</p>", url + "/moved") if "page" in url else ("image/png", b"x", url)

    source = base.UrlSource(("http://h/page", "http://h/gone", "http://h/pic.png", "http://h/page"), fetch)
    got = source.rows(spark).collect()
    assert [(r.file_url, r.document_type) for r in got] == [("http://h/page", "html")]
    rows = base.ingest_urls(spark, ("http://h/page",), fetch).collect()
    assert [r.snippet for r in rows] == ["# T\nbody"] and rows[0].acl_principals == ["public"]


def test_paths_are_ingested_once(spark, tmp_path):
    (tmp_path / "a.md").write_text("# A\nbody of a")
    (tmp_path / "b.md").write_text("body of b")
    first = base.ingest_path(spark, str(tmp_path), ("group:x",)).cache()
    assert sorted(r.file_name for r in first.collect()) == ["a.md", "b.md"] and first.first().acl_principals == ["group:x"]
    (tmp_path / "b.md").write_text("new body of b")
    assert [r.file_name for r in base.ingest_path(spark, str(tmp_path), stored=first).collect()] == ["b.md"]
    assert base.ingest_path(spark, str(tmp_path), stored=first, force=True).count() == 2


def test_registered_extractors_reach_tasks(spark):
    before = list(extract._REGISTRY)
    try:
        extract.register_extractor(("rev", "txt"), lambda content: extract.Extracted(content.decode()[::-1]))
        rows = spark.createDataFrame([(1, "rev", bytearray(b"abc")), (2, "txt", bytearray(b"abc")), (3, "md", bytearray(b"abc"))], "doc_id int, document_type string, content binary")
        assert {r.doc_id: r.text for r in extract.extract(rows).collect()} == {1: "cba", 2: "cba", 3: "abc"}
    finally:
        extract._REGISTRY[:] = before


def test_chunk_options_of_settings():
    assert base.chunk_options(Settings()).chunk_size == 100


def test_rendered_pages(spark):
    pages = spark.createDataFrame([("d", 1, "x" * 50, bytearray(b"pdf")), ("d", 2, "", bytearray(b"pdf")), ("d", 9, "", bytearray(b"pdf")), ("e", 1, "", bytearray(b"broken"))], "doc_id string, page_no int, text string, content binary")

    def render(content, numbers):
        if content == b"broken":
            raise ValueError
        return [b"image %d" % n for n in numbers if n < 5]

    got = {(r.doc_id, r.page_no): r.image and bytes(r.image) for r in extract.rendered(pages, render).collect()}
    assert got == {("d", 1): None, ("d", 2): b"image 2", ("d", 9): None, ("e", 1): None}
    assert extract.rendered(pages, None).where("image IS NOT NULL").count() == 0


def made_pdf(pages, packed=False):
    """A file of the format with a page for each contents; fonts F1 (Latin) and F2 (two bytes, with a table to Unicode)."""
    import zlib

    table = b"1 beginbfchar <0001> <6C49> endbfchar 1 beginbfrange <0010> <0012> <0061> endbfrange"
    streams = [zlib.compress(c) for c in pages]
    kids = b" ".join(b"%d 0 R" % (10 + k) for k in range(len(pages)))
    plain = {1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: b"<< /Type /Pages /Kids [%s] /Count %d /Resources << /Font << /F1 3 0 R /F2 4 0 R >> >> >>" % (kids, len(pages)), 3: b"<< /Type /Font /Subtype /Type1 >>", 4: b"<< /Type /Font /Subtype /Type0 /ToUnicode 5 0 R >>"}
    plain |= {10 + k: b"<< /Type /Page /Parent 2 0 R /Contents %d 0 R >>" % (100 + k) for k in range(len(pages))}
    objects = {} if packed else dict(plain)
    if packed:
        bodies, head, at = b"", b"", 0
        for n, b in plain.items():
            head += b"%d %d " % (n, len(bodies))
            bodies += b + b" "
        body = zlib.compress(head + bodies)
        objects[50] = b"<< /Type /ObjStm /N %d /First %d /Filter /FlateDecode /Length %d >>\nstream\n%s\nendstream" % (len(plain), len(head), len(body), body)
    objects[5] = b"<< /Length %d >>\nstream\n%s\nendstream" % (len(table), table)
    for k, s in enumerate(streams):
        objects[100 + k] = b"<< /Filter %s /Length %d >>\nstream\n%s\nendstream" % (b"/LZWDecode" if pages[k] == b"bad" else b"/FlateDecode", len(s), s)
    return b"%PDF-1.5\n" + b"\n".join(b"%d 0 obj\n%s\nendobj" % (n, o) for n, o in objects.items()) + b"\ntrailer << /Root 1 0 R >>\n%%EOF"


@pytest.mark.parametrize("packed", [False, True])
def test_pdf_text(spark, packed):
    one = b"BT /F1 12 Tf 1 0 0 1 72 700 Tm (Hello \\(world\\)) Tj 0 -14 Td [(sec) 20 (ond) -300 (li-)] TJ T* (ne\\351 \\\\) Tj ET"
    two = b"BT /F2 12 Tf <000100100011> Tj <0012> ' ET BI /W 1 ID \x00(x) Tj EI BT /F1 9 Tf (end) Tj ET"
    data = made_pdf([one, two, b"bad", b""], packed)
    found = extract.from_pdf(data)
    assert found.pages == ["Hello (world)\nsecond line\u00e9 \\", "\u6c49ab\nc\nend", "", ""]
    rows = spark.createDataFrame([(1, "pdf", bytearray(data)), (2, "pdf", bytearray(b"no")), (3, "pdf", bytearray(data + b" /Encrypt 9 0 R"))], "doc_id int, document_type string, content binary")
    got = {r.doc_id: r for r in extract.extract(rows).collect()}
    assert got[1].error is None and got[1].pages == found.pages and "not a PDF" in got[2].error and "encrypted" in got[3].error


# --- registry and index


def test_constraints(spark):
    sessions = spark.createDataFrame([("s",)], "id string")
    none = spark.createDataFrame([], "id string, session_id string, role string, content string, sources array<map<string,string>>, trace map<string,string>, created_at double")
    new = lambda s, c: spark.createDataFrame([(s, "user", c)], "session_id string, role string, content string")
    row = registry.inserted(none, new("s", "hello"), "messages", F.lit(3.0), ("session_id", "content"), sessions).first()
    assert len(row.id) == 16 and row.created_at == 3.0 and row.sources is None
    with pytest.raises(Exception, match="messages.content is null"):
        registry.inserted(none, new("s", None), "messages", F.lit(3.0), ("session_id",), sessions).collect()
    with pytest.raises(Exception, match="refers to no row of sessions: t"):
        registry.inserted(none, new("t", "x"), "messages", F.lit(3.0), ("session_id",), sessions).collect()


def test_index_life(spark, tmp_path):
    path = str(tmp_path / "index")
    assert not index.ping(spark, path)
    assert index.ensured_index(spark, path, 4).count() == 0 and index.ping(spark, path)
    index.write_index(chunk_rows(spark, ["a"], [[1.0, 2.0, 3.0, 4.0]]), path)
    assert index.ensured_index(spark, path, 4).count() == 1
    with pytest.raises(ValueError, match="4 dimensions"):
        index.ensured_index(spark, path, 3)
    assert index.dropped_index(spark, path) and not index.dropped_index(spark, path)
    assert "semantic_vector array<float>" in index.index_body(4) and "'vector.dims' = '4'" in index.index_body(4)


def test_buckets_spare_a_shuffle(spark):
    chunks = chunk_rows(spark, [f"t{i}" for i in range(40)]).withColumn("metadata", F.lit(None).cast("map<string,string>"))
    for name in ("buckets_a", "buckets_b"):
        index.write_bucketed(chunks, name, 4)
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        joined = spark.table("buckets_a").join(spark.table("buckets_b").select("doc_id", F.col("snippet").alias("other")), "doc_id").groupBy("doc_id").agg(F.count("*").alias("n"))
        assert joined.where("n = 1").count() == 40
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        for name in ("buckets_a", "buckets_b"):
            spark.sql(f"DROP TABLE IF EXISTS {name}")


def test_tokenizers_as_sizes(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    from docloom.functions import text as tx

    texts = ["Some words, and more.", "", "漢字 é", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for name in ("word_bpe_49k.json", "byte_bpe_50k.tiktoken"):
        path = public_tokenizers.path(name)
        tx.register_tokenizer(name, path)
        got = [r[0] for r in df.select(tx.size_function(name)("t")).collect()]
        assert got[1] == 0 and got[3] is None and got[0] == tx.token_counter(path)(texts[0]) > 3
        chunking.register_size(name, tx.token_counter(path))
        chunks = chunking.chunk_documents(spark.createDataFrame([(1, "one two three. " * 40)], "doc_id int, text string"), chunking.ChunkOptions(chunk_size=20, size=name)).collect()
        assert len(chunks) > 5 and all(tx.token_counter(path)(c.text) <= 45 for c in chunks)  # short ones take in the next
    own = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    assert tx.token_counter(public_tokenizers.path("word_bpe_49k.json"))(texts[0]) == len(own.encode(texts[0], add_special_tokens=False).ids)


def test_deleted_and_failed(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id int, x string")
    a, b = index.deleted(rows, rows, rows.where("doc_id = 1"))
    assert [r.doc_id for r in a.collect()] == [r.doc_id for r in b.collect()] == [2]
    failed = spark.createDataFrame([(i, "failed" if i % 2 else "indexed", "e") for i in range(60)], "doc_id int, status string, error string")
    assert [r.doc_id for r in index.ingest_failures(failed).collect()] == list(range(1, 41, 2))


def test_provider_factories():
    made = []
    providers.register_provider("llm", "echo", lambda key, size=1: made.append((key, size)) or object())
    one = providers.provider("llm", "echo", "k", size=2)
    assert providers.provider("llm", "echo", "k", size=2) is one and made == [("k", 2)]
    with pytest.raises(providers.NoKey):
        providers.provider("llm", "echo", None)
    with pytest.raises(ValueError, match="no llm provider"):
        providers.provider("llm", "unheard of")
    providers.close_providers()
    assert providers.provider("llm", "echo", "k", size=2) is not one


# --- chunks


def test_headers_of_tables():
    rows = "\n".join(f"| {i} | {i * i} |" for i in range(9))
    options = chunking.ChunkOptions(chunk_size=2, size="lines")
    assert chunking.table_pieces(f"| a | b |\n| - | - |\n{rows}", options) == ["<th>| a | b |</th>\n" + "\n".join(rows.split("\n")[k : k + 4]) for k in (0, 4, 8)]
    assert chunking.table_pieces(f"| a | b |\n{rows}", options)[0] == "| a | b |\n" + "\n".join(rows.split("\n")[:3])  # no row of dashes, no header
    assert chunking.table_pieces("| a | b |\n| - | - |\n", options) == ["| a | b |\n| - | - |"]
    wide = "| " + "word " * 400 + "|"
    assert not any("<th>" in p for p in chunking.table_pieces(f"{wide}\n| - |\n{rows}", options))
    off = chunking.ChunkOptions(chunk_size=2, size="lines", header_propagation=False)
    assert chunking.table_pieces(f"| a | b |\n| - | - |\n{rows}", off)[0] == "\n".join(rows.split("\n")[:4])


def test_contexts():
    options = chunking.ChunkOptions(context_size=3)
    body = "# H\n## S\none\ntwo\n\n| a |\n| - |\n| 1 |\n\nthree\nfour\nfive\nsix\n### deeper\nseven"
    got = chunking.contexts("H", "S", body, options)
    assert [k for k, _ in got] == ["text", "table", "text", "text"] and got[0][1] == "# H\n## S\none\ntwo" and got[1][1] == "| a |\n| - |\n| 1 |"
    assert [t for _, t in got[2:]] == ["three\nfour\nfive", "six\nseven"]
    assert chunking.contexts("H", "", "# H", options) == [("heading", "# H")] and chunking.contexts("", "", " \n", options) == []
    assert chunking.contexts("H", "", "# H\n\n| a |\n| - |\n| 1 |", options) == [("table", "| a |\n| - |\n| 1 |")]  # no heading before a table


def test_merged_chunks_are_text():
    c = lambda t, ctx=0, f="text": chunking.Chunk(t, "", "", 0, ctx, f)
    got = chunking.merged([c("# a", 0, "heading"), c("(b)", 0, "heading"), c("| t |", 1, "table"), c("x", 2), c("y", 2), c("z", 2), c("long " * 40, 3)])
    assert [(x.text, x.format) for x in got] == [("# a(b)", "text"), ("| t |", "table"), ("x y z", "text"), ("long " * 40, "text")]


def test_short_pages_leave_the_estimate():
    chunks = [chunking.Chunk(t, "", "", 0, 0, "text") for t in ("abcdefgh", "ijklmnop", "qrstuvwx")]
    assert [x.page_no for x in chunking.located(chunks, ["abcdefgh", "ijklmnop", "qrstuvwx"])] == [1, 2, 3]
    assert chunking.located(chunks, []) == chunks and chunking.located([], ["a", "b"]) == []
