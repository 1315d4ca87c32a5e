"""Semantics that the tables don't show: chunking, extraction, filters, registry, schema, providers, streaming."""

import io
import os
import random
import zipfile

import duckdb
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docloom import config, schema
from docloom.functions import acl, analysis
from docloom.operators import chunking, evaluation, filters, generation, index, parents, providers, registry, scoring
from docloom.plans import catalogue
from docloom.session import map_batches
from docloom.sources import extract, files, jsonl, urls
from docloom.streaming import ingest

HANDBOOK = """# Staff guide
How we work.
## Leave
All staff have twenty days a year. Ask two weeks ahead. Sick days are apart.
More on the next page.
## Allowances
The table has all of them.

| Kind | Sum | Who | Note |
| --- | --- | --- | --- |
""" + "\n".join(f"| kind {i} | {i}00 | everybody at work | note number {i} |" for i in range(12)) + """

Ask for the rest.
## Safety
员工必须遵守安全规定。不得泄露密码。"""


def squeezed(text):
    return "".join(text.split())


def test_chunks_keep_everything():
    options = chunking.ChunkOptions(chunk_size=60, context_size=12)
    chunks = chunking.chunk_document(HANDBOOK, options=options)
    assert {"Leave", "Allowances", "Safety"} <= {c.header2 for c in chunks} and any(c.header1 == "Staff guide" for c in chunks)
    tables = [c for c in chunks if c.format == "table"]
    assert len({c.context_id for c in tables}) == 1 and len(tables) > 1 and any("<th>" in c.text for c in tables)
    for s in ("Sick days are apart.", "Ask for the rest.", "不得泄露密码"):
        assert sum(squeezed(s) in squeezed(c.text) for c in chunks) == 1
    assert chunking.chunk_document("") == chunking.chunk_document(" \n ") == chunking.chunk_document(None) == []


@pytest.mark.parametrize("n", [19, 20, 21, 40])
def test_a_line_left_over_is_a_piece(n):
    rows = [f"line {i}" + f" word{i}" * 20 for i in range(n + 1)]
    pages = ["\n".join(rows[i : i + 4]) for i in range(0, n + 1, 4)]
    got = chunking.chunk_document("\n".join(rows), pages, chunking.ChunkOptions(chunk_size=2, context_size=20, size="lines"))
    assert [(c.text, c.page_no) for c in got] == [("\n".join(rows[i : i + 2]), i // 4 + 1) for i in range(0, n + 1, 2)]


def test_overlap_is_refused():
    with pytest.raises(ValueError):
        chunking.ChunkOptions(chunk_overlap=1)
    with pytest.raises(ValueError):
        config.Chunking(context_overlap=2)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab .,;\n。#|-", max_size=300), st.integers(1, 20))
def test_split_round_trip(text, limit):
    pieces = chunking.split_recursively(text, limit, len)
    assert squeezed("".join(pieces)) == squeezed(text)
    assert all(p.strip() == p and p for p in pieces)


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="ab .\n#", max_size=200))
def test_sections_round_trip(text):
    found = chunking.sections(text)
    assert squeezed("".join(b for _, _, b in found)) == squeezed(text)


def test_sections_native_as_python(spark):
    docs = [(1, HANDBOOK), (2, "no heading"), (3, "# a\n\n### b\ntext\n# c"), (4, "\n\n")]
    got = {(r.doc_id, r.section_id, r.header1, r.header2) for r in chunking.split_sections(spark.createDataFrame(docs, "doc_id int, text string")).collect()}
    assert got == {(d, i, h1, h2) for d, t in docs for i, (h1, h2, _) in enumerate(chunking.sections(t))}


def test_pages_never_fall():
    pages = [f"# Part {i}\n" + f"Sentence of page {i} about matter {i}. " * 8 for i in range(1, 4)]
    got = [c.page_no for c in chunking.chunk_document("\n\n".join(pages), pages, chunking.ChunkOptions(chunk_size=30))]
    assert got == sorted(got) and got[0] == 1 and got[-1] == 3


@pytest.mark.parametrize("before, after", [(450, 900), (300, 340), (340, 300), (900, 450)])
def test_chunks_over_a_page_end_are_where_most_of_them_is(before, after):
    rng = random.Random(before)
    text = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n - 1)) + "x"
    first, one, two, last = text(600), text(before), text(after), text(600)
    chunks = [chunking.Chunk(t, "", "", 0, 0, "text") for t in (first, one + two, last)]
    assert [c.page_no for c in chunking.located(chunks, [first + one, two + last])] == [1, 2 if after > before else 1, 2]


def test_pages_of_the_query(spark, sf):
    whole = over = 0
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    chunks = {}
    for r in catalogue.QUERIES["chunk_pages"](spark, sf).orderBy("doc_id", "chunk_index").collect():
        chunks.setdefault(r.doc_id, []).append(r)
    for d, own in chunks.items():
        assert own[0].page_no == 1 and [r.page_no for r in own] == sorted(r.page_no for r in own)
        for r in own[1:]:
            if texts[d].count(r.text) == 1:  # where it is in the text says on which page most of it is
                at = texts[d].index(r.text)
                parts = {p + 1: min(at + len(r.text), 1000 * p + 1000) - max(at, 1000 * p) for p in range(at // 1000, (at + len(r.text) - 1) // 1000 + 1)}
                most = max(parts.values())
                if len(texts[d]) % 1000 < len(r.text) and max(parts) > len(texts[d]) // 1000:
                    continue  # a page that is shorter than the chunk and in it is as alike as can be
                if len(parts) == 1 or most > 0.7 * len(r.text):
                    whole, over = whole + (len(parts) == 1), over + (len(parts) > 1)
                    assert r.page_no == max(parts, key=parts.get), (d, r.chunk_index, parts, r.page_no)
    assert whole > 100 and over > 10


def test_inline_filters_of_whole_texts(spark, tmp_path):
    texts = {0: "one ext:DOC two\n\nuntil: 2020-05-06 three and four", 1: "a long text without any filter words, but for type", 2: "after:2019-01-02 and much xtype:pdf", 4: "plain"}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.term, r.types, str(r.date_from), str(r.date_to)) for r in catalogue.QUERIES["inline_filter_texts"](spark, str(tmp_path)).collect()}
    assert got == {
        0: ("one two three and four", "csv,doc,docx,pdf,xls,xlsm,xlsx", "2024-02-01", "2024-12-31"),
        1: ("a long text without any f ilter words, but for type", "htm,html,pdf", "None", "2024-12-31"),
        2: ("and much xtype:pdf", "", "2024-02-01", "2024-12-31"),
        4: ("pl ain", "htm,html,pdf", "2024-02-01", "2024-12-31"),
    }


def test_short_chunks_join():
    c = lambda t, ctx=0, f="text": chunking.Chunk(t, "", "", 0, ctx, f)
    long = "word " * 40
    assert [x.text for x in chunking.merged([c("short"), c(long)])] == ["short " + long]
    assert [x.text for x in chunking.merged([c(long), c("short"), c(long, 1)])] == [long + " short", long]
    assert [x.text for x in chunking.merged([c(long), c("end")])] == [long, "end"]  # one that waits at the end stays


def test_table_rejoin(spark):
    pieces = ["<th>| c1 | c2 |</th>\n| v1 | v2 |"] * 3
    df = spark.createDataFrame([(pieces,), (["plain"],), (["<th>| a |</th>\n| - |\n| 1 |"],)], "p array<string>")
    got = [r[0] for r in df.select(parents.rejoined_table(F.col("p"))).collect()]
    assert got == ["| c1 | c2 |\n| --- | --- |\n| v1 | v2 |\n| v1 | v2 |\n| v1 | v2 |", "plain", "| a |\n| - |\n| 1 |"]


def test_window_of_siblings(spark):
    chunks = spark.createDataFrame([("d", 0, 0, i, i + 1, "text", f"p{i}") for i in range(60)], "doc_id string, section_id int, context_id int, chunk_index int, page_no int, format string, snippet string")
    hits = chunks.where("chunk_index IN (0, 10, 55)").select(F.lit(1).alias("query_id"), *parents.PARENT, "chunk_index", "page_no", "snippet")
    got = {r.chunk_index: r.snippet.split("\n") for r in parents.passages(hits, chunks, 2).collect()}
    assert got[0] == ["p0", "p1", "p2"] and got[10] == ["p8", "p9", "p10", "p11", "p12"]
    assert got[55] == ["p23", "p24", "p25", "p26", "p27"]  # beyond the first 50: the middle one


@settings(max_examples=20, deadline=None)
@given(st.lists(st.integers(0, 2000), min_size=1, max_size=12), st.integers(600, 3000))
def test_packing_is_greedy(spark, sizes, budget):
    rows = [(1, i + 1, "x" * n) for i, n in enumerate(sizes)]
    got = generation.packed(spark.createDataFrame(rows, "query_id int, rank int, snippet string"), budget, 1500).count()
    total = n = 0
    for s in sizes:
        total += chunking.tokens("x" * min(s, 1500)) + 30
        if n and total > max(budget - 800, 500):
            break
        n += 1
    assert got == n


def test_citations(spark):
    cases = {"[1]": [1], "[1][3]": [1, 3], "[2, 3]": [2, 3], "[1，2]": [1, 2], "[9][0]": [], "[2] x [1] y [2]": [2, 1]}
    df = spark.createDataFrame([(k,) for k in cases], "a string")
    assert {r.a: list(r.c) for r in df.select("a", generation.citations(F.col("a"), F.lit(3)).alias("c")).collect()} == cases


def test_rewrite_falls_back(spark):
    df = spark.createDataFrame([("q", '"better"\nmore'), ("q", None), ("q", ""), ("q", "x" * 301)], "q string, a string")
    assert [r[0] for r in df.select(generation.rewritten(F.col("q"), F.col("a"))).collect()] == ["better", "q", "q", "q"]


def test_principals(spark):
    who = acl.Identity("alice", ("finance", "hr"), ("admin",))
    assert who.principals() == ["public", "user:alice", "group:finance", "group:hr", "role:admin"] and acl.Identity().principals() == ["public"]
    df = spark.createDataFrame([("alice", ["finance", "hr"], ["admin"]), ("anonymous", None, None)], "s string, g array<string>, r array<string>")
    assert [r[0] for r in df.select(acl.principals_of(F.col("s"), F.col("g"), F.col("r"))).collect()] == [who.principals(), ["public"]]


def test_inline_filters(spark):
    df = spark.createDataFrame([("report filetype:excel",), ("x after:2024-01-01 before:2024-12-31",), ("y EXT: pdf ",)], "q string")
    p = filters.parsed_query("q")
    a, b, c = df.select(*[v.alias(k) for k, v in p.items()]).collect()
    assert a.term == "report" and {"xlsx", "xls"} <= set(a.file_types) and b.term == "x" and str(b.date_from) == "2024-01-01" and str(b.date_to) == "2024-12-31" and c.file_types == ["pdf"] and c.term == "y"


def test_clauses(spark):
    df = spark.createDataFrame([(1, 5.0), (2, 0.0), (3, None)], "id int, s double")
    only = filters.Clauses(should=[F.col("s")])
    assert [r.id for r in only.apply(df).collect()] == [1]
    both = filters.Clauses(filter=[F.col("id") > 1], should=[F.col("s")], must_not=[F.col("id") == 3])
    assert [(r.id, r.score) for r in both.apply(df).collect()] == [(2, 0.0)] and len(both) == 3

    def broken(term, clauses, context):
        context.error = "no vector"
        return term

    assert filters.run_chain([broken, lambda *a: 1 / 0], "q", filters.Context()) is None


def test_modes(spark):
    part = lambda v: spark.createDataFrame([(1, "a", v)], "query_id int, k string, value double")
    parts = {"lexical": part(1.0), "vector": part(2.0), "decay": part(4.0)}
    assert {m: scoring.fused(parts, "k", m).first().score for m in scoring.MODES} == {"hybrid": 7.0, "keyword_only": 5.0, "semantic_only": 6.0}
    assert scoring.fused({"lexical": part(1.0)}, "k").first().score == 1.0  # no vector could be had


def test_cjk_terms(spark):
    df = spark.createDataFrame([("The ＡＢ用户手册 x1",)], "t string")
    assert df.select(analysis.terms("t")).first()[0] == ["ab", "用", "户", "手", "册", "用户", "户手", "手册", "x1"]


def test_decay_weight(spark):
    df = spark.createDataFrame([("the Latest rules",), ("rules",), ("最新规定",)], "q string")
    assert [r[0] for r in df.select(scoring.decay_weight(F.col("q"))).collect()] == [2.0, 1.0, 2.0]


def test_contract():
    schema.verify_contract(schema.chunk_type())
    with pytest.raises(ValueError, match="invented"):
        schema.verify_contract(schema.chunk_type(), [*schema.READ_FIELDS, "invented"])


def test_dims_guard(spark):
    df = spark.createDataFrame([([1.0, 2.0],)], "semantic_vector array<float>")
    assert schema.with_dims_guard(df, 2).count() == 1
    with pytest.raises(Exception, match="dimensions"):
        schema.with_dims_guard(df, 3).collect()


def test_row_codec(spark):
    df = spark.createDataFrame([("", 0, [], "x")], "file_name string, section_id int, acl array<string>, snippet string")
    assert df.select(schema.encoded(df)).first()[0] == '{"section_id":0,"snippet":"x"}'
    got = schema.decoded(spark.createDataFrame([(None, None, "", "body")], "file_name string, score double, snippet string, text_to_index string")).first()
    assert (got.file_name, got.score, got.snippet) == ("", 0.0, "body")


def test_settings(tmp_path):
    f = tmp_path / "c.yaml"
    f.write_text("chunking:\n  chunk_size: 50\nretrieval:\n  top_k: 7\n")
    s = config.load(f, {"DOCLOOM__RETRIEVAL__TOP_K": "9", "DOCLOOM__RETRIEVAL__RETURN_PARENT": "false"})
    assert (s.chunking.chunk_size, s.retrieval.top_k, s.retrieval.return_parent) == (50, 9, False)
    assert [config.coerce(x) for x in ("true", "3", "2.5", "x")] == [True, 3, 2.5, "x"]
    with pytest.raises(ValueError):
        config.load(None, {"DOCLOOM__NOWHERE__X": "1"})


def test_bad_rating(spark):
    with pytest.raises(Exception, match="no such rating"):
        registry.checked_feedback(spark.createDataFrame([("maybe",)], "rating string")).collect()


def test_empty_log(spark):
    r = registry.request_metrics(spark.createDataFrame([], "ok boolean, latency_ms long")).first()
    assert tuple(r) == (0, 0, 0, 0, 0.0)
    r = registry.request_metrics(spark.createDataFrame([(True, 100), (True, 300), (False, 50)], "ok boolean, latency_ms long")).first()
    assert tuple(r) == (3, 2, 150, 300, 0.3333)


def test_metrics(spark):
    cases = [(1, ["a", "x"], ["a", "b"]), (2, [], ["a"]), (3, ["x", "a"], ["a"]), (4, ["a"], [])]
    got = {(r.case_id, r.metric): r.value for r in evaluation.per_case(spark.createDataFrame(cases, "case_id int, retrieved array<string>, expected array<string>")).collect()}
    assert got[1, "recall@5"] == 0.5 and got[2, "precision@5"] == 0 and got[3, "mrr"] == 0.5 and got[3, "ndcg@5"] == 0.6309 and got[4, "recall@5"] == 0 and got[3, "recall@1"] == 0


def test_extractors(spark):
    html = b"<html><head><title>T</title><style>x</style></head><body><nav>skip</nav><h2>A</h2><p>one<br>two</p><ul><li>i</li></ul><table><tr><th>k</th></tr><tr><td>a|b</td></tr></table><pre>x\n y</pre></body></html>"
    assert extract.from_html(html).markdown == "# T\n\n## A\n\none two\n\n- i\n\n| k |\n| --- |\n| a\\|b |\n\n```\nx\n y\n```"
    assert extract.from_csv("a,b\n1\n".encode()).markdown == "| a | b |\n| --- | --- |\n| 1 |  |"
    assert extract.decode("汉".encode("gb18030")) == "汉"
    assert extract.html_table("<table><tr><td colspan=2>x</td></tr><tr><td>1</td><td>2</td></tr></table>").split("\n")[0] == "| x | x |"
    rows = spark.createDataFrame([(1, "html", bytearray(html)), (2, "zzz", bytearray(b"?")), (3, "docx", bytearray(b"broken"))], "doc_id int, document_type string, content binary")
    got = {r.doc_id: r for r in extract.extract(rows).collect()}
    assert got[1].error is None and got[1].title == "T" and "no extractor" in got[2].error and got[3].error


def _zip(files_):
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        for n, x in files_.items():
            z.writestr(n, x)
    return b.getvalue()


def test_character_references_on_request():
    page = b"<title>a &amp; b&amp c &quot;d &lt;p&gt; &#65;</title><h1>&amp;lt; &copy</h1>"
    assert extract.from_html(page).markdown == '# a & b& c "d <p> A\n\n# &lt; \u00a9'
    assert extract.from_html(page, references=("lt", "gt", "amp")).markdown == "# a & b&amp c &quot;d <p> &#65;\n\n# &lt; &copy"


@pytest.mark.parametrize("name", ["layout_blocks", "detector_results"])
def test_blocks_at_one_place_are_in_file_order(spark, tmp_path, name):
    rng = random.Random(5)
    rows = [(rng.randrange(40), rng.randrange(2), 1, rng.choice("NR"), rng.choice("OF"), f) for f in range(4) for _ in range(300)]
    for f in range(4):  # of different sizes, so not read in the order of their names
        part = pd.DataFrame([r[:5] for r in rows if r[5] == f], columns=["l_orderkey", "l_partkey", "l_linenumber", "l_returnflag", "l_linestatus"])
        os.makedirs(f"{tmp_path}/lineitem.parquet", exist_ok=True)
        part.to_parquet(f"{tmp_path}/lineitem.parquet/{f}.parquet", row_group_size=300 if f % 2 else 7)
    want = {}
    for key, part_key, _, flag, status, _ in sorted(rows, key=lambda r: (r[0], r[1])):
        if flag != "R":
            want.setdefault(key, []).append("## " * (status == "O") + f"part {part_key}")
    got = {r.l_orderkey: r.page for r in catalogue.QUERIES[name](spark.newSession(), str(tmp_path)).collect()}
    assert got == {k: "\n\n".join(v) for k, v in want.items()}


@pytest.mark.parametrize("name", ["layout_blocks", "detector_results"])
def test_blocks_of_lines_with_nulls(spark, tmp_path, name):
    rng = random.Random(8)
    pick = lambda *xs: rng.choice([None, *xs])
    rows = [(rng.randrange(150), pick(0, 1, 2), pick(1, 2, 3, 4), pick("N", "R"), pick("O", "F")) for _ in range(600)]
    columns = ["l_orderkey", "l_partkey", "l_linenumber", "l_returnflag", "l_linestatus"]
    spark.createDataFrame(rows, ", ".join(f"{c} {t}" for c, t in zip(columns, ["long", "long", "int", "string", "string"], strict=True))).coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    con = duckdb.connect()
    con.execute("SET threads = 1")  # on more, the order of what its ORDER BY leaves open varies
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    want = dict(con.execute(catalogue.ORACLE_SQL[name]).fetchall())
    assert None in want.values()
    assert {r.l_orderkey: r.page for r in catalogue.QUERIES[name](spark.newSession(), str(tmp_path)).collect()} == want


def test_office():
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    p = lambda t, s="": f'<w:p>{f"<w:pPr><w:pStyle w:val=\"{s}\"/></w:pPr>" if s else ""}<w:r><w:t>{t}</w:t></w:r></w:p>'
    doc = f'<w:document {w}><w:body>{p("Top", "Heading1")}{p("text")}<w:tbl><w:tr><w:tc>{p("a")}</w:tc><w:tc>{p("b")}</w:tc></w:tr></w:tbl></w:body></w:document>'
    assert extract.from_docx(_zip({"word/document.xml": doc})).markdown == "# Top\n\ntext\n\n| a | b |\n| --- | --- |"
    s, r = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"', 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    book = {
        "xl/workbook.xml": f'<workbook {s} {r}><sheets><sheet name="S" r:id="r1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>',
        "xl/sharedStrings.xml": f"<sst {s}><si><t>h</t></si></sst>",
        "xl/worksheets/sheet1.xml": f'<worksheet {s}><sheetData><row><c r="A1" t="s"><v>0</v></c></row><row><c r="B2"><v>5</v></c></row><row><c r="A3"/></row></sheetData></worksheet>',
    }
    assert extract.from_xlsx(_zip(book)).markdown == "## S\n\n| h |  |\n| --- | --- |\n|  | 5 |"


def test_ocr_fills_low_text_pages(spark):
    pages = spark.createDataFrame([("d", 1, "x" * 50, None), ("d", 2, " ", bytearray(b"img"))], "doc_id string, page_no int, text string, image binary")

    def read(s: pd.Series) -> pd.Series:
        return s.map(lambda b: "read" if b is not None else "")

    assert [(r.text, r.ocr) for r in extract.with_ocr(pages, read).orderBy("page_no").collect()] == [("x" * 50, False), ("read", True)]
    assert [r.ocr for r in extract.with_ocr(pages, None).collect()] == [False, False]


def test_files_and_stream(spark, tmp_path):
    root = tmp_path / "in"
    (root / ".git").mkdir(parents=True)
    for name, text in {"a.md": "# A\nbody of a", "~$b.md": "x", ".c.md": "x", "d.bin": "x", "e.txt": "", ".git/f.md": "x"}.items():
        (root / name).write_text(text)
    got = files.described(files.scan(spark, str(root)), str(root)).collect()
    assert [r.file_name for r in got] == ["a.md"] and got[0].extras["relative_path"] == "a.md" and got[0].document_type == "md"
    run = lambda: ingest.ingest_stream(spark, str(root), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    run()
    (root / "g.md").write_text("second file")
    run()
    rows = ingest.read_chunks(spark, str(tmp_path / "out")).collect()
    assert sorted(r.file_name for r in rows) == ["a.md", "g.md"]
    # a file that changes is read again, by the same checkpoint and by a new one, and has its last text only
    (root / "a.md").write_text("# A\nanother body")
    os.utime(root / "a.md", (2_000_000_000, 2_000_000_000))
    run()
    bodies = lambda: {r.file_name: r.snippet for r in ingest.read_chunks(spark, str(tmp_path / "out")).collect()}
    assert "another body" in bodies()["a.md"] and ingest.read_chunks(spark, str(tmp_path / "out")).count() == 2
    (root / "a.md").write_text("# A\nlast body")
    os.utime(root / "a.md", (2_000_000_100, 2_000_000_100))
    version = ingest.opened(spark, str(tmp_path / "out")).version
    ingest.ingest_stream(spark, str(root), str(tmp_path / "out"), str(tmp_path / "cp2")).awaitTermination()
    assert "last body" in bodies()["a.md"] and ingest.read_chunks(spark, str(tmp_path / "out")).count() == 2
    assert ingest.opened(spark, str(tmp_path / "out")).version == version + 1  # what the new checkpoint reads again is as it was
    (root / "g.md").unlink()
    ingest.refresh(spark, str(root), str(tmp_path / "out"), remove_missing=True)
    assert set(bodies()) == {"a.md"}


def test_delta_goes_by_the_newest_chunk(spark):
    held = spark.createDataFrame([("a", "z-old", 1), ("a", "b-new", 2), ("b", "x", None)], "doc_id string, content_hash string, indexed_at int")
    incoming = spark.createDataFrame([("a", "b-new"), ("b", "y"), ("c", "x")], "doc_id string, content_hash string")
    assert {r.doc_id: r.state for r in index.delta(held, incoming).collect()} == {"a": "unchanged", "b": "changed", "c": "new"}


def test_batches_come_in_parts(spark):
    def run(batches):
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "n": [len(b)] * len(b)})

    got = map_batches(spark.range(0, 1203, 1, 1).withColumnRenamed("id", "doc_id"), run, "doc_id long, n long").collect()
    assert sorted(r.doc_id for r in got) == list(range(1203)) and max(r.n for r in got) <= 500


def test_whole_csv_files():
    content = "\n".join(["a,b"] + [f"{i},x" for i in range(7000)]).encode()
    assert extract.from_csv(content).markdown.count("\n") == extract.CSV_ROWS and extract.from_csv(content, None).markdown.count("\n") == 7001


def test_keywords_fold_ascii_only(spark):
    df = spark.createDataFrame([("CAFÉ.md",), ("café.md",), ("a_b%",)], "n string")
    found = lambda k: [r.n for r in df.where(filters.like_keyword(k, F.col("n"))).collect()]
    assert found("Café") == ["café.md"] and found("cafÉ") == ["CAFÉ.md"] and found("CAF") == ["CAFÉ.md", "café.md"] and found("A_B") == ["a_b%"]


def test_jsonl(spark, tmp_path):
    (tmp_path / "c.jsonl").write_text('# c\n\n{"query": "q", "expected": ["a"]}\n{bad\n{"query": " "}\n{"query": "r", "expected_docs": ["b"], "tags": ["t"]}\n')
    cases = jsonl.read_cases(spark, str(tmp_path / "c.jsonl"))
    assert sorted((r.query, tuple(r.expected_docs)) for r in cases.collect()) == [("q", ("a",)), ("r", ("b",))]
    jsonl.write_cases(cases, str(tmp_path / "out"))
    assert jsonl.read_cases(spark, str(tmp_path / "out")).count() == 2


def test_urls(spark):
    df = spark.createDataFrame([("http://h/a%20b.PDF?x#y", None), ("http://h.org/", "text/plain; charset=x"), ("http://h/x/报告.md", "a/b")], "u string, c string")
    s = urls.guessed_suffix(F.col("u"), F.col("c"))
    assert [tuple(r) for r in df.select(s, urls.safe_name(F.col("u"), s)).collect()] == [("pdf", "a-b.pdf"), ("txt", "h.org.txt"), ("md", "报告.md")]


def test_providers(spark):
    df = spark.createDataFrame([("same words",), ("same words",), ("",), (None,)], "t string")
    got = [list(r.v) for r in providers.embedded(df, "t", lambda: providers.hash_embedding(8), 8, "v").collect()]
    assert got[0] == got[1] and got[2] == got[3] == [0.0] * 8
    waits, calls = [], []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise OSError
        return "ok"

    assert providers.with_retries(flaky, sleep=waits.append) == "ok" and waits == [1, 2]

    def refuse():
        raise providers.Refused(400)

    with pytest.raises(providers.Refused):
        providers.with_retries(refuse, sleep=waits.append)
    assert len(waits) == 2


def test_plans_push_down(spark, sf):
    from docloom.session import table

    plan = table(spark, sf, "orders").where(filters.in_dates(F.col("o_orderdate"), "1995-03-01")).select("o_orderkey")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(o_orderdate), GreaterThanOrEqual" in plan or "o_orderdate" in plan.split("PushedFilters")[1]
    assert "o_custkey" not in plan


def test_stems_are_words_of_the_vocabulary(spark):
    known = "pony ponies hope hop hopped hoped hoping hopping boxes box class classes news new sing singing king thing studied study meeting meetings agreed agree ties tie red".split()
    got = {r.term: r.stem for r in analysis.stems(spark.createDataFrame([(w,) for w in known + ["pony"]], "term string")).collect()}
    want = {w: w for w in known} | {
        "ponies": "pony", "hopped": "hop", "hoped": "hope", "hoping": "hope", "hopping": "hop", "boxes": "box", "classes": "class", "news": "new", "singing": "sing", "studied": "study", "meetings": "meeting", "agreed": "agree", "ties": "tie",
    }
    assert got == want
    rows = spark.createDataFrame([(1, "hoped"), (1, "unheard")], "query_id int, term string")
    table = analysis.stems(spark.createDataFrame([("hoped",), ("hope",)], "term string"))
    assert sorted(tuple(r) for r in analysis.stemmed(rows, table).collect()) == [(1, "hope"), (1, "unheard")]


def test_chunk_pages_counts_grams_as_numbers():
    """located() built a table of strings for each page and chunk; numbers tell the same."""
    texts = ["", "a b", "abcde", "the same words again and again and again", "again and words", "漢字 " * 9, "".join(map(chr, range(0x3400, 0x3400 + 7000)))]
    for some in (texts[:-1], texts):
        counts = chunking.gram_counts(some)
        for i, a in enumerate(some):
            for j, b in enumerate(some):
                assert chunking.shared(counts[i], counts[j]) == (chunking.character_grams(a) & chunking.character_grams(b)).total()


def test_chunks_keep_large_and_null_ids(spark):
    rows = spark.createDataFrame([(2**62 + 1, "# A\n\none two"), (None, "x"), (3, None)], "doc_id long, text string")
    assert sorted(((r.doc_id, r.chunk_index, r.header1) for r in chunking.chunk_documents(rows).collect()), key=str) == [(2**62 + 1, 0, "A"), (None, 0, "")]


def test_metrics_look_at_places_once(spark):
    """Each metric had functions of its own for each place, none of them compiled."""
    from docloom.operators import evaluation

    cases = spark.createDataFrame([(1, ["x", "a", None, "a"], ["a", "b"]), (2, [], ["a"]), (3, ["a"], []), (4, None, None)], "case_id int, retrieved array<string>, expected array<string>")
    values = evaluation.per_case(cases, (1, 3, 40))
    assert values._jdf.queryExecution().optimizedPlan().toString().count("lambdafunction(coalesce(array_contains") == 1
    got = {(r.case_id, r.metric): r.value for r in values.collect()}
    assert got[1, "precision@3"] == 0.3333 and got[1, "precision@40"] == 0.5 and got[1, "mrr"] == 0.5 and got[1, "recall@3"] == 0.5
    assert got[1, "ndcg@3"] == 0.3869 and got[1, "ndcg@40"] == round((0.6309297535714574 + 0.43067655807339306) / 1.6309297535714573, 4)
    assert all(v == 0 for (case, _), v in got.items() if case > 1)
