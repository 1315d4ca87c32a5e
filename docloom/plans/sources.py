"""Queries over files and what is read from them. The files are made of table rows, so that SQL can say what comes out."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions import analysis
from docloom.functions import text as tx
from docloom.schema import decoded
from docloom.session import table
from docloom.sources import extract, files, jsonl

from .base import AS_OF, query

#: Names that are read and names that are passed over, by doc_id.
_NAMES = ("/a.md", "/b.TXT", "/~$c.docx", "/.hidden.md", "/.git/d.md", "/node_modules/x/e.md", "/f.exe", "/g", "/sub dir/h.xlsx", "/i.tar.csv")


def _files(spark: SparkSession, sf: str) -> DataFrame:
    """path, length, modificationTime and content of a made file for each document."""
    name = F.element_at(F.array(*map(F.lit, _NAMES)), (F.col("doc_id") % len(_NAMES) + 1).cast("int"))
    length = F.when(F.col("doc_id") % 7 == 0, 0).when(F.col("doc_id") % 11 == 0, 200 * 1024 * 1024).otherwise(F.length("text")).cast("long")
    return table(spark, sf, "documents").select(
        "doc_id", F.concat(F.lit("file:///data/"), F.col("doc_id").cast("string"), name).alias("path"), length.alias("length"), F.lit(AS_OF).cast("timestamp").alias("modificationTime"), F.col("text").cast("binary").alias("content"),
    )


@query("""SELECT doc_id FROM documents WHERE doc_id % 10 IN (0, 1, 8, 9) AND doc_id % 7 <> 0 AND doc_id % 11 <> 0 AND length(text) > 0""")
def file_scan_rules(spark: SparkSession, sf: str) -> DataFrame:
    """Suffixes, folders and names that are passed over, empty and too large files."""
    return _files(spark, sf).where(files.accepted(F.col("path"), F.col("length"))).select("doc_id")


@query("""SELECT left(sha1(path), 16) AS doc_id, regexp_extract(path, '[^/]*$') AS file_name, path AS file_path, 'file://' || path AS file_url, suffix AS document_type, sha256(text) AS content_hash, 'group:x' AS acl, path[7:] AS relative
  FROM (SELECT '/data/' || doc_id || ['/a.md', '/b.TXT', '/~$c.docx', '/.hidden.md', '/.git/d.md', '/node_modules/x/e.md', '/f.exe', '/g', '/sub dir/h.xlsx', '/i.tar.csv'][doc_id % 10 + 1] AS path,
    ['md', 'txt', 'docx', 'md', 'md', 'md', 'exe', '', 'xlsx', 'csv'][doc_id % 10 + 1] AS suffix, text FROM documents)""")
def file_metadata(spark: SparkSession, sf: str) -> DataFrame:
    found = files.described(_files(spark, sf), "/data", ("group:x",))
    return found.select("doc_id", "file_name", "file_path", "file_url", "document_type", "content_hash", F.array_join("acl_principals", ",").alias("acl"), F.col("extras")["relative_path"].alias("relative"))


@query("""SELECT '{"query":"q' || item_id || ' é","expected_docs":["' || item_id || '"],"note":"","tags":[]}' AS value FROM benchmark""")
def eval_export(spark: SparkSession, sf: str) -> DataFrame:
    key, none = F.col("item_id").cast("string"), F.array().cast("array<string>")
    cases = table(spark, sf, "benchmark").select(F.concat(F.lit("q"), key, F.lit(" é")).alias("query"), F.array(key).alias("expected_docs"), F.lit("").alias("note"), none.alias("tags"))
    return jsonl.case_lines(cases)


@query("""SELECT doc_id, CASE WHEN doc_id % 4 = 3 THEN '' ELSE regexp_replace(text, '^\\s+|\\s+$', '', 'g') END AS text, doc_id % 4 = 3 AS failed FROM documents""")
def text_extract(spark: SparkSession, sf: str) -> DataFrame:
    """Texts by their suffixes, every third kind in gb18030 and the others in UTF-8; a suffix that nobody reads is a failed row."""
    kind = F.element_at(F.array(*map(F.lit, ("md", "txt", "rst", "unheard"))), (F.col("doc_id") % 4 + 1).cast("int"))
    wide = F.concat(F.lit("  "), "text", F.lit(" \n\n"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(content=[t.encode("gb18030" if kind == "rst" else "utf-8") for kind, t in zip(b["document_type"], b["content"], strict=True)])

    rows = table(spark, sf, "documents").select("doc_id", kind.alias("document_type"), wide.alias("content")).mapInPandas(run, "doc_id long, document_type string, content binary")
    return extract.extract(rows).select("doc_id", "text", F.col("error").isNotNull().alias("failed"))


@query("""SELECT o_custkey AS doc_id, '| key | priority | note |' || chr(10) || '| --- | --- | --- |' || chr(10) || string_agg('| ' || o_orderkey || ' | ' || replace(o_orderpriority, '-', '\\|') || ' |  |', chr(10) ORDER BY o_orderkey) AS text FROM orders GROUP BY o_custkey""")
def csv_extract(spark: SparkSession, sf: str) -> DataFrame:
    """A customer's orders as CSV, with bars in cells, quotes, and a last column that only the header has."""
    line = F.concat(F.col("o_orderkey").cast("string"), F.lit(',"'), F.replace("o_orderpriority", F.lit("-"), F.lit("|")), F.lit('"'))
    rows = table(spark, sf, "orders").select("o_custkey", "o_orderkey", line.alias("line")).groupBy(F.col("o_custkey").alias("doc_id"))
    lines = rows.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", "line"))), lambda x: x["line"]), "\r\n").alias("lines"))
    made = lines.select("doc_id", F.lit("csv").alias("document_type"), F.concat(F.lit("key,priority,note\r\n"), "lines").cast("binary").alias("content"))
    return extract.extract(made).select("doc_id", "text")


@query("""SELECT r_regionkey AS doc_id, '# ' || r_name || chr(10) || chr(10) || '## Nations & more' || chr(10) || chr(10) || string_agg('- ' || n_name, chr(10) || chr(10) ORDER BY n_nationkey) || chr(10) || chr(10) || '| key | name |' || chr(10) || '| --- | --- |' || chr(10)
  || string_agg('| ' || n_nationkey || ' | ' || n_name || '\\|x |', chr(10) ORDER BY n_nationkey) || chr(10) || chr(10) || '```' || chr(10) || 'a  b' || chr(10) || '```' AS text, r_name AS title FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_regionkey, r_name""")
def html_extract(spark: SparkSession, sf: str) -> DataFrame:
    """A page for each region: title, heading, items, a table, code; scripts and navigation are left out."""
    nations = table(spark, sf, "nation")
    item = F.struct("n_nationkey", F.concat(F.lit("<li>"), "n_name", F.lit("</li>")).alias("li"), F.concat(F.lit("<tr><td>"), F.col("n_nationkey").cast("string"), F.lit("</td><td>"), "n_name", F.lit("|x</td></tr>")).alias("tr"))
    each = nations.groupBy("n_regionkey").agg(F.array_sort(F.collect_list(item)).alias("x"))
    joined = lambda name: F.array_join(F.transform("x", lambda v: v[name]), "")
    page = F.concat(
        F.lit("<html><head><title>"), "r_name", F.lit("</title><script>var x = 1;</script></head><body><nav><li>skip</li></nav><h2>Nations &amp; more</h2><ul>"), joined("li"),
        F.lit("</ul><table><tr><th>key</th><th>name</th></tr>"), joined("tr"), F.lit("</table><pre>a  b</pre><footer><p>skip</p></footer></body></html>"),
    )
    rows = table(spark, sf, "region").join(each, F.col("r_regionkey") == F.col("n_regionkey"))
    return extract.extract(rows.select(F.col("r_regionkey").alias("doc_id"), F.lit("html").alias("document_type"), page.cast("binary").alias("content"))).select("doc_id", "text", "title")


@query("""SELECT doc_id, CASE WHEN doc_id % 3 = 0 AND doc_id % 2 = 0 THEN 'read ' || doc_id WHEN doc_id % 3 = 0 THEN ' short ' ELSE text END AS text, doc_id % 6 = 0 AS ocr FROM documents WHERE length(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) >= 40""")
def ocr_routing(spark: SparkSession, sf: str) -> DataFrame:
    """Pages with little text get what is read from their images, where anything is."""
    import pandas as pd

    def read(images: pd.Series) -> pd.Series:
        return images.map(lambda b: bytes(b).decode() if b is not None and len(b) else "")

    pages = table(spark, sf, "documents").where(F.length(tx.strip("text")) >= 40).select(
        "doc_id", F.lit(1).alias("page_no"), F.when(F.col("doc_id") % 3 == 0, " short ").otherwise(F.col("text")).alias("text"), F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("read "), F.col("doc_id").cast("string")).cast("binary")).alias("image"),
    )
    read.__annotations__ = {"images": pd.Series, "return": pd.Series}
    return extract.with_ocr(pages, read).select("doc_id", "text", "ocr")


@query("""SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN '' ELSE lang END AS document_type, CASE WHEN doc_id % 3 = 0 THEN text ELSE 'own' END AS snippet, 1 AS page_no, CASE WHEN doc_id % 5 = 0 THEN 0.0 ELSE 1.5 END::DOUBLE AS score FROM documents""")
def row_decode(spark: SparkSession, sf: str) -> DataFrame:
    """What readers see of rows with nulls: defaults, the indexed text for an empty snippet, no score as 0."""
    k = F.col("doc_id")
    rows = table(spark, sf, "documents").select(
        "doc_id", F.when(k % 2 == 1, F.col("lang")).alias("document_type"), F.when(k % 3 == 0, F.when(k % 2 == 0, "")).otherwise("own").alias("snippet"), F.col("text").alias("text_to_index"), F.lit(None).cast("int").alias("page_no"),
        F.when(k % 5 != 0, 1.5).alias("score"),
    )
    return decoded(rows).select("doc_id", "document_type", "snippet", "page_no", "score")


@query("""SELECT o_orderkey, left(sha256('order' || chr(31) || o_orderkey || chr(31) || o_orderpriority), 16) AS id FROM orders""")
def derived_ids(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select("o_orderkey", tx.stable_id(F.lit("order"), "o_orderkey", "o_orderpriority").alias("id"))


@query("""WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS term FROM documents), p AS (SELECT unnest([term, term || 's', term || 'es', term || 'ies']) AS term FROM w WHERE length(term) > 1)
  SELECT DISTINCT term, CASE WHEN length(term) <= 3 THEN term WHEN regexp_matches(term, '[^ae]ies$') THEN term[:-4] || 'y' WHEN regexp_matches(term, '[^us]s$') THEN term[:-2] ELSE term END AS stem FROM p""")
def stemmed_terms(spark: SparkSession, sf: str) -> DataFrame:
    """All words of the documents, also with endings put on, and their singulars."""
    words = table(spark, sf, "documents").select(F.explode(analysis.terms("text", ())).alias("term")).distinct().where("length(term) > 1")
    more = words.select(F.explode(F.array("term", *[F.concat("term", F.lit(e)) for e in ("s", "es", "ies")])).alias("term")).distinct()
    return more.select("term", F.element_at(analysis.terms("term", (), stem=True), 1).alias("stem"))


_SINGLE = "CASE WHEN substr(term, length(term) - {n}, 1) = substr(term, length(term) - {m}, 1) THEN [term[:-{k}]] ELSE []::VARCHAR[] END"
_INFLECTED_SQL = f"""CASE WHEN length(term) <= 3 THEN []::VARCHAR[] WHEN suffix(term, 'ies') THEN [term[:-2], term[:-4] || 'y'] WHEN suffix(term, 'es') THEN [term[:-2], term[:-3]]
  WHEN suffix(term, 's') AND NOT suffix(term, 'ss') THEN [term[:-2]] WHEN suffix(term, 'ied') THEN [term[:-2], term[:-4] || 'y'] WHEN suffix(term, 'ed') THEN list_concat([term[:-2], term[:-3]], {_SINGLE.format(n=2, m=3, k=4)})
  WHEN suffix(term, 'ing') AND length(term) > 5 THEN list_concat([term[:-4] || 'e', term[:-4]], {_SINGLE.format(n=3, m=4, k=5)}) ELSE []::VARCHAR[] END"""


@query(f"""WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+')) AS term FROM documents),
  v AS (SELECT DISTINCT unnest([term, term || 's', term || 'es', term || 'ed', term || 'ing', term || right(term, 1) || 'ed', term || right(term, 1) || 'ing', left(term, length(term) - 1) || 'ied', left(term, length(term) - 1) || 'ies']) AS term FROM w WHERE length(term) > 1),
  c AS (SELECT term, unnest(s) AS stem, generate_subscripts(s, 1) AS k FROM (SELECT term, {_INFLECTED_SQL} AS s FROM v)), f AS (SELECT c.term, arg_min(c.stem, c.k) AS stem FROM c JOIN v ON v.term = c.stem GROUP BY c.term)
  SELECT v.term, coalesce(f.stem, v.term) AS stem FROM v LEFT JOIN f USING (term)""")
def vocabulary_stems(spark: SparkSession, sf: str) -> DataFrame:
    """All words of the documents, also inflected, and their stems among themselves."""
    words = table(spark, sf, "documents").select(F.explode(analysis.terms("text", ())).alias("term")).distinct().where("length(term) > 1")
    last, rest = F.right("term", F.lit(1)), F.left("term", F.length("term") - 1)
    forms = [F.concat("term", F.lit(e)) for e in ("s", "es", "ed", "ing")] + [F.concat("term", last, F.lit(e)) for e in ("ed", "ing")] + [F.concat(rest, F.lit(e)) for e in ("ied", "ies")]
    return analysis.stems(words.select(F.explode(F.array("term", *forms)).alias("term")))
