"""Files to markdown: text, CSV, HTML, DOCX, XLSX and layout blocks, by a registry of extractors.

Parsers are of the standard library. PDF text and page images come from outside: a PDF row brings its pages, and pages with little text can go through an OCR function.
"""

from __future__ import annotations

import csv
import io
import re
import zipfile
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser
from itertools import islice
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions.text import escape_cell, strip
from docloom.session import map_batches

from . import pdf

#: Rows of a CSV and characters of a cell that are read unless others are asked for; characters that a page without OCR has at least; elements of a page that aren't read; labels of layout blocks.
CSV_ROWS, CELL, LOW_TEXT = 5000, 2000, 40
DROPPED = ("script", "style", "nav", "footer", "noscript")
TITLE_LABELS, HEADING_LABELS = ("doc_title", "title"), ("paragraph_title", "para_title", "section_title")
TABLE_LABELS, FORMULA_LABELS = ("table",), ("formula", "equation")
SKIPPED_LABELS = ("header", "footer", "page_number", "aside_text", "footnote")


@dataclass
class Extracted:
    """A document's markdown and its pages; where one is missing it comes from the other."""

    markdown: str = ""
    pages: list[str] = field(default_factory=list)
    meta: dict[str, str] = field(default_factory=dict)
    ocr_pages: list[int] = field(default_factory=list)

    def __post_init__(self) -> None:
        if not self.markdown and self.pages:
            self.markdown = "\n\n".join(self.pages)
        elif self.markdown and not self.pages:
            self.pages = [self.markdown]


def decode(content: bytes) -> str:
    for name in ("utf-8", "gb18030"):
        try:
            return content.decode(name)
        except UnicodeDecodeError:
            pass
    return content.decode("latin-1")


def cell(text: object, most: int | None = CELL) -> str:
    """most: characters that are kept, None for all."""
    return ("" if text is None else str(text)).replace("|", "\\|").replace("\n", " ").strip()[:most]


def markdown_table(rows: list[list[str]]) -> str:
    """The first row is the header; short rows are filled up."""
    if not rows:
        return ""
    width = max(map(len, rows))
    line = lambda r: "| " + " | ".join([*r, *[""] * (width - len(r))]) + " |"
    return "\n".join([line(rows[0]), "|" + " --- |" * width, *map(line, rows[1:])])


def from_csv(content: bytes, most_rows: int | None = CSV_ROWS) -> Extracted:
    """most_rows: None for all; `register_extractor(("csv",), partial(from_csv, most_rows=None))` reads files whole."""
    rows = list(islice(csv.reader(io.StringIO(decode(content))), most_rows))
    return Extracted(markdown_table([[x.strip().replace("|", "\\|") for x in r] for r in rows]))


def from_text(content: bytes) -> Extracted:
    return Extracted(decode(content).strip())


class _Page(HTMLParser):
    """Title, and a tree of elements with their texts."""

    VOID = frozenset(("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"))

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root: list = ["root", {}, []]
        self.open = [self.root]

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in ("p", "li", "tr", "td", "th"):  # that close themselves
            for i in range(len(self.open) - 1, 0, -1):
                if self.open[i][0] == tag:
                    del self.open[i:]
                    break
                if self.open[i][0] in ("ul", "ol", "table", "div", "blockquote", "body", "section", "article", "tr" if tag in ("td", "th") else "table"):
                    break
        node = [tag, dict(attrs), []]
        self.open[-1][2].append(node)
        if tag not in self.VOID:
            self.open.append(node)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.open[-1][2].append([tag, dict(attrs), []])

    def handle_endtag(self, tag: str) -> None:
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i][0] == tag:
                del self.open[i:]
                return

    def handle_data(self, data: str) -> None:
        self.open[-1][2].append(data)


def _walk(node: list) -> Iterator[list]:
    for x in node[2]:
        if isinstance(x, list) and x[0] not in DROPPED:
            yield x
            yield from _walk(x)


def _text(node: list, raw: bool = False) -> str:
    parts = []
    for x in node[2]:
        if isinstance(x, str):
            parts.append(x)
        elif x[0] not in DROPPED:
            parts.append("\n" if x[0] == "br" and raw else " " if x[0] == "br" else _text(x, raw))
    joined = "".join(parts)
    return joined if raw else re.sub(r"\s+", " ", joined).strip()


def _spanned_rows(table: list, spans: bool) -> list[list[str]]:
    rows = []
    for tr in (x for x in _walk(table) if x[0] == "tr"):
        row: list[str] = []
        for td in (x for x in _walk(tr) if x[0] in ("td", "th")):
            n = td[1].get("colspan") or "1"
            row.extend([cell(_text(td))] * (max(1, int(n)) if spans and n.isdigit() else 1))
        if row:
            rows.append(row)
    return rows


def from_html(content: bytes, nested_twice: bool = True, references: tuple[str, ...] | None = None) -> Extracted:
    """Headings, paragraphs, list items, tables and code, in order. A paragraph or an item inside of an item or a table counts there and on its own, unless nested_twice is off.

    references: names of the character references that are read, all others stay as they are written; None for all that HTML has, numbers and those without a semicolon among them.
    """
    text = decode(content)
    if references is not None:
        text = re.sub(rf"&(?!(?:{'|'.join(map(re.escape, references))});)", "&amp;", text)
    page = _Page()
    page.feed(text)
    page.close()
    title = next((_text(x) for x in _walk(page.root) if x[0] == "title"), "")
    parts = [f"# {title}"] if title else []
    inside: set[int] = set()
    for x in _walk(page.root):
        if id(x) in inside and not nested_twice:
            continue
        tag = x[0]
        if tag in ("h1", "h2", "h3", "h4"):
            part = "#" * min(int(tag[1]), 3) + " " + _text(x) if _text(x) else ""
        elif tag == "p":
            part = _text(x)
        elif tag == "li":
            part = "- " + _text(x) if _text(x) else ""
        elif tag == "table":
            part = markdown_table(_spanned_rows(x, False))
        elif tag == "pre":
            part = "```\n" + _text(x, raw=True).strip("\n") + "\n```"
        else:
            continue
        inside.update(id(y) for y in _walk(x))
        if part:
            parts.append(part)
    return Extracted(re.sub(r"\n{3,}", "\n\n", "\n\n".join(parts)).strip(), meta={"title": title} if title else {})


def html_table(text: str) -> str:
    """A table's HTML, as OCR gives it, to markdown; a cell over several columns is repeated, rowspan isn't."""
    page = _Page()
    page.feed(text)
    page.close()
    return markdown_table(_spanned_rows(page.root, True)) or text


_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def from_docx(content: bytes) -> Extracted:
    """Body order; heading styles to levels of at most 3, the title style to level 1, list styles to items; tables."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")
        meta = {}
        if "docProps/core.xml" in z.namelist():
            for e in ElementTree.fromstring(z.read("docProps/core.xml")):
                if e.text and e.tag.rpartition("}")[2] in ("title", "creator", "subject"):
                    meta[e.tag.rpartition("}")[2]] = e.text
    words = lambda e: "".join(t.text or "" for t in e.iter(f"{_W}t")).strip()
    parts = []
    for e in body if body is not None else []:
        if e.tag == f"{_W}tbl":
            parts.append(markdown_table([[cell(words(c)) for c in r.findall(f"{_W}tc")] for r in e.findall(f"{_W}tr")]))
        elif e.tag == f"{_W}p" and (text := words(e)):
            style = e.find(f"{_W}pPr/{_W}pStyle")
            name = (style.get(f"{_W}val") or "").lower().replace(" ", "") if style is not None else ""
            level = re.match(r"heading(\d)", name)
            parts.append(f"{'#' * min(int(level.group(1)), 3)} {text}" if level else f"# {text}" if name == "title" else f"- {text}" if name.startswith("list") else text)
    return Extracted("\n\n".join(p for p in parts if p), meta=meta)


def from_xlsx(content: bytes) -> Extracted:
    """A page for each sheet: its title and its rows that aren't blank."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = z.namelist()
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in si.iter(f"{_S}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).findall(f"{_S}si")]
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        pages = []
        for sheet in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{_S}sheet"):
            target = (targets.get(sheet.get(f"{_R}id")) or "").lstrip("/")
            root = ElementTree.fromstring(z.read(target if target.startswith("xl/") else f"xl/{target}"))
            rows = []
            for r in root.iter(f"{_S}row"):
                row: list[str] = []
                for c in r.findall(f"{_S}c"):
                    letters = re.match(r"[A-Z]*", c.get("r") or "").group()
                    at = 0
                    for ch in letters:
                        at = at * 26 + ord(ch) - 64
                    row.extend([""] * (at - 1 - len(row)))
                    v, kind = c.find(f"{_S}v"), c.get("t")
                    inline = "".join(t.text or "" for t in c.iter(f"{_S}t"))
                    value = v.text if v is not None and v.text else inline
                    row.append(cell(shared[int(value)] if kind == "s" and value else value))
                if any(row):
                    rows.append(row)
            pages.append("\n\n".join(x for x in (f"## {sheet.get('name')}", markdown_table(rows)) if x))
    return Extracted(pages=pages)


def from_pdf(content: bytes) -> Extracted:
    """Pages of text; those with little of it are for OCR (low_text)."""
    return Extracted(pages=[pdf.normalised(t) for t in pdf.pages_of(content)])


Extractor = Callable[[bytes], Extracted]
_REGISTRY: list[tuple[tuple[str, ...], Extractor]] = [
    (("docx",), from_docx), (("xlsx", "xlsm"), from_xlsx), (("md", "markdown", "mdx"), from_text), (("html", "htm"), from_html), (("csv",), from_csv), (("pdf",), from_pdf),
    (("txt", "log", "rst", "json", "yaml", "yml"), from_text),
]


def register_extractor(suffixes: tuple[str, ...], extractor: Extractor, front: bool = True) -> None:
    _REGISTRY.insert(0 if front else len(_REGISTRY), (suffixes, extractor))


def replace_registry(registry: list[tuple[tuple[str, ...], Extractor]]) -> None:
    _REGISTRY[:] = registry


def extractor_for(suffix: str) -> Extractor:
    for suffixes, e in _REGISTRY:
        if suffix.lower() in suffixes:
            return e
    raise ValueError(f"no extractor for {suffix!r}")


def extract(files: DataFrame, first: tuple[tuple[tuple[str, ...], Extractor], ...] = ()) -> DataFrame:
    """files: doc_id, document_type, content. doc_id, text, pages, title, error (null when it went well): a file that can't be read is a row with an error. first: (suffixes, extractor) that come before those of the registry."""
    kind = files.schema["doc_id"].dataType.simpleString()
    registry = [*first, *_REGISTRY]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        replace_registry(registry)  # what was registered on the driver, in the worker's own module
        for b in batches:
            rows = []
            for key, suffix, content in zip(b["doc_id"], b["document_type"], b["content"], strict=True):
                try:
                    e = extractor_for(suffix or "")(bytes(content or b""))
                    rows.append((key, e.markdown, e.pages, e.meta.get("title"), None))
                except Exception as x:  # noqa: BLE001  a bad file is a failed row, not a failed job
                    rows.append((key, "", [], None, f"{type(x).__name__}: {x}"[:1000]))
            yield pd.DataFrame(rows, columns=["doc_id", "text", "pages", "title", "error"])

    return map_batches(files.select("doc_id", "document_type", "content"), run, f"doc_id {kind}, text string, pages array<string>, title string, error string")


def low_text(page: Column) -> Column:
    """A page that needs OCR."""
    return F.length(strip(page)) < LOW_TEXT


def with_ocr(pages: DataFrame, ocr: Callable[[pd.Series], pd.Series] | None) -> DataFrame:
    """pages: doc_id, page_no, text, image. Low-text pages get what OCR reads; without a function, or where it gives nothing, they stay. Adds ocr."""
    need = low_text(F.coalesce("text", F.lit("")))
    if ocr is None:
        return pages.withColumn("ocr", F.lit(False))
    read = F.pandas_udf(ocr, "string")
    found = F.when(need, read(F.when(need, F.col("image"))))
    out = pages.withColumn("_read", found).withColumn("ocr", need & (F.coalesce(F.length("_read"), F.lit(0)) > 0))
    return out.withColumn("text", F.when(F.col("ocr"), F.col("_read")).otherwise(F.col("text"))).drop("_read")


def layout_markdown(blocks: Column) -> Column:
    """Blocks (label, content, bbox) of a page by their top and left corner: titles, headings, tables (already markdown), formulas, text; headers, footers and the like are left out."""
    at = lambda b, i: F.coalesce(F.get(b["bbox"], F.lit(i)), F.lit(0))
    placed = F.transform(blocks, lambda b, i: F.struct(at(b, 1).alias("top"), at(b, 0).alias("left"), i.alias("i"), F.lower(F.coalesce(b["label"], F.lit(""))).alias("label"), strip(F.coalesce(b["content"], F.lit(""))).alias("content")))
    kept = F.filter(F.array_sort(placed), lambda b: (b["content"] != "") & ~b["label"].isin(*SKIPPED_LABELS))
    line = lambda b: (
        F.when(b["label"].isin(*TITLE_LABELS), F.concat(F.lit("# "), b["content"])).when(b["label"].isin(*HEADING_LABELS), F.concat(F.lit("## "), b["content"]))
        .when(b["label"].isin(*FORMULA_LABELS), F.concat(F.lit("$$\n"), b["content"], F.lit("\n$$"))).otherwise(b["content"])
    )
    return F.array_join(F.transform(kept, line), "\n\n")


def rows_to_markdown(rows: Column) -> Column:
    """An array of arrays of cells as a markdown table, the first its header."""
    line = lambda r: F.concat(F.lit("| "), F.array_join(F.transform(r, lambda c: escape_cell(c)), " | "), F.lit(" |"))
    head = F.element_at(rows, 1)
    separator = F.concat(F.lit("|"), F.array_join(F.array_repeat(F.lit(" --- "), F.size(head)), "|"), F.lit("|"))
    return F.array_join(F.concat(F.array(line(head), separator), F.transform(F.slice(rows, F.lit(2), F.greatest(F.lit(0), F.size(rows) - 1)), line)), "\n")


def blocks_of_results(items: Column) -> Column:
    """Results of a layout detector, under any of the names that they come with, as blocks (label, content, bbox) for layout_markdown().

    items: array of structs with label, type, content, text, res (a struct with html, or null), bbox, box. The label is label, else type, else text; the content is content, else text, else, if there is a res, its html.
    """
    first = lambda *xs: F.coalesce(*[F.nullif(x, F.lit("")) for x in xs], F.lit(""))
    corner = lambda b: F.when(F.size(b) > 0, b)
    return F.transform(F.coalesce(items, F.array().cast("array<struct<label:string,type:string,content:string,text:string,res:struct<html:string>,bbox:array<bigint>,box:array<bigint>>>")), lambda r: F.struct(
        F.coalesce(F.nullif(r["label"], F.lit("")), F.nullif(r["type"], F.lit("")), F.lit("text")).alias("label"), first(r["content"], r["text"], r["res"]["html"]).alias("content"),
        F.coalesce(corner(r["bbox"]), corner(r["box"]), F.array().cast("array<bigint>")).alias("bbox"),
    ))


def rendered(pages: DataFrame, render: Callable[[bytes, list[int]], list[bytes]] | None) -> DataFrame:
    """pages: doc_id, page_no, text, content (of the whole file). Adds image: of low-text pages, what render(content, page numbers) gives; null without a renderer, for page numbers that the file doesn't have, and where it fails."""
    need = low_text(F.coalesce("text", F.lit("")))
    if render is None:
        return pages.withColumn("image", F.lit(None).cast("binary"))

    def one(content: bytes | None, number: int) -> bytes | None:
        try:
            got = render(bytes(content), [number]) if content is not None else []
        except Exception:  # noqa: BLE001  a page that can't be rendered has no image
            return None
        return got[0] if got else None

    def run(content, number):
        return pd.Series([one(c, int(n)) if n is not None and n == n else None for c, n in zip(content, number, strict=True)], index=content.index, dtype=object)

    run.__annotations__ = {"content": pd.Series, "number": pd.Series, "return": pd.Series}
    image = F.pandas_udf(run, "binary")(F.when(need, F.col("content")), F.when(need, F.col("page_no")))
    return pages.withColumn("image", image)
