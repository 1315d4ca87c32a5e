"""Benchmark decontamination by a prefix-filtered set join.

A benchmark item's windows are all runs of WINDOW words (an item of fewer words is one window). A window is the set of its word shingles, each with
its place. All of them have to occur in a document, so of a window's shingles in the order of rarity over all documents only the first, the rarest, is needed to find it: that is its
prefix. A document's shingles are joined with the prefixes; length and place bound where the window can lie (it has to fit into the document around the shingle);
there all of its words are compared.

The items are taken in blocks of bounded size, so the index that is sent to the executors is bounded however large the benchmark is; each block
is a pass over the documents, and what the passes find is put together by document.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import alnum_words, grams, map_batches, small_batches, table, written
from .tokenfile import text_runs

WINDOW, SHINGLE = 10, 5
#: UTF-8 bytes of the items of one block. An index takes some 20 times as much.
BLOCK_BYTES = 8 << 20
#: Words of an item that are kept together. A longer one is cut into pieces that have WINDOW - 1 words in common, so no window is lost.
PIECE_WORDS = 20_000
_MASK = (1 << 22) - 1


@dataclass
class Index:
    """Windows of one block of items.

    vocabulary: word -> number from 1; words: of every window, by row, 0 beyond its length; lengths; items of window w: of[starts[w] : starts[w + 1]].
    Shingle s has sizes[s] words; windows have their shingles in shingle_of, offset_of, window_of. codes: the shingles' hashes, sorted, with shingle numbers in order.
    """

    vocabulary: dict[bytes, int]
    words: np.ndarray
    lengths: np.ndarray
    starts: np.ndarray
    of: np.ndarray
    items: list[str]
    codes: np.ndarray
    sizes: np.ndarray
    shingle_of: np.ndarray
    offset_of: np.ndarray
    window_of: np.ndarray


def build_index(items: list[tuple[str, str | None]], window: int = WINDOW, shingle: int = SHINGLE) -> Index:
    """items: id as text, text. Items without words have no windows. Equal windows of different items are one window."""
    vocabulary: dict[bytes, int] = {}
    windows: dict[tuple[int, ...], set[int]] = {}
    names = sorted({i for i, _ in items})
    number = {n: k for k, n in enumerate(names)}
    for name, text in items:
        ids = [vocabulary.setdefault(w, len(vocabulary) + 1) for w in alnum_words(text)]
        for k in range(max(1, len(ids) - window + 1) if ids else 0):
            windows.setdefault(tuple(ids[k : k + window]), set()).add(number[name])
    words = np.zeros((len(windows), window), np.uint64)
    lengths = np.zeros(len(windows), np.int64)
    of, starts, parts = [], [0], []
    for w, (ids, own) in enumerate(windows.items()):
        words[w, : len(ids)], lengths[w] = ids, len(ids)
        of.extend(sorted(own))
        starts.append(len(of))
        codes = grams(np.array(ids, np.uint64), shingle)
        parts.append((codes, np.arange(len(codes)), np.full(len(codes), w), np.full(len(codes), min(shingle, len(ids)))))
    codes, offset_of, window_of, size = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 3)
    unique, first, shingle_of = np.unique(codes, return_index=True, return_inverse=True)
    return Index(vocabulary, words, lengths, np.array(starts), np.array(of, np.int64), names, unique, size[first], shingle_of, offset_of, window_of)


class Finder:
    """Finds given shingles of an index in texts."""

    def __init__(self, index: Index, shingles: np.ndarray):
        self.index, self.shingles = index, shingles
        self.codes, self.sizes = index.codes[shingles], index.sizes[shingles]
        self.maybe = {}
        for k in np.unique(self.sizes).tolist():
            self.maybe[k] = np.zeros(_MASK + 1, bool)
            self.maybe[k][(self.codes[self.sizes == k] & np.uint64(_MASK)).astype(np.int64)] = True

    def numbered(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Word numbers of all texts with a 0 after each, 0 for words that no item has; words of each text."""
        get, counts, parts = self.index.vocabulary.get, np.zeros(len(texts), np.int64), []
        for i, t in enumerate(texts):
            words = alnum_words(t)
            counts[i] = len(words)
            parts.append(np.fromiter((get(w, 0) for w in words), np.uint64, len(words)))
            parts.append(np.zeros(1, np.uint64))
        return (np.concatenate(parts) if parts else np.zeros(0, np.uint64)), counts

    def find(self, numbers: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(places, which of the shingles begin there), by shingle size."""
        known = np.concatenate([[0], np.cumsum(numbers != 0)])
        for k, maybe in self.maybe.items():
            if len(numbers) < k:
                continue
            at = np.flatnonzero(known[k:] - known[:-k] == k)
            if not len(at):
                continue
            code = grams_at(numbers, at, k)
            hit = maybe[(code & np.uint64(_MASK)).astype(np.int64)]
            at, code = at[hit], code[hit]
            which = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
            same = (self.codes[which] == code) & (self.sizes[which] == k)
            yield at[same], which[same]


def grams_at(numbers: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """grams() of the k words from each place on."""
    from .common import _M, mixed

    with np.errstate(over="ignore"):
        out = numbers[at] + np.uint64(k)
        for i in range(1, k):
            out = (out ^ (out >> np.uint64(29))) * _M + numbers[at + i]
    return mixed(out)


def document_counts(docs: DataFrame, index: Index) -> np.ndarray:
    """In how many rows of docs each shingle of the index occurs. Counted within tasks, then summed; a number for each shingle of the block reaches the driver."""
    held = docs.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        finder = Finder(held.value, np.arange(len(held.value.codes)))
        seen = np.zeros(len(held.value.codes), np.int64)
        for b in batches:
            texts = b["text"].tolist()
            for s in text_runs(texts):
                numbers, counts = finder.numbered(texts[s])
                ends = np.cumsum(counts + 1)
                for at, which in finder.find(numbers):
                    pairs = np.unique(np.searchsorted(ends, at, side="right") * len(seen) + which)
                    seen += np.bincount(pairs % len(seen), minlength=len(seen))
        some = np.flatnonzero(seen)
        yield pd.DataFrame({"shingle": some, "n": seen[some]})

    out = np.zeros(len(index.codes), np.int64)
    if len(out):
        for r in docs.select("text").mapInPandas(run, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n")).toLocalIterator():
            out[r.shingle] = r.n
    return out


def prefixes(index: Index, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The rarest shingle of every window (the smaller hash among equals): shingles in order, and for shingle i windows[starts[i] : starts[i + 1]] with offsets."""
    order = np.lexsort((index.codes[index.shingle_of], counts[index.shingle_of], index.window_of))
    first = order[np.unique(index.window_of[order], return_index=True)[1]]
    first = first[np.argsort(index.shingle_of[first], kind="stable")]
    shingles, starts = np.unique(index.shingle_of[first], return_index=True)
    return shingles, np.append(starts, len(first)), index.window_of[first], index.offset_of[first]


def digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


def scan(docs: DataFrame, index: Index, counts: np.ndarray, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, text_key, the columns named in carry, n_words, runs (start, end, start, end ... of hit words), items (with occurring windows) of every row of docs."""
    held = docs.sparkSession.sparkContext.broadcast((index, prefixes(index, counts)))
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_key"), *carry, "text")
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.drop("text").schema)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index, (shingles, starts, windows, offsets) = held.value
        finder = Finder(index, shingles)
        span = np.arange(index.words.shape[1])
        for b in batches:
            texts, out = b["text"].tolist(), []
            for s in text_runs(texts):
                numbers, counts = finder.numbered(texts[s])
                ends = np.cumsum(counts + 1)
                begins = ends - counts - 1
                cover, hits = np.zeros(len(numbers) + 1, np.int64), []
                padded = np.append(numbers, np.zeros(len(span), np.uint64))
                for at, which in finder.find(numbers):
                    for part in np.array_split(np.arange(len(at)), max(1, len(at) // 200_000)):
                        a, w = at[part], which[part]
                        n = starts[w + 1] - starts[w]
                        pick = np.repeat(starts[w] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
                        window, start = windows[pick], np.repeat(a, n) - offsets[pick]
                        doc = np.repeat(np.searchsorted(ends, a, side="right"), n)
                        fits = (start >= begins[doc]) & (start + index.lengths[window] < ends[doc])
                        window, start, doc = window[fits], start[fits], doc[fits]
                        here = padded[start[:, None] + span]
                        same = ((here == index.words[window]) | (span >= index.lengths[window][:, None])).all(1)
                        window, start, doc = window[same], start[same], doc[same]
                        np.add.at(cover, start, 1)
                        np.add.at(cover, start + index.lengths[window], -1)
                        hits.append(np.unique(doc * len(index.lengths) + window))
                on = np.concatenate([[False], np.cumsum(cover)[:-1] > 0, [False]])
                edges = np.flatnonzero(on[1:] != on[:-1]).reshape(-1, 2)
                where = np.searchsorted(ends, edges[:, 0], side="right") if len(edges) else np.zeros(0, np.int64)
                runs, items = [[] for _ in counts], [set() for _ in counts]
                for d, (x, y) in zip(where.tolist(), edges.tolist(), strict=True):
                    runs[d] += [x - int(begins[d]), y - int(begins[d])]
                for hit in np.unique(np.concatenate(hits)).tolist() if hits else []:
                    d, w = divmod(hit, len(index.lengths))
                    items[d].update(index.of[index.starts[w] : index.starts[w + 1]].tolist())
                out.append((counts, runs, [[index.items[i] for i in sorted(x)] for x in items]))
            yield b.drop(columns="text").assign(
                n_words=np.concatenate([x[0] for x in out]) if out else [], runs=[r for x in out for r in x[1]], items=[i for x in out for i in x[2]]
            )

    return map_batches(rows, run, f"{kinds}, n_words long, runs array<long>, items array<string>")


def pieces(items: DataFrame, words: int = PIECE_WORDS) -> DataFrame:
    """item, text (its words, lower-case, with spaces between), size (bytes) of the items' pieces of at most `words` words, each once."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for item, text in zip(b["item"], b["text"], strict=True):
                own = alnum_words(text)
                for k in range(0, max(1, len(own) - WINDOW + 1) if own else 0, words - WINDOW + 1):
                    part = b" ".join(own[k : k + words])
                    out.append((item, part.decode("utf-8", "surrogatepass"), len(part)))
            yield pd.DataFrame(out, columns=["item", "text", "size"])

    return items.mapInPandas(run, "item string, text string, size long").distinct()


def item_blocks(items: DataFrame, block_bytes: int) -> Iterator[list[tuple[str, str]]]:
    """The items' pieces in blocks of about block_bytes. They are dealt to cells by hash, some 16 to a block; cells are put together as long as they fit."""
    held = written(pieces(items, PIECE_WORDS), "items")
    total = held.agg(F.sum("size")).first()[0] or 0
    cells = 16 * max(1, -(-total // block_bytes))
    held = held.withColumn("cell", F.pmod(F.xxhash64("item", "text"), F.lit(cells)))
    first, size = 0, 0
    for cell, n in sorted((r.cell, r.n) for r in held.groupBy("cell").agg(F.sum("size").alias("n")).collect()):
        if size and size + n > block_bytes:
            yield [(r.item, r.text) for r in held.where(F.col("cell").between(first, cell - 1)).collect()]
            first, size = cell, 0
        size += n
    yield [(r.item, r.text) for r in held.where(F.col("cell") >= first).collect()]


def decontaminate(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES, carry: tuple[str, ...] = ()) -> DataFrame:
    """What of every row of docs (doc_id, text; others ignored) lies in the benchmark (item_id, text; others ignored).

    Returns doc_id, n_words, n_hit (words inside any occurrence of a window), n_items (items with occurring windows), items_sha256 (of those ids, sorted as text, joined by
    commas; of nothing if there are none), contaminated, runs (start, end ... of the hit words), items, and the columns of docs named in carry. A null text has no words. Items that are null, empty or without
    words have no windows; a null item_id is the id "null". Equal item_ids are one item with the windows of all their rows; repeated rows count once. Whole texts and items are used, however long. An empty
    benchmark hits nothing; no documents give no rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    items = benchmark.where("text IS NOT NULL").select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"), "text").distinct()
    found: list[DataFrame] = []
    for block in item_blocks(items, block_bytes):
        index = build_index(block)  # of about block_bytes, whatever the benchmark's size
        found.append(scan(docs, index, document_counts(docs, index), carry if not found else ()))
    if len(found) == 1:
        rows = found[0]
    else:  # rows with equal ids and texts have equal results, so they are found once and joined to all of them
        found[0] = written(found[0], "found")
        hits = None
        for f in found:
            one = f.where("size(runs) > 0").select("doc_id", "text_key", "runs", "items").dropDuplicates(["doc_id", "text_key"])
            hits = written(one, "hits") if hits is None else hits.union(written(one, "hits"))
        hits = hits.groupBy("doc_id", "text_key").agg(
            F.flatten(F.collect_list("runs")).alias("runs"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items")
        )
        d, h = found[0].drop("runs", "items").alias("d"), written(hits, "all-hits").alias("h")
        rows = d.join(h, F.col("d.doc_id").eqNullSafe(F.col("h.doc_id")) & (F.col("d.text_key") == F.col("h.text_key")), "left").select(
            "d.*", *[F.coalesce(c, F.array().cast(t)).alias(c) for c, t in (("runs", "array<long>"), ("items", "array<string>"))]
        )
    # runs of different blocks can overlap: a word counts where it is the first to be covered
    pairs = F.array_sort(F.transform(F.sequence(F.lit(0), (F.size("runs") / 2).cast("int") - 1), lambda i: F.struct(F.element_at("runs", 2 * i + 1).alias("a"), F.element_at("runs", 2 * i + 2).alias("b"))))
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("upto"))
    covered = F.aggregate(pairs, start, lambda s, x: F.struct((s["n"] + F.greatest(F.lit(0).cast("long"), x["b"] - F.greatest(x["a"], s["upto"]))).alias("n"), F.greatest(s["upto"], x["b"]).alias("upto")))["n"]
    return rows.select(
        "doc_id", "n_words",
        F.when(F.size("runs") == 0, F.lit(0).cast("long")).otherwise(covered).alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("runs") > 0).alias("contaminated"), "runs", "items", *carry,
    )


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("runs", "items")
