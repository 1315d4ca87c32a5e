"""Packing of documents into training sequences by sums of squares.

Each task packs the documents that it reads, in their order. A window has `width` places. The level array counts the partially filled windows of each fill; a document goes to the fill level that makes the sum of the squared
counts least, of equal ones the fullest, a new window being level 0. A document's full windows come first, so what is placed is shorter than a window and is not cut.

Windows are let go when they are full. When more than MOST_OPEN stay open, as where no lengths go together, and at the end of a task, the open ones are completed: the emptiest are cut into the holes of the fullest, until
one is left. It stays open or, at the end, is cut by the binary digits of its fill, so that nothing is padded. So a task holds MOST_OPEN windows at most, whatever the documents, and no row is shuffled.
"""

from __future__ import annotations

import json
import re
import zlib
from collections import deque
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import map_batches, small_batches, table, written
from .tokenfile import Encoder, text_runs, tokenizer_path

WIDTH, END_ID = 1024, 0
TOKENIZER = "byte_bpe_50k.json"
#: Windows that a task holds open at most, and characters of pieces that an encoder remembers.
MOST_OPEN, MOST_CHARS = 4096, 64 << 20
#: No window of this level is there.
NONE = 1 << 40

#: Before one space between visible ASCII characters a byte-level tokenizer always splits.
_SPLIT = re.compile(r"(?<=[!-~])(?= [!-~])")
#: Fixed value: ASCII marks, without the apostrophe, between a letter and white space or the end; no pre-token goes over from letters to marks.
_MARKS = re.compile(r"(?<=[a-zß-öø-ÿ])[!#$%&()*+,./:;=?@\[\]^_{|}~-]+(?=[ \n]|\Z)")
#: A piece of ASCII and Latin-1 letters, which is one pre-token.
_LETTERS = re.compile(r"\0?[A-Za-zÀ-ÖØ-öø-ÿ]+").fullmatch
#: Fixed value: byte-level tokenizers write bytes without a visible character as those from 256 on, in order; a space is Ġ. These are the ones that letters have.
_BYTES = {b: chr(256 + 33 + b - 127) for b in range(127, 161)} | {173: chr(256 + 67)}


class ByteEncoder(Encoder):
    r"""Ids by a byte-level tokenizer that keeps white space and has a space begin a pre-token.

    A text with nothing but single spaces and newlines between its words is encoded word by word, and the marks behind a word by themselves. A piece is the word without its space; one without a space before it is marked by \0.
    Other texts are split where that is sure. Each different piece is encoded once; one of letters by the library's model alone.
    """

    def __init__(self, path: str, end_id: int = END_ID, most: int = 600_000):
        super().__init__(path, end_id, most)
        self.chars = 0
        with open(path, encoding="utf-8") as f:
            given = json.load(f)
        before = given["pre_tokenizer"]
        if given["normalizer"] or before["type"] != "ByteLevel" or before["add_prefix_space"] or not before["use_regex"]:
            raise ValueError("not a byte-level tokenizer that keeps texts as they are")

    def _pieces(self, text: str | None) -> list[str]:
        if not text:
            return []
        if "\0" not in text and sum(map(len, text.split())) == len(text) - text.count(" ") - text.count("\n"):  # no other white space
            found = f"\0{_MARKS.sub(" \0\\g<0>", text)}".replace("\n", " \n \0").split(" ")
            if "" not in found and "\0" not in found:
                return found
        return [f"\0{x}" for x in _SPLIT.split(text)]

    def _learn(self, new: list[str]) -> None:
        self.chars += sum(map(len, new))
        split, fast = self.tokenizer.model.tokenize, self.tokenizer.encode_batch_fast
        found: list = [None] * len(new)
        rest = []
        for i, p in enumerate(new):
            if _LETTERS(p):
                p = p if p.isascii() else p.encode().decode("latin-1").translate(_BYTES)
                found[i] = [t.id for t in split(p[1:] if p[0] == "\0" else f"Ġ{p}")]
            else:
                rest.append(i)
        for k in range(0, len(rest), 2000):  # the library's results are large
            texts = [p[1:] if p[0] == "\0" else p if p == "\n" else f" {p}" for p in (new[i] for i in rest[k : k + 2000])]
            for i, e in zip(rest[k : k + 2000], fast(texts, add_special_tokens=False), strict=True):
                found[i] = e.ids
        lengths = np.fromiter(map(len, found), np.int64, len(found))
        self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(lengths) - lengths])
        self.lengths = np.concatenate([self.lengths, lengths])
        self.flat = np.concatenate([self.flat, np.fromiter(chain.from_iterable(found), np.uint32, int(lengths.sum()))])

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        if self.chars > MOST_CHARS:  # forget all
            self.known.clear()
            self.flat, self.starts, self.lengths, self.chars = self.flat[:0].copy(), self.starts[:0].copy(), self.lengths[:0].copy(), 0
        return super().encode(texts)


@lru_cache(maxsize=2)
def worker_encoder(path: str, end_id: int) -> ByteEncoder:
    return ByteEncoder(path, end_id)


class Levels:
    """How many windows have each fill, and what the sum of squares changes by when one leaves or enters a level."""

    def __init__(self, width: int):
        self.width, self.counts = width, np.zeros(width + 1, np.int64)
        self.leave, self.enter = np.full(width + 1, NONE), np.ones(width + 1, np.int64)
        self.leave[0] = self.enter[width] = 0  # a new window leaves no level, a full one enters none

    def best(self, size: int) -> int:
        """The level to put `size` into; of equally good ones the fullest."""
        change = self.leave[: self.width - size + 1] + self.enter[size:]
        return self.width - size - int(change[::-1].argmin())

    def add(self, level: int, by: int) -> None:
        if 0 < level < self.width:
            self.counts[level] = n = self.counts[level] + by
            self.leave[level], self.enter[level] = 1 - 2 * n if n else NONE, 2 * n + 1


#: A piece: what is known of its document, its start there, its ids.
Piece = tuple[tuple, int, np.ndarray]


class Packer:
    """Packs documents one after another. A sequence, as it is let go, is its list of pieces."""

    def __init__(self, width: int = WIDTH, most_open: int = MOST_OPEN):
        self.width, self.most_open = width, most_open
        self.levels, self.windows, self.n_open = Levels(width), [[] for _ in range(width)], 0

    def add(self, doc: tuple, ids: np.ndarray) -> Iterator[list[Piece]]:
        whole = len(ids) // self.width * self.width
        for start in range(0, whole, self.width):
            yield [(doc, start, ids[start : start + self.width])]
        size = len(ids) - whole
        if not size:
            return
        level = self.levels.best(size)
        window = self.windows[level].pop() if level else []
        self.n_open += not level
        window.append((doc, whole, ids[whole:].copy()))
        self.levels.add(level, -1)
        if level + size == self.width:
            self.n_open -= 1
            yield window
        else:
            self.levels.add(level + size, 1)
            self.windows[level + size].append(window)
            if self.n_open > self.most_open:
                yield from self._complete()

    def _complete(self) -> Iterator[list[Piece]]:
        """Fills the fullest windows with what the emptiest hold; at most one stays open."""
        rest = deque(w for own in self.windows for w in own)  # the emptiest first
        self.levels, self.windows, self.n_open = Levels(self.width), [[] for _ in range(self.width)], 0
        while rest:
            window = rest.pop()
            hole = self.width - sum(len(p[2]) for p in window)
            while hole and rest:
                doc, start, ids = rest[0].pop()
                keep = max(0, len(ids) - hole)
                window.append((doc, start + keep, ids[keep:]))
                hole -= len(ids) - keep
                if keep:
                    rest[0].append((doc, start, ids[:keep]))
                elif not rest[0]:
                    rest.popleft()
            if hole:
                self.levels.add(self.width - hole, 1)
                self.windows[self.width - hole].append(window)
                self.n_open += 1
            else:
                yield window

    def end(self) -> Iterator[list[Piece]]:
        """What is left, in full windows and in sequences of powers of two."""
        yield from self._complete()
        for window in [w for level in self.windows for w in level]:
            fill = sum(len(p[2]) for p in window)
            for size in (1 << b for b in reversed(range(fill.bit_length())) if fill >> b & 1):
                sequence = []
                while size:
                    doc, start, ids = window.pop(0)
                    sequence.append((doc, start, ids[:size]))
                    if len(ids) > size:
                        window.insert(0, (doc, start + size, ids[size:]))
                    size -= len(sequence[-1][2])
                yield sequence


def pack(docs: DataFrame, path: str, end_id: int = END_ID, width: int = WIDTH, most_open: int = MOST_OPEN, id_bytes: int = 2) -> DataFrame:
    """The pieces of all documents, as a stored table: doc_id, start (ids of its document before it), length, ids (little-endian, id_bytes each), ids_crc32 (of the ids as 32-bit numbers), doc_tokens, part, number (of the
    sequence in the part), offset.

    docs: doc_id, text; other columns are ignored. A document is its text's ids by the tokenizer at path and the end id; null and empty texts have that alone. Repeated rows and ids, and null ids, are documents like any
    others. A width that is no power of two, and ids that don't fit id_bytes, are refused. No rows give no pieces.
    """
    if width < 1 or width & (width - 1):
        raise ValueError("the width has to be a power of two")
    spark = docs.sparkSession
    small_batches(spark)
    names = ["doc_id", "start", "length", "ids", "ids_crc32", "doc_tokens", "part", "number", "offset"]
    kind = f"<u{id_bytes}"

    def documents(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[tuple, np.ndarray]]:
        encoder = worker_encoder(path, end_id)
        for b in batches:
            texts, keys = b["text"].tolist(), b["doc_id"].tolist()
            for s in text_runs(texts):
                flat, counts = encoder.encode(texts[s])
                if len(flat) and int(flat.max()) >> 8 * id_bytes:
                    raise ValueError(f"an id doesn't fit {id_bytes} bytes")
                at = 0
                for key, n in zip(keys[s], counts.tolist(), strict=True):
                    yield (key, n), flat[at : at + n]
                    at += n

    def sequences(batches: Iterator[pd.DataFrame]) -> Iterator[list[Piece]]:
        packer = Packer(width, most_open)
        for doc, ids in documents(batches):
            yield from packer.add(doc, ids)
        yield from packer.end()

    def rows(part: int, found: Iterable[list[Piece]]) -> Iterator[tuple]:
        for number, sequence in enumerate(found):
            offset = 0
            for (key, total), start, ids in sequence:
                yield key, start, len(ids), ids.astype(kind).tobytes(), zlib.crc32(ids.astype("<u4").tobytes()), total, part, number, offset
                offset += len(ids)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        held: list[tuple] = []
        for row in rows(TaskContext.get().partitionId(), sequences(batches)):
            held.append(row)
            if len(held) >= 4000:
                yield pd.DataFrame(held, columns=names)
                held = []
        if held:
            yield pd.DataFrame(held, columns=names)

    own = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {own}, start long, length long, ids binary, ids_crc32 long, doc_tokens long, part int, number long, offset long"
    return written(map_batches(docs.select("doc_id", "text"), run, schema), "packed")


def numbered(pieces: DataFrame) -> DataFrame:
    """pieces with sequence_id, from 0 without gaps, instead of part and number: a sum over the parts, a row for each task."""
    totals = pieces.groupBy(F.col("part").alias("p")).agg((F.max("number") + 1).alias("n"))
    before = F.sum("n").over(Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1))
    starts = totals.select("p", F.coalesce(before, F.lit(0)).alias("before"))
    rest = [c for c in pieces.columns if c not in ("part", "number")]
    return pieces.join(F.broadcast(starts), F.col("part") == F.col("p")).select(*rest, (F.col("before") + F.col("number")).cast("long").alias("sequence_id"))


def fills(pieces: DataFrame, width: int = WIDTH) -> DataFrame:
    """sequence_id, fill, padded: the ids of each sequence of numbered pieces and its length with padding, which powers of two don't get."""
    fill = pieces.groupBy("sequence_id").agg(F.sum("length").alias("fill"))
    return fill.select("sequence_id", "fill", F.when(F.col("fill").bitwiseAND(F.col("fill") - 1) == 0, F.col("fill")).otherwise(width).cast("long").alias("padded"))


def sequences(pieces: DataFrame) -> DataFrame:
    """sequence_id, ids (little-endian, as in the pieces): the sequences as they are trained on, from numbered pieces. A sequence has `width` ids at most."""
    ordered = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(ordered, F.lit(b"").cast("binary"), lambda out, x: F.concat(out, x["ids"]))
    return pieces.groupBy("sequence_id").agg(joined.alias("ids"))


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = numbered(pack(table(spark, sf_dir, "documents"), tokenizer_path(TOKENIZER)))
    return pieces.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
