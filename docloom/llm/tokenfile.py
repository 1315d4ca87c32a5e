"""Token-id files in directly addressable codes.

An id is cut into bytes, the lowest first. Level 0 holds the lowest byte of every id, level 1 the next byte of those ids that
have more, and so on. Each level but the last used has a continuation bitmap (1: this id goes on in the next level), and each bitmap a rank directory: the ones before every 512th bit. The
byte of an id in the next level is at the rank of its bit, so any token is found by one directory entry and at most 64 bytes of bitmap a level,
without decoding any block.

A file is a table of segments, in ascending doc_id order, written by Spark's own writer into the shared folder, without compression: its commit survives lost executors and it needs no
file system but Spark's. Any token is found by its place in the file, or by document and place in it: the segments' starts, which are read without their payloads, name the segment, and
its payload gives the token as it lies there. A segment's payload, the format proper, is little-endian:

    b"DAC1", uint32 levels, uint64 ids, then for each level: uint64 n, n bytes, ceil(n / 8) bytes of bitmap (lowest bit first), ceil(n / 512) uint32 of the directory
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import small_batches, table, written

MAGIC, BLOCK = b"DAC1", 512
#: A segment is closed at the end of the document that brings it to so many ids or documents.
SEGMENT_IDS, SEGMENT_DOCS = 1 << 16, 1 << 12
END_ID = 2
TOKENIZER = "word_bpe_49k.json"


def dac_encode(ids: np.ndarray) -> bytes:
    """The payload of a segment. ids: uint32."""
    levels, rest = [], np.ascontiguousarray(ids, dtype=np.uint32)
    while True:
        more = rest > 255
        bits = np.packbits(more, bitorder="little")
        ones = np.add.reduceat(more.astype(np.uint32), np.arange(0, len(more), BLOCK)) if len(more) else np.zeros(0, np.uint32)
        before = (np.cumsum(ones) - ones).astype("<u4")
        levels.append(struct.pack("<Q", len(rest)) + (rest & 255).astype(np.uint8).tobytes() + bits.tobytes() + before.tobytes())
        rest = rest[more] >> np.uint32(8)
        if not len(rest):
            break
    return MAGIC + struct.pack("<IQ", len(levels), len(ids)) + b"".join(levels)


class Dac:
    """Reads a segment's payload."""

    def __init__(self, payload: bytes):
        if payload[:4] != MAGIC:
            raise ValueError("not a DAC1 payload")
        n, self.n = struct.unpack_from("<IQ", payload, 4)
        at, self.levels = 16, []
        for _ in range(n):
            (size,) = struct.unpack_from("<Q", payload, at)
            at += 8
            low = np.frombuffer(payload, np.uint8, size, at)
            bits = np.frombuffer(payload, np.uint8, -(-size // 8), at + size)
            before = np.frombuffer(payload, "<u4", -(-size // BLOCK), at + size + len(bits))
            at += size + len(bits) + 4 * len(before)
            self.levels.append((low, bits, before))

    def __len__(self) -> int:
        return self.n

    def _rank(self, level: int, i: int) -> int:
        """Ones before bit i."""
        low, bits, before = self.levels[level]
        if i >= len(low):
            return len(self.levels[level + 1][0]) if level + 1 < len(self.levels) else 0
        first = i // BLOCK * (BLOCK // 8)
        part = np.unpackbits(bits[first : i // 8 + 1], bitorder="little")[: i - first * 8]
        return int(before[i // BLOCK]) + int(part.sum())

    def __getitem__(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        value, shift = 0, 0
        for level, (low, bits, _) in enumerate(self.levels):
            value |= int(low[i]) << shift
            if not bits[i >> 3] >> (i & 7) & 1:
                break
            i, shift = self._rank(level, i), shift + 8
        return value

    def slice(self, start: int, stop: int, level: int = 0) -> np.ndarray:
        """ids start .. stop - 1 as uint32, reading only what belongs to them."""
        low, bits, _ = self.levels[level]
        out = low[start:stop].astype(np.uint32)
        if level + 1 < len(self.levels) and stop > start:
            first = start // 8
            more = np.unpackbits(bits[first : -(-stop // 8)], bitorder="little")[start - first * 8 : stop - first * 8].astype(bool)
            if more.any():
                at = self._rank(level, start)
                out[more] |= self.slice(at, at + int(more.sum()), level + 1) << np.uint32(8)
        return out


#: Fixed value: ASCII marks but no apostrophe, between a lower-case ASCII or Latin-1 letter and white space or the end: no pre-token goes over from letters to marks.
_MARKS = re.compile(rb"[!#$%&()*+,./:;=?@\[\]^_{|}~-](?:(?<=[a-z].)|(?<=\xc3[\xa0-\xb6\xb8-\xbf].))[!#$%&()*+,./:;=?@\[\]^_{|}~-]*(?=[ \t\n\x0b\x0c\r]|\Z)")


class _Known(dict):
    """Numbers of pieces; a piece that is asked for and not there gets the next number and is noted in `new`."""

    def __init__(self) -> None:
        super().__init__()
        self.base, self.new = 0, []

    def __missing__(self, piece: bytes) -> int:
        self[piece] = n = self.base + len(self.new)
        self.new.append(piece)
        return n


class Encoder:
    """Ids of whole texts by a tokenizer of the tokenizers library, without special tokens, each text followed by an end id.

    A tokenizer that drops white space gives the ids of a text as those of its pieces between ASCII white space, one after
    another. So each different piece is encoded once and its ids are kept. A tokenizer that also lower-cases gives a text the ids of its lower-case form, and white space may be put
    in between a word and the marks after it; both make pieces fewer. The first `most` pieces are kept, later ones only for the texts at hand.
    """

    def __init__(self, path: str, end_id: int = END_ID, most: int = 900_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        import json

        from tokenizers import Tokenizer

        self.tokenizer, self.end_id, self.most = Tokenizer.from_file(path), end_id, most
        with open(path, encoding="utf-8") as f:
            self.folds = any(n.get("type") == "Lowercase" for n in ((json.load(f).get("normalizer") or {}).get("normalizers") or []))
        self.known = _Known()
        self.flat, self.starts, self.lengths = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _pieces(self, text: str | None) -> list[bytes]:
        if not text:
            return []
        raw = text.encode()
        if self.folds and b"<|" not in raw:  # special tokens are told by their case
            raw = _MARKS.sub(rb" \g<0>", raw.lower())
        return raw.split()

    def _learn(self, new: list[bytes]) -> None:
        fast = getattr(self.tokenizer, "encode_batch_fast", self.tokenizer.encode_batch)
        split = self.tokenizer.model.tokenize
        # where a tokenizer lower-cases, a word of a-z is one pre-token as it is: the library's model alone gives its ids
        found = [[t.id for t in split(p.decode())] if p.isalpha() and p.islower() else None for p in new] if self.folds else [None] * len(new)
        rest = [i for i, ids in enumerate(found) if ids is None]
        for k in range(0, len(rest), 2000):  # the library's results are large
            some = rest[k : k + 2000]
            for i, e in zip(some, fast([new[i].decode() for i in some], add_special_tokens=False), strict=True):
                found[i] = e.ids
        lengths = np.fromiter(map(len, found), np.int64, len(found))
        self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(lengths) - lengths])
        self.lengths = np.concatenate([self.lengths, lengths])
        self.flat = np.concatenate([self.flat, np.fromiter(chain.from_iterable(found), np.uint32, int(lengths.sum()))])

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, one text after another, and how many each text has, its end id included."""
        pieces = [self._pieces(t) for t in texts]
        n, known = sum(map(len, pieces)), self.known
        known.base, known.new, kept = len(self.starts), [], (len(self.flat), len(self.starts))
        which = np.fromiter(map(known.__getitem__, chain.from_iterable(pieces)), np.int64, n)
        if known.new:
            self._learn(known.new)
        lengths = self.lengths[which]
        ends = np.cumsum(lengths)
        flat = self.flat[np.repeat(self.starts[which] - (ends - lengths), lengths) + np.arange(int(lengths.sum()))]
        upto = np.concatenate([[0], ends])[np.cumsum([len(x) for x in pieces])] if texts else np.zeros(0, np.int64)
        if len(known) > self.most:
            for p in known.new:
                del known[p]
            self.flat, self.starts, self.lengths = self.flat[: kept[0]].copy(), self.starts[: kept[1]].copy(), self.lengths[: kept[1]].copy()
        return np.insert(flat, upto, np.uint32(self.end_id)), np.diff(upto, prepend=0) + 1


@lru_cache(maxsize=2)
def worker_encoder(path: str, end_id: int) -> Encoder:
    """The encoder of a Python worker: what it has learnt serves the worker's later tasks."""
    return Encoder(path, end_id)


def text_runs(texts: list[str | None], most: int = 2 << 20) -> Iterator[slice]:
    """Slices of texts of about `most` characters together at most; a longer text is alone."""
    start = size = 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if i > start and size + n > most:
            yield slice(start, i)
            start, size = i, 0
        size += n
    if start < len(texts):
        yield slice(start, len(texts))


def write_segments(docs: DataFrame, tokenizer_path: str, end_id: int = END_ID, segment_ids: int = SEGMENT_IDS) -> DataFrame:
    """Encodes docs (doc_id, text; other columns are ignored) and writes the file; returns its table of segments.

    Columns: part, seq (the order of the segments), before (ids of the part before this segment), n_ids, doc_ids, lengths (ids of each document), payload.
    Parts are ranges of (doc_id, a hash of the text), so that an id with very many rows is cut too; null ids come first, and rows with equal ids are
    in the order of the hashes. Null and empty texts have the end id only. A document is always whole in one segment. No rows give no segments.
    """
    spark = docs.sparkSession
    small_batches(spark)
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = "part int, seq int, before long, n_ids long, doc_ids array<string>, lengths array<long>, payload binary"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part, encoder, seq, before = TaskContext.get().partitionId(), worker_encoder(tokenizer_path, end_id), 0, 0
        held: list[np.ndarray] = []
        ids: list = []
        lengths: list[int] = []
        size = 0

        def closed() -> pd.DataFrame:
            nonlocal seq, before, held, ids, lengths, size
            row = pd.DataFrame([{"part": part, "seq": seq, "before": before, "n_ids": size, "doc_ids": ids, "lengths": lengths, "payload": dac_encode(np.concatenate(held))}])
            seq, before, held, ids, lengths, size = seq + 1, before + size, [], [], [], 0
            return row

        for b in batches:
            texts, keys = b["text"].tolist(), b["doc_id"].tolist()
            for s in text_runs(texts):
                flat, counts = encoder.encode(texts[s])
                at = 0
                for key, n in zip(keys[s], counts.tolist(), strict=True):
                    held.append(flat[at : at + n])
                    ids.append(key)
                    lengths.append(n)
                    at, size = at + n, size + n
                    if size >= segment_ids or len(ids) >= SEGMENT_DOCS:
                        yield closed()
        if ids:
            yield closed()

    order = [F.col("doc_id").asc_nulls_first(), F.col("h").asc()]
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("h")).repartitionByRange(*order).sortWithinPartitions(*order)
    segments = rows.select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInPandas(run, schema)  # ids as text: pandas would make floats of them beside a null
    return written(segments.withColumn("doc_ids", F.col("doc_ids").cast(f"array<{kind}>")), "segments", "uncompressed")


def part_starts(segments: DataFrame) -> DataFrame:
    """p, part_start: the ids before each part. A row for each task that wrote, summed up in one place."""
    totals = segments.groupBy("part").agg(F.sum("n_ids").alias("n"))
    upto = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select(F.col("part").alias("p"), F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("part_start"))


def directory(segments: DataFrame, *columns: str) -> DataFrame:
    """part, seq, start (ids before the segment), n_ids, and other columns of the segments; payloads are not read unless asked for."""
    starts = F.broadcast(part_starts(segments))
    return segments.join(starts, F.col("part") == F.col("p")).select("part", "seq", (F.col("part_start") + F.col("before")).alias("start"), "n_ids", *columns)


def tokens_at(segments: DataFrame, wanted: DataFrame, width: int = SEGMENT_IDS) -> DataFrame:
    """position, token (null beyond the file's end, before its begin, and for null) of the positions wanted (position: ids before the token), each once.

    Positions and segments meet by stretches of the file of `width` ids; only payloads of segments that hold a position are opened, and of those only the bytes of the tokens.
    """
    asked = wanted.select(F.col("position").cast("long").alias("position")).distinct()
    stretch = lambda c: F.floor(c / F.lit(width)).cast("long")
    at = directory(segments).where("n_ids > 0").withColumn("stretch", F.explode(F.sequence(stretch(F.col("start")), stretch(F.col("start") + F.col("n_ids") - 1))))
    met = asked.withColumn("stretch", stretch(F.col("position"))).join(at, "stretch").where("position >= start AND position < start + n_ids")
    own = met.groupBy("part", "seq").agg(F.collect_list(F.struct("position", (F.col("position") - F.col("start")).alias("i"))).alias("these"))  # as many as the segment has ids at most

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for payload, these in zip(b["payload"], b["these"], strict=True):
                ids = Dac(payload)
                yield pd.DataFrame([(t["position"], ids[t["i"]]) for t in these], columns=["position", "token"])

    found = own.join(segments.select("part", "seq", "payload"), ["part", "seq"]).select("payload", "these").mapInPandas(run, "position long, token long")
    return asked.join(found, "position", "left")


def token_at(segments: DataFrame, position: int) -> int:
    """The token at one position. Reads the directory and one segment."""
    if position < 0:
        raise IndexError(position)
    places = directory(segments).where((F.col("start") <= position) & (F.col("start") + F.col("n_ids") > position)).collect()
    if not places:
        raise IndexError(position)
    (s,) = places
    return Dac(one_segment(segments, s.part, s.seq).first().payload)[position - s.start]


def one_segment(segments: DataFrame, part: int, seq: int) -> DataFrame:
    return segments.where((F.col("part") == part) & (F.col("seq") == seq)).select("payload")


def document_starts(segments: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens of every document, without its ids: start + i is the position of its token i."""
    kind = segments.schema["doc_ids"].dataType.elementType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for start, keys, lengths in zip(b["start"], b["doc_ids"], b["lengths"], strict=True):
                yield _placed(start, keys, lengths)

    rows = directory(segments, "doc_ids", "lengths").select("start", F.col("doc_ids").cast("array<string>").alias("doc_ids"), "lengths")
    return rows.mapInPandas(run, "doc_id string, start long, n_tokens long").withColumn("doc_id", F.col("doc_id").cast(kind))


def _placed(start: int, keys: Iterable, lengths: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame({"doc_id": list(keys), "start": start + np.cumsum(lengths) - lengths, "n_tokens": lengths})


def read_documents(segments: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 of every document, from the payloads of a file."""
    kind = segments.schema["doc_ids"].dataType.elementType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for start, keys, lengths, payload in zip(b["start"], b["doc_ids"], b["lengths"], b["payload"], strict=True):
                ids, ends = Dac(payload), np.cumsum(lengths)
                crcs = [zlib.crc32(ids.slice(e - n, e).astype("<u4").tobytes()) for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)]
                yield _placed(start, keys, lengths).assign(ids_crc32=crcs)

    rows = directory(segments, "doc_ids", "lengths", "payload").select("start", F.col("doc_ids").cast("array<string>").alias("doc_ids"), "lengths", "payload")
    return rows.mapInPandas(run, "doc_id string, start long, n_tokens long, ids_crc32 long").withColumn("doc_id", F.col("doc_id").cast(kind))


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op7_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_documents(write_segments(table(spark, sf_dir, "documents"), tokenizer_path()))
