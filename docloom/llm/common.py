"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.session import map_batches, shared_dir, table
from docloom.session import stored as written

__all__ = ["map_batches", "shared_dir", "table", "written"]

#: A pandas batch holds at most so many rows; texts can be long, so the default of 10,000 is too many.
BATCH_ROWS = 1000

#: Fixed value: ASCII white space, the separators of `[^\x20\x09-\x0D]+`.
SPACES = b" \t\n\x0b\x0c\r"

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
#: Lower-cases A-Z and blanks every ASCII byte that is no letter or digit; bytes of other characters stay.
_ALNUM = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Bounds the Arrow batches that Python workers get, by rows and by bytes. The setting is the session's, so it holds for later queries too; it changes no result."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


def crc_mod(column: str, modulus: int) -> Column:
    """crc32 of the decimal text of an id, modulo a number: how folds are dealt. A null id is in fold -1."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % modulus, F.lit(-1)).cast("int")


def crc32_of(text: str) -> int:
    return zlib.crc32(text.encode())


def words_of(text: str | None) -> list[bytes]:
    r"""Words `[^\x20\x09-\x0D]+` of a text with A-Z in lower case, as UTF-8; none for null."""
    return text.encode("utf-8", "surrogatepass").translate(_LOWER).split() if text else []


def alnum_words(text: str | None) -> list[bytes]:
    r"""Words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` of a text with A-Z in lower case, as UTF-8; none for null."""
    return text.encode("utf-8", "surrogatepass").translate(_ALNUM).split() if text else []


class WordHash(dict):
    """64-bit hashes of words, kept for words seen lately; emptied when it holds too many."""

    def __init__(self, most: int = 300_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= self.most:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


_M = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n values; of the whole, with its length, when there are fewer than n; empty for none."""
    if not len(hashes):
        return hashes
    size = min(n, len(hashes))
    with np.errstate(over="ignore"):
        out = hashes[: len(hashes) - size + 1] + np.uint64(size)
        for i in range(1, size):
            out = (out ^ (out >> np.uint64(29))) * _M + hashes[i : len(hashes) - size + 1 + i]
    return mixed(out)


def groups_in(batches: Iterator, key: str) -> Iterator:
    """Pandas frames of one key each, from batches sorted by that key. The groups have to fit in memory."""
    import pandas as pd

    held: list = []
    for batch in batches:
        if not len(batch):
            continue
        values = batch[key].to_numpy()
        cuts = np.flatnonzero(values[1:] != values[:-1]) + 1
        edges = [0, *cuts, len(values)]
        for i in range(len(edges) - 1):
            part = batch.iloc[edges[i] : edges[i + 1]]
            if held and held[0][key].iloc[0] != part[key].iloc[0]:
                yield pd.concat(held) if len(held) > 1 else held[0]
                held = []
            held.append(part)
    if held:
        yield pd.concat(held) if len(held) > 1 else held[0]
