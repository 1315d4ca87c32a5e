r"""Spelling variants: words that are one edit apart, found by Aho-Corasick automata over the halves of words.

Of two words that differ by one inserted, deleted or replaced code point, either half of the one stands whole in the other: the first half at its beginning or the second at its end, and their lengths differ by one at most.
So halves are dealt to shards by a hash of (which half, its text), and each word goes to the shards of the halves that words near to it may have: two beginnings and two ends of its own. A shard's automaton holds its halves; every word
that comes is scanned, matches count where place and lengths fit, and what remains of both words is compared. A shard sends one row for each word, with the number of its near words and the best of them, so no pairs leave it.

Many words may share a half. A shard then looks the rests up by what is left of them without one code point, so its work stays in proportion to the words. Halves of more than HOT words are not put in a shard: their words meet by the same keys through a
shuffle, where a key has no more words than there are ways to put one code point in.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.session import broadcast_if_small, map_batches

from .common import small_batches, table, written

#: Code points of a word and its occurrences at least; one of so many occurrences loses a code point; a form has so many times a word's occurrences.
LEAST_LENGTH, LEAST_COUNT, DAMAGED, TIMES = 7, 2, 31, 10
#: Halves of more words than HOT are met by shuffled keys; a shard has about SHARD words; so many rests of a half are compared one by one.
HOT, SHARD, FEW = 20_000, 50_000, 12
#: Different words that a task counts before it lets them go.
COUNTED = 300_000
#: Rests of more code points than this have hashes for keys.
LONG = 48

_UPPER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_RUN = re.compile(rf"[a-zÀ-ÿ]{{{LEAST_LENGTH},}}")  # what is shorter gives no word
_BASE = np.uint64(0x9E3779B97F4A7C15)


def word_counts(docs: DataFrame, damage: int = DAMAGED, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """word, n of the different words of all texts, stored. docs: doc_id, text.

    A word is a run of ASCII and Latin-1 letters with A-Z in lower case; where `damage` divides crc32(`doc_id:run`), without its code point number crc32 % length. Words shorter than least_length or rarer than
    least_count are left out. Counts of a task are added up before they are shuffled. A null text has no words; a null id counts as no text.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: Counter = Counter()
        for b in batches:
            for key, text in zip(b["doc_id"], b["text"], strict=True):
                if not text:
                    continue
                start = zlib.crc32(f"{'' if key is None else key}:".encode())
                for word, n in Counter(_RUN.findall(text.encode().translate(_UPPER).decode())).items():
                    h = zlib.crc32(word.encode(), start)
                    if h % damage == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1 :]
                        if len(word) < least_length:
                            continue
                    counts[word] += n
                if len(counts) >= COUNTED:
                    yield pd.DataFrame({"word": list(counts), "n": list(counts.values())})
                    counts.clear()
        if counts:
            yield pd.DataFrame({"word": list(counts), "n": list(counts.values())})

    found = map_batches(docs.select("doc_id", "text"), run, "word string, n long")
    return written(found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count), "words")


def near(a: str, b: str) -> bool:
    """Whether exactly one code point has to be inserted, deleted or replaced."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    low, high = 0, len(a)
    while low < high:  # code points that both begin with
        mid = (low + high + 1) // 2
        low, high = (mid, high) if b.startswith(a[:mid]) else (low, mid - 1)
    return a[low + (len(a) == len(b)) :] == b[low + 1 :]


def thinned(rest: str) -> list:
    """rest, and what is left of it without one code point; what has more than LONG code points as (length, hash). Two texts one edit apart share one of these."""
    n = len(rest)
    short = [rest[:i] + rest[i + 1 :] for i in range(n)] if n <= LONG + 1 else []
    if n <= LONG:
        return [rest, *short]
    codes = np.frombuffer(rest.encode("utf-32-le"), "<u4").astype(np.uint64) + np.uint64(1)
    with np.errstate(over="ignore"):
        powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, _BASE)]))
        upto = np.concatenate([[np.uint64(0)], np.cumsum(codes * powers[1:])])  # sum of code * base^place
        without = upto[:-1] + (upto[-1] - upto[1:]) * np.uint64(pow(int(_BASE), -1, 1 << 64))  # all behind is one place nearer
    return [(n, int(upto[-1])), *(short or ((n - 1, int(x)) for x in without))]


class Group:
    """Words that have one half: their rests and how often they occur."""

    def __init__(self) -> None:
        self.rests: list[str] = []
        self.words: list[tuple[str, int]] = []
        self.keys: dict | None = None

    def add(self, rest: str, word: str, n: int) -> None:
        self.rests.append(rest)
        self.words.append((word, n))

    def of(self, rest: str) -> list[tuple[str, int]]:
        """Words whose rest is near to this one."""
        if len(self.rests) <= FEW:
            return [w for r, w in zip(self.rests, self.words, strict=True) if near(r, rest)]
        if self.keys is None:
            self.keys = {}
            for i, r in enumerate(self.rests):
                for key in thinned(r):
                    self.keys.setdefault(key, []).append(i)
        found = {i for key in thinned(rest) for i in self.keys.get(key, ())}
        return [self.words[i] for i in found if near(self.rests[i], rest)]


#: Which half of a word: the first at its beginning, the second at its end.
FIRST, SECOND = 0, 1


class Automaton:
    """The halves of a shard's words, each with its group of words for either half."""

    def __init__(self) -> None:
        import ahocorasick

        self.machine, self.size = ahocorasick.Automaton(), 0

    def add(self, half: int, word: str, n: int) -> None:
        cut = len(word) // 2
        segment, rest = (word[:cut], word[cut:]) if half == FIRST else (word[cut:], word[:cut])
        groups = self.machine.get(segment, None)
        if groups is None:
            groups = (len(segment), Group(), Group())
            self.machine.add_word(segment, groups)
        groups[1 + half].add(rest, word, n)
        self.size += 1

    def close(self) -> None:
        if self.size:
            self.machine.make_automaton()

    def of(self, word: str) -> Iterator[tuple[str, int]]:
        """The words near to this one by a half that is here. One that both halves find is found by its first."""
        if not self.size:
            return
        n = len(word)
        for end, (length, firsts, seconds) in self.machine.iter(word):
            # the first half of a word of n - 1 to n + 1 code points at the beginning, or the second at the end
            if end + 1 == length and (n - 1) // 2 <= length <= (n + 1) // 2:
                yield from firsts.of(word[length:])
            if end + 1 == n and n // 2 <= length <= (n + 2) // 2:
                for other, count in seconds.of(word[: n - length]):
                    if not word.startswith(other[: len(other) // 2]):
                        yield other, count


def _halves(words: DataFrame) -> DataFrame:
    """half, segment, word, n: the two halves of each word."""
    cut = F.floor(F.length("word") / 2).cast("int")
    first = F.struct(F.lit(FIRST).alias("half"), F.left("word", cut).alias("segment"))
    second = F.struct(F.lit(SECOND).alias("half"), F.right("word", F.length("word") - cut).alias("segment"))
    return words.select("word", "n", F.explode(F.array(first, second)).alias("of")).select("of.half", "of.segment", "word", "n")


def _places(words: DataFrame, least_length: int) -> DataFrame:
    """half, segment, word, n: the beginnings and ends of each word that are a half of a word near to it."""
    length = F.length("word")
    lengths = F.filter(F.array(length - 1, length, length + 1), lambda x: x >= least_length)
    firsts = F.transform(F.array_distinct(F.transform(lengths, lambda x: F.floor(x / 2).cast("int"))), lambda k: F.struct(F.lit(FIRST).alias("half"), F.left("word", k).alias("segment")))
    seconds = F.transform(F.array_distinct(F.transform(lengths, lambda x: F.ceil(x / 2).cast("int"))), lambda k: F.struct(F.lit(SECOND).alias("half"), F.right("word", k).alias("segment")))
    return words.select("word", "n", F.explode(F.concat(firsts, seconds)).alias("of")).select("of.half", "of.segment", "word", "n")


SUMS = "word string, near long, best_n long, best string"


def _best(found: list[tuple[str, int]]) -> tuple[int, int, str]:
    n, word = min((-n, w) for w, n in found)
    return len(found), -n, word


def _shard(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """For mapInPandas over a shard: halves first, then words to scan, equal ones together."""
    automaton, closed, last = Automaton(), False, None
    for b in batches:
        out = []
        for scan, half, word, n in zip(b["scan"].tolist(), b["half"].tolist(), b["word"], b["n"].tolist(), strict=True):
            if not scan:
                automaton.add(half, word, n)
                continue
            if not closed:
                automaton.close()
                closed = True
            if word != last:
                last = word
                if found := list(automaton.of(word)):
                    out.append((word, *_best(found)))
        if out:
            yield pd.DataFrame(out, columns=["word", "near", "best_n", "best"])


def _keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """For mapInPandas over words at hot halves: a key for each way to take one code point out of the rest."""
    import xxhash

    for b in batches:
        out: list[tuple] = []
        for half, segment, word, n in zip(b["half"].tolist(), b["segment"], b["word"], b["n"].tolist(), strict=True):
            rest = word[len(segment) :] if half == FIRST else word[: len(word) - len(segment)]
            start = xxhash.xxh3_64_intdigest(f"{half}{segment}")
            out += [(xxhash.xxh3_64_intdigest(repr(key), seed=start) - (1 << 63), half, word, n) for key in set(thinned(rest))]
            if len(out) >= 20_000:
                yield pd.DataFrame(out, columns=["key", "half", "word", "n"])
                out = []
        if out:
            yield pd.DataFrame(out, columns=["key", "half", "word", "n"])


def _by_keys(halves: DataFrame, places: DataFrame, hot: DataFrame) -> DataFrame:
    """word, near, best_n, best by the hot halves. Pairs are near ones and a few more; each is counted once, by its first half if that finds it."""
    own = lambda df: df.join(hot, ["half", "segment"]).select("half", "segment", "word", "n").mapInPandas(_keys, "key long, half int, word string, n long")
    met = own(places).drop("n").join(own(halves).withColumnRenamed("word", "other"), ["key", "half"]).where((F.col("word") != F.col("other")) & (F.levenshtein("word", "other", 1) == 1))
    begins = F.col("word").startswith(F.left("other", F.floor(F.length("other") / 2).cast("int")))
    pairs = met.where((F.col("half") == FIRST) | ~begins).select("word", "other", "n").distinct()
    best = F.min(F.struct((-F.col("n")).alias("m"), F.col("other").alias("best")))
    return pairs.groupBy("word").agg(F.count("*").alias("near"), best.alias("b")).select("word", "near", (-F.col("b.m")).alias("best_n"), "b.best")


def nearest(words: DataFrame, least_length: int = LEAST_LENGTH, hot: int = HOT, shard: int = SHARD) -> DataFrame:
    """word, near (near words), best_n, best (the near word of largest n, of equal ones the first by code points) of the words that have any. words: word, n, stored, each word once."""
    spark = words.sparkSession
    halves, places = _halves(words), _places(words, least_length)
    crowded = written(halves.groupBy("half", "segment").count().where(F.col("count") > hot).select("half", "segment"), "crowded-halves")
    crowded = broadcast_if_small(crowded)
    rows = halves.select(F.lit(0).alias("scan"), "half", "segment", "word", "n").unionByName(places.select(F.lit(1).alias("scan"), "half", "segment", "word", "n"))
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-2 * words.count() // shard))
    dealt = rows.join(crowded, ["half", "segment"], "left_anti").repartition(shards, "half", "segment").sortWithinPartitions("scan", "word")
    found = dealt.select("scan", "half", "word", "n").mapInPandas(_shard, SUMS).unionByName(_by_keys(halves, places, crowded))
    first: Column = F.min(F.struct((-F.col("best_n")).alias("m"), F.col("best").alias("best")))
    return found.groupBy("word").agg(F.sum("near").alias("near"), first.alias("b")).select("word", "near", (-F.col("b.m")).alias("best_n"), "b.best")


def variants(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, times: int = TIMES, damage: int = DAMAGED, hot: int = HOT, shard: int = SHARD) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word (see word_counts()).

    A word's form is its near word of largest n, of equal ones the first by code points, if that n is at least `times` the word's n, else null; its root is where its form's form, and so on, ends. docs: doc_id, text; other columns are
    ignored. Repeated rows count as often as they are there. Null and empty texts, and no rows, give no words. A word may be of any length.
    """
    small_batches(docs.sparkSession)
    words = word_counts(docs, damage, least_length, least_count)
    both = words.join(nearest(words, least_length, hot, shard), "word", "left")
    chosen = F.col("best_n") >= times * F.col("n")
    each = written(both.select("word", "n", F.coalesce("near", F.lit(0)).cast("long").alias("n_near"), F.when(chosen, F.col("best")).alias("form"), F.when(chosen, F.col("best_n")).alias("form_n")), "word-forms")
    roots = each.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    # each round goes twice as far; a form has at least `times` the occurrences, so few are needed
    while True:
        ahead = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = written(roots.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "word-roots")
        roots = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            break
    return each.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(table(spark, sf_dir, "documents"))
