"""Toxicity by a factorization machine over hashed terms.

A document's terms are its words and their beginnings, hashed to buckets, and every bucket is an input, 1 if present. A score is the logistic of
bias + sum of weights + sum over pairs of present inputs of the dot product of their factors, so a pair of terms (an insult and a group's name) can count for more than both alone, or for something that neither does.
Buckets that no training row has keep a weight of 0 and no factors, so they count nothing.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod, map_batches, small_batches, table, written
from .quality import training_labels

#: The classifier is fitted on so many labelled rows at most: those with the smallest hashes of their doc_ids, one row for each doc_id.
TRAIN_ROWS = 30_000
#: Buckets of terms, all of them inputs; factors of an input.
BUCKETS, FACTORS = 1 << 20, 8
PREFIXES = (4, 5, 6, 7)
#: A training row of label 1 counts for so many of label 0.
RARE = 2.0
#: Batches of the bias and weights alone, then of all, and their size, whatever the number of rows.
STEPS, ROWS = (500, 500), 128
#: Factors begin with this deviation from 0, small beside weights, are shrunk by this ridge, and have this share of the rate.
#: Sums of squared steps of weights begin with this, so that those of inputs in few rows move little.
HELD = 0.01
#: What an input's value is measured by: the chi-square that one in a hundred has by chance, the share of the rows, and the least value.
BY_CHANCE, BY_SHARE, LEAST = 6.63, 1 / 3, 0.02
START, FACTOR_RIDGE, FACTOR_RATE = 0.02, 1e-4, 0.3

_WORD = re.compile(r"[^\W\d_]+")


def term_buckets(word: str) -> tuple[int, ...]:
    """Buckets of a lower-case word and of its beginnings."""
    import xxhash

    return tuple({xxhash.xxh3_64_intdigest(t) % BUCKETS for t in (f"w{word}", *(f"{n}{word[:n]}" for n in PREFIXES if len(word) > n))})


def words_of(text: str | None) -> set[str]:
    return set(_WORD.findall(text.lower())) if text else set()


class Terms(dict):
    """By word, its buckets; emptied when it holds too many words."""

    def __init__(self, most: int = 200_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) >= self.most:
            self.clear()
        self[word] = found = term_buckets(word)
        return found

    def of(self, text: str | None) -> np.ndarray:
        """The buckets of a text, ascending."""
        found = np.fromiter(set(chain.from_iterable(map(self.__getitem__, words_of(text)))), np.int64)
        found.sort()
        return found


@dataclass(frozen=True)
class Machine:
    """inputs: the buckets that training rows have, ascending; weights and factors: theirs, in single precision, as they go to all tasks."""

    inputs: np.ndarray
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def placed(self, buckets: np.ndarray) -> np.ndarray:
        """Places of those of the buckets that are inputs."""
        if not len(self.inputs):
            return np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.inputs, buckets), len(self.inputs) - 1)
        return at[self.inputs[at] == buckets]

    def scores(self, rows: list[np.ndarray]) -> np.ndarray:
        """Of rows of buckets; each from its own, so a row's score doesn't depend on the rows around it."""
        out = np.empty(len(rows))
        for i, r in enumerate(rows):
            at = self.placed(r)
            v = self.factors[at].astype(float)
            s = v.sum(0)
            out[i] = self.bias + self.weights[at].sum(dtype=float) + 0.5 * (s @ s - (v * v).sum())
        return 1 / (1 + np.exp(-np.clip(out, -60, 60)))


def input_values(placed: list[np.ndarray], labels: np.ndarray, n: int) -> np.ndarray:
    """How much each input counts where it is present: near 1 if its presence goes with the label (chi-square with Yates's correction) or if it is in many rows, whose pairs may tell what none of them tells alone; else little, but something."""
    has, pos = np.zeros(n), np.zeros(n)
    for r, y in zip(placed, labels, strict=True):  # a row has an input once
        has[r] += 1
        pos[r] += y
    rows, all_pos = len(placed), float(labels.sum())
    off = np.maximum(np.abs(pos * (rows - all_pos) - (has - pos) * all_pos) - rows / 2, 0)
    chi = off * off * rows / np.maximum(1, all_pos * (rows - all_pos) * has * (rows - has))
    return np.maximum(np.maximum(chi / (chi + BY_CHANCE), has / (has + BY_SHARE * rows)), LEAST).astype(np.float32)


def train(rows: Iterable[np.ndarray], labels: np.ndarray, steps: tuple[int, int] = STEPS, rate: float = 0.3, ridge: float = 2e-5, start: float = START, factor_ridge: float = FACTOR_RIDGE, seed: int = 7) -> Machine:
    """By AdaGrad on batches of ROWS rows: bias and weights alone in the first steps, so that factors learn what weights leave over.

    rows: the buckets of each, all of which become inputs with their input_values(); a step reads and changes those of its batch only. With no rows, or one class only, the scores are the
    smoothed share of label 1.
    """
    placed = list(rows)
    there = np.zeros(BUCKETS, bool)
    for r in placed:
        there[r] = True
    inputs = np.flatnonzero(there).astype(np.int32)
    n, rng = len(inputs), np.random.default_rng(seed)
    share = (labels.sum() + 1) / (len(labels) + 2)
    bias, w, v = np.float32(np.log(share / (1 - share))), np.zeros(n, np.float32), rng.standard_normal((n, FACTORS), np.float32) * np.float32(start)
    if len(set(labels.tolist())) < 2 or not n:
        return Machine(inputs, float(bias), w, v * 0)
    place = np.cumsum(there, dtype=np.int32) - 1
    for i, r in enumerate(placed):
        placed[i] = place[r]
    values = input_values(placed, labels, n)
    sizes, labels = np.array([len(r) for r in placed]), labels.astype(np.float32)
    gb, gw, gv, order = 1e-8, np.full(n, HELD, np.float32), np.full((n, FACTORS), 1e-8, np.float32), np.zeros(0, np.int64)
    for step in range(sum(steps)):
        while len(order) < ROWS:
            order = np.concatenate([order, rng.permutation(len(placed))])
        pick, order = order[:ROWS], order[ROWS:]
        flat, of = np.concatenate([placed[i] for i in pick]), np.repeat(np.arange(ROWS), sizes[pick])
        by_input = np.argsort(flat, kind="stable")
        heads = np.flatnonzero(np.diff(flat[by_input], prepend=-1))
        some = flat[by_input][heads]  # the batch's inputs
        x = values[some]
        raw = bias + np.bincount(of, w[flat] * values[flat], ROWS).astype(np.float32)
        pairs = step >= steps[0]
        if pairs:
            own = v[flat] * values[flat][:, None]
            sums = np.zeros((ROWS, FACTORS), np.float32)
            full = sizes[pick] > 0
            sums[full] = np.add.reduceat(own, (np.cumsum(sizes[pick]) - sizes[pick])[full], axis=0)
            raw += 0.5 * ((sums * sums).sum(1) - np.bincount(of, (own * own).sum(1), ROWS).astype(np.float32))
        p = 1 / (1 + np.exp(-np.clip(raw, -60, 60)))
        g = ((p - labels[pick]) * np.where(labels[pick] == 1, RARE, 1.0) / ROWS).astype(np.float32)
        each = g[of[by_input]]
        xg = np.add.reduceat(each, heads) if len(heads) else each
        dw = xg * x + ridge * w[some]
        if pairs and len(heads):
            dv = np.add.reduceat(each[:, None] * sums[of[by_input]], heads, axis=0)
            dv = (dv - v[some] * (x * xg)[:, None]) * x[:, None] + factor_ridge * v[some]
            gv[some] += dv * dv
            v[some] -= FACTOR_RATE * rate * dv / np.sqrt(gv[some])
        db = g.sum()
        gb, gw[some] = gb + db * db, gw[some] + dw * dw
        bias = np.float32(bias - rate * db / np.sqrt(gb))
        w[some] -= rate * dw / np.sqrt(gw[some])
    return Machine(inputs, float(bias), w * values, v * values[:, None])


def training_terms(docs: DataFrame, labels: DataFrame, train_rows: int) -> DataFrame:
    """doc_id, label, terms (buckets, packed) of the training rows, at most train_rows: of rows with equal doc_ids, the one with the least hash of its text. Their ids are broadcast, and no text is shuffled."""
    spark = docs.sparkSession
    chosen = labels.orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows).collect()
    sample = spark.createDataFrame(chosen, labels.schema).select(F.col("doc_id").alias("_id"), F.col("label").alias("_label"))
    texts = docs.select("doc_id", "text", F.xxhash64("text").alias("key")).join(F.broadcast(sample), F.col("doc_id") == F.col("_id"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        terms = Terms()
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "key": b["key"], "label": b["_label"], "terms": [packed(terms.of(t)) for t in b["text"]]})

    kind = docs.schema["doc_id"].dataType.simpleString()
    found = map_batches(texts.select("doc_id", "key", "_label", "text"), run, f"doc_id {kind}, key long, label int, terms binary")
    return written(found.groupBy("doc_id").agg(F.min_by(F.struct("label", "terms"), "key").alias("one")).select("doc_id", "one.*"), "toxicity-terms")


def packed(buckets: np.ndarray) -> bytes:
    """Ascending numbers as their compressed steps, a byte or two each."""
    return zlib.compress(np.diff(buckets, prepend=0).astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def unpacked(data: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(zlib.decompress(data), np.uint8).reshape(4, -1).T.copy().view("<u4").ravel(), dtype=np.int32)


def fit(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> Machine:
    """labels: doc_id, label. What reaches the driver is bounded by train_rows: the packed terms of so many rows, of which a row has BUCKETS at most."""
    rows = sorted((bytes(r.terms), r.label) for r in training_terms(docs, labels, train_rows).select("label", "terms").collect())
    labels_of = np.array([y for _, y in rows], dtype=float)
    rows.reverse()
    return train((unpacked(rows.pop()[0]) for _ in range(len(rows))), labels_of)  # packed rows go as they are unpacked


def toxicity_scores(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs: doc_id, text (others ignored).

    labels: doc_id, toxic. Rows with crc32(doc_id) mod 5 = 0, a null doc_id or a null label teach nothing. Null and empty texts, and those without letters, have no terms: they get the
    score of the bias. Whole texts are read, however long. Repeated rows are scored each, and one row of an id teaches; no rows give no rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    learn = training_labels(labels, "toxic", 5, 0).where("label IN (0, 1)").select("doc_id", F.col("label").cast("int").alias("label"))
    held = spark.sparkContext.broadcast(fit(docs, learn, train_rows))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        terms = Terms()
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "score": held.value.scores([terms.of(t) for t in b["text"]])})

    scored = map_batches(docs.select("doc_id", "text"), run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")
    return scored.select(
        "doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
