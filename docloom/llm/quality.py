"""Quality classifier: a regularised quadratic discriminant over transformed document statistics.

Each whole text gives STATISTICS, shares and lengths brought near a bell shape by logarithms. Their sums and products per class, over all
labelled training rows, give class means and covariances. A class covariance is shrunk towards the pooled one, and that towards its
diagonal's mean, by fixed shares. A score is the logistic of the difference of the two log-densities plus the log of the prior odds; each density comes from
a Mahalanobis distance by the Cholesky factor of its class, which is inverted once and sent with the model (a few KB, whatever the data).
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod, map_batches, small_batches, table, written

STATISTICS = (
    "words", "word_length", "symbols", "bars", "marks", "capitals", "digits", "stops", "commas", "top_word", "variety", "stutter", "pairs", "lines", "line_words",
)

_UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_DIGITS = b"0123456789"
_SYMBOLS = b"#$%&*<=>@[\\]^_`{}~+/"

#: Shrinkage: rows' worth of the pooled covariance mixed into each class's, and the share of the pooled one's mean variance mixed into its diagonal.
POOLED_ROWS, RIDGE = 200.0, 0.02


def statistics(text: str | None) -> list[float]:
    """STATISTICS of a whole text. Null and empty texts, and those of white space only, are alike: no words."""
    raw = text.encode("utf-8", "surrogatepass") if text else b""
    words = raw.split()
    n, size = len(words), len(raw) + 1
    counts = Counter(words)
    lines = [x for x in raw.split(b"\n") if x.strip()]

    def share(chars: bytes) -> float:
        return math.log(0.002 + (len(raw) - len(raw.translate(None, chars))) / size)

    def part(count: float, of: int, least: float = 0.01) -> float:
        return math.log(least + count / of) if of else math.log(least + 1)

    # how many different words a text of n words may be expected to have grows slower than n; the exponent takes that out
    return [
        math.log1p(n),
        math.log(1 + len(raw) / (n + 1)),
        share(_SYMBOLS), share(b"|"), share(b"!"), share(_UPPER), share(_DIGITS),
        part(raw.count(b"."), n), part(raw.count(b","), n),
        part(max(counts.values(), default=0), n),
        math.log(len(counts) + 1) - 0.75 * math.log1p(n),
        part(sum(map(eq, words, words[1:])), n),
        math.log(1.01 - len(set(zip(words, words[1:], strict=False))) / (n - 1)) if n > 1 else math.log(0.01),
        math.log(1.01 - len(set(lines)) / len(lines)) if lines else math.log(0.01),
        math.log1p(n / (len(lines) or 1)),
    ]


@dataclass(frozen=True)
class Discriminant:
    """means[k], whiten[k] (inverse Cholesky factor), log_det[k] of class k (0, 1) and the log of the prior odds, all after centring and scaling."""

    centre: np.ndarray
    scale: np.ndarray
    means: np.ndarray
    whiten: np.ndarray
    log_det: np.ndarray
    odds: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.centre) / self.scale
        d = [-0.5 * (((z - self.means[k]) @ self.whiten[k].T) ** 2).sum(1) - 0.5 * self.log_det[k] for k in (0, 1)]
        return 1 / (1 + np.exp(-np.clip(d[1] - d[0] + self.odds, -500, 500)))


def fit(moments: dict[int, tuple[float, np.ndarray, np.ndarray]], pooled_rows: float = POOLED_ROWS, ridge: float = RIDGE) -> Discriminant:
    """moments: by class: rows, sums, sums of products. A class without rows is taken to look like the other; without any rows all scores are 0.5."""
    p = len(STATISTICS)
    n = np.array([moments.get(k, (0.0,))[0] for k in (0, 1)], dtype=float)
    if not n.sum():
        return Discriminant(np.zeros(p), np.ones(p), np.zeros((2, p)), np.stack([np.eye(p)] * 2), np.zeros(2), 0.0)
    total = sum(moments[k][1] for k in moments)
    centre = total / n.sum()
    spread = sum(moments[k][2] for k in moments) / n.sum() - np.outer(centre, centre)
    scale = np.sqrt(np.maximum(np.diag(spread), 1e-12))
    means, inner = np.zeros((2, p)), np.zeros((2, p, p))
    for k, (rows, s, q) in moments.items():
        mean = s / rows
        means[k] = (mean - centre) / scale
        inner[k] = (q - rows * np.outer(mean, mean)) / np.outer(scale, scale)
    pooled = (inner.sum(0) + np.eye(p)) / (n.sum() + 1)
    pooled = (1 - ridge) * pooled + ridge * np.trace(pooled) / p * np.eye(p)
    whiten, log_det = np.zeros((2, p, p)), np.zeros(2)
    for k in (0, 1):
        factor = np.linalg.cholesky((inner[k] + pooled_rows * pooled) / (n[k] + pooled_rows))
        whiten[k] = np.linalg.inv(factor)
        log_det[k] = 2 * np.log(np.diag(factor)).sum()
    return Discriminant(centre, scale, means, whiten, log_det, math.log((n[1] + 1) / (n[0] + 1)))


def with_statistics(docs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the columns named in carry, and STATISTICS. docs: doc_id, text; others are ignored."""
    small_batches(docs.sparkSession)
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in docs.select("doc_id", *carry).schema)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x = np.array([statistics(t) for t in b["text"]]).reshape(-1, len(STATISTICS))
            yield pd.concat([b.drop(columns="text").reset_index(drop=True), pd.DataFrame(x, columns=list(STATISTICS))], axis=1)

    return map_batches(docs.select("doc_id", *carry, "text"), run, f"{kinds}, " + ", ".join(f"{s} double" for s in STATISTICS))


def train(stats: DataFrame, labels: DataFrame) -> Discriminant:
    """stats: doc_id and STATISTICS; labels: doc_id, label (0 or 1; others are no labels). The sums are of all rows; 2 * (1 + 15 + 120) numbers reach the driver."""
    p = len(STATISTICS)
    sums = [F.sum(F.lit(1.0))] + [F.sum(s) for s in STATISTICS] + [F.sum(F.col(a) * F.col(b)) for i, a in enumerate(STATISTICS) for b in STATISTICS[: i + 1]]
    rows = (
        stats.join(labels.where("label IN (0, 1)"), "doc_id").groupBy("label").agg(*[s.alias(f"m{i}") for i, s in enumerate(sums)]).collect()
    )
    moments = {}
    for r in rows:
        q = np.zeros((p, p))
        q[np.tril_indices(p)] = r[2 + p :]
        moments[int(r["label"])] = (r[1], np.array(r[2 : 2 + p]), q + np.tril(q, -1).T)
    return fit(moments)


def score(stats: DataFrame, model: Discriminant) -> DataFrame:
    """Score, 0 to 1 (higher: label 1 likelier), in place of the STATISTICS."""
    held, kept = stats.sparkSession.sparkContext.broadcast(model), stats.drop(*STATISTICS)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.drop(columns=list(STATISTICS)).assign(score=held.value.scores(b[list(STATISTICS)].to_numpy(float)))

    return map_batches(stats, run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept.schema) + ", score double")


def training_labels(labels: DataFrame, column: str, modulus: int, held_out: int) -> DataFrame:
    """doc_id, label of the rows that may be learnt from; one row for each doc_id (the larger of contrary labels)."""
    return (
        labels.where(f"doc_id IS NOT NULL AND {column} IS NOT NULL").where(crc_mod("doc_id", modulus) != held_out)
        .groupBy("doc_id").agg(F.max(column).alias("label"))
    )


def quality_scores(docs: DataFrame, labels: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, held_out, score, predicted, and the columns named in carry, for every row of docs: doc_id, text (others ignored).

    labels: doc_id, quality. Rows with crc32(doc_id) mod 3 = 1, a null doc_id or a null quality teach nothing. The statistics are
    computed once, written to the shared folder and read for both learning and scoring. Null, empty and very long texts are scored like any, by the text alone; repeated rows
    are scored each; no rows give no rows.
    """
    stats = written(with_statistics(docs, carry), "quality-stats")
    model = train(stats, training_labels(labels, "quality", 3, 1))
    return score(stats, model).select(
        "doc_id", (crc_mod("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), *carry
    )


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
