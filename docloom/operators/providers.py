"""Models as functions of batches: embedding, reranking, completion, with retries. Deterministic stand-ins serve tests and offline runs."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Embed = Callable[[list[str]], list[list[float]]]


class Refused(Exception):
    """An answer that another attempt won't change; status is its HTTP status."""

    def __init__(self, status: int):
        super().__init__(f"status {status}")
        self.status = status


def with_retries(call: Callable[[], object], attempts: int = 4, least: float = 1.0, most: float = 20.0, sleep: Callable[[float], None] = time.sleep) -> object:
    """Up to `attempts` calls, waiting twice as long each time. A refusal with a status of 400 to 499 other than 429 is final."""
    for n in range(attempts):
        try:
            return call()
        except Refused as e:
            if 400 <= e.status < 500 and e.status != 429 or n + 1 == attempts:
                raise
        except Exception:
            if n + 1 == attempts:
                raise
        sleep(min(most, least * 2**n))
    raise AssertionError("unreachable")


def hash_embedding(dims: int = 64) -> Embed:
    """Signed hashes of words, of length 1: the same text has the same vector everywhere."""

    def embed(texts: list[str]) -> list[list[float]]:
        import zlib

        out = []
        for t in texts:
            v = np.zeros(dims)
            for w in t.lower().split():
                h = zlib.crc32(w.encode())
                v[h % dims] += 1 if h & 0x80000000 else -1
            n = np.linalg.norm(v)
            out.append((v / n if n else v).tolist())
        return out

    return embed


def embedded(rows: DataFrame, text: str, make: Callable[[], Embed], dims: int, column: str = "semantic_vector", batch: int = 32, chars: int = 8000) -> DataFrame:
    """Adds a vector of each text. `make` is called once in each Python task, so a model is loaded once; texts go in batches, cut, empty ones as a space; a vector of another length is an error."""

    def run(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        embed = make()
        for s in series:
            texts = [(t or "")[:chars] or " " for t in s]
            out: list[list[float]] = []
            for i in range(0, len(texts), batch):
                got = with_retries(lambda i=i: embed(texts[i : i + batch]))
                if any(len(v) != dims for v in got):
                    raise ValueError(f"a vector of other than {dims} dimensions")
                out.extend(got)
            yield pd.Series(out, index=s.index)

    run.__annotations__ = {"series": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return rows.withColumn(column, F.pandas_udf(run, "array<float>")(F.col(text)))


def reranker(score: Callable[[pd.Series, pd.Series], pd.Series]) -> Callable[[Column, Column], Column]:
    """A function of (query, snippet) series as a column for scoring.rerank. One that fails scores all rows 0, which keeps their order."""

    def run(query, snippet):
        try:
            return score(query, snippet).astype(float)
        except Exception:  # noqa: BLE001  an order without reranking is better than none
            return pd.Series(np.zeros(len(query)), index=query.index)

    run.__annotations__ = {"query": pd.Series, "snippet": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, "double")


def completed(rows: DataFrame, prompt: str, complete: Callable[[str], str], column: str = "answer") -> DataFrame:
    """Adds a model's answer to each prompt; null where it failed after all attempts."""

    def one(p: str) -> str | None:
        try:
            return str(with_retries(lambda: complete(p)))
        except Exception:  # noqa: BLE001  the row says so by its null
            return None

    def run(prompts: pd.Series) -> pd.Series:
        return prompts.map(one)

    run.__annotations__ = {"prompts": pd.Series, "return": pd.Series}
    return rows.withColumn(column, F.pandas_udf(run, "string")(F.col(prompt)))


_FACTORIES: dict[tuple[str, str], Callable[..., object]] = {("embedding", "hash"): hash_embedding}
_MADE: dict[tuple, object] = {}


class NoKey(Exception):
    """A provider that needs a key was asked for without one."""


def register_provider(kind: str, name: str, factory: Callable[..., object]) -> None:
    """kind: embedding, rerank or llm."""
    _FACTORIES[kind, name] = factory


def provider(kind: str, name: str, key: str | None = "", **options) -> object:
    """A provider, made once in each process for the same options. key: None if it needs one and there is none."""
    if (kind, name) not in _FACTORIES:
        raise ValueError(f"no {kind} provider {name!r}; there are {sorted(n for k, n in _FACTORIES if k == kind)}")
    if key is None:
        raise NoKey(f"{kind} provider {name!r} needs a key")
    full = (kind, name, key, *sorted(options.items()))
    if full not in _MADE:
        _MADE[full] = _FACTORIES[kind, name](**({"key": key} if key else {}), **options)
    return _MADE[full]


def close_providers() -> None:
    """Forgets all that were made, closing those that can be."""
    while _MADE:
        made = _MADE.popitem()[1]
        if hasattr(made, "close"):
            made.close()


#: What happens while an answer is made, in this order; delta and warning may come again, message is followed by done or error. Fixed values.
EVENTS = ("session", "trace", "delta", "sources", "warning", "message", "done", "error")


def events_of(answers: DataFrame, deltas: int = 200) -> DataFrame:
    """query_id, seq, event, payload: the events of answered queries as rows. answers: query_id, session_id, trace, answer (null where it failed), sources, warnings (texts), message_id. The answer comes in deltas of so many characters."""
    event = lambda name, payload: F.struct(F.lit(name).alias("event"), payload.alias("payload"))
    text = F.coalesce("answer", F.lit(""))
    parts = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.length(text) / deltas).cast("int") - 1)), lambda i: event("delta", F.substring(text, i * deltas + 1, F.lit(deltas))))
    warnings = F.transform(F.coalesce("warnings", F.array().cast("array<string>")), lambda w: event("warning", w))
    begin, end = F.array(event("session", F.col("session_id")), event("trace", F.col("trace"))), F.array(event("message", F.col("message_id")), event("done", F.lit("")))
    whole = F.concat(begin, parts, F.array(event("sources", F.col("sources"))), warnings, end)
    failed = F.concat(begin, F.array(event("error", F.lit("no answer"))))
    return answers.select("query_id", F.posexplode(F.when(F.col("answer").isNotNull(), whole).otherwise(failed)).alias("seq", "e")).select("query_id", "seq", "e.event", "e.payload")
