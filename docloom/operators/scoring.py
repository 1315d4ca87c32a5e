"""Lexical, vector and time scores of chunks for a table of queries, their fusion, and top-k.

Postings are (chunk, term, tf) rows; a query touches those of its terms only. Everything is keyed by query_id, so any number of queries is one job.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions.analysis import terms
from docloom.functions.vectors import cosine
from docloom.session import broadcast_if_small, small, stored

from . import filters

K1, B = 1.2, 0.75
#: Words of a query that make newer documents count more (matched anywhere in it).
RECENCY_WORDS = (
    "latest", "newest", "recent", "recently", "current", "up to date", "this year",
    "最新", "最近", "近期", "当前", "今年", "本月", "本周", "目前",
)
DECAY_DAYS, DECAY = 180.0, 0.5


def postings(rows: DataFrame, key: str, text: str, stop_words: tuple[str, ...] | None = None) -> DataFrame:
    """key, term, tf, dl (terms of the row), first (whether the row's first term is this one). key is unique. To be stored when several scores are made of it."""
    found = terms(text) if stop_words is None else terms(text, stop_words)
    each = rows.select(key, found.alias("terms")).select(key, F.size("terms").alias("dl"), F.posexplode("terms").alias("pos", "term"))
    return each.groupBy(key, "term", "dl").agg(F.count("*").alias("tf"), (F.min("pos") == 0).alias("first")).select(key, "term", "tf", "dl", "first")


@dataclass(frozen=True)
class Totals:
    """Rows with terms, and their mean number of them."""

    n_docs: int
    avgdl: float


def totals(posting: DataFrame) -> Totals:
    """One sum over all postings: each row has one first term, and as many terms as its tf add up to."""
    n, total = posting.agg(F.count_if("first"), F.sum("tf")).first()
    return Totals(n, total / n if n else 1.0)


def _idf(n_docs: int) -> Column:
    return F.log(1 + (F.lit(float(n_docs)) - F.col("df") + 0.5) / (F.col("df") + 0.5))


def _tf_part(freq: Column, avgdl: float, k1_plus_one: bool = False, length: Column | None = None) -> Column:
    tf = freq.cast("double")
    return tf / (tf + F.lit(K1) * (1 - B + B * (F.col("dl") if length is None else length) / F.lit(avgdl))) * (K1 + 1 if k1_plus_one else 1)


def document_frequencies(posting: DataFrame, asked: DataFrame) -> DataFrame:
    """term, df of the asked terms (term)."""
    return posting.join(broadcast_if_small(asked.select("term").distinct()), "term", "left_semi").groupBy("term").agg(F.count("*").alias("df"))


def bm25(posting: DataFrame, query_terms: DataFrame, key: str, k1_plus_one: bool = False, total: Totals | None = None) -> DataFrame:
    """query_id, key, bm25. query_terms: query_id, term (repeats count once) and, if wished, weight, by which a term counts.

    idf = ln(1 + (N - df + 0.5) / (df + 0.5)), tf part = tf / (tf + k1 * (1 - b + b * length / mean length)). Lengths and counts are of all postings. Of the postings, only those of asked
    terms are joined, with one small table of the queries' terms; sums are combined before they are shuffled.
    """
    total = total or totals(posting)
    asked = query_terms if "weight" in query_terms.columns else query_terms.withColumn("weight", F.lit(1.0))
    asked = asked.groupBy("query_id", "term").agg(F.max("weight").alias("weight"))
    asked = stored(asked.join(document_frequencies(posting, asked), "term").withColumn("part", F.col("weight") * _idf(total.n_docs)).select("query_id", "term", "part"), "asked")
    hits = posting.join(broadcast_if_small(asked), "term")
    return hits.groupBy("query_id", key).agg(F.sum(F.col("part") * _tf_part(F.col("tf"), total.avgdl, k1_plus_one)).alias("bm25"))


def fuzziness(term: Column) -> Column:
    """Edits allowed: none up to 2 characters, one up to 5, else two."""
    return F.when(F.length(term) <= 2, 0).when(F.length(term) <= 5, 1).otherwise(2)


#: Characters at a term's beginning that candidates are looked for by.
PREFIX = 8


def exchanged(x: Column) -> Column:
    """The texts with two neighbouring characters exchanged."""
    n = F.length(x)
    return F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.concat(F.substring(x, F.lit(1), i - 1), F.substring(x, i + 1, F.lit(1)), F.substring(x, i, F.lit(1)), F.substring(x, i + 2, n)))


def thinned(x: Column, most: Column) -> Column:
    """The first PREFIX characters, and what is left of them without one of them, and without two, as far as `most` (0 to 2) allows."""
    p = F.left(x, F.lit(PREFIX))
    n = F.length(p)
    places = F.sequence(F.lit(1), F.greatest(n, F.lit(1)))
    without = lambda t, i: F.concat(F.substring(t, F.lit(1), i - 1), F.substring(t, i + 1, n))
    one = F.transform(places, lambda i: without(p, i))
    two = F.flatten(F.transform(one, lambda t, k: F.transform(F.sequence(k + 1, F.greatest(k + 1, n - 1)), lambda i: without(t, i))))
    return F.array_distinct(F.concat(F.array(p), F.when(most > 0, one).otherwise(F.array().cast("array<string>")), F.when(most > 1, two).otherwise(F.array().cast("array<string>"))))


def edit_distance(a: Column, b: Column, most: Column) -> Column:
    """Edits from a to b if there are at most `most` (0 to 2), else null. An edit puts in, takes out or replaces a character or exchanges two neighbours, between which others may then stand.

    An exchange is two edits where there are none, at the most, so only pairs with one or two too many are tried with exchanges: with one alone, with one beside another edit, with two.
    """
    plain = F.levenshtein(a, b, 4)  # -1 beyond
    same = F.length(a) == F.length(b)
    alone = same & F.array_contains(exchanged(a), b)
    beside = F.exists(exchanged(a), lambda x: F.levenshtein(x, b, 1) >= 0) | F.exists(exchanged(b), lambda y: F.levenshtein(a, y, 1) >= 0)
    return (
        F.when(plain.isin(0, 1) & (plain <= most), plain).when((plain == 2) & (most > 0) & alone, 1).when((plain == 2) & (most > 1), 2)
        .when((plain == 3) & (most > 1) & beside, 2).when(plain.isin(3, 4) & (most > 1) & same & F.arrays_overlap(exchanged(a), exchanged(b)), 2)
    )


def thinned_vocabulary(vocabulary: DataFrame) -> DataFrame:
    """match, key: each term of the vocabulary (term) with all that is left of its beginning."""
    v = vocabulary.select(F.col("term").alias("match")).distinct()
    # the longest term that can be near to one of n characters has n + 2, so terms of up to 3 have one edit at most, of 2 to them
    return v.select("match", F.explode(thinned(F.col("match"), F.when(F.length("match") <= 3, 1).otherwise(2))).alias("key"))


def fuzzy_terms(vocabulary: DataFrame | None, query_terms: DataFrame, keyed: DataFrame | None = None) -> DataFrame:
    """query_id, term, match, distance: vocabulary terms within the edits of each query term (see edit_distance). keyed: what thinned_vocabulary() makes of the vocabulary, if that is stored.

    Two terms that are so near have the same first PREFIX characters but for as many that are taken out of either. So query terms and vocabulary, read once, are joined by what is left when up to so many are taken out:
    37 keys a term at most, however long it is, and the distance is computed only of those that meet.
    """
    asked = query_terms.select("query_id", "term").distinct()
    q = asked.select("term").distinct().withColumn("edits", fuzziness(F.col("term")))  # each term once, whoever asks
    keys = stored(q.select("term", "edits", F.explode(thinned(F.col("term"), F.col("edits"))).alias("key")), "thinned")
    rows = thinned_vocabulary(vocabulary) if keyed is None else keyed
    near = F.abs(F.length("match") - F.length("term")) <= F.col("edits")
    met = rows.join(broadcast_if_small(keys, 500_000), "key").where(near).select("term", "match", "edits").distinct()
    found = stored(met.withColumn("distance", edit_distance(F.col("term"), F.col("match"), F.col("edits"))).where("distance IS NOT NULL").select("term", "match", "distance"), "near")
    return asked.join(found, "term").select("query_id", "term", "match", "distance")


def fuzzy_weights(matches: DataFrame) -> DataFrame:
    """query_id, term, weight for bm25(), of what fuzzy_terms() gives: a match counts 1 - distance / the shorter length, for each term of the query that it is near to."""
    part = 1 - F.col("distance") / F.least(F.length("term"), F.length("match"))
    return matches.groupBy("query_id", F.col("match").alias("term")).agg(F.sum(part).alias("weight"))


def phrase_matches(rows: DataFrame, queries: DataFrame, posting: DataFrame, key: str, text: str, slop: int = 2) -> DataFrame:
    """query_id, key, n, freq: where all terms of a query stand as in the query, each at most `slop` places farther on than the first of them. rows: key, text; queries: query_id, query.

    A term's place less its place in the query is where the phrase would begin. An occurrence is such a place that a term begins at, from which on all others begin within the slop, no two at one place of the row; it
    counts 1 / (1 + its slop) in freq. Only places of a query's rarest term with its second rarest near by are looked at; from there all places that a term may be at are known, so all joins are by place.
    """
    asked = stored(queries.select("query_id", F.posexplode(terms("query")).alias("i", "term")), "phrases")
    frequencies = document_frequencies(posting, asked)
    least = Window.partitionBy("query_id").orderBy("df", "term", "i")
    known = asked.join(frequencies, "term", "left").withColumn("df", F.coalesce("df", F.lit(0))).withColumn("k", F.row_number().over(least))
    two = known.where("k <= 2").groupBy("query_id").agg(
        F.min("df").alias("df"), F.max(F.when(F.col("k") == 1, F.col("term"))).alias("term"), F.max(F.when(F.col("k") == 1, F.col("i"))).alias("i"),
        F.max(F.when(F.col("k") == 2, F.col("term"))).alias("term2"), F.max(F.when(F.col("k") == 2, F.col("i"))).alias("i2"),
    )
    two = stored(two.where("df > 0").drop("df"), "rarest")
    words = broadcast_if_small(asked.select("term").distinct())
    places = stored(rows.select(key, F.posexplode(terms(text)).alias("pos", "term")).join(words, "term", "left_semi"), "places")  # of the queries' terms only
    rare = places.join(broadcast_if_small(two), "term").select("query_id", key, "pos", "i", "term2", "i2")
    by = F.explode(F.sequence(F.lit(-slop), F.lit(slop)))
    other = places.select(key, F.col("pos").alias("pos2"), F.col("term").alias("term2"))
    pair = rare.where("term2 IS NOT NULL").select("*", by.alias("by")).withColumn("pos2", F.col("pos") + F.col("i2") - F.col("i") + F.col("by"))
    near = pair.join(other, [key, "term2", "pos2"], "left_semi").select("query_id", key, "pos", "i")
    hit = near.unionByName(rare.where("term2 IS NULL").select("query_id", key, "pos", "i"))
    starts = hit.select("query_id", key, "pos", "i", F.explode(F.sequence(F.lit(0), F.lit(slop))).alias("late")).select("query_id", key, (F.col("pos") - F.col("i") - F.col("late")).alias("start")).distinct()
    due = starts.join(broadcast_if_small(asked), "query_id").select("query_id", key, "start", "i", "term", F.explode(F.sequence(F.lit(0), F.lit(slop))).alias("late"))
    met = due.withColumn("pos", F.col("start") + F.col("i") + F.col("late")).join(places, [key, "term", "pos"])
    each = met.groupBy("query_id", key, "start", "i").agg(F.min("late").alias("late"))
    own = each.groupBy("query_id", key, "start").agg(
        F.count("*").alias("met"), F.count_if(F.col("late") == 0).alias("exact"), F.max("late").alias("late"), F.size(F.collect_set(F.col("start") + F.col("i") + F.col("late"))).alias("distinct_places")
    )
    sizes = asked.groupBy("query_id").agg(F.count("*").alias("n_terms"))
    whole = own.join(broadcast_if_small(sizes), "query_id").where("met = n_terms AND exact > 0 AND distinct_places = n_terms")
    return whole.groupBy("query_id", key).agg(F.count("*").alias("n"), F.sum(1 / (1 + F.col("late"))).alias("freq"))


def phrase_scores(rows: DataFrame, queries: DataFrame, posting: DataFrame, key: str, text: str, slop: int = 2, total: Totals | None = None) -> DataFrame:
    """query_id, key, bm25 of the phrase as one term: its idf is the sum of its terms', its tf the freq of phrase_matches()."""
    total = total or totals(posting)
    asked = queries.select("query_id", F.explode(terms("query")).alias("term"))
    idf = asked.join(document_frequencies(posting, asked), "term").groupBy("query_id").agg(F.sum(_idf(total.n_docs)).alias("idf"))
    found = phrase_matches(rows, queries, posting, key, text, slop)
    lengths = posting.join(found.select(key).distinct(), key, "left_semi").groupBy(key).agg(F.first("dl").alias("dl"))
    return found.join(lengths, key).join(idf, "query_id").select("query_id", key, (F.col("idf") * _tf_part(F.col("freq"), total.avgdl)).alias("bm25"))


#: How much each clause counts, by what a query's weight is multiplied with: words, words with typing errors, the phrase; words of the file's name, those with typing errors.
CLAUSES = {"match": 1.0, "fuzzy": 0.5, "phrase": 1.5, "name": 2.0, "name_fuzzy": 1.0}


def lexical(rows: DataFrame, queries: DataFrame, key: str, text: str = "text", name: str = "file_name", weight: float = 1.0, slop: int = 2) -> DataFrame:
    """query_id, key, value: the weighted sum of CLAUSES. rows: key, text, name; queries: query_id, query. Postings of texts and names are made and stored once."""
    asked = stored(queries.select("query_id", F.explode(terms("query")).alias("term")).distinct(), "query-terms")
    out: list[DataFrame] = []

    def add(scores: DataFrame, clause: str) -> None:
        out.append(scores.select("query_id", key, (F.col("bm25") * F.lit(weight * CLAUSES[clause])).alias("value")))

    for column, exact, fuzzy in ((text, "match", "fuzzy"), (name, "name", "name_fuzzy")):
        posting = stored(postings(rows, key, column), "postings")
        total = totals(posting)
        add(bm25(posting, asked, key, total=total), exact)
        add(bm25(posting, fuzzy_weights(fuzzy_terms(posting.select("term"), asked)), key, total=total), fuzzy)
        if column == text:
            add(phrase_scores(rows, queries, posting, key, text, slop, total), "phrase")
    return reduce(DataFrame.unionByName, out).groupBy("query_id", key).agg(F.sum("value").alias("value"))


def time_decay(date: Column, as_of: Column, weight: Column | float = 1.0) -> Column:
    """weight * DECAY ^ ((days / DECAY_DAYS)^2); a row without a date counts in full."""
    days = F.abs(F.unix_timestamp(date) - F.unix_timestamp(as_of)) / 86400.0
    w = F.lit(float(weight)) if isinstance(weight, int | float) else weight
    return w * F.coalesce(F.pow(F.lit(DECAY), F.pow(days / F.lit(DECAY_DAYS), 2)), F.lit(1.0))


def decay_weight(query: Column) -> Column:
    """2 if the query asks for what is new, else 1."""
    low = F.lower(query)
    asks = F.lit(False)
    for w in RECENCY_WORDS:
        asks = asks | low.contains(w)
    return F.when(asks, 2.0).otherwise(1.0)


#: Similarities are to so many places, so that those equal but for the order of sums are ties, which the key decides.
PLACES = 9


def knn_native(queries: DataFrame, vectors: DataFrame, key: str, k: int, allowed: DataFrame | None = None) -> DataFrame:
    """query_id, key, similarity, rank of the k nearest by cosine, exactly, with built-in functions only. queries: query_id, qvec; vectors: key, vec. allowed: (query_id, key) pairs that may be returned, applied before the top-k.

    Null vectors and those of another length than the query's, or with parts that are no numbers, are near to nothing. All pairs are made, task by task, each keeps its k best: for few queries, and to check knn().
    """
    if allowed is None and not small(queries, 10_000):
        raise ValueError("too many queries for all pairs; knn() takes them in blocks")
    order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), key)
    rounded = F.round("similarity", PLACES).alias("similarity")
    ranked = lambda pairs: pairs.where("NOT isnan(similarity)").select("query_id", key, rounded).withColumn("rank", F.row_number().over(order))
    if allowed is not None:
        pairs = queries.join(allowed, "query_id").join(vectors, key).where(F.size("qvec") == F.size("vec"))
        return ranked(pairs.select("query_id", key, cosine(F.col("qvec"), F.col("vec")).alias("similarity"))).where(F.col("rank") <= k)
    # the k-th best of one vector in SAMPLE is a bound that the k best of all don't fall below, so few pairs are sorted
    lengths = [r.n for r in queries.where("size(qvec) > 0").select(F.size("qvec").alias("n")).distinct().collect()]  # a row for each length
    cores = vectors.sparkSession.sparkContext.defaultParallelism
    out = None
    for n in lengths:
        q = stored(queries.where(F.size("qvec") == n).select("query_id", *_parts("qvec", n, "q")), "asked")
        v = vectors.where(F.size("vec") == n).select(key, *_parts("vec", n, "v"))
        dot = reduce(Column.__add__, [F.col(f"q{i}") * F.col(f"v{i}") for i in range(n)])
        value = F.when(F.col("q_norm") * F.col("v_norm") == 0, 0.0).otherwise(dot / F.when(F.col("q_norm") * F.col("v_norm") != 0, F.col("q_norm") * F.col("v_norm")))
        some = v.where(F.pmod(F.xxhash64(key), F.lit(SAMPLE)) == 0).repartition(cores)
        bounds = ranked(some.crossJoin(F.broadcast(q)).select("query_id", key, value.alias("similarity"))).where(F.col("rank") == k)
        bounds = stored(bounds.select("query_id", (F.col("similarity") - 2 * 10.0**-PLACES).alias("bound")), "bounds")
        asked = q.join(F.broadcast(bounds), "query_id", "left").withColumn("bound", F.coalesce("bound", F.lit(-2.0)))
        pairs = v.repartition(4 * cores).join(F.broadcast(asked), value >= F.col("bound"))  # a file's rows may be one piece
        got = ranked(pairs.select("query_id", key, value.alias("similarity")))
        out = got if out is None else out.unionByName(got)
    if out is None:
        out = ranked(vectors.crossJoin(queries).select("query_id", key, F.lit(float("nan")).alias("similarity")))
    return out.where(F.col("rank") <= k)


#: Of so many vectors, one counts for the bounds of knn_native().
SAMPLE = 64


def _parts(vec: str, n: int, p: str) -> list[Column]:
    """The n parts of a vector as columns of doubles, NaN for null, and its length: sums over them are compiled, those over arrays are not."""
    part = lambda i: F.coalesce(F.get(vec, F.lit(i)).cast("double"), F.lit(float("nan")))
    norm = F.sqrt(F.aggregate(F.col(vec), F.lit(0.0), lambda t, x: t + F.coalesce(x.cast("double"), F.lit(float("nan"))) * F.coalesce(x.cast("double"), F.lit(float("nan")))))
    return [*[part(i).alias(f"{p}{i}") for i in range(n)], norm.alias(f"{p}_norm")]


def knn(queries: DataFrame, vectors: DataFrame, key: str, k: int, most_queries: int = 10_000) -> DataFrame:
    """The same for many vectors: a matrix product in each task keeps its k nearest, then the k nearest of those are taken. Queries go in blocks of most_queries, so what is sent is bounded.

    If queries have the columns filters.OWN (and vectors acl_principals, document_type, seconds), the k nearest are of what each query may see and asks for: a task takes other rows out before it keeps any.
    """
    own = [c for c in filters.OWN if c in queries.columns]
    asked = queries.where("qvec IS NOT NULL").select("query_id", "qvec", *own)
    blocks = max(1, -(-asked.count() // most_queries))
    out = None
    for block in range(blocks):
        part = asked if blocks == 1 else asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block)
        got = _knn_block(part.collect(), vectors, key, k, queries)
        out = got if out is None else out.unionByName(got)
    order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), key)
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _units(rows: list) -> np.ndarray:
    """Rows of length 1, of zeros where a row is, of NaN where it has what is no number."""
    plain = all(isinstance(r, np.ndarray) and r.dtype.kind == "f" for r in rows)
    x = np.array(rows if plain else [[np.nan if c is None else c for c in r] for r in rows], np.float64)
    with np.errstate(invalid="ignore"):
        norm = np.linalg.norm(x, axis=1, keepdims=True)
        return np.where(norm > 0, x / np.maximum(norm, 1e-300), x * 0)


def _knn_block(rows: list, vectors: DataFrame, key: str, k: int, queries: DataFrame) -> DataFrame:
    by_length: dict[int, list] = {}
    for r in rows:
        by_length.setdefault(len(r.qvec), []).append(r)
    filtered = bool(rows) and filters.OWN[0] in rows[0]
    held = vectors.sparkSession.sparkContext.broadcast({n: ([r.query_id for r in own], _units([r.qvec for r in own]), filters.Masks(own) if filtered else None) for n, own in by_length.items() if n})
    kinds = queries.schema["query_id"].dataType.simpleString(), vectors.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best = {n: _Nearest(len(ids), k) for n, (ids, _, _) in held.value.items()}
        for b in batches:
            b = b[b["vec"].notna() & b[key].notna()]
            lengths = b["vec"].map(len).to_numpy(int)
            for n, (_, q, masks) in held.value.items():
                rows = b[lengths == n]
                step = max(1, CELLS // len(q))
                for at in range(0, len(rows), step):
                    own = rows.iloc[at : at + step]
                    s = np.round(_units(own["vec"].tolist()) @ q.T, PLACES)
                    if masks is not None:
                        s[~masks.bits(own)[masks.of].T] = np.nan
                    best[n].add(own[key].to_numpy(), s)
        for n, (ids, _, _) in held.value.items():
            of, keys, similarity = best[n].sorted()
            ids = np.array(ids, object)
            for at in range(0, len(of), 100_000):
                some = slice(at, at + 100_000)
                yield pd.DataFrame({"query_id": ids[of[some]], key: keys[some], "similarity": similarity[some]})

    spread = vectors.select(key, "vec", *["acl_principals", "document_type", "seconds"] * filtered).repartition(2 * vectors.sparkSession.sparkContext.defaultParallelism)  # a file's rows may be one piece
    return spread.mapInPandas(run, f"query_id {kinds[0]}, {key} {kinds[1]}, similarity double")


#: Similarities that a task of knn() holds at once, about.
CELLS = 1_000_000


class _Nearest:
    """The k nearest of each of n queries, as rows come in: those at least as near as the k-th so far are held and, when they are many, cut to k. Of equals, the smallest keys stay."""

    def __init__(self, n: int, k: int):
        self.k, self.held, self.many = k, [], 0
        self.least = np.full(n, -np.inf)

    def add(self, keys: np.ndarray, similarity: np.ndarray) -> None:
        """similarity: a row for each key, a column for each query; NaN is near to nothing."""
        row, of = np.nonzero(similarity >= self.least)
        self.held.append((of, keys[row], similarity[row, of]))
        self.many += len(of)
        if self.many > 2 * len(self.least) * self.k:
            self.sorted()

    def sorted(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query's place, key, similarity) of what is held, cut to k each."""
        if not self.held:
            return np.empty(0, np.int64), np.empty(0, object), np.empty(0)
        of, keys, similarity = (np.concatenate(x) for x in zip(*self.held, strict=True))
        order = np.lexsort((np.unique(keys, return_inverse=True)[1], -similarity, of))
        of, keys, similarity = of[order], keys[order], similarity[order]
        first = np.searchsorted(of, of)  # where each query's begin
        rank = np.arange(len(of)) - first
        self.least[of[rank == self.k - 1]] = similarity[rank == self.k - 1]
        stay = rank < self.k
        self.held, self.many = [(of[stay], keys[stay], similarity[stay])], int(stay.sum())
        return self.held[0]


def newest(rows: DataFrame, asked: DataFrame, key: str, k: int, most_sets: int = 10_000) -> DataFrame:
    """_set, key, score, rank: the k best of rows (key, score, acl_principals, document_type, seconds) by score, then key, for each different set in asked (_set, filters.OWN). Sets go in blocks; a task keeps the k best of each and looks at no row that can't be among them."""
    sets = asked.groupBy("_set").agg(*[F.first(c).alias(c) for c in filters.OWN])
    sets = stored(sets, "sets")
    blocks, out = max(1, -(-sets.count() // most_sets)), None
    kind = rows.schema[key].dataType.simpleString()
    for block in range(blocks):
        some = sets if blocks == 1 else sets.where(F.pmod(F.xxhash64("_set"), F.lit(blocks)) == block)
        own = some.collect()
        held = rows.sparkSession.sparkContext.broadcast(([r["_set"] for r in own], filters.Masks(own)))

        def run(batches: Iterator[pd.DataFrame], held=held) -> Iterator[pd.DataFrame]:  # noqa: ANN001
            ids, masks = held.value
            best: list = [None] * len(masks.numbers)
            least = np.full(len(best), -np.inf)
            for b in batches:
                b = b[b[key].notna()].sort_values(["score", key], ascending=[False, True])
                score = b["score"].to_numpy()
                for i, bits in enumerate(masks.bits(b)):
                    at = np.flatnonzero(bits & (score >= least[i]))[:k]
                    if len(at):
                        new = b.iloc[at][[key, "score"]]
                        best[i] = new if best[i] is None else pd.concat([best[i], new]).sort_values(["score", key], ascending=[False, True]).head(k)
                        if len(best[i]) == k:
                            least[i] = best[i]["score"].iloc[-1]
            for name, i in zip(ids, masks.of, strict=True):
                if best[i] is not None:
                    yield best[i].assign(_set=name)

        got = rows.select(key, "score", "acl_principals", "document_type", "seconds").mapInPandas(run, f"{key} {kind}, score double, _set long")
        out = got if out is None else out.unionByName(got)
    order = Window.partitionBy("_set").orderBy(F.desc("score"), key)
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("_set", key, "score", "rank")


def knn_score(similarity: Column, boost: float = 1.0) -> Column:
    return (1 + similarity) / 2 * boost


#: Which parts count in each mode.
MODES = {"hybrid": ("lexical", "vector", "decay"), "keyword_only": ("lexical", "decay"), "semantic_only": ("vector", "decay")}


def fused(parts: dict[str, DataFrame], key: str, mode: str = "hybrid") -> DataFrame:
    """query_id, key, score. parts: by name, DataFrames of query_id, key, value; those of the mode are summed. A part that is missing, as when no vector could be had, counts 0."""
    chosen = [parts[p].select("query_id", key, "value") for p in MODES[mode] if p in parts]
    if not chosen:
        raise ValueError(f"none of the parts of mode {mode!r} is given")
    out = chosen[0]
    for c in chosen[1:]:
        out = out.unionByName(c)
    return out.groupBy("query_id", key).agg(F.sum("value").alias("score"))


def top_k(scored: DataFrame, key: str, k: int) -> DataFrame:
    """Adds rank, 1 to k by falling score, then key. A task keeps its k best of each query before the shuffle."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), key)
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def normalised(scored: DataFrame) -> DataFrame:
    """Adds normalized_score: score by the query's highest, 6 places; where that isn't above 0, by 1."""
    most = F.max("score").over(Window.partitionBy("query_id"))
    return scored.withColumn("normalized_score", F.round(F.col("score") / F.when(most > 0, most).otherwise(1.0), 6))


def rerank(candidates: DataFrame, top_n: int, scorer: Column | None = None) -> DataFrame:
    """candidates: query_id, rank, query, snippet and more. Adds rerank_score, renumbers rank and keeps top_n. The default score is the share of the query's terms that the snippet has."""
    q = F.array_distinct(terms("query"))
    score = scorer if scorer is not None else F.when(F.size(q) > 0, F.size(F.array_intersect(q, terms("snippet"))) / F.size(q)).otherwise(0.0)
    order = Window.partitionBy("query_id").orderBy(F.desc("rerank_score"), "rank")
    return (
        candidates.withColumn("rerank_score", score).withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= top_n)
        .drop("rank").withColumnRenamed("_rank", "rank")
    )
