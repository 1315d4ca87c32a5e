"""Near-duplicates by MinHash, with sequential Bayesian verification of banded candidates.

1. One pass over the texts gives each document's set of shingles, its size, a fingerprint and a signature of HASHES minima.
2. Documents with equal sets are one node; its representative is its smallest doc_id.
3. Signatures are cut into bands; nodes with an equal band share a bucket. A link at the threshold is in no common bucket with the probability (1 - 0.85^4)^16, 7 in a million.
4. Candidates of a bucket are compared by larger sketches, a batch of hashes at a time. With m of n hashes equal and an even prior, the similarity is at least the threshold with the
   probability that a binomial of n + 1 draws at the threshold is at most m. A pair goes as soon as that is below MISS. Pairs whose sizes differ too much, or that are in one component already, are left out.
5. Survivors are verified exactly, on the full sets.
6. Verified links are contracted to components, and 4 to 6 are repeated. At first each node proposes only its few most similar partners in other components, within
   blocks of its bucket, which joins large groups at linear cost. The last round has no such limit and goes through all pairs of nodes of different components: a bucket's largest component is
   held against the rest of the bucket, and the rest against itself, so no link between components is left out, and a million copies with one outlier cost a million comparisons.

No group is gathered as a whole: buckets are cut into blocks of at most about BLOCK nodes, and a task sees one block or one pair of blocks. Joins by bucket, node or component have tables
on both sides, so adaptive execution can split a large key.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WordHash, grams, groups_in, map_batches, mixed, small_batches, table, words_of, written
from .graph import components
from .tokenfile import text_runs

WORDS = 5
#: Hashes of the bands; hashes of a sketch, 16 bits of each, by which candidates are compared; rows of a band; hashes of a batch.
HASHES, SKETCH, BAND_ROWS, BATCH = 64, 512, 4, 64
MISS = 1e-6
BLOCK = 256
#: Partners that a node may propose in each round but the last, which has no limit.
ROUNDS = (2, 4)


def _seeds(n: int) -> tuple[np.ndarray, np.ndarray]:
    s = mixed(np.arange(1, 2 * n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return s[:n] | np.uint64(1), s[n:]


_A, _B = _seeds(SKETCH)


def minima(shingles: np.ndarray, n: int) -> np.ndarray:
    """n minima, uint32, of a set of 64-bit values that isn't empty."""
    out = np.full(n, 0xFFFFFFFFFFFFFFFF, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(0, len(shingles), 256):  # pieces that stay in the cache
            part = shingles[k : k + 256]
            out = np.minimum(out, (part[None, :] * _A[:n, None] + _B[:n, None]).min(1))
    return (out >> np.uint64(32)).astype(np.uint32)


def sketch(shingles: np.ndarray) -> bytes:
    return (minima(shingles, SKETCH) & np.uint32(0xFFFF)).astype(np.uint16).tobytes()


def least_equal(threshold: float, miss: float = MISS) -> list[int]:
    """For 0, 1 .. SKETCH compared hashes, the fewest equal ones with which a pair is kept."""
    out = []
    for n in range(SKETCH + 1):
        tail, m = 0.0, -1
        while m < n:
            tail += math.comb(n + 1, m + 1) * threshold ** (m + 1) * (1 - threshold) ** (n - m)
            if tail >= miss:
                break
            m += 1
        out.append(m + 1)
    return out


def with_signatures(docs: DataFrame, words: int = WORDS, salt: int = 0, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_shingles, node (a fingerprint of the set; null without words), check (another one), sig (null without words), and the columns named in carry."""
    held = docs.select("doc_id", *carry)
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in held.schema)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = WordHash()
        for b in batches:
            sets = [np.unique(grams(known.of(words_of(t)), words)) for t in b["text"]]
            yield b.drop(columns="text").assign(
                n_shingles=[len(s) for s in sets], node=pd.array([fingerprint(s, salt) for s in sets], dtype="Int64"), check=pd.array([second_fingerprint(s) for s in sets], dtype="Int64"),
                sig=[minima(s, HASHES).tobytes() if len(s) else None for s in sets],
            )

    return map_batches(docs.select("doc_id", *carry, "text"), run, f"{kinds}, n_shingles long, node long, check long, sig binary")


def fingerprint(shingles: np.ndarray, salt: int = 0) -> int | None:
    """Of a set, 64 bits."""
    if not len(shingles):
        return None
    with np.errstate(over="ignore"):
        return int(mixed(np.array([shingles.sum() + np.uint64(len(shingles)) + np.uint64(salt) * shingles[0]], np.uint64)).view(np.int64)[0])


def second_fingerprint(shingles: np.ndarray) -> int | None:
    """64 more bits, by another function: sets with the same node and another one of these are different."""
    import xxhash

    return int(np.uint64(xxhash.xxh3_64_intdigest(shingles.tobytes())).view(np.int64)) if len(shingles) else None


def with_sets(docs: DataFrame, words: int = WORDS, salt: int = 0) -> DataFrame:
    """node, shingles (the sorted 64-bit values, little-endian), sketch; texts without words have no row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = WordHash()
        for b in batches:
            texts = b["text"].tolist()
            for s in text_runs(texts):
                sets = [np.unique(grams(known.of(words_of(t)), words)) for t in texts[s]]
                sets = [x for x in sets if len(x)]
                yield pd.DataFrame({"node": pd.array([fingerprint(x, salt) for x in sets], dtype="Int64"), "shingles": [x.tobytes() for x in sets], "sketch": [sketch(x) for x in sets]})

    return docs.select("text").mapInPandas(run, "node long, shingles binary, sketch binary")


def compare(group: pd.DataFrame, least: list[int], percent: int, limit: int | None) -> pd.DataFrame:
    """Pairs (a, b) of a block, or of both sides of a pair of blocks, that stand the sequential comparison."""
    n = len(group)
    node, comp, size, side = (group[c].to_numpy() for c in ("node", "comp", "n", "side"))
    sig = np.frombuffer(b"".join(group["sketch"]), np.uint16).reshape(n, SKETCH)
    if (side == 0).all():
        x, y = np.triu_indices(n, 1)
    else:
        x, y = (v.ravel() for v in np.meshgrid(np.flatnonzero(side == 1), np.flatnonzero(side == 2), indexing="ij"))
    small, large = np.minimum(size[x], size[y]), np.maximum(size[x], size[y])
    ok = (comp[x] != comp[y]) & (100 * small >= percent * large)
    x, y = x[ok], y[ok]
    equal = np.zeros(len(x), np.int64)
    for k in range(0, SKETCH, BATCH):
        parts = [(sig[x[p : p + 50_000], k : k + BATCH] == sig[y[p : p + 50_000], k : k + BATCH]).sum(1) for p in range(0, len(x), 50_000)]
        equal = equal + (np.concatenate(parts) if parts else 0)
        ok = equal >= least[k + BATCH]
        x, y, equal = x[ok], y[ok], equal[ok]
    if len(x):  # a pair counts in the first bucket that both nodes are in
        sets, here = [set(b) for b in group["buckets"]], group["bucket"].tolist()
        first = np.fromiter((min(sets[i] & sets[j]) == here[i] for i, j in zip(x.tolist(), y.tolist(), strict=True)), bool, len(x))
        x, y, equal = x[first], y[first], equal[first]
    if limit is not None and len(x):
        ends, others, which = np.concatenate([x, y]), np.concatenate([y, x]), np.tile(np.arange(len(x)), 2)
        order = np.lexsort((mixed(node[others].view(np.uint64)), -np.tile(equal, 2), ends))
        first = np.searchsorted(ends[order], ends[order], side="left")
        pick = np.unique(which[order[np.arange(len(order)) - first < limit]])
        x, y = x[pick], y[pick]
    return pd.DataFrame({"a": np.minimum(node[x], node[y]), "b": np.maximum(node[x], node[y])})


def open_buckets(members: DataFrame, state: DataFrame) -> DataFrame:
    """bucket, top (its largest component), n_top and n_rest (nodes of it and of others) of the buckets that still hold several components."""
    parts = members.select("bucket", "node").join(state.select("node", "comp"), "node").groupBy("bucket", "comp").agg(F.count("*").alias("n"))
    each = parts.groupBy("bucket").agg(F.count("*").alias("k"), F.sum("n").alias("all"), F.max(F.struct("n", "comp")).alias("largest")).where("k > 1")
    return written(each.select("bucket", F.col("largest.comp").alias("top"), F.col("largest.n").alias("n_top"), (F.col("all") - F.col("largest.n")).alias("n_rest")), "open")


def blocked(rows: DataFrame, turn: int) -> DataFrame:
    """Adds group and side: the block that a node is in, once."""
    block = F.pmod(F.xxhash64("node", "bucket", F.lit(turn)), F.ceil(F.col("size") / F.lit(BLOCK)).cast("int"))
    return rows.withColumn("group", F.xxhash64("bucket", block)).withColumn("side", F.lit(0))


def paired(rows: DataFrame, turn: int) -> DataFrame:
    """Adds group and side, a row for each pair of blocks that a node is in: those of the largest component with those of the rest (sides 1 and 2), and those of the rest with each other (side 0 within a block)."""
    blocks = lambda n: F.greatest(F.lit(1), F.ceil(F.col(n) / F.lit(BLOCK)).cast("int"))
    rows = rows.withColumn("tops", blocks("n_top")).withColumn("rests", blocks("n_rest")).withColumn("is_top", F.col("comp") == F.col("top"))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("node", "bucket", F.lit(turn)), F.when(F.col("is_top"), F.col("tops")).otherwise(F.col("rests"))).cast("int"))
    block, every = F.col("block"), lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    pair = lambda kind, a, b, side: F.struct(F.xxhash64("bucket", F.lit(kind), a, b).alias("group"), side.cast("int").alias("side"))
    one = F.transform(every("rests"), lambda k: pair("top", block, k, F.lit(1)))
    two = F.transform(every("tops"), lambda k: pair("top", k, block, F.lit(2)))
    own = F.transform(every("rests"), lambda k: pair("rest", F.least(block, k), F.greatest(block, k), F.when(block == k, 0).when(block < k, 1).otherwise(2)))
    return rows.withColumn("pair", F.explode(F.when(F.col("is_top"), one).otherwise(F.concat(two, own)))).withColumn("group", F.col("pair.group")).withColumn("side", F.col("pair.side"))


def candidates(members: DataFrame, state: DataFrame, least: list[int], percent: int, limit: int | None, turn: int) -> DataFrame:
    """Pairs of nodes in different components. members: bucket, size, node; state: node, n, sketch, buckets (all that the node is in), comp."""
    rows = members.join(state, "node")
    if turn or limit is None:
        rows = rows.join(open_buckets(members, state), "bucket")
    rows = paired(rows, turn) if limit is None else blocked(rows, turn)
    rows = rows.select("group", "bucket", "buckets", "node", "n", "sketch", "comp", "side")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0
        for g in groups_in(batches, "group"):
            if len(g) > 1:
                held.append(compare(g, least, percent, limit))
                size += len(held[-1])
            if size > 100_000:
                yield pd.concat(held)
                held, size = [], 0
        if held:
            yield pd.concat(held)

    return rows.repartition("group").sortWithinPartitions("group").mapInPandas(run, "a long, b long").distinct()


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those pairs whose full sets have 100 * intersection >= percent * union."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            keep = np.zeros(len(p), bool)
            for i, (s, t) in enumerate(zip(p["sa"], p["sb"], strict=True)):
                x, y = np.frombuffer(s, np.uint64), np.frombuffer(t, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep[i] = 100 * both >= percent * (len(x) + len(y) - both)
            yield p.loc[keep, ["a", "b"]]

    a = sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa"))
    b = sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))
    return pairs.join(a, "a").join(b, "b").select("a", "b", "sa", "sb").mapInPandas(run, "a long, b long")


def near_duplicates(docs: DataFrame, percent: int = 85, words: int = WORDS, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs: doc_id, text (others ignored).

    Documents are linked when 100 * intersection >= percent * union of their sets of distinct shingles of `words` words (fewer words: the whole sequence is the only one). A component
    has the smallest doc_id reachable by links. Null and empty texts, and those of white space only, have an empty set and no links. Rows with equal doc_ids are each what their own texts make them; if their
    components' smallest doc_id is their own, all of them are kept. A null doc_id is never anybody's component_id if another id is in the component; alone it has a null component_id; it is kept only then.
    No rows give no rows. With columns named in carry, rows have these too, and `component`: a number for each component, null for rows without words, which are components of their own.
    """
    spark = docs.sparkSession
    small_batches(spark)
    least = least_equal(percent / 100)
    for salt in range(8):  # two sets with one fingerprint are not to be expected below a billion of them, but would be one
        rows = written(with_signatures(docs, words, salt, carry), "signatures")
        nodes = written(
            rows.where("node IS NOT NULL").groupBy("node")
            .agg(F.min("doc_id").alias("first_id"), F.max("n_shingles").alias("n"), F.first("sig").alias("sig"), (F.min("check") != F.max("check")).alias("mixed")), "nodes"
        )
        if nodes.where("mixed").isEmpty():
            break
    else:
        raise RuntimeError("different sets have the same fingerprint by every salt")
    bands = F.transform(
        F.sequence(F.lit(0), F.lit(HASHES // BAND_ROWS - 1)), lambda k: F.xxhash64(k, F.substring("sig", k * (4 * BAND_ROWS) + 1, F.lit(4 * BAND_ROWS)))
    )
    member = nodes.select("node", F.explode(bands).alias("bucket"))
    shared = member.groupBy("bucket").agg(
        F.count("*").alias("size"), F.bit_xor(F.xxhash64("node")).alias("k"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("l")
    ).where("size > 1")
    shared = shared.groupBy("size", "k", "l").agg(F.min("bucket").alias("bucket")).drop("k", "l")  # of buckets with the same nodes, one
    members = written(member.join(shared, "bucket"), "members")
    state = written(nodes.join(members.select("node").distinct(), "node", "left_semi").select("node", "first_id", "n"), "state")
    # the ids grow with the corpus, so they are never broadcast, however few they are
    wanted = docs.select("doc_id", "text").join(state.select(F.col("first_id").alias("doc_id")).distinct().hint("merge"), "doc_id", "left_semi")
    sets = with_sets(wanted, words, salt).join(state.select("node"), "node", "left_semi").dropDuplicates(["node"])
    # null ids have no first_id to be found by; such nodes are looked for among the rows without id
    lost = state.where("first_id IS NULL").select("node")
    if not lost.isEmpty():
        sets = sets.unionByName(with_sets(docs.where("doc_id IS NULL"), words, salt).join(lost, "node", "left_semi").dropDuplicates(["node"]))
    sets = written(sets, "sets")
    own = members.groupBy("node").agg(F.collect_list("bucket").alias("buckets"))  # as many as bands at most
    state = written(state.join(sets.select("node", "sketch"), "node").join(own, "node"), "sketched")
    now, links = written(state.select("node", "n", "sketch", "buckets", F.col("node").alias("comp")), "comp"), None
    for turn, limit in enumerate((*ROUNDS, None)):
        pairs = written(candidates(members, now, least, percent, limit, turn), "pairs")
        if pairs.isEmpty():  # in a limited round, pairs of different blocks have not been looked at
            continue
        new = written(verified(pairs, sets, percent), "links")
        links = new if links is None else links.union(new)
        if new.isEmpty():
            continue
        comp = components(links)
        now = written(
            state.select("node", "n", "sketch", "buckets").join(comp.select(F.col("id").alias("node"), F.col("component")), "node", "left")
            .select("node", "n", "sketch", "buckets", F.coalesce("component", "node").alias("comp")),
            "comp",
        )
    ids = now.select("node", "comp").join(state.select("node", "first_id"), "node")
    smallest = written(ids.groupBy("comp").agg(F.min("first_id").alias("component")), "smallest")
    named = ids.join(smallest, "comp").select("node", "comp", "component")
    # nodes in no common bucket are their own component: their first_id
    of_node = written(
        nodes.select("node", "first_id").join(named, "node", "left").select("node", F.coalesce("comp", "node").alias("component"), F.coalesce("component", "first_id").alias("component_id")), "of-node"
    )
    linked = rows.where("node IS NOT NULL").join(of_node, "node")
    alone = rows.where("node IS NULL").withColumn("component", F.lit(None).cast("long")).withColumn("component_id", F.col("doc_id"))
    out = linked.select(*(names := ["doc_id", "n_shingles", "component_id", *carry, *["component"] * bool(carry)])).unionByName(alone.select(*names))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def audited(docs: DataFrame, found: DataFrame, rows: int = 200, percent: int = 85, words: int = WORDS) -> tuple[int, int]:
    """(links, those whose ends have one component in found) of `rows` documents, by least hash of doc_id, to all documents: what near_duplicates() may miss, measured. found: doc_id, component_id.

    Each document's full set is held against the sets of the sample, all at once; those are broadcast, so `rows` bounds what is sent. Ids have to be unique; null ones are left out.
    """
    small_batches(docs.sparkSession)
    sample = docs.where("doc_id IS NOT NULL").orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows).select("doc_id", "text").collect()
    known = WordHash()
    sets = [np.unique(grams(known.of(words_of(r.text)), words)) for r in sample]
    values, owner = np.concatenate([*sets, np.zeros(0, np.uint64)]), np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    order = np.argsort(values, kind="stable")
    ids = [str(r.doc_id) for r in sample]
    held = docs.sparkSession.sparkContext.broadcast((values[order], owner[order], np.array([len(x) for x in sets])))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        values, owner, sizes = held.value
        known, out = WordHash(), []
        for b in batches:
            for key, text in zip(b["doc_id"], b["text"], strict=True):
                own = np.unique(grams(known.of(words_of(text)), words))
                first, last = np.searchsorted(values, own, "left"), np.searchsorted(values, own, "right")
                n = last - first
                at = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
                both = np.bincount(owner[at], minlength=len(sizes))
                out += [(ids[i], key) for i in np.flatnonzero((both > 0) & (100 * both >= percent * (len(own) + sizes - both))).tolist() if ids[i] != key]
        yield pd.DataFrame(out, columns=["a", "b"])

    links = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text").where("doc_id IS NOT NULL").mapInPandas(run, "a string, b string")
    of = found.select(F.col("doc_id").cast("string").alias("id"), "component_id")
    ends = links.join(of.select(F.col("id").alias("a"), F.col("component_id").alias("ca")), "a").join(of.select(F.col("id").alias("b"), F.col("component_id").alias("cb")), "b")
    n, right = ends.agg(F.count("*"), F.count_if(F.col("ca") == F.col("cb"))).first()
    return n, right


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
