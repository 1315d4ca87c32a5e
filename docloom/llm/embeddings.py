"""Near-duplicates of embeddings by robust-pruned flat graphs over overlapping cluster shards.

1. Vectors are cleaned and normalised in double precision; equal vectors of one label are one node with a count.
2. Each label gets centres, fitted on a bounded sample. Each node goes to the shards of its OVERLAP nearest centres of its label. A shard of more than SPLIT nodes gets centres of its own, fitted on a bounded
   sample of it, and its nodes go to the shards of the nearest of those; so shards stay small up to some hundred million nodes. A shard with too many nodes for a task is cut into blocks.
3. Each block builds a graph: a node's nearest and some far nodes, robustly pruned, with the reverse edges. The lists that a node gets in its shards are united.
4. In each block, the nodes of its shard search the block's graph: greedily from the medoids, then on through all neighbours within the range as long as any are new.
5. What is within the range is verified by the cosine in double precision. A link found in several shards counts in the first that both ends share, so links are counted
   where they are found and never emitted as pairs; only a spanning forest of a block's links leaves it, for the components.
6. The recall is audited: of sampled nodes that have links, the share of each one's links that was found, against those to all nodes. While the mean is below LEAST_RECALL, all is done again with twice
   the overlap, up to all shards of the label, then with twice the beam, and at last without a graph, by all pairs of the blocks of each label.

A task holds two blocks of at most about BLOCK nodes, whatever the size of a shard, a label or a group of copies.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import groups_in, map_batches, small_batches, table, written
from .graph import components

THRESHOLD = 0.93
#: Rows to fit centres on, centres at most, and nodes wanted in a shard for each shard that a node is in.
SAMPLE, CENTRES, SHARD = 20_000, 1024, 512
OVERLAP, BLOCK = 3, 1024
#: Nodes beyond which a shard gets centres of its own; nodes of it for each of them to fit them on; nodes that a task gives to them at once.
SPLIT, FIT, CHUNK = 16_384, 16, 8192
NEAR, FAR, DEGREE, ALPHA = 32, 12, 24, 1.2
BEAM, ENTRIES = 48, 24
#: Audited nodes: a share of all, at least and at most; the recall wanted.
AUDIT, LEAST_RECALL = (0.002, 200, 2000), 0.98
EPS = 1e-12  # candidates are looked for so far below the threshold, as rounding depends on the order of sums; then the cosine of the pair itself counts


def clean(vectors: DataFrame) -> DataFrame:
    """vec_id, label, unit (float64, little-endian; null if the vector links with nothing), dims."""
    kind = vectors.schema["vec_id"].dataType.simpleString()
    label = vectors.schema["label"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            units = []
            for v in b["embedding"]:
                x = None if v is None else np.array([np.nan if c is None else c for c in v], np.float64)
                scale = 0.0 if x is None or not len(x) else np.abs(x).max()
                if not np.isfinite(scale) or scale == 0:
                    units.append(None)
                else:
                    x = x / scale  # components of any finite size
                    units.append((x / np.sqrt((x * x).sum())).tobytes())
            yield pd.DataFrame({"vec_id": b["vec_id"], "label": b["label"], "unit": units})

    usable = vectors.select("vec_id", "label", F.when(F.col("label").isNotNull(), F.col("embedding")).alias("embedding"))
    return map_batches(usable, run, f"vec_id {kind}, label {label}, unit binary", ("vec_id", "label"))


def units(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.float64).reshape(len(column), -1)


def lloyd(x: np.ndarray, k: int, rounds: int = 8, seed: int = 3) -> np.ndarray:
    """k unit centres of unit rows."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        own = np.concatenate([(x[i : i + 4096] @ c.T).argmax(1) for i in range(0, len(x), 4096)])
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        c = np.where(norm > 0, sums / np.maximum(norm, 1e-300), c)
    return c


def fit_centres(nodes: DataFrame) -> dict[tuple, np.ndarray]:
    """By (label, dims), centres fitted on a sample of at most SAMPLE nodes; a label without sampled nodes has none, its nodes are one shard."""
    sizes = {(r.label, r.dims): r["count"] for r in nodes.groupBy("label", "dims").count().orderBy(F.desc("count"), "label", "dims").limit(CENTRES).collect()}
    total = sum(sizes.values())
    rows = nodes.select("label", "dims", "unit").orderBy(F.xxhash64("node")).limit(SAMPLE).collect()
    out = {}
    for key, n in sizes.items():
        x = [np.frombuffer(r.unit, np.float64) for r in rows if (r.label, r.dims) == key]
        k = min(len(x), max(1, round(n * OVERLAP / SHARD)), max(1, CENTRES * n // max(total, 1)))
        if k > 1:
            out[key] = lloyd(np.array(x), k)
    return out


def assign(nodes: DataFrame, centres: dict[tuple, np.ndarray], overlap: int) -> DataFrame:
    """node, label, dims, count, unit and shards: its `overlap` nearest centres, ascending."""
    held = nodes.sparkSession.sparkContext.broadcast(centres)  # CENTRES rows at most
    columns = nodes.select("node", "label", "dims", "count", "unit")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in columns.schema)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            shards = pd.Series([[0]] * len(b), index=b.index, dtype=object)
            for key, part in b.groupby(["label", "dims"]):
                c = held.value.get(key)
                if c is not None:
                    k = min(overlap, len(c))
                    near = np.sort(np.argpartition(-(units(part["unit"]) @ c.T), k - 1, axis=1)[:, :k], axis=1)
                    shards.loc[part.index] = pd.Series(near.tolist(), index=part.index)
            yield b.assign(shards=shards)

    return columns.mapInPandas(run, f"{schema}, shards array<int>")


#: A shard's number is that of its centre times this, and its own centre's number from 1 within.
WITHIN = 1 << 20


def refined(assigned: DataFrame, overlap: int) -> DataFrame:
    """What assign() gives, with shards of more than SPLIT nodes split by centres of their own. Shards have other numbers then, ascending."""
    number = F.transform("shards", lambda s: s.cast("long") * WITHIN)
    rows = assigned.select("node", "label", "dims", "unit", F.explode("shards").alias("shard"))
    cell = ["label", "dims", "shard"]
    large = written(rows.groupBy(*cell).agg(F.count("*").alias("size")).where(F.col("size") > SPLIT), "large")
    if large.isEmpty():
        return assigned.withColumn("shards", number)
    inside = rows.join(large, cell).withColumn("k", F.least(F.lit(CENTRES), F.ceil(F.col("size") / F.lit(SHARD)).cast("int")))
    # of each shard, some FIT nodes for each centre
    sample = inside.where(F.pmod(F.xxhash64("node", "shard", F.lit(2)), F.greatest(F.lit(1), F.floor(F.col("size") / (F.col("k") * FIT)))) == 0)

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in groups_in(batches, "cell"):
            x, first = units(g["unit"]), g.iloc[0]
            c = lloyd(x, min(int(first["k"]), len(x)))
            yield pd.DataFrame({**{n: [first[n]] * len(c) for n in cell}, "size": int(first["size"]), "number": np.arange(1, len(c) + 1), "unit": [v.tobytes() for v in c]})

    def kinds(*names: str) -> str:
        return ", ".join(f"{n} {rows.schema[n].dataType.simpleString()}" for n in names)

    key = F.xxhash64(*cell)
    ordered = sample.select(key.alias("cell"), *cell, "size", "k", "unit").repartition("cell").sortWithinPartitions("cell")
    own = written(ordered.mapInPandas(fit, f"{kinds(*cell)}, size long, number int, unit binary"), "own-centres")
    # a shard's nodes go to its centres in chunks, so no shard is gathered as a whole
    chunks = F.ceil(F.col("size") / F.lit(CHUNK)).cast("int")
    some = inside.select(F.xxhash64(*cell, F.pmod(F.xxhash64("node", F.lit(3)), chunks).cast("int")).alias("group"), F.lit(1).alias("side"), "node", "shard", F.lit(0).alias("number"), "unit")
    each = own.withColumn("chunk", F.explode(F.sequence(F.lit(0), chunks - 1)))
    centres = each.select(F.xxhash64(*cell, "chunk").alias("group"), F.lit(0).alias("side"), F.lit(0).cast("long").alias("node"), "shard", "number", "unit")

    def give(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in groups_in(batches, "group"):
            c, x = g[g["side"] == 0], g[g["side"] == 1]
            if len(x):
                k = min(overlap, len(c))
                near = np.argpartition(-(units(x["unit"]) @ units(c["unit"]).T), k - 1, axis=1)[:, :k]
                yield pd.DataFrame({"node": np.repeat(x["node"].to_numpy(), k), "number": (np.repeat(x["shard"].to_numpy(np.int64), k) * WITHIN + c["number"].to_numpy()[near].ravel())})

    both = some.unionByName(centres).repartition("group").sortWithinPartitions("group", "side", "node", "number")
    numbers = both.mapInPandas(give, "node long, number long").groupBy("node").agg(F.collect_list("number").alias("numbers"))  # overlap * overlap at most
    split = F.coalesce(F.transform("numbers", lambda n: F.floor(n / WITHIN)), F.array().cast("array<bigint>"))
    rest = F.filter(number, lambda n: ~F.array_contains(split, F.floor(n / WITHIN)))
    joined = assigned.join(numbers, "node", "left")
    return joined.withColumn("shards", F.array_sort(F.concat(rest, F.coalesce("numbers", F.array().cast("array<bigint>"))))).drop("numbers")


def robust_prune(x: np.ndarray, sims: np.ndarray, order: np.ndarray, degree: int = DEGREE, alpha: float = ALPHA) -> np.ndarray:
    """For each row, up to `degree` of its candidates (ids by falling similarity, -1 for none): the nearest is kept and drops those to which it is alpha times nearer than the row is, and so on."""
    n, m = order.shape
    rows = np.arange(n)
    valid = order >= 0
    far = 2 - 2 * sims[rows[:, None], order]
    kept = np.full((n, degree), -1)
    for d in range(degree):
        has = valid.any(1)
        if not has.any():
            break
        first = order[rows, valid.argmax(1)]
        kept[has, d] = first[has]
        near = 2 - 2 * sims[first[:, None], order]
        valid &= (alpha * alpha * near > far) & (order != first[:, None]) & has[:, None]
    return kept


def build_graph(x: np.ndarray, seed: int = 5) -> np.ndarray:
    """Adjacency (n x 2 DEGREE, -1 for none) of the unit rows of a block."""
    n = len(x)
    if n == 1:
        return np.full((1, 1), -1)
    sims = x @ x.T
    ranked = sims.copy()
    np.fill_diagonal(ranked, -np.inf)
    k = min(NEAR, n - 1)
    near = np.argpartition(-ranked, k - 1, axis=1)[:, :k]
    far = np.random.default_rng(seed).integers(0, n, (n, FAR))
    far[far == np.arange(n)[:, None]] = -1
    def by_similarity(c: np.ndarray) -> np.ndarray:
        s = np.where(c >= 0, ranked[np.arange(n)[:, None], c], -np.inf)
        return np.take_along_axis(c, np.argsort(-s, axis=1, kind="stable"), 1)
    # the far nodes are pruned among themselves, so that the near ones don't take all places
    kept = np.concatenate([robust_prune(x, sims, by_similarity(near), DEGREE - FAR // 2), robust_prune(x, sims, by_similarity(far), FAR // 2)], axis=1)
    u, v = np.repeat(np.arange(n), kept.shape[1]), kept.ravel()
    u, v = u[v >= 0], v[v >= 0]
    order = np.lexsort((-ranked[v, u], v))  # reverse edges: the nearest first
    u, v = u[order], v[order]
    place = np.arange(len(v)) - np.searchsorted(v, v, side="left")
    back = np.full((n, DEGREE), -1)
    ok = place < DEGREE
    back[v[ok], place[ok]] = u[ok]
    return np.concatenate([kept, back], axis=1)


def medoids(x: np.ndarray, n: int = ENTRIES) -> np.ndarray:
    """The node nearest to the mean, then those farthest from all before."""
    first = int((x @ x.mean(0)).argmax())
    out, best = [first], x @ x[first]
    while len(out) < min(n, len(x)):
        out.append(int(best.argmin()))
        best = np.maximum(best, x @ x[out[-1]])
    return np.array(out)


def search(q: np.ndarray, x: np.ndarray, graph: np.ndarray, threshold: float, beam: int = BEAM) -> np.ndarray:
    """Which nodes of the graph (unit rows x) are within the range of the unit rows q: a boolean matrix."""
    m, n = len(q), len(x)
    start = medoids(x)
    seen, inside = np.zeros((m, n), bool), np.zeros((m, n), bool)
    seen[:, start] = True
    ids = np.tile(start, (m, 1))
    sims = q @ x[start].T
    inside[:, start] = sims >= threshold - EPS
    done = np.zeros(ids.shape, bool)
    live = np.arange(m)
    while len(live):  # greedy: expand each query's best open node, keep the best `beam`
        open_sims = np.where(done[live], -np.inf, sims[live])
        best = open_sims.argmax(1)
        ok = open_sims[np.arange(len(live)), best] > -np.inf
        live, best = live[ok], best[ok]
        if not len(live):
            break
        done[live, best] = True
        to = graph[ids[live, best]]
        new = (to >= 0) & ~seen[live[:, None], to]
        r, c = np.nonzero(new)
        rows, cols = live[r], to[r, c]
        seen[rows, cols] = True
        s = np.full(to.shape, -np.inf)
        s[r, c] = np.einsum("ij,ij->i", q[rows], x[cols])
        inside[rows, cols] |= s[r, c] >= threshold - EPS
        every = np.concatenate([sims, np.full((m, to.shape[1]), -np.inf)], axis=1)
        names = np.concatenate([ids, np.zeros((m, to.shape[1]), ids.dtype)], axis=1)
        marks = np.concatenate([done, np.ones((m, to.shape[1]), bool)], axis=1)
        w = ids.shape[1]
        every[live, w:], names[live, w:], marks[live, w:] = s, to, s == -np.inf
        top = np.argsort(-every, axis=1, kind="stable")[:, :beam]
        sims, ids, done = (np.take_along_axis(a, top, 1) for a in (every, names, marks))
    edge = inside.copy()
    while edge.any():  # range: all neighbours of what is inside, as long as some are new
        r, c = np.nonzero(edge)
        edge = np.zeros((m, n), bool)
        for p in range(0, len(r), 100_000):
            rows, to = r[p : p + 100_000], graph[c[p : p + 100_000]]
            ok = to >= 0
            rows, cols = np.repeat(rows, to.shape[1])[ok.ravel()], to[ok]
            fresh = ~seen[rows, cols]
            both = np.unique(rows[fresh] * n + cols[fresh])
            rows, cols = both // n, both % n
            seen[rows, cols] = True
            hit = np.einsum("ij,ij->i", q[rows], x[cols]) >= threshold - EPS
            edge[rows[hit], cols[hit]] = True
        inside |= edge
    return inside


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the edges (a, b), each node with the smallest that it reaches by them."""
    names, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(names))
    while True:
        new = label.copy()
        np.minimum.at(new, x, label[y])
        np.minimum.at(new, y, label[x])
        new = new[new]
        if (new == label).all():
            return names, names[label]
        label = new


def placed(assigned: DataFrame) -> DataFrame:
    """A row for each node and shard, with the shard's blocks and the node's block."""
    rows = assigned.withColumn("shard", F.explode("shards"))
    sizes = rows.groupBy("label", "dims", "shard").agg(F.ceil(F.count("*") / F.lit(BLOCK)).cast("int").alias("blocks"))
    return rows.join(sizes, ["label", "dims", "shard"]).withColumn("block", F.pmod(F.xxhash64("node", "shard"), "blocks").cast("int"))


def verified(q: np.ndarray, x: np.ndarray, inside: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (row of q, row of x) of those inside whose cosine, summed up by itself, is at least the threshold."""
    r, c = np.nonzero(inside)
    ok = [np.einsum("ij,ij->i", q[r[p : p + 50_000]], x[c[p : p + 50_000]]) >= threshold for p in range(0, len(r), 50_000)]
    ok = np.concatenate(ok) if ok else np.zeros(0, bool)
    return r[ok], c[ok]


def linked(rows: DataFrame, threshold: float, beam: int | None) -> tuple[DataFrame, DataFrame]:
    """rows: as placed() gives. Returns (node, n: links to vectors of other nodes, m: those nodes) and the edges (a, b) of forests of the links. Without a beam, blocks are compared as a whole, without a graph."""

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in groups_in(batches, "cell"):
            ids = g["node"].to_numpy()
            graph = build_graph(units(g["unit"]))
            yield pd.DataFrame({"node": ids, "near": [ids[r[r >= 0]].tolist() for r in graph]})

    none = F.array().cast("array<long>")
    if beam is None:
        both = rows.withColumn("near", none)
    else:
        own = F.xxhash64("label", "dims", "shard", "block")
        lists = rows.select(own.alias("cell"), "node", "unit").repartition("cell").sortWithinPartitions("cell").mapInPandas(build, "node long, near array<long>")
        united = lists.groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"))  # as many lists as shards that a node is in
        both = written(rows.join(united, "node"), "graph")
    # side 0: the block's graph; side 1: nodes of a block of the shard that search it
    pair = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    graphs = both.withColumn("other", pair).select(F.xxhash64("label", "dims", "shard", "other", "block").alias("cell"), F.lit(0).alias("side"), "shard", "node", "count", "unit", "shards", "near")
    queries = both.withColumn("other", pair).select(
        F.xxhash64("label", "dims", "shard", "block", "other").alias("cell"), F.lit(1).alias("side"), "shard", "node", "count", "unit", "shards", none.alias("near")
    )

    def neighbours(x: pd.DataFrame) -> np.ndarray:
        """Places in the block of the nodes that each is next to; those of other blocks don't count here."""
        ids = x["node"].to_numpy()
        order = np.argsort(ids)
        graph = np.full((len(x), max(1, max(map(len, x["near"])))), -1)
        for i, near in enumerate(x["near"]):
            at = np.minimum(np.searchsorted(ids, near, sorter=order), len(ids) - 1) if len(near) else np.zeros(0, int)
            at = order[at][ids[order[at]] == near]
            graph[i, : len(at)] = at
        return graph

    def first_shared(q: pd.DataFrame, x: pd.DataFrame, r: np.ndarray, c: np.ndarray) -> np.ndarray:
        """The first shard that both ends of each pair are in."""
        names = np.unique(np.concatenate([*q["shards"], *x["shards"]]))
        sets = [np.zeros((len(side), len(names)), bool) for side in (q, x)]
        for have, side in zip(sets, (q, x), strict=True):
            for i, s in enumerate(side["shards"]):
                have[i, np.searchsorted(names, s)] = True
        return names[np.concatenate([(sets[0][r[p : p + 50_000]] & sets[1][c[p : p + 50_000]]).argmax(1) for p in range(0, len(r), 50_000)])] if len(r) else np.zeros(0, int)

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in groups_in(batches, "cell"):
            x, q = g[g["side"] == 0], g[g["side"] == 1]
            if not len(x) or not len(q):
                continue
            a, b = units(q["unit"]), units(x["unit"])
            r, c = verified(a, b, a @ b.T >= threshold - EPS if beam is None else search(a, b, neighbours(x), threshold, beam), threshold)
            mine, ids = q["node"].to_numpy(), x["node"].to_numpy()
            r, c = r[mine[r] != ids[c]], c[mine[r] != ids[c]]
            here = first_shared(q, x, r, c) == int(g["shard"].iloc[0])
            r, c = r[here], c[here]
            n, m = np.bincount(r, x["count"].to_numpy()[c], len(q)).astype(np.int64), np.bincount(r, minlength=len(q))
            names, roots = forest(mine[r], ids[c])
            some = np.flatnonzero(m)
            links = pd.DataFrame({"node": mine[some], "n": pd.array(n[some], "Int64"), "m": pd.array(m[some], "Int64"), "root": pd.array([None] * len(some), "Int64")})
            trees = pd.DataFrame({"node": names, "n": pd.array([None] * len(names), "Int64"), "m": pd.array([None] * len(names), "Int64"), "root": pd.array(roots, "Int64")})
            yield pd.concat([links, trees])

    cells = graphs.unionByName(queries).repartition("cell").sortWithinPartitions("cell", "side", "node")
    found = written(cells.mapInPandas(find, "node long, n long, m long, root long"), "found")
    counts = found.where("n IS NOT NULL").groupBy("node").agg(F.sum("n").alias("n"), F.sum("m").alias("m"))
    return counts, found.where("root IS NOT NULL AND root <> node").select(F.col("node").alias("a"), F.col("root").alias("b"))


def recall(nodes: DataFrame, counts: DataFrame, threshold: float, audit: tuple[float, int, int] = AUDIT) -> float:
    """Of sampled nodes (by least hash) that have links, the mean share of their linked nodes that the counts have: each node counts alike, however many links or copies it has. The sample is broadcast, a number
    of rows that is bounded by audit, and held against all nodes of its labels."""
    spark, (share, least, most) = nodes.sparkSession, audit
    rows = max(least, min(most, round(share * nodes.count())))
    sample = nodes.select("node", "label", "dims", "unit").orderBy(F.xxhash64("node", F.lit(1))).limit(rows).collect()
    held = spark.sparkContext.broadcast([(r.node, (r.label, r.dims), np.frombuffer(r.unit, np.float64)) for r in sample])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for key, part in b.groupby(["label", "dims"]):
                mine = [(n, u) for n, k, u in held.value if k == key]
                if mine:
                    a, x = np.array([u for _, u in mine]), units(part["unit"])
                    r, c = verified(a, x, a @ x.T >= threshold - EPS, threshold)
                    other = np.array([n for n, _ in mine])[r] != part["node"].to_numpy()[c]
                    yield pd.DataFrame({"node": [n for n, _ in mine], "links": np.bincount(r[other], minlength=len(mine))})

    true = nodes.select("node", "label", "dims", "unit").mapInPandas(run, "node long, links long").groupBy("node").agg(F.sum("links").alias("links")).where("links > 0")
    got = true.join(counts, "node", "left").agg(F.avg(F.coalesce("m", F.lit(0)) / F.col("links"))).first()[0]
    return 1.0 if got is None else got


def shards_of(nodes: DataFrame, centres: dict[tuple, np.ndarray], overlap: int, beam: int | None) -> DataFrame:
    """Nodes with their shards; all of a label in one shard where no beam searches them."""
    assigned = written(assign(nodes, centres, overlap), "assigned")
    return assigned if beam is None else written(refined(assigned, overlap), "refined")


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, overlap: int = OVERLAP, least_recall: float = LEAST_RECALL, report: dict | None = None) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of vectors: vec_id, embedding, label (others ignored).

    Rows of equal, not null labels are linked when their cosine is at least the threshold. Null, empty and zero vectors, and those with null or non-finite components, link with
    nothing: 0 links, a component of their own. Vectors of any length are taken whole; those of different lengths don't link. Equal vectors are linked with each other. Rows with equal vec_ids are each linked by what they hold; a component's id is its
    smallest vec_id that isn't null. A null vec_id has the component_id of its links, null if alone, and is kept only then. No rows give no rows.
    report gets the audited recall and the overlap and beam that gave it (no beam: all pairs, which miss nothing).
    """
    spark = vectors.sparkSession
    small_batches(spark)
    rows = written(clean(vectors).withColumn("dims", F.octet_length("unit") / 8), "vectors")
    rows = rows.withColumn("dims", F.col("dims").cast("int"))
    for salt in range(8):  # two vectors with one hash are not to be expected below a billion of them, but would be one
        named = rows.withColumn("node", F.when(F.col("unit").isNotNull(), F.xxhash64("label", "unit", F.lit(salt))))
        check = F.xxhash64(F.lit("check"), "unit", "label")
        nodes = written(
            named.where("node IS NOT NULL").groupBy("node")
            .agg(F.first("label").alias("label"), F.first("dims").alias("dims"), F.min("vec_id").alias("first_id"), F.count("*").alias("count"), F.first("unit").alias("unit"), (F.min(check) != F.max(check)).alias("mixed")), "nodes"
        )
        if nodes.where("mixed").isEmpty():
            break
    else:
        raise RuntimeError("different vectors have the same hash by every salt")
    rows = named
    centres = fit_centres(nodes)
    most, beam = max([1, *map(len, centres.values())]), BEAM
    while True:
        counts, edges = linked(written(placed(shards_of(nodes, centres, overlap, beam)), "placed"), threshold, beam)
        counts = written(counts, "counts")
        measured = 1.0 if beam is None else recall(nodes, counts, threshold)
        if report is not None:
            report.update(recall=measured, overlap=overlap, beam=beam)
        if measured >= least_recall:
            break
        if overlap < most:
            overlap = min(2 * overlap, most)
        elif beam < 4 * BEAM:
            beam *= 2
        else:  # all pairs, which miss nothing
            centres, overlap, beam = {}, 1, None
    comp = components(edges).select(F.col("id").alias("node"), F.col("component").alias("c"))
    named = nodes.select("node", "first_id", "count").join(comp, "node", "left").withColumn("c", F.coalesce("c", "node"))
    smallest = named.groupBy("c").agg(F.min("first_id").alias("component_id"))
    done = named.join(smallest, "c").join(counts, "node", "left").select("node", "component_id", (F.coalesce("n", F.lit(0)) + F.col("count") - 1).alias("n_links"))
    done = written(done, "linked")
    some = rows.where("node IS NOT NULL").select("vec_id", "node").join(done, "node").select("vec_id", "n_links", "component_id")
    none = rows.where("node IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return some.unionByName(none).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op2_embedding_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))
