"""Each operator against a brute-force version, an exact round trip or held-out accuracy, on rows of every awkward kind."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docloom.llm import decontaminate, embeddings, graph, licenses, minhash, mixing, quality, sharding, tokencount, tokenfile, toxicity
from docloom.llm.common import table

from .conftest import words

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def roots(ids, links):
    up = {i: i for i in ids}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


# --- graph


@settings(max_examples=6, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 30)), max_size=40))
def test_components(spark, edges):
    got = {r.id: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = roots(range(31), edges)
    assert got == {i: want[i] for i in got} and set(got) == {x for a, b in edges if a != b for x in (a, b)}


def test_components_of_a_long_path(spark):
    rng = random.Random(1)
    names = list(range(300))
    rng.shuffle(names)
    got = graph.components(spark.createDataFrame(list(zip(names, names[1:], strict=False)), "a long, b long")).collect()
    assert len(got) == 300 and {r.component for r in got} == {0}


# --- 1 and 8: classifiers


def auc(pairs):
    pos, neg = [s for s, y in pairs if y], [s for s, y in pairs if not y]
    return sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))


@pytest.mark.parametrize("run, column, modulus, fold, least", [(quality.op8_quality, "quality", 3, 1, 0.98), (toxicity.op1_toxicity, "toxic", 5, 0, 0.8)])
def test_classifiers_on_held_out_rows(spark, run, column, modulus, fold, least):
    sf = "/root/testdata/sf0.01"
    out = run(spark, sf).join(table(spark, sf, "labels"), "doc_id", "left").collect()
    assert len(out) == table(spark, sf, "documents").count()
    for r in out:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % modulus == fold) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
    assert auc([(r.score, r[column]) for r in out if r.held_out and r[column] is not None]) >= least


@pytest.mark.parametrize("run", [quality.quality_scores, toxicity.toxicity_scores])
def test_classifiers_on_awkward_rows(run, docs, empty, labels, corpus):
    out = run(docs, labels).collect()
    assert Counter(r.doc_id for r in out) == Counter(i for i, *_ in corpus)
    by_text = defaultdict(set)
    texts = {i: t for i, t, *_ in corpus if i != 7}
    for r in out:
        assert 0 <= r.score <= 1 and r.held_out is not None
        if r.doc_id in texts and r.doc_id is not None:
            by_text[texts[r.doc_id] or ""].add(round(r.score, 12))
    assert all(len(v) == 1 for v in by_text.values())  # equal texts, null and empty ones, have equal scores
    assert run(empty, labels).count() == 0
    assert run(docs, labels.limit(0)).count() == len(corpus)


@pytest.mark.parametrize("run, column, modulus, fold", [(quality.quality_scores, "quality", 3, 1), (toxicity.toxicity_scores, "toxic", 5, 0)])
def test_labels_of_held_out_rows_teach_nothing(docs, labels, run, column, modulus, fold):
    flipped = labels.withColumn(column, F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus == fold, 1 - F.col(column)).otherwise(F.col(column)))
    a, b = (Counter((r.doc_id, round(r.score, 9)) for r in run(docs, x).collect()) for x in (labels, flipped))
    assert a == b


def test_machine_is_a_sum_over_pairs():
    rng = np.random.default_rng(2)
    inputs = np.arange(12) * 5
    m = toxicity.Machine(inputs, 0.3, rng.normal(size=12), rng.normal(size=(12, toxicity.FACTORS)))
    rows = [np.sort(rng.choice(60, rng.integers(0, 30), replace=False)) for _ in range(30)]  # some are no inputs
    own = [[x // 5 for x in r.tolist() if x % 5 == 0] for r in rows]
    want = [m.bias + sum(m.weights[i] for i in r) + sum(m.factors[i] @ m.factors[j] for i, j in itertools.combinations(r, 2)) for r in own]
    assert np.allclose(m.scores(rows), 1 / (1 + np.exp(-np.array(want))))


def plain_training(rows, labels):
    """toxicity.train() with dense rows and sums written out."""
    n, rng = toxicity.BUCKETS, np.random.default_rng(7)
    inputs = sorted({x for r in rows for x in r})
    has = {x: sum(x in r for r in rows) for x in inputs}
    pos = {x: sum(x in r and y for r, y in zip(rows, labels, strict=True)) for x in inputs}
    n, n_pos, value = len(rows), sum(labels), []
    for x in inputs:
        a, b, c, d = pos[x], has[x] - pos[x], n_pos - pos[x], n - n_pos - has[x] + pos[x]
        chi = max(0, abs(a * d - b * c) - n / 2) ** 2 * n / max(1, (a + b) * (c + d) * (a + c) * (b + d))
        value.append(max(chi / (chi + toxicity.BY_CHANCE), has[x] / (has[x] + toxicity.BY_SHARE * n), toxicity.LEAST))
    x = np.array([[value[i] if b in r else 0.0 for i, b in enumerate(inputs)] for r in rows])
    bias, w, v = np.log((n_pos + 1) / (n + 2) / (1 - (n_pos + 1) / (n + 2))), np.zeros(len(inputs)), rng.standard_normal((len(inputs), toxicity.FACTORS), np.float32).astype(float) * toxicity.START
    gb, gw, gv, order = 1e-8, np.full(len(inputs), toxicity.HELD), np.full(v.shape, 1e-8), []
    y = np.array(labels, float)
    for step in range(sum(toxicity.STEPS)):
        while len(order) < toxicity.ROWS:
            order += rng.permutation(n).tolist()
        pick, order = order[: toxicity.ROWS], order[toxicity.ROWS :]
        b = x[pick]
        raw, sums = bias + b @ w, b @ v
        if step >= toxicity.STEPS[0]:
            raw = raw + 0.5 * (sums**2 - b**2 @ v**2).sum(1)
        g = (1 / (1 + np.exp(-raw)) - y[pick]) * np.where(y[pick] == 1, toxicity.RARE, 1) / toxicity.ROWS
        there = (b > 0).any(0)
        dw = (b.T @ g + 2e-5 * w) * there
        if step >= toxicity.STEPS[0]:
            dv = (b.T @ (g[:, None] * sums) - v * (b**2).T.dot(g)[:, None] + toxicity.FACTOR_RIDGE * v) * there[:, None]
            gv += dv**2
            v = v - 0.3 * toxicity.FACTOR_RATE * dv / np.sqrt(gv)
        gb, gw = gb + g.sum() ** 2, gw + dw**2
        bias, w = bias - 0.3 * g.sum() / np.sqrt(gb), w - 0.3 * dw / np.sqrt(gw)
    return bias, {b: w[i] * value[i] for i, b in enumerate(inputs)}, {b: v[i] * value[i] for i, b in enumerate(inputs)}


def test_toxicity_against_a_plain_version(spark):
    """All of it: which rows teach, their terms, training, scores of every row."""
    import xxhash

    rng = random.Random(8)
    vocabulary = words(rng, 40)
    texts = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 9)))) for i in range(60)]
    labels = [(i, int("vit" in t or rng.random() < 0.1)) for i, t in texts if i % 7]

    def terms(text):
        out = set()
        for w in re.findall(r"[^\W\d_]+", text.lower()):
            out |= {xxhash.xxh3_64_intdigest(f"w{w}") % toxicity.BUCKETS} | {xxhash.xxh3_64_intdigest(f"{k}{w[:k]}") % toxicity.BUCKETS for k in toxicity.PREFIXES if len(w) > k}
        return out

    by = dict(texts)
    learn = [(toxicity.packed(np.array(sorted(terms(by[i])))), y, terms(by[i])) for i, y in labels if zlib.crc32(str(i).encode()) % 5]
    learn.sort(key=lambda r: r[:2])
    bias, w, v = plain_training([r[2] for r in learn], [r[1] for r in learn])
    got = {r.doc_id: r.score for r in toxicity.toxicity_scores(spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()}
    for i, t in texts:
        own = [x for x in terms(t) if x in w]
        raw = bias + sum(w[x] for x in own) + sum(v[a] @ v[b] for a, b in itertools.combinations(own, 2))
        assert abs(got[i] - 1 / (1 + np.exp(-raw))) < 1e-3, i


@given(st.sets(st.integers(0, toxicity.BUCKETS - 1), max_size=50))
def test_packed_terms(buckets):
    assert toxicity.unpacked(toxicity.packed(np.array(sorted(buckets), np.int64))).tolist() == sorted(buckets)


@pytest.mark.parametrize("kind", ["one of the two", "insult with group"])
def test_fit_learns_pairs(spark, kind):
    """Through all of fit, in the midst of other words: `one of the two` has terms that alone tell nothing, which no weights can learn."""
    rng = random.Random(3)
    vocabulary = [w for w in words(rng, 60) if w not in ("zork", "quux")]

    def text(a, b):
        w = [rng.choice(vocabulary) for _ in range(12)] + ["zork"] * a + ["quux"] * b
        rng.shuffle(w)
        return " ".join(w)

    label = (lambda a, b: a ^ b) if kind == "one of the two" else (lambda a, b: a & b)
    rows = [(i, text(i & 1, i >> 1 & 1), label(i & 1, i >> 1 & 1)) for i in range(3000)]
    m = toxicity.fit(spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, label int"))
    terms = toxicity.Terms()
    for a, b in itertools.product((0, 1), (0, 1)):
        right = (m.scores([terms.of(text(a, b)) for _ in range(100)]) >= 0.5) == label(a, b)
        assert right.mean() >= 0.95, (a, b, right.mean())


def test_training_rows_are_bounded(spark):
    """One row for each id, however often it is there, and at most train_rows."""
    df = spark.createDataFrame([(1, f"text number {k % 7}") for k in range(3000)] + [(i, "another text") for i in range(2, 50)], "doc_id long, text string")
    own = spark.createDataFrame([(i, i % 2) for i in range(1, 50)], "doc_id long, label int")
    ids = [r.doc_id for r in toxicity.training_terms(df, own, 20).collect()]
    assert len(ids) == len(set(ids)) == 20
    got = toxicity.training_terms(df, own, 49).where("doc_id = 1").collect()
    assert len(got) == 1 and got == toxicity.training_terms(df.repartition(7), own, 49).where("doc_id = 1").collect()


@pytest.mark.parametrize("text", ["Some words, some WORDS.\n\nmore words 123!\nmore words 123!", "", None, " \n\t ", "one", "a a a a b | c", "é漢字 naïve É\n#### $$$ <p>", "x " * 500])
def test_statistics_by_definition(text):
    """Counted over bytes and words with plain loops."""
    raw = (text or "").encode()
    words = [w for w in re.split(rb"[\x09-\x0d\x20]+", raw) if w]
    lines = [x for x in raw.split(b"\n") if x.strip()]
    n, log = len(words), np.log
    share = lambda keep: log(0.002 + sum(chr(b) in keep for b in raw) / (len(raw) + 1))
    part = lambda count: log(0.01 + count / n) if n else log(1.01)
    pairs = list(zip(words, words[1:], strict=False))
    want = {
        "words": log(n + 1), "word_length": log(1 + len(raw) / (n + 1)), "symbols": share("#$%&*<=>@[\\]^_`{}~+/"), "bars": share("|"), "marks": share("!"), "capitals": share("ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
        "digits": share("0123456789"), "stops": part(raw.count(b".")), "commas": part(raw.count(b",")), "top_word": part(max(map(words.count, words), default=0)), "variety": log(len(set(words)) + 1) - 0.75 * log(n + 1),
        "stutter": part(sum(a == b for a, b in pairs)), "pairs": log(1.01 - len(set(pairs)) / len(pairs)) if pairs else log(0.01), "lines": log(1.01 - len(set(lines)) / len(lines)) if lines else log(0.01),
        "line_words": log(1 + n / max(1, len(lines))),
    }
    assert list(want) == list(quality.STATISTICS) and np.allclose(quality.statistics(text), list(want.values()))


def test_discriminant_is_gaussian():
    rng = np.random.default_rng(0)
    p = len(quality.STATISTICS)
    x = [rng.normal(0, 1, (400, p)), rng.normal(0.4, 2, (500, p))]
    m = quality.fit({k: (float(len(v)), v.sum(0), v.T @ v) for k, v in enumerate(x)}, 0.0, 0.0)
    z = x[0][:20]

    def log_density(v):
        c, d = np.cov(v.T, bias=True), z - v.mean(0)
        return -0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(c), d) - 0.5 * np.linalg.slogdet(c)[1]

    want = 1 / (1 + np.exp(-(log_density(x[1]) - log_density(x[0]) + np.log(501 / 401))))
    assert np.allclose(m.scores(z), want, atol=1e-6)


# --- 2: embeddings


def vectors_fixture():
    rng = np.random.default_rng(3)
    rows = []
    for label in (0, 1, None):
        centre = rng.normal(size=16)
        for _ in range(60):
            rows.append((rng.normal(size=16).tolist(), label))
        for _ in range(80):
            rows.append(((centre + rng.normal(size=16) * 0.25).tolist(), label))
    rows += [rows[0]] * 40 + [([2 * x for x in rows[1][0]], 0), (rows[2][0], 1)]
    rows += [(None, 0), ([], 0), ([0.0] * 16, 0), ([float("nan")] * 16, 0), ([1.0] * 15 + [None], 0), ([float("inf")] + [1.0] * 15, 0), ([1.0, 2.0], 0), ([1.0, 2.0], 0)]
    return [(i, [None if x is None else float(np.float32(x)) for x in v] if v is not None else None, k) for i, (v, k) in enumerate(rows)]


def test_embeddings_brute_force(spark, monkeypatch):
    rows = vectors_fixture()
    monkeypatch.setattr(embeddings, "BLOCK", 64)  # so that shards have several blocks
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("node", F.lit("clash")).withColumn("unit", F.lit(1))
    unit = {}
    for i, v, k in rows:
        if k is not None and v and None not in v and np.isfinite(v).all() and any(v):
            x = np.array(v, np.float64)
            unit[i] = (k, x / np.linalg.norm(x))
    links = [(a, b) for a, b in itertools.combinations(unit, 2) if unit[a][0] == unit[b][0] and len(unit[a][1]) == len(unit[b][1]) and unit[a][1] @ unit[b][1] >= 0.93 - 1e-12]
    n = Counter(x for pair in links for x in pair)
    comp = roots([i for i, *_ in rows], links)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embeddings.near_duplicates(df).collect()}
    assert got == {i: (n[i], comp[i], comp[i] == i) for i, *_ in rows}
    assert embeddings.near_duplicates(df.limit(0)).count() == 0


def test_null_vec_ids_and_repeats(spark):
    v = [1.0, 2.0]
    df = spark.createDataFrame([(None, v, 1), (5, v, 1), (5, v, 1), (None, [3.0, -1.0], 1)], "vec_id long, embedding array<float>, label int")
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in embeddings.near_duplicates(df).collect()), key=str)
    assert got == sorted([(None, 2, 5, False), (5, 2, 5, True), (5, 2, 5, True), (None, 0, None, True)], key=str)


def test_shards_with_centres_of_their_own(spark, monkeypatch):
    """Large shards are split again; results are the same, and shards are smaller."""
    rows = vectors_fixture()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    want = sorted(map(tuple, embeddings.near_duplicates(df).collect()), key=str)
    for name, n in (("SPLIT", 30), ("SHARD", 15), ("CENTRES", 4), ("CHUNK", 20)):
        monkeypatch.setattr(embeddings, name, n)
    seen = []
    real = embeddings.refined
    monkeypatch.setattr(embeddings, "refined", lambda assigned, overlap: seen.append((assigned, real(assigned, overlap))) or seen[-1][1])
    assert sorted(map(tuple, embeddings.near_duplicates(df).collect()), key=str) == want
    sizes = [max(r["count"] for r in x.select(F.explode("shards").alias("s"), "label", "dims").groupBy("s", "label", "dims").count().collect()) for x in seen[0]]
    assert sizes[1] < sizes[0] and seen[0][1].where("size(shards) <> size(array_distinct(shards))").count() == 0


def test_all_pairs_where_the_graph_fails(spark, monkeypatch):
    """A search that finds too little is noticed, and all pairs are compared at last."""
    rows = vectors_fixture()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    want = sorted(map(tuple, embeddings.near_duplicates(df).collect()), key=str)
    beams = []
    real = embeddings.linked
    monkeypatch.setattr(embeddings, "linked", lambda rows, threshold, beam: beams.append(beam) or real(rows, threshold, beam))
    monkeypatch.setattr(embeddings, "search", lambda q, x, graph, threshold, beam: np.zeros((len(q), len(x)), bool))
    monkeypatch.setattr(embeddings, "BLOCK", 64)
    report = {}
    assert sorted(map(tuple, embeddings.near_duplicates(df, report=report).collect()), key=str) == want and beams[-1] is None and len(beams) > 2
    assert report == {"recall": 1.0, "overlap": 1, "beam": None}


def test_audit_counts_nodes_alike(spark):
    """A node that lost its one link weighs as much as one with many."""
    near = np.eye(8)[0] + np.eye(8) * 1e-3
    unit = lambda v: (v / np.linalg.norm(v)).tobytes()
    rows = [(i, 1, 8, 1, unit(near[i])) for i in range(6)] + [(10, 2, 8, 1000, unit(near[0])), (11, 2, 8, 1, unit(near[1]))]
    nodes = spark.createDataFrame(rows, "node long, label int, dims int, count long, unit binary")
    counts = spark.createDataFrame([(i, 5, 5) for i in range(6)], "node long, n long, m long")
    assert embeddings.recall(nodes, counts, 0.93) == pytest.approx(6 / 8)


def test_no_link_below_the_threshold():
    a = np.array([[1.0, 0.0]])
    angles = np.arccos(0.93) + np.linspace(-1e-13, 1e-13, 21)
    x = np.stack([np.cos(angles), np.sin(angles)], 1)
    r, c = embeddings.verified(a, x, a @ x.T >= 0.93 - embeddings.EPS, 0.93)
    assert (x[c, 0] >= 0.93).all() and len(c) == (x[:, 0] >= 0.93).sum() < 21


def test_graph_search_recall():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, 32))
    x[200:400] = x[0] + rng.normal(size=(200, 32)) * 0.15
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    inside = embeddings.search(x, x, embeddings.build_graph(x), 0.93)
    true = x @ x.T >= 0.93
    assert (inside & ~true).sum() == 0 and (inside & true).sum() >= 0.99 * true.sum()


# --- 3: licences


def dice(a, b):
    """Over bags: a repeated bigram counts as often as it is there."""
    x, y = (Counter(zip(v, v[1:], strict=False)) for v in (a, b))
    return 2 * (x & y).total() / (x.total() + y.total()) if x or y else 0.0


def brute_licences(doc, templates):
    """All passages of all templates, by definition: the best from each first word, then the most similar that don't overlap."""
    found = []
    for k, (name, text) in enumerate(templates):
        w = licenses.alnum_words(text)
        for i in range(len(doc) - 1):
            d, j = max((dice(doc[i:j], w), j) for j in range(i + 2, min(len(doc), i + 3 * len(w)) + 1))
            if d >= 0.8 - 1e-12:
                found.append((name in licenses.FAMILIES, -d, i, -j, k))
    out = []
    for _, d, i, j, k in sorted(found):
        if all(-j <= a or i >= b for _, _, a, b in out):
            out.append((-d, k, i, -j))
    return out


def test_licences_with_repeats():
    """Notices again and again, with words in between, of templates that repeat bigrams themselves."""
    templates = (("A", "released under the mit license"), ("B", "ka lo ka lo ka lo mi"), ("C", "ka lo mi ka lo tu"), ("BSD", "lo mi ka lo"), ("D", "the mit license released under"))
    known, rng = licenses.Templates(templates), random.Random(4)
    for n in range(60):
        doc = []
        for _ in range(rng.randint(1, 6)):
            w = licenses.alnum_words(rng.choice(templates)[1]) * rng.randint(1, 3)
            doc += [x if rng.random() > 0.08 else b"zz" for x in w] + [b"yy"] * rng.choice([0, 0, 1, 3])
        assert known.matches(doc) == brute_licences(doc, templates), (n, doc)


def test_licences_take_linear_time():
    import time

    known = licenses.Templates()
    bodies = sorted(licenses.TEMPLATES, key=lambda x: -len(x[1]))
    for text, n, seconds in (("Released under the MIT License. ", 10_000, 2), (bodies[0][1] + " ", 20, 6), ("of the license and the software or of the ", 3_000, 2)):
        words = licenses.alnum_words(text * n)
        begun = time.process_time()
        found = known.matches(words)
        assert time.process_time() - begun < seconds, (text[:40], n)
        assert len(found) == (0 if text.startswith("of") else n)


def test_licences_brute_force():
    known = licenses.Templates()
    rng = random.Random(2)
    words = lambda t: licenses.alnum_words(t)
    for name, text in licenses.TEMPLATES[3:12]:
        w = words(text)
        noise = [rng.choice(w) if rng.random() < 0.2 else b"zzz%d" % rng.randint(0, 9) for _ in range(12)]
        for drop in range(0, 3):
            own = [x for i, x in enumerate(w) if i not in rng.sample(range(len(w)), drop)]
            doc = noise + own + noise[::-1]
            best = max(dice(doc[i:j], words(t)) for _, t in licenses.TEMPLATES for i in range(len(doc)) for j in range(i + 2, len(doc) + 1) if j - i < 3 * len(words(t)) + 4) if len(w) < 30 else None
            found = known.matches(doc)
            if best is not None:
                assert (found[0][0] == pytest.approx(best)) if best >= 0.8 else not found
            if drop == 0:
                assert known.names[found[0][1]] == name and found[0][0] == 1.0 and (found[0][2], found[0][3]) == (12, 12 + len(w))


def test_licences_have_their_own_names():
    known = licenses.Templates()
    gnu = "This {} is free software{} you can redistribute it and/or modify it under the terms of the GNU {}General Public License as published by the Free Software Foundation{} either version {} or (at your option) any later version."
    cases = [(gnu.format("program", ";", "", ";", "1,"), "GPL-1.0"), (gnu.format("library", ";", "Library ", ";", "2 of the License,"), "LGPL-2.0")]
    for colon in (":", ";"):
        for v in ("{} of the License,", "{},"):
            cases += [(gnu.format("program", colon, "", ",", v.format(n)), f"GPL-{n}.0") for n in (2, 3)]
            cases += [(gnu.format("file", colon, "", ",", v.format(n)), f"GPL-{n}.0") for n in (2, 3)]
            cases += [(gnu.format("library", colon, "Lesser ", ",", v.format(n)), f"LGPL-{n}") for n in ("2.1", "3")]
            cases += [(gnu.format("program", colon, "Affero ", ",", v.format(3)), "AGPL-3.0")]
    texts = {n: t for n, t in licenses.TEMPLATES if len(t) > 600}
    bsd = {n: texts[n].replace("COPYRIGHT HOLDERS AND CONTRIBUTORS", "REGENTS AND CONTRIBUTORS").replace("list of conditions", "list of terms") for n in texts if n.startswith("BSD")}
    cases += [*((t, n) for n, t in bsd.items()), *((t, n) for n, t in texts.items())]
    assert len(bsd) == 3 and {"Apache-2.0", "Zlib", "MIT-0", "0BSD", "LGPL-3.0"} <= set(texts)
    for text, name in cases:
        found = known.matches(licenses.alnum_words(f"Copyright someone. {text} Then the code begins."))
        assert [known.names[m[1]].removesuffix(".0") for m in found] == [name.removesuffix(".0")], (text[:80], name)
    lead = next(t for n, t in licenses.TEMPLATES if n == "BSD")
    assert [known.names[m[1]] for m in known.matches(licenses.alnum_words(lead))] == ["BSD"]


def test_licences_on_awkward_rows(docs, empty, corpus):
    out = licenses.scan(docs.withColumn("text", F.concat(F.coalesce("text", F.lit("")), F.when(F.col("doc_id") == 3, "\nReleased under the MIT License. Licensed under CC BY-NC 4.0."))), licenses.TEMPLATES).collect()
    assert len(out) == len(corpus) and {m.license for r in out for m in r.matches} <= {"MIT", "CC-BY-NC-4.0"}
    assert [[m.license for m in r.matches] for r in licenses.scan(docs.where("doc_id = 3").withColumn("text", F.lit("x Released under the MIT licence. y\n\nLicensed under CC BY NC 4.0"))).collect()] == [["MIT", "CC-BY-NC-4.0"]]
    assert licenses.scan(docs).count() == len(corpus) and licenses.scan(empty).count() == 0


# --- 4: shards


def test_ring_brute_force(spark, docs, empty, corpus):
    shards, vnodes, cells = 7, 8, 256
    out = sharding.shard_documents(docs, shards, vnodes, cells).collect()
    assert len(out) == len(corpus)
    sizes = Counter(r.shard for r in out)
    assert set(sizes) == set(range(shards)) and max(sizes.values()) - min(sizes.values()) <= 1
    for s in range(shards):
        assert sorted(r.slot for r in out if r.shard == s) == list(range(sizes[s]))
    texts = Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t, *_ in corpus)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in out) == texts and {r.law for r in out} == {"rows"}
    # the walk, row by row
    hashed = docs.select("doc_id", F.xxhash64(F.lit("key"), "doc_id").alias("k")).distinct().collect()
    at = {r.doc_id: r.k for r in hashed}
    nodes = sharding.ring_nodes(spark, shards, vnodes, cells)
    room = [len(out) // shards + (s < len(out) % shards) for s in range(shards)]
    want = defaultdict(Counter)
    for r in sorted(out, key=lambda r: (at[r.doc_id] % cells, at[r.doc_id], r.doc_id is not None, r.doc_id or 0, r.text_crc32, r["size"])):
        cell = at[r.doc_id] % cells
        start = next((i for i, (c, _) in enumerate(nodes) if c >= cell), 0)
        shard = next(s for _, s in nodes[start:] + nodes[:start] if room[s])
        room[shard] -= 1
        want[r.doc_id][shard] += 1
    got = defaultdict(Counter)
    for r in out:
        got[r.doc_id][r.shard] += 1
    assert got == want
    assert sharding.shard_documents(empty).count() == 0


def test_one_more_shard_moves_little(spark):
    df = table(spark, "/root/testdata/sf0.01", "documents")
    a, b = ({r.doc_id: r.shard for r in sharding.shard_documents(df, n).collect()} for n in (40, 41))
    assert sum(a[i] != b[i] for i in a) < 0.1 * len(a)


# --- 5: decontamination


def brute_decontamination(docs, items):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    windows = defaultdict(set)
    for i, t in items:
        w = split(t)
        for k in range(max(1, len(w) - 9) if w else 0):
            windows[tuple(w[k : k + 10])].add(str(i) if i is not None else "null")
    out = []
    for d, t in docs:
        w, hit, found = split(t), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if own := windows.get(tuple(w[k : k + n])):
                    hit.update(range(k, k + n))
                    found |= own
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


@pytest.mark.parametrize("block_bytes", [1 << 20, 300])
def test_decontamination_brute_force(spark, docs, empty, corpus, block_bytes):
    texts = [t for _, t, *_ in corpus if t]
    piece = lambda t, a, b: " ".join(t.split()[a:b])
    items = [(1, piece(texts[0], 2, 18)), (2, piece(texts[5], 0, 12).upper()), (3, piece(texts[60], 0, 60)), (3, piece(texts[9], 3, 14)), (10, "one"), (11, ""), (12, None), (None, piece(texts[20], 0, 10)), (13, "ka lo ka lo ka lo ka lo ka lo ka lo"), (14, piece(texts[60], 20, 40))]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(1)).withColumn("item", F.lit("clash"))
    got = sorted(((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in decontaminate.decontaminate(docs, bench, block_bytes).collect()), key=str)
    assert got == brute_decontamination([(i, t) for i, t, *_ in corpus], items) and sum(r[5] for r in got) > 10
    assert decontaminate.decontaminate(empty, bench).count() == 0
    assert decontaminate.decontaminate(docs, bench.limit(0)).where("contaminated").count() == 0


def test_long_and_repeated_items(spark, monkeypatch):
    """A long item is cut into pieces and no window is lost; repeated rows of an item don't make a block larger."""
    monkeypatch.setattr(decontaminate, "PIECE_WORDS", 25)
    rng = random.Random(6)
    long = words(rng, 200)
    rows = [(k, " ".join(words(rng, 5) + long[a:b] + words(rng, 5))) for k, (a, b) in enumerate([(0, 10), (10, 21), (16, 40), (95, 130), (190, 200), (191, 200), (0, 200)])]
    items = [(1, " ".join(long))] * 50 + [(2, " ".join(long[20:29])), (3, " ".join(long[30:40]))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    blocks = list(decontaminate.item_blocks(bench.select(F.col("item_id").cast("string").alias("item"), "text"), 400))
    assert len(blocks) > 2 and sum(map(len, blocks)) == 2 + 12 and all(sum(len(t) for _, t in b) <= 600 for b in blocks)
    for size in (400, 1 << 20):
        got = sorted(((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in decontaminate.decontaminate(spark.createDataFrame(rows, "doc_id long, text string"), bench, size).collect()), key=str)
        assert got == brute_decontamination(rows, items)


def test_op5_on_table(spark):
    got = sorted((tuple(r) for r in decontaminate.op5_decontaminate(spark, SF).collect()), key=str)
    docs, bench = table(spark, SF, "documents").select("doc_id", "text").collect(), table(spark, SF, "benchmark").select("item_id", "text").collect()
    assert got == brute_decontamination(docs, bench) and any(r[5] for r in got)


# --- 6: token counts


_ODD = st.one_of(st.text(alphabet=" \t\n\xa0", max_size=60), st.text(alphabet="a \t\n\xa0'", max_size=60), st.text(alphabet="ab' \n.é漢1", max_size=400))


@settings(max_examples=1000, deadline=None)
@given(_ODD, st.lists(st.tuples(st.integers(0, 420), st.integers(0, 60), st.one_of(st.text(alphabet="a' \n.9", max_size=200), st.text(alphabet=" \t\n", max_size=4))), max_size=6))
def test_edits(text, edits):
    """After every edit the kept tree has the pre-tokens of the whole text split anew, and their tokens."""
    counter = _counter()
    tree = tokencount.Tree(*tokencount.count_pieces(text, counter))
    for start, n, new in edits:
        tree = tokencount.Tree.load(*tree.dump())
        text, _ = tree.edit(text, min(start, len(text)), start + n, new, counter)
        assert tree.pieces() == tokencount.count_pieces(text, counter)
        assert tree.total == len(counter.encoding.encode_ordinary(text)) and tree.chars[1] == len(text)
        assert tree.chars[0] == tree.leaves.count(tokencount.EMPTY) and _sums(tree) == _sums(tokencount.Tree.load(*tree.dump()))


def _sums(tree):
    """Of all nodes, as they are kept; each has to be what its two have together."""
    for a in (tree.chars, tree.tokens):
        assert all(a[i] == a[2 * i] + a[2 * i + 1] for i in range(1, tree.width))
    return tree.chars.tolist(), tree.tokens.tolist()


def test_white_space_run_before_an_edit():
    """A run's pieces are decided by what comes after all of it."""
    assert _after_edit("\t \n\n.", 4, 5, "") == len(_counter().encoding.encode_ordinary("\t \n\n"))


def test_edit_touches_few_leaves():
    counter, text = _counter(), "word " * 50_000
    tree = tokencount.Tree(*tokencount.count_pieces(text, counter))
    leaves = list(tree.leaves)
    tree.edit(text, 100_000, 100_003, "changed", counter)
    assert sum(a is not b for a, b in zip(leaves, tree.leaves, strict=True)) == 1


@pytest.mark.parametrize("alphabet", [" \na", " \na.", "'re ", "'sl\n"])
def test_edits_after_white_space_and_apostrophes(alphabet):
    counter, rng = _counter(), random.Random(3)
    encode = counter.encoding.encode_ordinary
    assert _after_edit("end.\n\nExample next", 6, 13, "") == len(encode("end.\n\n next"))
    assert _after_edit("a 'rx", 4, 5, "e") == len(encode("a 're"))
    for _ in range(300):
        text = "".join(rng.choice(alphabet) for _ in range(rng.choice([7, 7, 7, 200])))
        start, n, new = rng.randint(0, len(text)), rng.randint(0, 3), "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 2)))
        assert _after_edit(text, start, start + n, new) == len(encode(text[:start] + new + text[start + n :])), (text, start, n, new)


def _after_edit(text, start, end, new):
    tree = tokencount.Tree(*tokencount.count_pieces(text, _counter()))
    tree.edit(text, start, end, new, _counter())
    return tree.total


_kept = []


def _counter():
    if not _kept:
        _kept.append(tokencount.Counter(tokenfile.tokenizer_path(tokencount.RANKS)))
    return _kept[0]


def test_edited_documents(docs, empty, corpus):
    path = tokenfile.tokenizer_path(tokencount.RANKS)
    trees = tokencount.build_trees(docs, path)
    out = tokencount.apply_edits(trees.withColumn("edits", tokencount.standard_edits()), path).collect()
    encode = _counter().encoding.encode_ordinary
    assert len(out) == len(corpus) and all(r.n_tokens == len(encode(r.text)) for r in out)
    before = Counter((i, len(encode(t or ""))) for i, t, *_ in corpus)
    assert Counter((r.doc_id, r.n_before) for r in out) == before
    longest = max(out, key=lambda r: len(r.text))
    assert longest.n_encoded < 400 < len(longest.text) / 100  # only what the edits touch is encoded again
    again = tokencount.apply_edits(trees.withColumn("edits", F.lit(None).cast("array<struct<start:int,end:int,new:string>>")), path)
    assert again.where("n_tokens <> n_before OR n_encoded <> 0").count() == 0
    assert tokencount.build_trees(empty, path).count() == 0


# --- 7: token files


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 255), st.integers(0, 70000), st.integers(0, 2**32 - 1)), max_size=1500), st.data())
def test_dac_round_trip(ids, data):
    d = tokenfile.Dac(tokenfile.dac_encode(np.array(ids, np.uint32)))
    assert len(d) == len(ids) and d.slice(0, len(ids)).tolist() == ids
    for _ in range(10):
        if ids:
            i = data.draw(st.integers(0, len(ids) - 1))
            j = data.draw(st.integers(i, len(ids)))
            assert d[i] == ids[i] and d.slice(i, j).tolist() == ids[i:j]
    with pytest.raises(IndexError):
        d[len(ids)]


def brute_tokens(rows):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenfile.tokenizer_path())
    return [(i, [*t.encode(x or "", add_special_tokens=False).ids, 2]) for i, x in rows]


@pytest.mark.parametrize("most", [300_000, 50])
def test_encoder(corpus, most):
    odd = ["É.", "İI", "ΑΣ σ.", "<|endoftext|> <|ENDOFTEXT|>", "don't 'S it's", "á.", "x\x1cy\x85z w", "ẞ ß.", "a×. 12,3 —."]
    texts = [t for _, t, *_ in corpus] + odd
    e = tokenfile.Encoder(tokenfile.tokenizer_path(), most=most)
    for _ in range(2):
        flat, n = e.encode(texts)
        assert [x.tolist() for x in np.split(flat, np.cumsum(n)[:-1])] == [ids for _, ids in brute_tokens(enumerate(texts))]


def test_token_file(docs, empty, corpus):
    segments = tokenfile.write_segments(docs, tokenfile.tokenizer_path(), segment_ids=500)
    out = sorted(tokenfile.read_documents(segments).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in out] == sorted((i for i, *_ in corpus), key=lambda i: (i is not None, i or 0))
    assert [r.start for r in out] == list(np.cumsum([0, *(r.n_tokens for r in out)])[:-1])
    want = Counter((i, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for i, x in brute_tokens((i, t) for i, t, *_ in corpus))
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in out) == want
    assert tokenfile.read_documents(tokenfile.write_segments(empty, tokenfile.tokenizer_path())).count() == 0


def test_tokens_by_place(spark, docs, empty, corpus):
    """By the place in the file, and by document and place in it, from one segment each."""
    segments = tokenfile.write_segments(docs.where("doc_id IS NOT NULL AND doc_id <> 7").dropDuplicates(["doc_id"]), tokenfile.tokenizer_path(), segment_ids=300)
    ids = [x for _, own in sorted({i: x for i, x in brute_tokens((i, t) for i, t, *_ in corpus) if i is not None and i != 7}.items()) for x in own]
    rng = random.Random(8)
    some = [0, len(ids) - 1, *(rng.randrange(len(ids)) for _ in range(300))]
    got = {r.position: r.token for r in tokenfile.tokens_at(segments, spark.createDataFrame([(p,) for p in [*some, *some, -1, len(ids), None]], "position long"), 256).collect()}
    assert got == {**{p: ids[p] for p in some}, -1: None, len(ids): None, None: None}
    assert [tokenfile.token_at(segments, p) for p in some[:4]] == [ids[p] for p in some[:4]] and segments.count() > 20
    for p in (-1, len(ids)):
        with pytest.raises(IndexError):
            tokenfile.token_at(segments, p)
    assert tokenfile.one_segment(segments, *segments.select("part", "seq").first()).count() == 1
    starts = {r.doc_id: (r.start, r.n_tokens) for r in tokenfile.document_starts(segments).collect()}
    for i, own in random.Random(9).sample(brute_tokens((i, t) for i, t, *_ in corpus if i is not None and i not in (5, 7)), 5):
        assert starts[i][1] == len(own) and ids[starts[i][0] : sum(starts[i])] == own
    none = tokenfile.write_segments(empty, tokenfile.tokenizer_path())
    assert [r.token for r in tokenfile.tokens_at(none, spark.createDataFrame([(0,)], "position long")).collect()] == [None] and tokenfile.document_starts(none).count() == 0


def test_payloads_are_stored_as_they_are(spark, docs):
    """Files of the table hold the payload's bytes, so nothing has to be decompressed to reach a token."""
    import glob

    segments = tokenfile.write_segments(docs, tokenfile.tokenizer_path())
    payload = bytes(segments.first().payload)
    files = [f for p in segments.inputFiles() for f in glob.glob(p.removeprefix("file://").removeprefix("file:"))]
    assert any(payload in open(f, "rb").read() for f in files)


# --- 9: MinHash


def brute_near(rows, percent=85):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
        sets.append(frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset())
    links = [(a, b) for a, b in itertools.combinations(range(len(rows)), 2) if sets[a] and sets[b] and min(len(sets[a]), len(sets[b])) * 100 >= percent * max(len(sets[a]), len(sets[b])) and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    comp = roots(range(len(rows)), links)
    least = defaultdict(list)
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[comp[k]].append(i)
    out = []
    for k, (i, _) in enumerate(rows):
        c = min(least[comp[k]]) if least[comp[k]] else None
        c = i if not sets[k] else c
        out.append((i, len(sets[k]), c, i == c))
    return sorted(out, key=str)


def test_minhash_brute_force(docs, empty, corpus, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 4)  # so that buckets have several blocks
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(docs).collect()), key=str)
    assert got == brute_near([(i, t) for i, t, *_ in corpus]) and sum(not r[3] for r in got) > 15
    assert minhash.near_duplicates(empty).count() == 0


def test_minhash_link_across_blocks_only(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 0.01)  # 200 blocks for a bucket of two, so the limited rounds have no pair
    rng = random.Random(9)
    w = [f"w{rng.randint(0, 9999)}" for _ in range(200)]
    rows = [(1, " ".join(w)), (2, " ".join([*w[:-1], "other"])), (3, "one more text that is like no other one")]
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert got == brute_near(rows) and [r[2:] for r in got] == [(1, True), (1, False), (3, True)]


def test_audit_of_near_duplicates(spark):
    docs = table(spark, SF, "documents")
    found = minhash.near_duplicates(docs).cache()
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    n, right = minhash.audited(docs, found, rows=10**6)
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if (w := re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))) else set() for i, t in rows}
    assert n == right == 2 * sum(100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]) for a, b in itertools.combinations(sets, 2) if sets[a] and sets[b]) > 0
    alone = found.withColumn("component_id", F.col("doc_id"))
    assert minhash.audited(docs, alone, rows=10**6) == (n, 0) and minhash.audited(docs.limit(0), found) == (0, 0)


def test_op9_on_table(spark):
    got = sorted((tuple(r) for r in minhash.op9_minhash(spark, SF).collect()), key=str)
    assert got == brute_near([tuple(r) for r in table(spark, SF, "documents").select("doc_id", "text").collect()])


def test_least_equal_is_the_posterior():
    least = minhash.least_equal(0.85, 1e-3)
    x = np.linspace(0.0005, 0.9995, 1000)
    for n in (64, 128, 512):
        for m, above in ((least[n] - 1, False), (least[n], True)):
            density = np.exp(m * np.log(x) + (n - m) * np.log1p(-x) - (m * np.log(m / n) + (n - m) * np.log1p(-m / n)))
            assert (density[x >= 0.85].sum() / density.sum() >= 1e-3 * (0.9 if above else 1.1)) == above


# --- 10: mixing


def brute_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    total, stopped = 1.5 * sum(sizes.values()), {}
    while True:
        rest = [s for s in names if s not in stopped]
        share = {s: (total - sum(stopped.values())) * weight[s] / sum(weight[r] for r in rest) for s in rest}
        over = {s: 2.0 * sizes[s] for s in rest if share[s] > 2 * sizes[s]}
        if not over:
            return {**stopped, **share}
        stopped |= over


def test_mixing_brute_force(docs, empty, corpus):
    count = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    rows = docs.select("doc_id", "source", mixing.word_count("text").alias("size"))
    out = mixing.mixed_rows(rows).collect()
    assert Counter((r.doc_id, r.source, r["size"]) for r in out) == Counter((i, s, count(t)) for i, t, _, s, _ in corpus)
    sizes = Counter()
    for _, t, _, s, _ in corpus:
        sizes[s] += count(t)
    want = brute_targets(sizes)
    taken = Counter()
    for r in out:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source]) and r.taken == r.copies * r["size"]
        rate = r.target / r.source_size if r.source_size else 0
        assert int(rate + 1e-9) <= r.copies + 1e-9 and r.copies <= 2 and r.copies <= int(rate + 1e-9) + 1
        taken[r.source] += r.taken
    largest = {s: max(count(t) for _, t, _, x, _ in corpus if x == s) for s in sizes}
    for s in sizes:
        assert abs(taken[s] - want[s]) <= max(0.05 * want[s], largest[s])
    assert sorted(map(str, out)) == sorted(map(str, mixing.mixed_rows(rows.repartition(3)).collect()))  # reruns agree
    assert mixing.mixed_rows(rows.limit(0)).count() == 0
    mixed = Counter(r.doc_id for r in mixing.mix(docs).collect())
    by_id = Counter()
    for r in out:
        by_id[r.doc_id] += r.copies
    assert mixed == +by_id and mixing.mix(docs).columns == docs.columns and mixing.mix(empty).count() == 0


def test_draws_have_the_fraction(spark):
    rows = spark.range(4000).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("string").alias("source"), F.lit(10).alias("size"))
    out = mixing.mixed_rows(rows, seeds=1).groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("w")).collect()
    assert all(abs(r.t / r.w - 1) < 0.05 for r in out)


def test_seeds_of_small_and_large_sources(spark):
    """What the query runs: a source that one draw serves has the first seed, a small one with long documents the first that comes near."""
    rows = spark.range(60_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 40, "few").otherwise((F.col("id") % 3).cast("string")).alias("source"), F.when(F.col("id") < 40, F.pow(F.lit(1.2), F.col("id")).cast("long")).otherwise(10).alias("size"))
    plan = {r.source: r for r in mixing.source_plan(rows).collect()}
    assert {plan[s].seed for s in "012"} == {0}
    took = {r.source: r.t for r in mixing.mixed_rows(rows).groupBy("source").agg(F.sum("taken").alias("t")).collect()}
    assert all(abs(took[s] / r.target - 1) <= 0.02 for s, r in plan.items())


def test_places_of_sources(spark):
    names = ["b", "a", "é", "B", "", None, "aa", "漢", "\U0001f600", "\uffff"]
    got = {r.source: r.place for r in mixing.ranked(spark.createDataFrame([(n, 1) for n in names], "source string, source_size long")).collect()}
    assert got == {n: i for i, n in enumerate(sorted(names, key=lambda n: (n is None, n or "")))}


def test_large_ids_beside_nulls(spark):
    """Ids that a float can't hold stay what they are in batches with null ids."""
    big = [2**62 + 1, 2**62 + 3, None, 5, -(2**62) - 1]
    rows = [(i, f"text number {k} with some words of its own, which are {k}") for k, i in enumerate(big)]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    own = spark.createDataFrame([(i, 1, k % 2) for k, i in enumerate(big) if i], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(1, "text number 0 with some words of its own, which")], "item_id long, text string")
    path = tokenfile.tokenizer_path(tokencount.RANKS)
    trees = tokencount.build_trees(df, path)
    vectors = spark.createDataFrame([(i, [1.0, float(k)], 1 if k else None) for k, i in enumerate(big)], "vec_id long, embedding array<double>, label int").coalesce(1).withColumnRenamed("vec_id", "doc_id")
    segments = tokenfile.write_segments(df, tokenfile.tokenizer_path())
    outs = [
        quality.quality_scores(df, own), toxicity.toxicity_scores(df, own), licenses.scan(df), decontaminate.decontaminate(df, bench), minhash.near_duplicates(df), trees,
        tokencount.apply_edits(trees.withColumn("edits", tokencount.standard_edits()), path), sharding.shard_documents(df), tokenfile.read_documents(segments), tokenfile.document_starts(segments),
        embeddings.near_duplicates(vectors.withColumnRenamed("doc_id", "vec_id")).withColumnRenamed("vec_id", "doc_id"), mixing.mix(df.withColumn("source", F.lit("a")), share=1.0),
    ]
    for out in outs:
        assert Counter(r.doc_id for r in out.collect()) == Counter(big) and out.schema["doc_id"].dataType.simpleString() == "bigint"
    near = minhash.near_duplicates(df).collect()
    assert all(r.component_id == r.doc_id for r in near)


# --- SQL


@pytest.mark.parametrize("name", ["op2_embedding_graph", "op5_decontaminate", "op9_minhash"])
def test_matches_sql(spark, name):
    import duckdb

    from docloom.llm.queries import ORACLE_SQL, QUERIES

    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    cur = con.execute(ORACLE_SQL[name])
    columns = [d[0] for d in cur.description]
    df = QUERIES[name](spark, SF)
    assert sorted(columns) == sorted(df.columns)
    assert sorted(map(tuple, df.select(*columns).collect())) == sorted(cur.fetchall())
