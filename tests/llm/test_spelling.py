"""Spelling variants against all pairs, with halves that many words share, and against SQL."""

import random
import re
import zlib
from collections import Counter

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docloom.llm import oracles, spelling

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def edited(word, alphabet):
    """All texts one edit away."""
    out = {word[:i] + word[i + 1 :] for i in range(len(word))}
    for c in alphabet:
        out |= {word[:i] + c + word[i:] for i in range(len(word) + 1)} | {word[:i] + c + word[i + 1 :] for i in range(len(word))}
    return out - {word}


def brute(rows):
    counts = Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}
    alphabet = {c for w in words for c in w}
    near = {w: edited(w, alphabet) & words.keys() for w in words}
    form = {}
    for w, others in near.items():
        best = min(((-words[x], x) for x in others), default=None)
        form[w] = best[1] if best and -best[0] >= 10 * words[w] else None
    out = set()
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n, len(near[w]), words[form[w]] if form[w] else None))
    return out


def texts(rng):
    """Words with common halves, variants of common and rare words, repeated and long ones."""
    heads, tails = ["inter", "abc", "aaaa", "ÿéà", "x" * 60], ["national", "abcd", "aaaa", "éàÿ÷", "y" * 55]
    base = [rng.choice(heads) + "".join(rng.choice("abé") for _ in range(rng.randint(0, 5))) + rng.choice(tails) for _ in range(80)] + ["a" * n for n in range(5, 13)] + ["ab" * 5, "ba" * 5, "aba" * 3]
    rows = []
    for i in range(220):
        words = []
        for _ in range(40):
            w = rng.choice(base[: rng.choice([2, 10, len(base)])])
            if rng.random() < 0.2:
                at = rng.randrange(len(w))
                w = rng.choice([w[:at] + w[at + 1 :], w[:at] + rng.choice("abÉz") + w[at:], w[:at] + rng.choice("abz") + w[at + 1 :]])
            words.append(w.upper() if rng.random() < 0.1 else w)
        rows.append((i, rng.choice([" ", ", ", "1", "漢", "_", "\n"]).join(words)))
    return rows + [(None, rows[0][1]), (5, rows[1][1]), (5, rows[1][1]), (900, None), (901, ""), (902, "1 2"), (903, "z" * 3000 + " " + "z" * 3000 + " " + "z" * 3001 + " " + "z" * 3001 + " short")]


@settings(max_examples=300, deadline=None)
@given(st.text("ab", max_size=9), st.text("ab", max_size=9))
def test_near_is_distance_one(a, b):
    assert spelling.near(a, b) == (distance(a, b) == 1)


@pytest.mark.parametrize("n", [3, spelling.LONG - 1, spelling.LONG, spelling.LONG + 1, spelling.LONG + 2, 200])
def test_near_texts_share_a_key(n):
    rng = random.Random(n)
    for _ in range(60):
        a = "".join(rng.choice("abé") for _ in range(n))
        b = rng.choice(sorted(edited(a, "abz")))
        assert set(spelling.thinned(a)) & set(spelling.thinned(b))
        assert len(spelling.thinned(a)) == n + 1


@pytest.mark.parametrize("hot, shard", [(0, 10), (2, 30), (15, 100), (spelling.HOT, spelling.SHARD)])
def test_variants_against_all_pairs(spark, hot, shard):
    rows = texts(random.Random(hot + 1))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for c in ("word", "n", "form", "root", "half", "segment", "scan", "near", "best", "key", "next", "moved"):
        df = df.withColumn(c, F.lit("clash"))
    found = spelling.variants(df.repartition(3), hot=hot, shard=shard).collect()
    got = {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in found}
    want = brute(rows)
    assert len(found) == len(got) and got == want
    assert sum(r[1] is not None for r in want) > 20 and max(r[4] for r in want) > 5


def test_groups_by_keys_and_one_by_one(monkeypatch):
    rng = random.Random(2)
    rests = ["".join(rng.choice("ab") for _ in range(rng.randint(0, 6))) for _ in range(300)]
    a, b = spelling.Group(), spelling.Group()
    for g in (a, b):
        for i, r in enumerate(rests):
            g.add(r, f"{i}", i)
    by_keys = {r: sorted(a.of(r)) for r in rests}
    monkeypatch.setattr(spelling, "FEW", 10**9)
    assert by_keys == {r: sorted(b.of(r)) for r in rests}


def test_roots_are_followed_to_the_end(spark):
    """Each word has ten times the occurrences of the one before, but for what is damaged."""
    words = ["wordaaaaa", "wordbaaaa", "wordbbaaa", "wordbbbaa", "wordbbbba"]
    text = " ".join(w for i, w in enumerate(words) for _ in range(2 * 11**i))
    got = {r.word: (r.form, r.root) for r in spelling.variants(spark.createDataFrame([(1, text)], "doc_id long, text string"), damage=10**10).collect()}
    assert got == {w: (words[i + 1] if i < 4 else None, words[4]) for i, w in enumerate(words)}


def test_no_words(spark):
    schema = "doc_id long, text string"
    assert spelling.variants(spark.createDataFrame([], schema)).count() == 0
    assert spelling.variants(spark.createDataFrame([(1, "short words only"), (2, None), (3, "lonesome")], schema)).count() == 0


def test_sql_says_the_same():
    rows = texts(random.Random(7))
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", [r for r in rows if r[0] != 903])
    cur = con.execute(oracles.SPELLING)
    names = [d[0] for d in cur.description]
    assert names == ["word", "form", "root", "n", "n_near", "form_n"] and set(cur.fetchall()) == brute([r for r in rows if r[0] != 903])
