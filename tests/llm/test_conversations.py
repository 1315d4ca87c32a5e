"""Conversation repair against all edits tried one by one, whole and in blocks, and against SQL."""

import hashlib
import itertools
import random
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from docloom.llm import conversations, oracles

SCHEMA = "conv_id long, turn long, role string, text string"
SPACE = " \t\n\x0b\x0c\r"


def after_damage(rows):
    out = []
    for c, t, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        if kind:
            text = "" if kind == 1 else "".join(x for x in text if x not in ".!?") if kind == 2 else text
            out += [(c, t, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def brute(rows):
    """gaps, blank, duplicate, truncated, illegal, cost, audit, hash of the rows of one conversation: all cheapest audits are carried along and compared as texts."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, hashlib.sha256(f"{len(r[2])}:{r[2]}{r[3]}".encode()).hexdigest()))
    turns = [r[1] for r in rows if r[1] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    faults, seen = [], set()
    for _, _, role, text in rows:
        shown = text.strip(SPACE)
        faults.append("blank" if not shown else "duplicate" if (role, text) in seen else "truncated" if shown[-1] not in ".!?" else "")
        seen.add((role, text))
    initials = [r[2][:1] for r in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
    # ways: by the initials so far, reduced to what matters next, the least (cost, audit, lines)
    ways = {"": (0, "", ())}

    def best(found):
        out = {}
        for state, way in found:
            out[state] = min(out.get(state, way), way)
        return out

    def insert(found):
        more = list(found)
        for state, (cost, audit, lines) in found:
            for role in ("user", "assistant"):
                if follows(state, role[0]):
                    more.append((role[0], (cost + 3, audit + "I", (*lines, role + ":"))))
        return more

    def follows(state, initial):
        return initial in {"": "su", "s": "u", "u": "a", "a": "u"}[state] if initial else False

    def inserted(ways):
        found = list(ways.items())
        for _ in range(3):
            found = list(best(insert(found)).items()) + found  # all ways with up to three insertions
        return found

    for (_, _, role, text), fault in zip(rows, faults, strict=True):
        found = []
        for state, (cost, audit, lines) in inserted(ways):
            found.append((state, (cost + 4, audit + "D", lines)))
            if fault in ("blank", "duplicate"):
                continue
            more = 3 * (fault == "truncated")
            if follows(state, role[:1]):
                found.append((role[0], (cost + more, audit + "K", (*lines, f"{role}:{text}"))))
            for other in ("user", "assistant"):
                if follows(state, other[0]):
                    found.append((other[0], (cost + more + 3, audit + "R", (*lines, f"{other}:{text}"))))
        ways = best(found)
    cost, audit, lines = min(way for state, way in inserted(ways) if state in ("", "a"))
    if not rows:
        cost, audit, lines = 0, "", ()
    return gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()


def made(rng):
    rows = []
    for c in [*range(60), None]:
        for t in range(rng.choice([1, 2, 3, 5, 9, 14])):
            turn = rng.choice([t, t, t, t + 3, None, 2])
            role = rng.choice(["system", "user", "assistant", "user", "assistant", "tool", "", None, "sage"])
            rows.append((c, turn, role, rng.choice([f"say {t}.", f"say {t}.", "ok!", "cut off", "", " \n", None, "é漢?  \n", "long " * 300 + "."])))
    return rows + rows[3:6]


def want(rows):
    by = {c: [] for c, *_ in rows}
    for r in after_damage(rows):
        by[r[0]].append(r)
    return {c: brute(own) for c, own in by.items()}


def got(df):
    return {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in df.collect()}


@pytest.mark.parametrize("block_rows", [1, 2, 5, conversations.BLOCK_ROWS])
def test_repair_against_brute_force(spark, block_rows):
    rows = made(random.Random(block_rows))
    df = spark.createDataFrame(rows, SCHEMA)
    for c in ("cid", "h", "n", "part", "seq", "whole", "audit", "copies", "fault", "kind"):
        df = df.withColumn(c, F.lit("clash"))
    assert got(conversations.damaged_report(df.repartition(3), block_rows)) == want(rows)


def test_one_long_conversation_and_one_repeated_row(spark):
    rng = random.Random(4)
    rows = [(1, t, rng.choice(["user", "assistant", "tool"]), f"{rng.randrange(200)}{rng.choice('.! ')}") for t in range(900)]
    rows += [(2, 1, "user", "again.")] * 300 + [(3, None, "assistant", "ok.")] * 5
    assert got(conversations.damaged_report(spark.createDataFrame(rows, SCHEMA), 100)) == want(rows)


def test_repaired_rows_are_legal(spark):
    rows = made(random.Random(9))
    df = spark.createDataFrame(rows, SCHEMA)
    report, repaired = conversations.repair(df, 3)
    by = {}
    for r in sorted(conversations.repaired_rows(repaired).collect(), key=lambda r: (r.cid, r.part, r.seq, r.i)):
        by.setdefault(r.cid, []).append(r.role[0])
    for own in by.values():
        text = "".join(own)
        assert text.removeprefix("s") == "ua" * (len(text) // 2)
    assert report.count() == 61


def test_no_rows(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert conversations.damaged_report(empty).count() == 0 and conversations.repair(empty)[0].count() == 0
    lost = next(c for c in itertools.count() if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    assert got(conversations.damaged_report(spark.createDataFrame([(lost, 0, "user", "gone.")], SCHEMA))) == {lost: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


def test_sql_says_the_same(spark):
    rows = made(random.Random(11))
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    cur = con.execute(oracles.CONVERSATIONS)
    names = [d[0] for d in cur.description]
    sql = {r[0]: tuple(r[1:]) for r in cur.fetchall()}
    assert names == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"] and sql == want(rows)
