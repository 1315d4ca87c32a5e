r"""Repair of conversation structure: the cheapest edits that make the roles of a conversation `(s?(ua)+)?`.

A conversation's rows are the layers of a dynamic program over four states: nothing yet, after the system's turn, after a user's, after an assistant's. A macro edit is a run of inserted turns and what
becomes of the next row; its code, such as `IK`, is part of the audit. The codes are free of prefixes and numbered in the order of their texts, so audits that lead to the states of a layer compare as their
sequences of numbers do. Instead of audits a layer holds, for each state, the cost, the rank of its audit among the layer's and a pointer to the state before. Of audits of equal cost, that of the lower-ranked
state before is the least, and the new ranks are the order of (rank before, code). Audits are put together once, backwards, at the end.

Rows go in their order through ranges of (conversation, turn), so a conversation of any length is cut where a range ends and every BLOCK rows. Of a block alone the program is run from each state; blocks of a conversation
are joined by their costs and ranks, sixteen numbers each, after which each block finds its own part of the audit.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, table, written

#: Costs of edits, and ASCII white space.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
SPACES = " \t\n\x0b\x0c\r"
#: States: nothing yet, after s, after u, after a; what an insertion or a rerole leads to; the edits that end a conversation.
START, S, U, A = range(4)
NEXT = (U, U, A, U)
TAIL = ("", "II", "I", "")
#: Codes of macro edits in the order of their texts. Longer runs of insertions lead where shorter ones do.
CODES = tuple(sorted("I" * run + edit for run in range(3) for edit in "DKR"))
#: Faults of a row: none, truncated, and blank or duplicate, which have to go.
FINE, CUT, GONE = range(3)
#: A block is closed at so many rows or characters.
BLOCK_ROWS, BLOCK_CHARS = 4096, 4 << 20
ROLES = {U: "user", A: "assistant"}


@lru_cache
def moves(initial: str, fault: int) -> tuple[tuple[tuple[int, int, int], ...], ...]:
    """For each state after a row, the states before that lead to it, with the least cost and, of equal ones, the first code. initial: s, u, a or another."""
    best: dict[tuple[int, int], tuple[int, int]] = {}
    for before in range(4):
        for number, code in enumerate(CODES):
            at, cost = before, INSERT * (len(code) - 1)
            for _ in code[1:]:
                at = NEXT[at]
            if code[-1] == "D":
                after, cost = at, cost + DELETE
            elif fault == GONE:
                continue
            elif code[-1] == "R":
                after, cost = NEXT[at], cost + REROLE + TRUNCATED * fault
            elif initial == "s" and at == START:
                after, cost = S, cost + KEEP + TRUNCATED * fault
            elif initial and initial in "ua" and "ua".index(initial) + U == NEXT[at]:
                after, cost = NEXT[at], cost + KEEP + TRUNCATED * fault
            else:
                continue
            best[before, after] = min(best.get((before, after), (cost, number)), (cost, number))
    return tuple(tuple((before, *best[before, after]) for before in range(4) if (before, after) in best) for after in range(4))


@dataclass
class Layer:
    """By state, the cost of the cheapest way (None: there is none) and the rank of its audit among the states'."""

    costs: list
    ranks: list


def step(layer: Layer, ways: Iterable) -> tuple[Layer, list[tuple[int, int]]]:
    """The next layer and, by state, (state before, number of what lies between). ways: by state after, (state before, cost, number)."""
    costs, pointers, keys = [None] * 4, [(0, 0)] * 4, []
    for after, found in enumerate(ways):
        options = [(layer.costs[b] + cost, layer.ranks[b], number, b) for b, cost, number in found if layer.costs[b] is not None]
        if options:
            cost, rank, number, before = min(options)
            costs[after], pointers[after] = cost, (before, number)
            keys.append((rank, number, after))
    ranks = [0] * 4
    for i, (_, _, after) in enumerate(sorted(keys)):
        ranks[after] = i
    return Layer(costs, ranks), pointers


def begin(state: int) -> Layer:
    return Layer([0 if s == state else None for s in range(4)], [0] * 4)


def run(initials: list[str], faults: list[int], entry: int = START) -> tuple[Layer, bytearray]:
    """The last layer from one state, and four pointers for each row, a byte each."""
    layer, back = begin(entry), bytearray()
    for initial, fault in zip(initials, faults, strict=True):
        layer, pointers = step(layer, moves(initial, fault))
        back += bytes(16 * before + number for before, number in pointers)
    return layer, back


def ending(layer: Layer) -> tuple[int, int]:
    """(cost, state) of the cheapest end, the least audit first. No audit begins another one of as many rows, so the rank decides."""
    cost, _, state = min((layer.costs[s] + INSERT * len(TAIL[s]), layer.ranks[s], s) for s in range(4) if layer.costs[s] is not None)
    return cost, state


def traced(back: bytearray, state: int) -> list[str]:
    """The codes of all rows, from the pointers and the state at the end."""
    codes = []
    for row in range(len(back) // 4 - 1, -1, -1):
        state, number = divmod(back[4 * row + state], 16)
        codes.append(CODES[number])
    return codes[::-1]


def applied(codes: list[str], roles: list[str], texts: list[str], state: int = START, tail: str = "") -> tuple[list[str], list[str]]:
    """Roles and texts after the edits."""
    out_roles, out_texts = [], []
    for code, role, text in [*zip(codes, roles, texts, strict=True), (tail, "", "")]:
        for edit in code:
            if edit == "D":
                continue
            state = S if edit == "K" and role[0] == "s" else NEXT[state]
            out_roles.append(role if edit == "K" else ROLES[state])
            out_texts.append("" if edit == "I" else text)
    return out_roles, out_texts


def legal(a: str, b: str) -> bool:
    return a + b in ("su", "ua", "au")


@dataclass
class Rows:
    """Rows of one conversation that are held."""

    roles: list = field(default_factory=list)
    texts: list = field(default_factory=list)
    faults: list = field(default_factory=list)
    chars: int = 0

    def add(self, role: str, text: str, fault: int) -> None:
        self.roles.append(role)
        self.texts.append(text)
        self.faults.append(fault)
        self.chars += len(text)

    @property
    def initials(self) -> list[str]:
        return [r[:1] for r in self.roles]

    @property
    def illegal(self) -> int:
        i = self.initials
        return sum(not legal(a, b) for a, b in zip(i, i[1:], strict=False))


#: What a range gives: a conversation as a whole (edits done), or a block (costs and ranks by state before and after).
PIECES = (
    "cid string, part int, seq int, whole boolean, cost long, audit string, illegal long, roles array<string>, texts array<string>, "
    "faults array<int>, costs array<int>, ranks array<int>, first string, last string"
)


def _whole(cid: str, part: int, rows: Rows) -> tuple:
    layer, back = run(rows.initials, rows.faults)
    cost, state = ending(layer)
    codes = traced(back, state)
    return (cid, part, 0, True, cost, "".join(codes) + TAIL[state], rows.illegal, *applied(codes, rows.roles, rows.texts, START, TAIL[state]), None, None, None, None, None)


def _block(cid: str, part: int, seq: int, rows: Rows) -> tuple:
    layers = [run(rows.initials, rows.faults, entry)[0] for entry in range(4)]
    costs, ranks = [c for x in layers for c in x.costs], [r for x in layers for r in x.ranks]
    return (cid, part, seq, False, None, None, rows.illegal, rows.roles, rows.texts, rows.faults, costs, ranks, rows.roles[0][:1], rows.roles[-1][:1])


def frames(rows: Iterator[tuple], schema: str, most: int = 500, chars: int = 8 << 20) -> Iterator[pd.DataFrame]:
    """Pandas frames of rows, which are let go after `most` of them or as soon as their texts have so many characters. Whole numbers stay such beside nulls."""
    names, held, size = [x.split()[0] for x in schema.split(", ")], [], 0
    for r in rows:
        held.append(r)
        size += sum(map(len, r[names.index("texts")] or []))
        if len(held) >= most or size >= chars:
            yield pd.DataFrame(held, columns=names, dtype=object)
            held, size = [], 0
    if held:
        yield pd.DataFrame(held, columns=names, dtype=object)


def _pieces(block_rows: int):  # noqa: ANN202
    """For mapInPandas over rows in order: cid, role, text, fault, n."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        from pyspark import TaskContext

        part, now, rows, seq, edge = TaskContext.get().partitionId(), None, Rows(), 0, True
        for b in batches:
            for cid, role, text, fault, n in zip(b["cid"], b["role"], b["text"], b["fault"], b["n"], strict=True):
                if cid != now:
                    if rows.roles:
                        # the first and the last conversation of a range may have begun before or go on behind it
                        yield _block(now, part, seq, rows) if seq or edge else _whole(now, part, rows)
                        edge = False
                    now, rows, seq = cid, Rows(), 0
                for i in range(n):
                    if len(rows.roles) >= block_rows or rows.chars >= BLOCK_CHARS:
                        yield _block(now, part, seq, rows)
                        rows, seq = Rows(), seq + 1
                    rows.add(role, text, GONE if i else fault)
        if rows.roles:
            yield _block(now, part, seq, rows)

    return lambda batches: frames(each(batches), PIECES)


def _joined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """For mapInPandas over blocks in order: of each block, the states before and after, with the conversation's end and cost at the last. Blocks hold sixteen numbers here, no rows."""
    out: list[tuple] = []

    def close(held: list) -> None:
        layer, backs, illegal = begin(START), [], 0
        for i, (_, _, _, costs, ranks, _, _) in enumerate(held):
            ways = [[(b, costs[4 * b + a], ranks[4 * b + a]) for b in range(4) if costs[4 * b + a] is not None] for a in range(4)]
            layer, pointers = step(layer, ways)
            backs.append([before for before, _ in pointers])
            illegal += bool(i) and not legal(held[i - 1][6], held[i][5])
        cost, state = ending(layer)
        last = True
        for (cid, part, seq, *_), back in zip(held[::-1], backs[::-1], strict=True):
            out.append((cid, part, seq, back[state], state, last, cost if last else 0, illegal if last else 0))
            state, last = back[state], False

    held: list = []
    for b in batches:
        for cid, part, seq, costs, ranks, first, last in zip(b["cid"], b["part"], b["seq"], b["costs"], b["ranks"], b["first"], b["last"], strict=True):
            if held and held[0][0] != cid:
                close(held)
                held = []
            held.append((cid, part, seq, [None if c is None or c != c else int(c) for c in costs], [int(r) for r in ranks], first, last))
        if len(out) >= 5000:
            yield pd.DataFrame(out, columns=JOINED_NAMES)
            out.clear()
    if held:
        close(held)
    yield pd.DataFrame(out, columns=JOINED_NAMES)


JOINED = "cid string, part int, seq int, entry int, leave int, at_end boolean, cost long, between long"
JOINED_NAMES = [x.split()[0] for x in JOINED.split(", ")]


def _finished(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """For mapInPandas over blocks with their states before and after: their part of the audit, and their rows after it."""

    def each() -> Iterator[tuple]:
        for b in batches:
            for r in b.itertuples():
                roles, texts = list(r.roles), list(r.texts)
                codes = traced(run([x[:1] for x in roles], [int(f) for f in r.faults], r.entry)[1], r.leave)
                tail = TAIL[r.leave] if r.at_end else ""
                yield (r.cid, r.part, r.seq, False, r.cost, "".join(codes) + tail, r.illegal + r.between, *applied(codes, roles, texts, r.entry, tail))

    return frames(each(), REPAIRED)


REPAIRED = "cid string, part int, seq int, whole boolean, cost long, audit string, illegal long, roles array<string>, texts array<string>"


def keyed(conv_id: str = "conv_id") -> Column:
    """An id as text that is never null."""
    return F.coalesce(F.concat(F.lit("="), F.col(conv_id).cast("string")), F.lit("null"))


def faulted(conversations: DataFrame) -> DataFrame:
    """cid, turn, role, text, h, n (how often the row is there), n_blank, n_duplicate, n_truncated, fault of each different row.

    conversations: conv_id, turn, role, text and, if wished, copies. A null role or text is one space. A row whose role and text an earlier turn has is found by the least turn of each; only those that several turns
    have are joined.
    """
    copies = F.col("copies") if "copies" in conversations.columns else F.lit(1)
    text_of = lambda c: F.coalesce(F.col(c), F.lit(" "))
    rows = conversations.select(keyed().alias("cid"), "turn", text_of("role").alias("role"), text_of("text").alias("text"), copies.cast("long").alias("copies"))
    h = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256)
    rows = rows.groupBy("cid", "turn", "role", "text").agg(F.sum("copies").alias("n")).withColumn("h", h)
    order = F.struct(F.col("turn").isNotNull().alias("there"), F.col("turn"))
    again = rows.groupBy("cid", "h").agg(F.min(order).alias("earliest"), F.count("*").alias("turns")).where("turns > 1").select("cid", "h", "earliest")
    seen = F.coalesce(F.col("earliest") < order, F.lit(False))
    blank = ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    last = F.right(F.rtrim("text", F.lit(SPACES)), F.lit(1))
    cut = ~last.isin(".", "!", "?")
    rows = rows.join(again, ["cid", "h"], "left").select("cid", "turn", "role", "text", "h", "n", blank.alias("blank"), seen.alias("seen"), cut.alias("cut"))
    count = lambda yes, n: F.when(yes, n).otherwise(F.lit(0)).cast("long")
    return rows.select(
        "cid", "turn", "role", "text", "h", "n", count(F.col("blank"), F.col("n")).alias("n_blank"), count(~F.col("blank"), F.when(F.col("seen"), F.col("n")).otherwise(F.col("n") - 1)).alias("n_duplicate"),
        count(~F.col("blank") & ~F.col("seen") & F.col("cut"), F.lit(1)).alias("n_truncated"),
        F.when(F.col("blank") | F.col("seen"), GONE).when(F.col("cut"), CUT).otherwise(FINE).alias("fault"),
    )


def repair(conversations: DataFrame, block_rows: int = BLOCK_ROWS) -> tuple[DataFrame, DataFrame]:
    """(report, repaired). conversations: conv_id, turn, role, text, and copies (how often each row is there) if wished; other columns are ignored.

    report, a row for each conv_id: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit. repaired, in pieces of conversations: cid, part, seq (their order), whole, roles, texts; see repaired_rows() and digests().

    Rows are in the order of their turns, nulls first; rows of one turn in that of a hash of role and text, so that equal rows are adjacent. A row is blank, else a duplicate if a row before has its role and text, else truncated.
    Null ids are one conversation. A role's initial is its first character; an empty role has none and is never kept. A conversation whose rows all go has an empty repair. No rows give none. Texts are taken whole.
    """
    spark = conversations.sparkSession
    small_batches(spark)
    rows = written(faulted(conversations), "conversation-rows")
    order = [F.col("cid"), F.col("turn").asc_nulls_first(), F.col("h")]
    dealt = rows.select("cid", "turn", "h", "role", "text", "fault", "n").repartitionByRange(*order).sortWithinPartitions(*order)
    pieces = written(dealt.select("cid", "role", "text", "fault", "n").mapInPandas(_pieces(block_rows), PIECES), "conversation-pieces")
    open_ = pieces.where("NOT whole")
    small = open_.select("cid", "part", "seq", "costs", "ranks", "first", "last").repartition(F.col("cid")).sortWithinPartitions("cid", "part", "seq")
    states = small.mapInPandas(_joined, JOINED)
    both = open_.select("cid", "part", "seq", "roles", "texts", "faults", "illegal").join(states, ["cid", "part", "seq"])
    names = [x.split()[0] for x in REPAIRED.split(", ")]
    repaired = written(pieces.where("whole").select(*names).unionByName(both.mapInPandas(_finished, REPAIRED)), "conversation-repaired")

    by_turn = rows.groupBy("cid", "turn").agg(*[F.sum(f"n_{c}").alias(c) for c in ("blank", "duplicate", "truncated")])
    spread = F.max("turn") - F.min("turn") + 1 - F.count("turn")
    faults = by_turn.groupBy("cid").agg(F.coalesce(spread, F.lit(0)).cast("long").alias("gaps"), *[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")])
    parts = F.array_sort(F.collect_list(F.struct("part", "seq", "audit")))  # the audit is one cell, so are its parts
    edits = repaired.groupBy("cid").agg(F.sum("illegal").alias("illegal"), F.sum("cost").alias("cost"), F.array_join(F.transform(parts, lambda x: x["audit"]), "").alias("audit"))
    report = conversations.select("conv_id").distinct().withColumn("cid", keyed()).join(faults, "cid", "left").join(edits, "cid", "left")
    numbers = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return report.select("conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit")), repaired


def repaired_rows(repaired: DataFrame) -> DataFrame:
    """cid, part, seq, i (their order), role, text: a row for each turn of the repaired conversations."""
    each = F.posexplode(F.arrays_zip("roles", "texts")).alias("i", "row")
    return repaired.select("cid", "part", "seq", each).select("cid", "part", "seq", "i", F.col("row.roles").alias("role"), F.col("row.texts").alias("text"))


def digests(repaired: DataFrame) -> DataFrame:
    """cid, repaired_sha256 of `role:text` of all turns, newline between. Conversations in several pieces go through a hash piece by piece, so none is held whole."""
    lines = F.array_join(F.zip_with("roles", "texts", lambda r, t: F.concat(r, F.lit(":"), t)), "\n")
    some = repaired.select("cid", "part", "seq", "whole", F.size("roles").alias("n"), lines.alias("lines"))

    def streamed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, digest, first = None, hashlib.sha256(), True
        for b in batches:
            done = []
            for cid, n, text in zip(b["cid"], b["n"], b["lines"], strict=True):
                if cid != now:
                    if now is not None:
                        done.append((now, digest.hexdigest()))
                    now, digest, first = cid, hashlib.sha256(), True
                if n:
                    digest.update(("" if first else "\n").encode() + text.encode())
                    first = False
            yield pd.DataFrame(done, columns=["cid", "repaired_sha256"])
        if now is not None:
            yield pd.DataFrame([(now, digest.hexdigest())], columns=["cid", "repaired_sha256"])

    pieces = some.where("NOT whole").repartition(F.col("cid")).sortWithinPartitions("cid", "part", "seq").select("cid", "n", "lines")
    return some.where("whole").select("cid", F.sha2("lines", 256).alias("repaired_sha256")).unionByName(pieces.mapInPandas(streamed, "cid string, repaired_sha256 string"))


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, copies of the rows that are left, by crc32(`conv_id:turn`) % 20: 0 takes a row away, 1 its text, 2 its full stops, exclamation and question marks, 3 repeats it, 4 makes its role user.

    Nulls are one space: ids and turns in the hashed text, roles and texts as such.
    """
    text_of = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(text_of("conv_id"), F.lit(":"), text_of("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", text_of("role").alias("role"), text_of("text").alias("text"), kind.alias("kind")).where("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.when(F.col("kind") == 3, 2).otherwise(1).alias("copies"))


def damaged_report(conversations: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """conv_id and what is found after damaged(), for every conv_id of the undamaged rows: the columns of repair()'s report and repaired_sha256. A conversation without rows has zeros, no audit and the hash of nothing."""
    report, repaired = repair(damaged(conversations), block_rows)
    found = report.withColumn("cid", keyed()).drop("conv_id").join(digests(repaired), "cid", "left")
    every = conversations.select("conv_id").distinct().withColumn("cid", keyed()).join(found, "cid", "left")
    numbers = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return every.select("conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return damaged_report(table(spark, sf_dir, "conversations"))
