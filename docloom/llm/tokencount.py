"""Token counts that follow edits, by segment trees over pre-tokens.

A text's pre-tokens, in order, are dealt to leaves of about LEAF. A complete binary tree over the leaves has the sums of characters and tokens of every subtree; its root has the document's count. An edit
replaces characters start .. end by a text. Pre-tokens that end at least two characters before `start` are as they were: their end was decided by no later
character than the second one behind it, as white space leaves its last character to what follows, and an apostrophe begins a contraction of up to three. From there
the text is split anew until, after the edit, a split falls on one of before: all behind it is as before too. Only this region is encoded; its leaves change and the sums above them are
renewed on the way to the root. When leaves grow beyond twice their size, they are dealt anew, without encoding anything.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_batches, small_batches, table, written
from .tokenfile import text_runs, tokenizer_path

RANKS = "byte_bpe_50k.tiktoken"
LEAF = 64


class Counter(dict):
    """Tokens of a pre-token, kept for those seen lately."""

    def __init__(self, path: str, most: int = 300_000):
        import base64

        import public_tokenizers
        import regex
        import tiktoken

        super().__init__()
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
        self.encoding = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.pattern, self.most = regex.compile(public_tokenizers.PATTERN), most

    def __missing__(self, piece: str) -> int:
        if len(self) >= self.most:
            self.clear()
        self[piece] = n = len(self.encoding.encode_ordinary(piece))
        return n


class Tree:
    """Lengths and token counts of a document's pre-tokens, in packed leaves, under a tree of sums.

    The sums are a heap of 2 * width nodes: 1 is the root, width + i is leaf i. chars[0] has the number of empty leaves.
    """

    def __init__(self, lengths: list[int], counts: list[int]):
        self.leaves = [pack(lengths[i : i + LEAF], counts[i : i + LEAF]) for i in range(0, len(lengths), LEAF)] or [pack([], [])]
        self._sum()

    @classmethod
    def load(cls, leaves: list[bytes], sums: bytes) -> Tree:
        """A tree as dump() gave it. Nothing is summed up again, and a leaf is unpacked when an edit comes to it."""
        tree = cls.__new__(cls)
        both = array("I")
        both.frombytes(sums)
        tree.leaves, tree.width = list(leaves), len(both) // 4
        tree.chars, tree.tokens = both[: 2 * tree.width], both[2 * tree.width :]
        return tree

    def dump(self) -> tuple[list[bytes], bytes]:
        return self.leaves, (self.chars + self.tokens).tobytes()

    def _sum(self) -> None:
        self.width = w = 1 << (len(self.leaves) - 1).bit_length()
        self.chars, self.tokens = array("I", bytes(8 * w)), array("I", bytes(8 * w))
        for i, leaf in enumerate(self.leaves):
            a, b = unpack(leaf)
            self.chars[w + i], self.tokens[w + i] = sum(a), sum(b)
            self.chars[0] += not a
        for i in range(w - 1, 0, -1):
            self._renew(i)

    def _renew(self, i: int) -> None:
        self.chars[i], self.tokens[i] = self.chars[2 * i] + self.chars[2 * i + 1], self.tokens[2 * i] + self.tokens[2 * i + 1]

    @property
    def total(self) -> int:
        return self.tokens[1]

    def pieces(self) -> tuple[list[int], list[int]]:
        """Lengths and counts of all pre-tokens."""
        both = [unpack(leaf) for leaf in self.leaves]
        return [x for a, _ in both for x in a], [x for _, b in both for x in b]

    def leaf_at(self, position: int) -> tuple[int, int]:
        """The leaf that holds a character (the last one for the end of the text) and where it begins."""
        if position >= self.chars[1]:
            last = len(self.leaves) - 1
            return last, self.chars[1] - self.chars[self.width + last]
        i, begin = 1, 0
        while i < self.width:
            i *= 2
            if position >= begin + self.chars[i]:
                begin, i = begin + self.chars[i], i + 1
        return i - self.width, begin

    def set_leaf(self, leaf: int, lengths: list[int], counts: list[int]) -> None:
        self.chars[0] += (not lengths) - (self.leaves[leaf] == EMPTY)
        self.leaves[leaf] = pack(lengths, counts)
        i = self.width + leaf
        self.chars[i], self.tokens[i] = sum(lengths), sum(counts)
        while i > 1:
            i //= 2
            self._renew(i)

    def edit(self, text: str, start: int, end: int, new: str, counter: Counter) -> tuple[str, int]:
        """Replaces text[start:end] by new. Returns the new text and how many of its characters were encoded."""
        start = max(0, min(start, len(text)))
        end = max(start, min(end, len(text)))
        changed = text[:start] + new + text[end:]
        shift = len(new) - (end - start)
        first, begin = self.leaf_at(max(0, start - 2))
        held = {first: unpack(self.leaves[first])}
        kept = 0
        # pieces with two unchanged characters behind them stay; they can all be in leaves before this one
        at, lengths = begin, held[first][0]
        while kept < len(lengths) and at + lengths[kept] + 2 <= start:
            at, kept = at + lengths[kept], kept + 1
        # old boundaries from the edit's end on, walked leaf by leaf
        leaf, piece, old = first, kept, at
        new_lengths, new_counts, scanned = [], [], at

        def step() -> bool:
            nonlocal leaf, piece, old
            while leaf < len(self.leaves) and piece == len(held[leaf][0]):
                if leaf + 1 == len(self.leaves):
                    return False
                leaf, piece = leaf + 1, 0
                held[leaf] = unpack(self.leaves[leaf])
            old += held[leaf][0][piece]
            piece += 1
            return True

        for m in counter.pattern.finditer(changed, at):
            new_lengths.append(m.end() - m.start())
            new_counts.append(counter[m.group()])
            scanned = m.end()
            more = True
            while more and (old < end or old + shift < scanned):
                more = step()
            if old >= end and old + shift == scanned:
                break
        else:  # to the end of the text
            leaf = len(self.leaves) - 1
            held[leaf] = unpack(self.leaves[leaf])
            piece = len(held[leaf][0])
        tail_lengths, tail_counts = held[leaf][0][piece:], held[leaf][1][piece:]
        head_lengths, head_counts = held[first][0][:kept], held[first][1][:kept]
        for i in range(first + 1, leaf + 1):
            self.set_leaf(i, [], [])
        self.set_leaf(first, head_lengths + new_lengths + tail_lengths, head_counts + new_counts + tail_counts)
        if kept + len(new_lengths) + len(tail_lengths) > 2 * LEAF or 2 * self.chars[0] > len(self.leaves):
            self.__init__(*self.pieces())
        return changed, scanned - at


def pack(lengths: list[int], counts: list[int]) -> bytes:
    """A leaf: the type code of the width that its largest number needs, then the lengths, then the counts."""
    most = max(lengths, default=0)  # a pre-token has at most four tokens a character, in bytes
    code = "B" if 4 * most < 1 << 8 else "H" if 4 * most < 1 << 16 else "I"
    return code.encode() + array(code, lengths).tobytes() + array(code, counts).tobytes()


def unpack(leaf: bytes) -> tuple[list[int], list[int]]:
    both = array(chr(leaf[0]))
    both.frombytes(leaf[1:])
    return both[: len(both) // 2].tolist(), both[len(both) // 2 :].tolist()


EMPTY = pack([], [])


def count_pieces(text: str | None, counter: Counter) -> tuple[list[int], list[int]]:
    pieces = counter.pattern.findall(text) if text else []
    return list(map(len, pieces)), list(map(counter.__getitem__, pieces))


def build_trees(docs: DataFrame, ranks_path: str) -> DataFrame:
    """doc_id, text, leaves, sums (of every subtree), n_tokens. Other columns of docs are dropped.

    Null texts have no pre-tokens, as empty ones. A very long text is one tree, held whole by one task, with sums of some 2 * 16 / LEAF bytes a pre-token; no text
    is cut. Equal rows have equal trees; no rows give no rows.
    """
    small_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counter = Counter(ranks_path)
        for b in batches:
            texts = b["text"].tolist()
            for s in text_runs(texts):
                trees = [Tree(*count_pieces(t, counter)) for t in texts[s]]
                kept = [t.dump() for t in trees]
                yield pd.DataFrame({
                    "doc_id": b["doc_id"].iloc[s], "text": texts[s], "leaves": [x for x, _ in kept], "sums": [y for _, y in kept], "n_tokens": [t.total for t in trees],
                })

    return map_batches(docs.select("doc_id", "text"), run, f"doc_id {kind}, {STATE}, n_tokens long")


STATE = "text string, leaves array<binary>, sums binary"


def apply_edits(trees: DataFrame, ranks_path: str) -> DataFrame:
    """trees, as build_trees gives, with edits: array<struct<start, end, new>>, applied one after another to what the ones before left.

    Positions are of characters and are cut to the text; a null array is no edit, a null replacement the empty text. An edit unpacks, splits and packs the leaves that it touches and renews the
    sums above them, however long the text is; only the string itself is put together anew. Returns doc_id, text, leaves, sums, n_tokens (after the edits), n_before, n_encoded (characters). Repeated
    rows are edited each; no rows give no rows.
    """
    kind = trees.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counter = Counter(ranks_path)
        for b in batches:
            rows = []
            for key, text, leaves, sums, before, edits in zip(b["doc_id"], b["text"], b["leaves"], b["sums"], b["n_tokens"], b["edits"], strict=True):
                tree, text, encoded = Tree.load(leaves, sums), text or "", 0
                for e in edits if edits is not None else []:
                    text, n = tree.edit(text, int(e["start"]), int(e["end"]), e["new"] or "", counter)
                    encoded += n
                rows.append((key, text, *tree.dump(), tree.total, before, encoded))
            yield pd.DataFrame(rows, columns=["doc_id", "text", "leaves", "sums", "n_tokens", "n_before", "n_encoded"])

    return map_batches(trees.select("doc_id", "text", "leaves", "sums", "n_tokens", "edits"), run, f"doc_id {kind}, {STATE}, n_tokens long, n_before long, n_encoded long")


def standard_edits(text: str = "text", key: str = "doc_id") -> Column:
    """The edits of the query: at places that hash from the id, 12 characters replaced, 7 taken out, and a phrase put in at the end."""
    n = F.coalesce(F.length(text), F.lit(0))
    at = [F.pmod(F.xxhash64(F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit(k)), n + 1).cast("int") for k in (1, 2)]
    return F.array(
        F.struct(at[0].alias("start"), (at[0] + 12).alias("end"), F.lit("an edited passage").alias("new")),
        F.struct(at[1].alias("start"), (at[1] + 7).alias("end"), F.lit("").alias("new")),
        F.struct((n + 100).alias("start"), (n + 100).alias("end"), F.lit(" and a last line.").alias("new")),
    )


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trees of all documents, kept as a table, then edited. doc_id, n_before, n_tokens, n_chars (after), n_encoded."""
    path = tokenizer_path(RANKS)
    trees = written(build_trees(table(spark, sf_dir, "documents"), path), "trees", "zstd")
    edited = apply_edits(trees.withColumn("edits", standard_edits()), path)
    return edited.select("doc_id", "n_before", "n_tokens", F.length("text").cast("long").alias("n_chars"), "n_encoded")
