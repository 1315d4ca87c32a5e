"""Packing: placements against the sums of squares themselves, ids against the tokenizers library, all ids once, nothing padded."""

import random
import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docloom.llm import packing
from docloom.llm.tokenfile import tokenizer_path

PATH = tokenizer_path(packing.TOKENIZER)


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


TEXTS = ["", "a", "a b", " a", "a ", "a  b", "a\nb", "a\n\nb", "a \nb", "a\n b", "\n", " ", "a\tb  c", "it's\nhe'll 123 45,6", "a\0b", "\0", "a\xa0b c", "a \xa0 b", "漢字 漢字。\n漢字", "é É à", "x<|endoftext|>\ny <|endoftext|> z", "a\x1cb \x1c c", "a\r\nb", "a\x85b c", "#### $$$ |||", "a " * 500]


def check(library, texts):
    encoder = packing.ByteEncoder(PATH, 0, most=50)
    for _ in range(2):  # the second time from what is kept
        flat, counts = encoder.encode(texts)
        at = 0
        for t, n in zip(texts, counts.tolist(), strict=True):
            assert flat[at : at + n].tolist() == [*library.encode(t or "", add_special_tokens=False).ids, 0], repr(t)
            at += n
        assert at == len(flat)


def test_ids_are_the_librarys(library):
    check(library, [*TEXTS, None])
    rng = random.Random(1)
    parts = ["a", "Bc", "é", "Àß÷ß", "\xad", "í", "word", ".", ",", "Ña", "à", "漢", " ", "  ", "\n", "\t", "\r\n", "\xa0", "'s", "'", "12", ".", "!?", "<|endoftext|>", "\0", "　", "<|"]
    check(library, ["".join(rng.choice(parts) for _ in range(rng.randrange(12))) for _ in range(3000)])


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text(max_size=20), max_size=5))
def test_ids_of_any_text(library, texts):
    check(library, [t.encode("utf-8", "ignore").decode() for t in texts])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=80))
def test_levels_minimise_the_sum_of_squares(sizes):
    width = 16
    packer = packing.Packer(width, 10**9)
    counts = [0] * (width + 1)
    for i, n in enumerate(sizes):
        list(packer.add((i, n), np.zeros(n, np.uint32)))
        size = n % width
        if not size:
            continue

        def after(level, size=size):
            new = list(counts)
            new[level] -= level > 0
            new[level + size] += level + size < width
            return sum(c * c for c in new[1:width]), -level

        level = min((h for h in range(width - size + 1) if h == 0 or counts[h]), key=after)
        counts[level] -= level > 0
        counts[level + size] += level + size < width
        assert packer.levels.counts[1:width].tolist() == counts[1:width] and packer.n_open == sum(counts[1:width])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 70), max_size=60), st.integers(1, 12))
def test_packer_keeps_every_id_once_and_pads_nothing(sizes, most_open):
    width, packer = 16, packing.Packer(16, most_open)
    docs = [np.arange(n, dtype=np.uint32) + 100 * i for i, n in enumerate(sizes)]
    out = []
    for i, d in enumerate(docs):
        out += list(packer.add((i, len(d)), d))
        assert packer.n_open <= most_open
    out += list(packer.end())
    got = {}
    for sequence in out:
        fill = sum(len(p[2]) for p in sequence)
        assert fill == width or (fill < width and fill & (fill - 1) == 0)
        for (i, _), start, ids in sequence:
            assert len(ids)
            for k, x in enumerate(ids.tolist()):
                assert (i, start + k) not in got
                got[i, start + k] = x
    assert got == {(i, k): x for i, d in enumerate(docs) for k, x in enumerate(d.tolist())}


def pieces_by_sequence(rows):
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append(r)
    return {k: sorted(v, key=lambda r: r.offset) for k, v in by.items()}


@pytest.mark.parametrize("most_open", [1, 8, packing.MOST_OPEN])
def test_pieces(docs, corpus, library, most_open):
    stored = packing.pack(docs.select("*", F.lit("clash").alias("part"), F.lit("clash").alias("length"), F.lit("clash").alias("offset")), PATH, most_open=most_open)
    numbered = packing.numbered(stored)
    rows = numbered.collect()
    by = pieces_by_sequence(rows)
    assert sorted(by) == list(range(len(by)))
    whole = {r.sequence_id: r.ids for r in packing.sequences(numbered).collect()}
    for k, own in by.items():
        assert [r.offset for r in own] == [sum(r.length for r in own[:i]) for i in range(len(own))]
        assert bytes(whole[k]) == b"".join(bytes(r.ids) for r in own) and len(whole[k]) <= 2 * packing.WIDTH
    for r in rows:
        ids = struct.unpack(f"<{r.length}H", r.ids)
        assert r.ids_crc32 == zlib.crc32(struct.pack(f"<{r.length}I", *ids))
    # documents from their pieces: those of one id and size may have been mixed up, so as sorted lists of ids
    found = sorted((repr(r.doc_id), r.doc_tokens, r.start, struct.unpack(f"<{r.length}H", r.ids)) for r in rows)
    want = [(repr(i), [*library.encode(t or "", add_special_tokens=False).ids, 0]) for i, t, *_ in corpus]
    assert sum(r[1] for r in {(r[0], r[1], r[2]): r for r in found if r[2] == 0}.values()) > 0
    assert sorted((k, n) for k, n, s, _ in found if s == 0) == sorted((k, len(ids)) for k, ids in want)
    once = {k: ids for k, ids in want if [x[0] for x in want].count(k) == 1}
    for k, ids in once.items():
        mine = sorted((s, x) for key, _, s, x in found if key == k)
        assert [s for s, _ in mine] == [sum(len(x) for _, x in mine[:i]) for i in range(len(mine))] and [x for _, p in mine for x in p] == ids
    fills = packing.fills(numbered).collect()
    assert all(r.padded == r.fill for r in fills) and sum(r.fill for r in fills) == sum(len(x) for _, x in want)


def test_none_and_refusals(docs, empty):
    assert packing.numbered(packing.pack(empty, PATH)).count() == 0
    with pytest.raises(ValueError):
        packing.pack(docs, PATH, width=1000)
    with pytest.raises(Exception, match="fit"):
        packing.pack(docs, PATH, id_bytes=1)
