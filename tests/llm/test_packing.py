"""Packing: histogram packing, ranks and whole documents."""

from collections import defaultdict
from zlib import crc32

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from ledgerloom.llm import encoding, packing

PATH = encoding.tokenizer_path("byte_bpe_50k.json")


def test_shortest_pack_first_by_hand():
    # 6 opens a pack; the first 5 opens another, the second fills it; 4 fills the pack of 6; 3 opens a third
    assert sorted(packing.shortest_pack_first({6: 1, 5: 2, 4: 1, 3: 1}, 10)) == [((3,), 1), ((5, 5), 1), ((6, 4), 1)]
    # both packs take a 3, the shorter one (5) first; the 1 goes to the pack with more room
    assert sorted(packing.shortest_pack_first({6: 1, 5: 1, 3: 2, 1: 1}, 10)) == [((5, 3, 1), 1), ((6, 3), 1)]


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 50)))
def test_patterns_hold_every_piece(counts):
    patterns = packing.shortest_pack_first(counts, 64)
    held = defaultdict(int)
    for pattern, n in patterns:
        assert sum(pattern) <= 64 and n > 0
        for length in pattern:
            held[length] += n
    assert dict(held) == counts
    spans = defaultdict(list)
    for length, lo, hi, _, _ in packing.rank_intervals(patterns):
        spans[length].append((lo, hi))
    for length, found in spans.items():
        ends = [0, *(hi for _, hi in sorted(found))]
        assert [lo for lo, _ in sorted(found)] == ends[:-1] and ends[-1] == counts[length]


def verify(rows, texts):
    """Every id in exactly one piece, offsets gapless, nothing over 1024."""
    tok = Tokenizer.from_file(PATH)
    pieces, packs = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        packs[r.sequence_id].append((r.offset, r.length))
    assert set(pieces) == set(texts)
    for i, own in pieces.items():
        ids = np.array([*tok.encode(texts[i] or "", add_special_tokens=False).ids, 0], dtype="<u4")
        at = 0
        for r in sorted(own, key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    for own in packs.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 1024
    return sum(1024 - sum(n for _, n in own) for own in packs.values()) / (1024 * len(packs))


def test_hard_cases(spark):
    texts = {1: None, 2: "", 3: "a b " * 4000, 4: "x", 5: "x", 6: "é" * 3000, None: "lost id"}
    df = spark.createDataFrame([(k, v, 9, 9) for k, v in texts.items()], "doc_id long, text string, start long, length long")
    verify(packing.pack_documents(df, PATH).collect(), texts)
    assert packing.pack_documents(df.limit(0), PATH).count() == 0
    twice = packing.pack_documents(df.where("doc_id = 4").union(df.where("doc_id = 4")), PATH).collect()
    assert sorted((r.sequence_id, r.offset) for r in twice) == [(0, 0), (0, 2)]


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert verify(packing.op8_packing(spark, sf).collect(), texts) < 0.1
