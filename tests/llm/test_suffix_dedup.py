"""Exact substring deduplication against counting every window."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from ledgerloom.llm import suffix_dedup


def slow(texts, length=200):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + length] for b in raw for i in range(len(b) - length + 1))
    out = []
    for b in raw:
        gone = np.zeros(len(b) + 2, dtype=np.int64)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i] += 1
                gone[i + length] -= 1
        gone = np.cumsum(gone)[: len(b)] > 0
        flags = np.concatenate([[0], gone.astype(int), [0]])
        out.append((len(b), int(gone.sum()), int((np.diff(flags) == 1).sum()), hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone])).hexdigest()))
    return out


def fixture():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdeé ") for _ in range(rng.randint(2, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passage, base = prose(60), prose(300)
    texts = [None, "", "short", "x" * 199, "x" * 200, "y" * 201, "z" * 5000, base, base, "s" + base[5:], prose(20) + passage + prose(30)]
    texts += [prose(rng.randint(5, 40)) + passage[rng.randint(0, 30) :] + prose(20) for _ in range(12)]
    texts += [base[:400] + prose(3) + base[450:900] + "!" + base[901:], passage[:199] + "#", "\0" * 450 + passage, ("ab" * 150) + prose(9) + ("ab" * 150)]
    texts += [passage + passage, "k" * 150 + passage + "k" * 150, *[base[:700] + f" edit {i} " + base[720:] for i in range(15)]]
    return texts


@pytest.mark.parametrize("hot, meet, slice_", [(8192, 16384, 1 << 22), (6, 16384, 1 << 22), (8192, 8, 900)])
def test_against_all_windows(spark, monkeypatch, hot, meet, slice_):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    monkeypatch.setattr(suffix_dedup, "MEET", meet)
    monkeypatch.setattr(suffix_dedup, "SLICE", slice_)
    texts = fixture()
    df = spark.createDataFrame([(i if i != 7 else None, t, "clash", 1) for i, t in enumerate(texts)], "doc_id long, text string, sha string, n_removed int")
    out = {r.doc_id: (r.n_bytes, r.n_removed, len(r.spans) // 2, r.kept_sha256) for r in suffix_dedup.repeated_spans(df).collect()}
    want = {i if i != 7 else None: w for i, w in enumerate(slow(texts))}
    assert out == want
    assert suffix_dedup.repeated_spans(df.limit(0)).count() == 0


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    out = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.op9_suffix_dedup(spark, sf).collect()}
    assert out == dict(zip([i for i, _ in rows], slow([t for _, t in rows]), strict=True))
    assert any(v[1] for v in out.values())
