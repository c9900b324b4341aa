"""The word shingles of a text as a sorted set of hashes."""

from __future__ import annotations

import numpy as np

SEED = 42


def shingles(text: str | None, width: int) -> np.ndarray:
    """The sorted distinct hashes of the word shingles, words as in ``simhash.fingerprint``; empty without words."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    width = min(width, len(words))
    starts = np.concatenate([[0], ends[: len(words) - width] + 1]).tolist()
    spans = zip(starts, ends[width - 1 :].tolist(), strict=True)
    return np.unique(np.array([xxh64_intdigest(line[a:b], SEED) for a, b in spans], dtype=np.uint64))
