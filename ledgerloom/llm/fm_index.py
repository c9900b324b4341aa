"""FM-index over a sequence of small integers, in numpy.

The suffixes are sorted by as many of their first symbols as a 63-bit number holds,
then by prefix doubling over the groups that are still open.
Ranks in the Burrows-Wheeler transform come from a wavelet tree, stored level by
level with a running count of ones; every ``SAMPLE``-th position of the text is
kept, and an occurrence is located by walking back to one. All queries go
through these steps at once, as arrays.
"""

from __future__ import annotations

import numpy as np

SAMPLE = 16


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Starts of the suffixes of ``text`` (integers from 0) in order; a suffix that is a prefix of another comes first."""
    n = len(text)
    bits = max(1, int(text.max(initial=0) + 1).bit_length())
    step = max(1, 63 // bits)
    text = np.concatenate([text.astype(np.int64) + 1, np.zeros(step, dtype=np.int64)])
    key = text[:n].copy()
    for k in range(1, step):
        key = key << bits | text[k : n + k]
    order = np.argsort(key, kind="stable")
    rank = np.empty(n, dtype=np.int64)
    at = np.arange(n)  # the places in order whose suffixes are not yet told apart

    def renumber(sorted_keys: np.ndarray, places: np.ndarray) -> np.ndarray:
        """New ranks: of each run of equal keys, the place of its first."""
        head = np.ones(len(places), dtype=bool)
        head[1:] = (sorted_keys[1:] != sorted_keys[:-1]).any(axis=1)
        return places[np.maximum.accumulate(np.where(head, np.arange(len(places)), 0))]

    ranked = renumber(key[order][:, None], at) + 1
    rank[order] = ranked
    same = ranked[1:] == ranked[:-1]
    at = np.flatnonzero(np.concatenate([same, [False]]) | np.concatenate([[False], same])) if n else at
    while len(at):
        follow = np.zeros(len(at), dtype=np.int64)
        behind = order[at] + step
        inside = behind < n
        follow[inside] = rank[behind[inside]]
        keys = np.stack([rank[order[at]], follow], axis=1)
        by = np.lexsort((keys[:, 1], keys[:, 0]))
        keys, moved = keys[by], order[at][by]
        order[at] = moved
        new = renumber(keys, at) + 1
        rank[moved] = new
        same = np.zeros(len(at), dtype=bool)
        equal = new[1:] == new[:-1]
        same[1:] |= equal
        same[:-1] |= equal
        at = at[same]
        step *= 2
    return order


class WaveletTree:
    """``rank(symbol, i)``: how often symbols occur among the first i entries."""

    def __init__(self, values: np.ndarray, size: int):
        self.bits = max(1, int(size - 1).bit_length())
        self.ones: list[np.ndarray] = []
        self.zeros: list[int] = []
        for level in range(self.bits - 1, -1, -1):
            bit = (values >> level) & 1
            self.ones.append(np.concatenate([[0], np.cumsum(bit)]).astype(np.int32))
            self.zeros.append(int(len(bit) - bit.sum()))
            values = np.concatenate([values[bit == 0], values[bit == 1]])

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        low, high = np.zeros_like(i), i
        for level, (ones, zeros) in enumerate(zip(self.ones, self.zeros, strict=True)):
            bit = (symbol >> (self.bits - 1 - level)) & 1
            a, b = ones[low], ones[high]
            low, high = np.where(bit, zeros + a, low - a), np.where(bit, zeros + b, high - b)
        return high - low

    def symbol(self, i: np.ndarray) -> np.ndarray:
        out = np.zeros_like(i)
        for ones, zeros in zip(self.ones, self.zeros, strict=True):
            bit = ones[i + 1] - ones[i]
            out = 2 * out + bit
            i = np.where(bit, zeros + ones[i], i - ones[i])
        return out


class FMIndex:
    """Index of ``text`` (integers 1 to size - 1; 0 is the end mark that it adds)."""

    def __init__(self, text: np.ndarray, size: int):
        text = np.concatenate([text, [0]]).astype(np.int64)
        order = suffix_array(text)
        self.n = len(text)
        self.tree = WaveletTree(text[order - 1], size)
        self.less = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=size))])
        self.kept = np.where(order % SAMPLE == 0, order, -1)

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row intervals [first, last) of each pattern; ``patterns`` is padded on the left."""
        first = np.zeros(len(patterns), dtype=np.int64)
        last = np.full(len(patterns), self.n, dtype=np.int64)
        width = patterns.shape[1] if len(patterns) else 0
        for back in range(1, width + 1):
            go = np.flatnonzero((lengths >= back) & (first < last))
            symbol = patterns[go, width - back]
            first[go] = self.less[symbol] + self.tree.rank(symbol, first[go])
            last[go] = self.less[symbol] + self.tree.rank(symbol, last[go])
        return first, np.maximum(first, last)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """The text positions of rows."""
        out, walked = self.kept[rows], np.zeros(len(rows), dtype=np.int64)
        rows = rows.copy()
        open_ = np.flatnonzero(out < 0)
        while len(open_):
            symbol = self.tree.symbol(rows[open_])
            rows[open_] = self.less[symbol] + self.tree.rank(symbol, rows[open_])
            walked[open_] += 1
            out[open_] = self.kept[rows[open_]]
            open_ = open_[out[open_] < 0]
        return out + walked
