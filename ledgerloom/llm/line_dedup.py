"""Fuzzy line deduplication: one line of each connected group of near-equal lines stays.

Lines are normalised (lower case, ASCII punctuation as space) and get a 64-bit
SimHash over their distinct words. Lines of an edit similarity of 0.8 differ in up to
a fifth of their words, that is in about 13 of the 64 bits, so no few blocks of
those bits stay equal. The blocks of the pigeonhole are blocks of words instead: a
line's distinct words are dealt out by their hashes to blocks of about ``WORDS`` = 4, a
changed word changes at most two blocks, and lines meet under each block
that is equal; a line's blocks all count, however many it has. Short lines meet under their words less any one.
Of those that meet, pairs within ``BITS`` = 13 bits and a fifth of their length
are candidates. That join carries numbers only; the texts of just those
lines then meet and are linked if their edit similarity is at least ``SIMILARITY``.
A pair is compared under the first key that its lines have in common, and only while it
isn't connected there yet, so a large group costs about one comparison a line. Keys first meet as packed numbers, which leaves
the lines with a possible partner. Of those a key's rows are counted before their texts meet, and
over ``CHUNK`` of them are dealt out as pairs of chunks: no task gets all texts of a key
and no pair is lost. What is lost are pairs that share no block; tests measure it.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterator
from itertools import accumulate, chain, islice, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import components, store

BITS = 13
WORDS = 4  # of a block, about
MOST = 1 << 10  # blocks that a line's words are dealt out to; with more words the blocks get larger
LEAST = 2  # words in such a block
SHORT = 9  # distinct words up to which a line meets others under its words less any one
NEAR = 1.3  # a line with that many times the words of a block size, or fewer, meets under the size below as well
SIMILARITY = 0.8
CHUNK = 4096  # rows of one key that meet in one task
PIECE = 1 << 19  # bytes of lines hashed at once, so few that the arrays stay in the processor's cache
LANE = 255  # words counted in one byte
KINDS = 32  # of letters that are counted to tell lines apart
LETTERS = 1 << 20  # of lines whose letters are counted at once, about
DEALT = 1 << 20  # keys that are dealt out to tasks at once, about
PROBES = 1 << 20  # keys that are looked up at once, about
OPEN = 256  # pairs whose distances are measured together
BITS_HELD = 1 << 16  # of the bit vectors that are side by side

_BASE = 0x9E3779B97F4A7C15
#: ASCII punctuation and control characters are spaces; line breaks and all else stay.
_TABLE = bytes(c if c > 127 or c == 10 or 48 <= c <= 57 or 97 <= c <= 122 or 65 <= c <= 90 else 32 for c in range(256))
#: Eight counters of a byte each: counter k is bit k.
_SPREAD = np.array([sum(((b >> k) & 1) << (8 * k) for k in range(8)) for b in range(256)], dtype=np.uint64)


def normalise(text: str | None) -> list[bytes]:
    """The normalised lines of a text, as many as it has; b"" for a line without words."""
    raw = (text or "").lower().encode("utf-8", "surrogatepass").translate(_TABLE)
    return [b" ".join(line.split()) for line in raw.split(b"\n")]


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def _powers(base: int, n: int) -> np.ndarray:
    """base ** 0 to base ** (n - 1), modulo 2 ** 64."""
    out = np.full(n, base, dtype=np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


class Hasher:
    """SimHashes and block keys of normalised lines.

    Where digits make up a fifth of a line or less, a digit counts as 0: lines that
    are then equal are similar as well. In other lines digits stand for themselves.
    """

    def __init__(self):
        self.up = self.down = np.zeros(0, dtype=np.uint64)

    def word_hashes(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """A mixed polynomial hash of each word's bytes, the same wherever the word stands."""
        if len(self.up) < len(data) + 1:
            self.up = _powers(_BASE, len(data) + 1)
            self.down = _powers(pow(_BASE, -1, 1 << 64), len(data) + 1)
        sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.up[: len(data)], out=sums[1:])
        return _mix((sums[ends] - sums[starts]) * self.down[starts])

    def hashes(self, lines: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(fingerprints, characters, keys, ends): of lines that have a word; a line's keys end at its entry in ``ends``."""
        none = np.zeros(0, dtype=np.uint64)
        out, at = [(none, none.astype(np.int32), none, none.astype(np.int64))], 0
        while at < len(lines):
            upto, held = at, 0
            while upto < len(lines) and (upto == at or held + len(lines[upto]) < PIECE):
                held += len(lines[upto]) + 1
                upto += 1
            out.append(self._piece(lines[at:upto]))
            at = upto
        ends, before = [], 0
        for _, _, keys, own in out:
            ends.append(own + before)
            before += len(keys)
        return *(np.concatenate([x[i] for x in out]) for i in range(3)), np.concatenate(ends)

    def _piece(self, lines: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        data = np.frombuffer(b"\n".join(lines) + b"\n", dtype=np.uint8)
        last = np.flatnonzero(data == 10)
        begin = np.concatenate([[0], last[:-1] + 1])
        digit = (data >= 48) & (data <= 57)
        digits = np.add.reduceat(digit, begin, dtype=np.int64)
        size = np.add.reduceat((data & 0xC0) != 0x80, begin, dtype=np.int64) - 1  # code points, without the break
        folds = np.repeat(5 * digits <= size, last - begin + 1)
        data = np.where(digit & folds, np.uint8(48), data)
        ends = np.flatnonzero((data == 32) | (data == 10))
        starts = np.concatenate([[0], ends[:-1] + 1])
        line = np.cumsum(data[ends] == 10) - (data[ends] == 10)
        # a line's words, each once: its number over 40 bits of the word's hash
        words = np.sort(line.astype(np.uint64) << np.uint64(40) | self.word_hashes(data, starts, ends) >> np.uint64(24))
        words = words[np.concatenate([[True], words[1:] != words[:-1]])]
        mixed = _mix(words & np.uint64((1 << 40) - 1))
        octets = mixed.astype("<u8").view(np.uint8).reshape(-1, 8)
        count = np.bincount((words >> np.uint64(40)).astype(np.int64), minlength=len(lines))
        first = np.cumsum(count) - count
        parts = -(-count // LANE)  # a line's words, LANE at a time
        head = np.cumsum(parts) - parts
        cuts = np.repeat(first, parts) + LANE * (np.arange(int(parts.sum())) - np.repeat(head, parts))
        lanes = np.stack([np.add.reduceat(_SPREAD[octets[:, k]], cuts) for k in range(8)], axis=1)
        ones = lanes.astype("<u8").view(np.uint8).reshape(len(cuts), 64)
        if len(cuts) > len(lines):
            ones = np.add.reduceat(ones, head, axis=0, dtype=np.int64)
        bits = 2 * ones.astype(np.int64) > count[:, None]
        fp = np.packbits(bits, axis=1, bitorder="little").view("<u8").ravel()
        return fp, size.astype(np.int32), *block_keys(words, mixed, count, first)


def block_keys(
    words: np.ndarray, mixed: np.ndarray, count: np.ndarray, first: np.ndarray, width: int = WORDS, most: int = MOST,
) -> tuple[np.ndarray, np.ndarray]:
    """(keys, ends): the keys under which lines meet, from their sorted distinct words (line number over 40 bits of hash).

    ``width``: words of a block, about; ``most``: blocks of a line, a power of two. Beyond ``width * most`` words blocks get larger; none is left out.
    """
    line = (words >> np.uint64(40)).astype(np.int64)
    owner, keys = [], []

    def add(lines: np.ndarray, kind: int | np.ndarray, sums: np.ndarray) -> None:
        owner.append(lines)
        keys.append(_mix(sums + np.asarray(kind).astype(np.uint64) * np.uint64(_BASE)))

    sums = np.add.reduceat(mixed, first) if len(first) else mixed
    short = count <= SHORT
    add(np.flatnonzero(short), 1, sums[short])
    less = np.flatnonzero((short & (count > 1))[line])
    add(line[less], 1, sums[line[less]] - mixed[less])
    level = np.floor(np.log2(np.maximum(count, 1) / width)).astype(np.int64).clip(1, most.bit_length() - 1)
    level[count < SHORT] = 0
    lower = np.where((level > 1) & (count < NEAR * width * 2.0**level), level - 1, 0)
    for size in (level, lower):
        own = size[line]
        block = (words & np.uint64((1 << 40) - 1)) >> (40 - own).astype(np.uint64)
        at = np.flatnonzero(own > 0)
        if not len(at):
            continue
        own, block, which = own[at], block[at].astype(np.int64), line[at]
        opens = np.flatnonzero(np.concatenate([[True], (block[1:] != block[:-1]) | (which[1:] != which[:-1])]))
        full = np.diff(np.append(opens, len(at))) >= LEAST
        add(which[opens][full], ((own * most + block) + 2)[opens][full], np.add.reduceat(mixed[at], opens)[full])
    every = np.concatenate(owner)
    by = np.argsort(every, kind="stable")
    return np.concatenate(keys)[by], np.searchsorted(every[by], np.arange(len(count)), side="right")


def edit_distance(a: str, b: str, most: int | None = None) -> int:
    """Levenshtein distance, by bit vectors over the shorter text; any larger number once it must be over ``most``."""
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return len(b)
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    full, top = (1 << len(a)) - 1, 1 << (len(a) - 1)
    plus, minus, score = full, 0, len(a)
    spare = len(b) + (len(b) if most is None else most)  # score may fall by one with each letter left
    for c in b:
        eq = at.get(c, 0)
        x = eq | minus
        d = (((x & plus) + plus) ^ plus) | x
        up, down = minus | (full & ~(d | plus)), d & plus
        score += bool(up & top) - bool(down & top)
        spare -= 1
        if score > spare:
            return score
        up, down = (up << 1 | 1) & full, down << 1 & full
        plus, minus = down | (full & ~((d & full) | up)), up & d
    return score


def edit_distances(pairs: list[tuple[str, str]]) -> list[int]:
    """The Levenshtein distances of pairs, by the bit vectors of ``edit_distance`` side by side in one integer."""
    full, low, at, ends, steps = 0, 0, 0, [], []
    for k, (a, b) in enumerate(pairs):
        if len(a) > len(b):
            a, b = b, a
        width = len(a) // 8 + 1  # bytes, with a bit at least that takes what is carried
        where: dict[str, int] = {}
        for i, c in enumerate(a):
            where[c] = where.get(c, 0) | 1 << i
        eq, none = {c: x.to_bytes(width, "little") for c, x in where.items()}, bytes(width)
        steps.append(chain([eq.get(c, none) for c in b], repeat(none)))
        full |= ((1 << len(a)) - 1) << at
        low |= bool(a) << at
        ends.append((len(b), at, (1 << len(a)) - 1, k))
        at += 8 * width
    out, plus, minus, done = [0] * len(pairs), full, 0, 0
    for n, at, mask, k in sorted(ends):
        for step in islice(zip(*steps, strict=True), n - done):
            eq = int.from_bytes(b"".join(step), "little")
            x = eq | minus
            d = (((x & plus) + plus) ^ plus | x) & full
            up, down = ((minus | (full ^ (d | plus))) << 1 | low) & full, (d & plus) << 1 & full
            plus, minus = down | (full ^ (d | up)), up & d
        done = n
        out[k] = n + (plus >> at & mask).bit_count() - (minus >> at & mask).bit_count()
    return out


def _anchored(x: list[str], y: list[str]) -> int:
    """An upper bound of the distance of two lists of words: those that occur once in both stay, as many as have one order, what is between them is replaced, word for word where both have as many."""
    once: dict[str, int] = {}
    for j, w in enumerate(y):
        once[w] = -1 if w in once else j
    seen: set[str] = set()
    twice = {w for w in x if w in seen or seen.add(w)}
    tails: list[int] = []  # places in y that end the rising runs of each length
    ends: list[int] = []
    where: list[tuple[int, int, int]] = []  # (i, j, the one before in its run)
    for i, w in enumerate(x):
        j = once.get(w, -1)
        if j >= 0 and w not in twice:
            k = bisect_left(tails, j)
            where.append((i, j, ends[k - 1] if k else -1))
            tails[k : k + 1], ends[k : k + 1] = [j], [len(where) - 1]
    p, q = ([0, *accumulate(len(w) + 1 for w in words)] for words in (x, y))

    def between(i: int, j: int, to_i: int, to_j: int) -> int:
        if to_i - i == to_j - j:
            return sum(max(len(v), len(w)) for v, w in zip(x[i:to_i], y[j:to_j], strict=True) if v != w)
        return max(p[to_i] - p[i], q[to_j] - q[j])

    i, j, cost, at = len(x), len(y), 0, ends[-1] if ends else -1
    while at >= 0:
        a, b, at = where[at]
        if (i, j) != (a + 1, b + 1):
            cost += between(a + 1, b + 1, i, j)
        i, j = a, b
    return cost + between(0, 0, i, j)


def _bounded(a: str, b: str, most: int) -> tuple[str, str] | bool:
    """Whether the distance is at most ``most``, or where the bounds leave that open, what is left to measure.

    Common first and last words don't count; changing word for word where both
    have as many, and keeping what both have once, bound the distance from above.
    """
    if abs(len(b) - len(a)) > most:
        return False
    x, y = a.split(" "), b.split(" ")
    n, i, j = min(len(x), len(y)) - 1, 0, 0
    while i < n and x[i] == y[i]:
        i += 1
    while j < n - i and x[-1 - j] == y[-1 - j]:
        j += 1
    x, y = x[i : len(x) - j], y[i : len(y) - j]
    if len(x) == len(y) and sum(max(len(p), len(q)) for p, q in zip(x, y, strict=True) if p != q) <= most:
        return True
    if _anchored(x, y) <= most:
        return True
    a, b = " ".join(x), " ".join(y)
    return max(len(a), len(b)) <= most or (a, b)


def _most(a: str, b: str, least: float) -> int:
    return int((1 - least) * max(len(a), len(b)) + 1e-9)


def similar(a: str, b: str, least: float = SIMILARITY) -> bool:
    """Whether 1 - distance / longer length is at least ``least``, for words joined by spaces; only what the bounds leave open is measured."""
    most = _most(a, b, least)
    found = _bounded(a, b, most)
    return found if isinstance(found, bool) else edit_distance(*found, most) <= most


def _doc_hash(text: str):
    return F.xxhash64(F.coalesce(F.col(text), F.lit("\0")))


def _line_rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, h, line, key binary, fp long, size int, at binary) of every line that has a word; ``h`` hashes the whole text, ``at`` are the bytes of its keys, eight each."""
    rows = docs.select(F.col(id_col).alias("id"), _doc_hash(text_col).alias("h"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest

        hasher = Hasher()
        for batch in batches:
            which, number, lines, held = [], [], [], 0
            for i, held_text in enumerate(batch.column(2)):
                text = held_text.as_py()
                for n, line in enumerate(normalise(text)):
                    if line:
                        which.append(i)
                        number.append(n)
                        lines.append(line)
                held += len(text or "")
                if lines and (held >= PIECE or i + 1 == batch.num_rows):
                    take = pa.array(which, pa.int64())
                    fp, size, keys, ends = hasher.hashes(lines)
                    offsets = pa.py_buffer(8 * np.concatenate([[0], ends]).astype(np.int32))
                    yield pa.RecordBatch.from_arrays([
                        batch.column(0).take(take), batch.column(1).take(take), pa.array(number, pa.int32()),
                        pa.array([xxh3_128_digest(x) for x in lines], pa.binary()), pa.array(fp.view(np.int64)), pa.array(size),
                        pa.Array.from_buffers(pa.binary(), len(lines), [None, offsets, pa.py_buffer(np.ascontiguousarray(keys))]),
                    ], ["id", "h", "line", "key", "fp", "size", "at"])
                    which, number, lines, held = [], [], [], 0

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, h long, line int, key binary, fp long, size int, at binary")


def _texts_of(docs: DataFrame, id_col: str, text_col: str, wanted: DataFrame) -> DataFrame:
    """(key, fp, norm) of the lines in ``wanted`` (key, fp, first), from their documents only."""
    lists = wanted.groupBy(F.col("first.id").alias("__id"), F.col("first.h").alias("__h")).agg(
        F.collect_list(F.struct(F.col("first.line").alias("line"), "key", "fp")).alias("lines")
    )
    rows = docs.select(F.col(id_col).alias("id"), _doc_hash(text_col).alias("h"), F.col(text_col).alias("text"))
    # an exchange at any size, so that what is moved grows with the input and no list of a large corpus is broadcast; the lists are hashed, no text is sorted
    met = rows.join(lists.hint("shuffle_hash"), F.col("id").eqNullSafe(F.col("__id")) & (F.col("h") == F.col("__h"))).select("text", "lines")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, fp, norm = [], [], []
            for text, lines in zip(batch.column(0), batch.column(1), strict=True):
                own = text.as_py().split("\n")
                for x in lines.as_py():
                    key.append(x["key"])
                    fp.append(x["fp"])
                    norm.append(normalise(own[x["line"]])[0])
            yield pa.RecordBatch.from_arrays([pa.array(key, pa.binary()), pa.array(fp, pa.int64()), pa.array(norm, pa.binary()).cast(pa.string())], ["key", "fp", "norm"])

    return met.mapInArrow(run, "key binary, fp long, norm string")


def _pairs(group: np.ndarray, size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions (i, j) of all pairs in equal groups of sorted rows, by their distance."""
    at = np.flatnonzero(group[1:] == group[:-1]) if size > 1 else np.zeros(0, dtype=np.int64)
    step = 1
    while len(at):
        yield at, at + step
        step += 1
        at = at[at + step < size]
        at = at[group[at] == group[at + step]]


def _whole_groups(names: tuple[str, ...], handle: Callable[[np.ndarray, pa.Table], pa.RecordBatch]):
    """Arrow function over rows sorted by ``names``: runs of whole groups at a time, the last carried on."""

    def changes(rows: pa.Table) -> np.ndarray:
        out = np.zeros(len(rows), dtype=bool)
        for n in names:
            x = rows[n].to_numpy()
            out[1:] |= x[1:] != x[:-1]
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: pa.Table | None = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            kept = rows if kept is None else pa.concat_tables([kept, rows])
            kept = kept.combine_chunks()
            new = changes(kept)
            cut = int(np.flatnonzero(new)[-1]) if new.any() else 0
            if cut:
                yield handle(np.cumsum(new[:cut]), kept.slice(0, cut))
            kept = kept.slice(cut)
        if kept is not None and len(kept):
            yield handle(np.cumsum(changes(kept)), kept)

    return run


def _near(fp: np.ndarray, size: np.ndarray, i: np.ndarray, j: np.ndarray, least: float) -> np.ndarray:
    """Which pairs (i, j) may be similar, by their fingerprints and lengths."""
    most = (1 - least) * np.maximum(size[i], size[j]) + 1e-9
    return (np.bitwise_count(fp[i] ^ fp[j]) <= BITS) & (np.abs(size[i] - size[j]) <= most)


#: A line under one of its keys, as tasks get it from others; ``k`` tells lines of one fingerprint apart.
_PLACE = np.dtype([("at", "<i8"), ("fp", "<u8"), ("k", "<i8"), ("size", "<i4")])


def _deal(tasks: int):
    def deal(rows: pa.Table) -> pa.RecordBatch:
        rows = rows.take(pa.array(np.unique(rows["k"].to_numpy(), return_index=True)[1]))
        lists = rows["at"].to_pylist()
        row = np.repeat(np.arange(len(lists)), [len(x) // 8 for x in lists])
        at = np.frombuffer(b"".join(lists), dtype="<i8")
        task = (at.view(np.uint64) >> np.uint64(32)) * np.uint64(tasks) >> np.uint64(32)
        by = np.argsort(task.astype(np.int32), kind="stable")
        places = np.empty(len(at), dtype=_PLACE)
        places["at"] = at[by]
        for n in ("fp", "k", "size"):
            places[n] = rows[n].to_numpy().astype(_PLACE[n])[row[by]]
        ends = np.searchsorted(task[by], np.arange(1, tasks + 1, dtype=np.uint64) - np.uint64(1), side="right")
        out = [places[lo:hi].tobytes() for lo, hi in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(np.arange(tasks, dtype=np.int32)), pa.array(out, pa.binary())], ["task", "places"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(task, places): the lines' keys for each task, which has a range of keys; repeats of a line are left out where they are seen."""
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += pc.sum(pc.binary_length(batch["at"])).as_py() or 0
            if n >= 8 * DEALT:
                yield deal(pa.Table.from_batches(held))
                held, n = [], 0
        if n:
            yield deal(pa.Table.from_batches(held))

    return run


def _partners(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(fp, at): lines that have a possible partner under a key, from the places of the task's keys; of a key with over CHUNK lines all, which are compared later."""
        places = np.frombuffer(b"".join(x for b in batches for x in b["places"].to_pylist()), dtype=_PLACE)
        if not len(places):
            return
        at = places["at"].copy()
        by = np.argsort(at)
        same = at[by][1:] == at[by][:-1]
        again = by[np.concatenate([same, [False]]) | np.concatenate([[False], same])]  # most keys have one line
        at, fp, size, k = (places[n][again] for n in ("at", "fp", "size", "k"))
        by = np.lexsort((k, fp, at))
        at, fp, size, k = (x[by] for x in (at, fp, size, k))
        new = np.ones(len(at), dtype=bool)
        new[1:] = (at[1:] != at[:-1]) | (fp[1:] != fp[:-1]) | (k[1:] != k[:-1])
        at, fp, size = at[new], fp[new], size[new]
        opens = np.ones(len(at), dtype=bool)
        opens[1:] = at[1:] != at[:-1]
        group = np.cumsum(opens) - 1
        found = (np.bincount(group) > CHUNK)[group] if len(at) else opens
        few = np.flatnonzero(~found)
        for i, j in _pairs(group[few], len(few)):
            i, j = few[i], few[j]
            near = _near(fp, size, i, j, least)
            found[i[near]] = True
            found[j[near]] = True
        yield pa.RecordBatch.from_arrays([pa.array(fp[found].view(np.int64)), pa.array(at[found])], ["fp", "at"])

    return run


def _letters(lines: pa.ChunkedArray) -> np.ndarray:
    """How often each line has the letters of ``KINDS`` kinds, counted for some lines at once."""
    size = pc.utf8_length(lines.combine_chunks()).to_numpy().astype(np.int64)
    out = np.zeros((len(size), KINDS), dtype=np.int32)
    part = np.cumsum(size) // LETTERS
    bounds = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1], [True]])) if len(size) else np.zeros(1, dtype=np.int64)
    for i, j in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        codes = np.frombuffer("".join(lines.slice(i, j - i).to_pylist()).encode("utf-32-le", "surrogatepass"), dtype="<u4") % KINDS
        row = np.repeat(np.arange(j - i, dtype=np.uint32) * KINDS, size[i:j])
        out[i:j] = np.bincount(row + codes, minlength=(j - i) * KINDS).reshape(-1, KINDS)
    return out


class _Earlier:
    """Whether two rows have a key in common that is less than the one they meet under."""

    def __init__(self, lists: pa.ListArray, here: np.ndarray):
        row = np.repeat(np.arange(len(here)), pc.list_value_length(lists).to_numpy().astype(np.int64))
        keys = lists.flatten().to_numpy()
        less = keys < here[row]
        row = row[less]
        every, self.key = np.unique(keys[less], return_inverse=True)
        self.kinds = max(len(every), 1)
        self.codes = np.sort(row * self.kinds + self.key)
        self.count = np.bincount(row, minlength=len(here))
        self.first = np.cumsum(self.count) - self.count
        self.marks = np.zeros(len(here), dtype=np.uint64)
        np.bitwise_or.at(self.marks, row, np.uint64(1) << (_mix(every.view(np.uint64)) >> np.uint64(58))[self.key])

    def __call__(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        out = np.zeros(len(i), dtype=bool)
        open_ = np.flatnonzero(self.marks[i] & self.marks[j])
        fewer = self.count[i[open_]] <= self.count[j[open_]]
        a, b = np.where(fewer, i[open_], j[open_]), np.where(fewer, j[open_], i[open_])
        part = np.cumsum(self.count[a]) // PROBES
        bounds = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1], [True]])) if len(a) else [0]
        for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
            n = self.count[a[lo:hi]]
            pair = np.repeat(np.arange(hi - lo), n)
            own = np.arange(len(pair)) - np.repeat(np.cumsum(n) - n, n) + self.first[a[lo:hi]][pair]
            code = b[lo:hi][pair] * self.kinds + self.key[own]
            at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
            out[open_[lo:hi]] = np.bincount(pair, self.codes[at] == code, hi - lo) > 0
        return out


def _verify(least: float):
    def handle(group: np.ndarray, rows: pa.Table) -> pa.RecordBatch:
        """(a, b): links that connect all similar lines of a group that meet nowhere before it, each line to the least key of those."""
        fp, size, here = rows["fp"].to_numpy().view(np.uint64), rows["size"].to_numpy(), rows["at"].to_numpy()
        counts = _letters(rows["norm"])
        earlier = _Earlier(rows["keys"].combine_chunks(), here)
        label = np.arange(len(fp))

        def find(i: int) -> int:
            while label[i] != i:
                label[i] = label[label[i]]
                i = label[i]
            return i

        def link(p: int, q: int) -> None:
            a, b = find(p), find(q)
            label[max(a, b)] = min(a, b)

        def measure(pairs: list) -> None:
            """Links those of (p, q, most, (text, text)) that are similar, texts of about one length at a time."""
            pairs = sorted((x for x in pairs if find(x[0]) != find(x[1])), key=lambda x: min(map(len, x[3])))
            while pairs:
                n, held = 0, 0
                while n < len(pairs) and (n == 0 or held + min(map(len, pairs[n][3])) <= BITS_HELD):
                    held += min(map(len, pairs[n][3])) + 8
                    n += 1
                part, pairs = pairs[:n], pairs[n:]
                distances = edit_distances([x[3] for x in part]) if n > 1 else [edit_distance(*part[0][3], part[0][2])]
                for (p, q, most, _), distance in zip(part, distances, strict=True):
                    if distance <= most:
                        link(p, q)

        norm = rows["norm"].to_pylist()
        left: list = []
        for i, j in _pairs(group, len(fp)):
            near = np.flatnonzero((label[i] != label[j]) & _near(fp, size, i, j, least))
            apart = np.abs(counts[i[near]] - counts[j[near]]).sum(axis=1)  # an edit changes two of the counts at most
            near = near[apart <= 2 * ((1 - least) * np.maximum(size[i[near]], size[j[near]]) + 1e-9)]
            near = near[~earlier(i[near], j[near])]  # under other keys they meet as well
            for p, q in zip(i[near].tolist(), j[near].tolist(), strict=True):
                if find(p) != find(q):
                    most = _most(norm[p], norm[q], least)
                    found = _bounded(norm[p], norm[q], most)
                    if found is True:
                        link(p, q)
                    elif found:
                        left.append((p, q, most, found))
                        if len(left) >= OPEN:
                            measure(left)
                            left = []
            while (label[label] != label).any():
                label = label[label]
        measure(left)
        while (label[label] != label).any():
            label = label[label]
        # stars of the least key: groups that share lines then agree on most ends, and the components take fewer rounds
        keys = rows["key"].combine_chunks()
        order = pc.sort_indices(keys).to_numpy()
        rank = np.empty(len(order), dtype=np.int64)
        rank[order] = np.arange(len(order))
        least_of = np.full(len(fp), len(fp))
        np.minimum.at(least_of, label, rank)
        least_of = least_of[label]
        linked = np.flatnonzero(least_of != rank)
        return pa.RecordBatch.from_arrays([keys.take(pa.array(linked)), keys.take(pa.array(order[least_of[linked]]))], ["a", "b"])

    return handle


def _meet(rows: DataFrame, counts: DataFrame, spread: str, handle: Callable, schema: str) -> DataFrame:
    """``handle`` over the rows of each ``at`` of ``counts`` (at, n), over all pairs of its chunks if it has several.

    ``counts`` is a stored table, so the join has plain exchanges on both sides, which Spark can split at a hot key.
    """
    g = F.ceil(F.col("n") / CHUNK).cast("int")
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # not fewer for small rows: comparing them is the work
    dealt = (
        rows.join(counts, "at").withColumn("g", g).withColumn("c", F.pmod(F.xxhash64(spread), F.col("g")).cast("int"))
        .select(*rows.columns, "c", F.explode(F.sequence(F.lit(0), F.col("g") - 1)).alias("x"))
        .select(*rows.columns, F.least("c", "x").alias("lo"), F.greatest("c", "x").alias("hi"))
        .repartition(tasks, "at", "lo", "hi").sortWithinPartitions("at", "lo", "hi")
    )
    return dealt.mapInArrow(_whole_groups(("at", "lo", "hi"), handle), schema)


def near_lines(placed: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """(fp, at) of the lines that have a possible partner under a key, from (key, fp, size, at binary); a line may be there more than once."""
    tasks = int(placed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # keys meet as packed numbers, one row for each task and piece of input: a row for each key would be most of the work
    dealt = placed.select("fp", "size", "at", F.xxhash64("key").alias("k")).mapInArrow(_deal(tasks), "task int, places binary")
    near = dealt.repartitionById(tasks, "task").select("places").mapInArrow(_partners(least), "fp long, at long")
    return store.keep(near, "near-lines")


def similar_links(firsts: DataFrame, texts_of: Callable[[DataFrame], DataFrame], least: float = SIMILARITY, wanted: DataFrame | None = None) -> DataFrame:
    """(a, b) keys of similar lines, from distinct (key, fp, size, at, first); ``texts_of(wanted)`` gives (key, fp, norm) of such rows.

    ``wanted``: what near_lines() gives for them, where ``firsts`` has no ``at``.
    """
    if wanted is None:
        packed = F.concat_ws("", F.transform("at", lambda x: F.lpad(F.hex(x), 16, "0")))
        wanted = near_lines(firsts.withColumn("at", F.unhex(packed)), least)
    spark = firsts.sparkSession
    wanted, repeated = store.keep(wanted.distinct(), "near-lines"), wanted
    store.drop(repeated)
    store.release(spark)
    lines = firsts.join(wanted.select("fp").distinct().hint("shuffle_hash"), "fp", "left_semi").select("key", "fp", "size", "first")
    texts = store.keep(texts_of(lines).groupBy("key", "fp").agg(F.first("norm").alias("norm")), "near-texts")
    store.release(spark)
    # of keys with the same lines one will do
    members = texts.select("key", "fp").join(wanted, "fp").groupBy("at").agg(
        F.count("*").alias("n"), F.bit_xor(F.xxhash64("key")).alias("x"), F.bit_xor(F.xxhash64("key", F.lit(1))).alias("y")
    )
    counts = store.keep(members.where("n > 1").groupBy("n", "x", "y").agg(F.min("at").alias("at")).select("at", "n"), "near-blocks")
    keys = wanted.join(counts.select("at"), "at").groupBy("fp").agg(F.collect_list("at").alias("keys"))  # a line has few
    met = texts.withColumn("size", F.length("norm")).join(keys, "fp").select("key", "fp", "size", "norm", "keys", F.explode("keys").alias("at"))
    links = store.keep(_meet(met, counts, "key", _verify(least), "a binary, b binary"), "line-links")
    for table in (wanted, texts, counts):
        store.drop(table)
    return links


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = SIMILARITY) -> DataFrame:
    """``docs`` with n_lines, n_removed and kept_text: of each group of near-equal lines all but the first occurrence are gone.

    Lines are parted by \\n. First is the least (id, hash of the text, line number).
    Lines without a word (blank, punctuation only) always stay. A null text has no
    lines and stays null; an empty one has one empty line. Null ids come first.
    Repeated rows (equal id and text) are one document: each is returned, with the
    same lines. Equal texts under other ids lose what the first keeps. Empty table:
    no rows. Columns of ``docs`` with the new names are replaced.
    """
    spark = docs.sparkSession
    lines = store.keep(_line_rows(docs, id_col, text_col), "lines")
    firsts = store.keep(
        lines.groupBy("key").agg(F.min(F.struct("id", "h", "line")).alias("first"), F.first("fp").alias("fp"), F.first("size").alias("size"), F.count("*").alias("n")),
        "distinct-lines",
    )
    store.release(spark)
    wanted = near_lines(lines, least)
    places = store.keep(lines.select("id", "h", "line", "key"), "line-places")  # what is read of them from here on
    store.drop(lines)
    store.release(spark)
    lines = places
    links = similar_links(firsts, lambda near: _texts_of(docs, id_col, text_col, near), least, wanted)
    roots = store.keep(components.components(links), "line-groups")
    store.drop(links)
    store.release(spark)
    # a line that is its own group and occurs once is never asked for
    named = firsts.join(roots.withColumnRenamed("node", "key").hint("shuffle_hash"), "key", "left").where("n > 1 or root is not null")
    named = store.keep(named.select("key", "first", "n", "root"), "line-roots")
    store.drop(roots)
    store.drop(firsts)
    # stored, so that the join has plain exchanges on both sides, which Spark can split at a large group
    least_of = store.keep(named.where("root is not null").groupBy("root").agg(F.min("first").alias("least")), "line-leasts")
    stays = named.join(least_of, "root", "left").select("key", "n", F.coalesce("least", "first").alias("stays"), "first")
    shared = stays.where("n > 1 or stays <> first").select("key", "stays")
    gone = lines.select("id", "h", "line", "key").join(shared.hint("shuffle_hash"), "key").where(
        ~F.struct("id", "h", "line").eqNullSafe(F.col("stays"))
    )
    drops = store.keep(gone.groupBy("id", "h").agg(F.collect_set("line").alias("drop")), "line-drops")
    for table in (lines, named, least_of):
        store.drop(table)
    store.release(spark)
    new = ("n_lines", "n_removed", "kept_text")
    own = [c for c in docs.columns if c.lower() not in new]
    rows = docs.select(*own).withColumn("__h", _doc_hash(text_col))
    met = rows.join(
        drops.select(F.col("id").alias("__id"), F.col("h").alias("__hash"), "drop").hint("shuffle_hash"),
        F.col(id_col).eqNullSafe(F.col("__id")) & (F.col("__h") == F.col("__hash")), "left",
    ).select(*own, F.split(text_col, "\n", -1).alias("__lines"), F.col("drop").alias("__drop"))
    last = F.size("__lines") - 1
    left = F.transform(F.array_except(F.sequence(F.lit(0), last), F.col("__drop")), lambda i: F.get("__lines", i))
    kept = F.when(F.col("__drop").isNull(), F.col(text_col)).otherwise(F.array_join(left, "\n"))
    return met.select(
        *own, F.when(F.col("__lines").isNull(), 0).otherwise(F.size("__lines")).cast("long").alias("n_lines"),
        F.when(F.col("__drop").isNull(), 0).otherwise(F.size("__drop")).cast("long").alias("n_removed"), kept.alias("kept_text"),
    )


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's line counts and the digest of what stays of it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_lines(docs).select(
        "doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("kept_text", F.lit("")), 256).alias("kept_sha256")
    )
