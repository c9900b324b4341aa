import hashlib
import random
from itertools import combinations

import numpy as np
import pytest

from ledgerloom.llm import line_dedup as L

SCHEMA = "doc_id long, text string, N_LINES int, key string"
MASK = (1 << 64) - 1


def mix(h: int) -> int:
    for _ in range(2):
        h = ((h ^ (h >> 32)) * 0xD6E8FEB86659FD93) & MASK
    return h ^ (h >> 32)


def brute_words(line: bytes) -> list[int]:
    """40-bit hashes of a normalised line's distinct words, in order."""
    digits = sum(48 <= c <= 57 for c in line)
    if 5 * digits <= len(line.decode()):
        line = bytes(48 if 48 <= c <= 57 else c for c in line)
    return sorted({mix(sum((c + 1) * pow(L._BASE, i, 1 << 64) for i, c in enumerate(w)) & MASK) >> 24 for w in line.split(b" ")})


def brute_fingerprint(line: bytes) -> int:
    """The SimHash of a normalised line's distinct words, word by word."""
    words = brute_words(line)
    return sum(1 << k for k in range(64) if 2 * sum(mix(w) >> k & 1 for w in words) > len(words))


def brute_keys(line: bytes) -> set:
    """What a line meets others under: its words less one, or blocks of its words."""
    words = brute_words(line)
    n, out = len(words), set()
    if n <= L.SHORT:
        out |= {frozenset(words), *(frozenset(words) - {w} for w in words if n > 1)}
    if n >= L.SHORT:
        level = max(1, (n // L.WORDS).bit_length() - 1)
        levels = {level, level - 1} if level > 1 and n < L.NEAR * L.WORDS * 2**level else {level}
        for k in levels:
            for b in range(L.MOST):
                block = frozenset(w for w in words if w >> (40 - k) == b)
                if len(block) >= L.LEAST:
                    out.add((k, b, block))
    return out


def brute_distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
    return row[-1]


def brute(rows):
    """{(id, text): kept text} by comparing all pairs of lines."""
    docs = sorted({(i, t) for i, t, *_ in rows if t is not None}, key=lambda r: (r[0] is not None, r[0] or 0))
    where, group = {}, {}
    for d, (_, text) in enumerate(docs):
        for n, line in enumerate(L.normalise(text)):
            if line:
                where.setdefault(line, []).append((d, n))
    group = {line: line for line in where}
    fp = {line: brute_fingerprint(line) for line in where}
    keys = {line: brute_keys(line) for line in where}

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    for a, b in combinations(where, 2):
        if keys[a] & keys[b] and (fp[a] ^ fp[b]).bit_count() <= L.BITS:
            x, y = a.decode(), b.decode()
            if 1 - L.edit_distance(x, y) / max(len(x), len(y)) >= L.SIMILARITY:
                group[find(a)] = find(b)
    first = {}
    for line, at in where.items():
        first[find(line)] = min([*at, *([first[find(line)]] if find(line) in first else [])])
    out = {}
    for d, (i, text) in enumerate(docs):
        norm = L.normalise(text)
        out[i, text] = "\n".join(x for n, x in enumerate(text.split("\n")) if not norm[n] or first[find(norm[n])] == (d, n))
    return out


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(n))


def corpus(seed=1):
    rng = random.Random(seed)
    base = [words(rng, n) for n in (1, 2, 5, 12, 40, 60)]
    rows, at = [], 0
    for d in range(40):
        lines = []
        for _ in range(rng.randint(0, 8)):
            line = rng.choice(base).split(" ")
            for _ in range(rng.choice([0, 0, 1, 2])):
                line[rng.randrange(len(line))] = words(rng, 1)
            lines.append(rng.choice(["", " ", "!?", "Page 7 of 9", "PAGE 3, of 5."]) if rng.random() < 0.2 else " ".join(line).upper() if rng.random() < 0.2 else " ".join(line))
        rows.append((at, "\n".join(lines), 0, "x"))
        at += 1
    return rows


def kept(spark, rows):
    return {(r["doc_id"], r["text"]): r["kept_text"] for r in L.dedup_lines(spark.createDataFrame(rows, SCHEMA)).collect()}


def test_fingerprints_and_distances_match_brute_force():
    rng = random.Random(5)
    lines = [words(rng, n).encode() for n in (1, 2, 3, 10, 254, 255, 256, 600)] + ["straße 00 é".encode()]
    lines += [words(rng, n).encode() + tail for n in range(3, 70) for tail in (b"", b" 12 page 7", b" 2021 99 12 445 1999 1 2 3" * 9)]
    fp, size, keys, ends = L.Hasher().hashes(lines)
    assert fp.tolist() == [brute_fingerprint(x) for x in lines] and size.tolist() == [len(x.decode()) for x in lines]
    got = [set(x.tolist()) for x in np.split(keys, ends[:-1])]
    assert list(map(len, got)) == [len(brute_keys(x)) for x in lines]
    shared = [[len(brute_keys(a) & brute_keys(b)) for b in lines[::7]] for a in lines[::5]]
    assert shared == [[len(a & b) for b in got[::7]] for a in got[::5]] and sum(map(sum, shared)) > 20
    assert sum(map(len, L.Hasher().hashes([]))) == 0
    for _ in range(300):
        a, b = ("".join(rng.choice("abc ") for _ in range(rng.randint(0, 90))) for _ in range(2))
        assert L.edit_distance(a, b) == brute_distance(a, b)
        c = "".join(x for x in a if rng.random() > 0.15)
        assert L.similar(a, b) == (brute_distance(a, b) <= int(0.2 * max(len(a), len(b)) + 1e-9))
        assert L.similar(a, c) == (brute_distance(a, c) <= int(0.2 * max(len(a), len(c)) + 1e-9))


def test_lines_match_brute_force(spark):
    rows = corpus()
    got = kept(spark, rows)
    assert got == brute(rows)
    exact = {x for r in rows for x in L.normalise(r[1]) if x}
    assert len(exact) > sum(bool(x) for t in got.values() for x in L.normalise(t))  # more than exact copies went


def test_chunks_lose_nothing(spark, monkeypatch):
    rows = corpus(2)
    want = kept(spark, rows)
    monkeypatch.setattr(L, "CHUNK", 3)
    assert kept(spark, rows) == want == brute(rows)


def test_blocks_whose_equal_fingerprints_cancel(spark):
    """Lines with the same words in another order have one fingerprint; a pair of such blocks is no reason to drop one."""
    rng = random.Random(3)
    a, b, c, d = (words(rng, 30).split() for _ in range(4))
    last = lambda x: [*x[:-2], x[-1], x[-2]]
    text = {"a": a, "b": b, "c": c, "c2": last(c), "d": d, "d2": last(d)}
    norm = {k: " ".join(v).encode() for k, v in text.items()}
    fp = dict(zip(norm, L.Hasher().hashes(list(norm.values()))[0].view(np.int64).tolist(), strict=True))
    assert fp["c"] == fp["c2"] and fp["d"] == fp["d2"]
    blocks = {"a": [1, 2], "b": [1, 2], "c": [1], "c2": [1], "d": [2], "d2": [2]}
    rows = [(k.encode(), fp[k], len(norm[k]), blocks[k], (0, 0, 0)) for k in text]
    firsts = spark.createDataFrame(rows, "key binary, fp long, size int, at array<long>, first struct<id:int,h:int,line:int>")
    texts = spark.createDataFrame([(k.encode(), fp[k], norm[k].decode()) for k in text], "key binary, fp long, norm string")
    got = {tuple(sorted((bytes(r["a"]).decode(), bytes(r["b"]).decode()))) for r in L.similar_links(firsts, lambda wanted: texts.join(wanted.select("key"), "key", "left_semi")).collect()}
    assert got == {("c", "c2"), ("d", "d2")}


def test_nulls_ties_and_repeats(spark):
    rows = [(3, "same line\nother", 0, ""), (3, "same line\nother", 1, ""), (2, None, 0, ""), (4, "", 0, ""), (None, "Other!", 0, ""), (9, "\n\n", 0, ""), (1, "same  LINE", 0, "")]
    got = L.dedup_lines(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r["doc_id"] or 0, r["n_lines"], r["n_removed"], r["kept_text"]) for r in got if r["kept_text"] is not None) == [
        (0, 1, 0, "Other!"), (1, 1, 0, "same  LINE"), (3, 2, 2, ""), (3, 2, 2, ""), (4, 1, 0, ""), (9, 3, 0, "\n\n"),
    ]
    null = next(r for r in got if r["kept_text"] is None)
    assert (null["doc_id"], null["n_lines"], null["n_removed"]) == (2, 0, 0)
    assert got[0].asDict().keys() == {"doc_id", "text", "key", "n_lines", "n_removed", "kept_text"}


def test_empty_table(spark):
    assert L.dedup_lines(spark.createDataFrame([], SCHEMA)).count() == 0


def test_very_long_texts(spark):
    letters = str.maketrans("0123456789", "abcdefghij")
    long = " ".join(str(i).translate(letters) for i in range(120_000))
    other = long.replace(" bcde ", " changed ")
    many = "\n".join(f"row {'abcdefghij'[i % 10] * (i // 10 + 1)}" for i in range(3000))
    got = kept(spark, [(1, long, 0, ""), (2, other + "\nnew words here", 0, ""), (3, many, 0, ""), (4, many, 0, "")])
    assert got[1, long] == long and got[2, other + "\nnew words here"] == "new words here"
    assert got[3, many] and got[4, many] == ""


def test_numbers_are_told_apart(spark):
    rows = [(1, "2021 14.5 33", 0, ""), (2, "1987 62.1 90", 0, ""), (3, "posted by the admin of this site on day 7", 0, ""), (4, "Posted by the admin of this site, on day 8", 0, "")]
    got = kept(spark, rows)
    assert [got[r[0], r[1]] for r in rows] == ["2021 14.5 33", "1987 62.1 90", rows[2][1], ""]


def similar_pairs(lines, asked):
    """Index pairs of lines with an edit similarity of 0.8 or more, with one of them among ``asked``."""
    text = [x.decode() for x in lines]
    size = np.array([len(x) for x in text])
    letters = np.zeros((len(text), 40), dtype=np.int32)
    for i, x in enumerate(text):
        np.add.at(letters[i], [ord(c) % 40 for c in x], 1)
    out = set()
    for i in asked:
        most = np.floor(0.2 * np.maximum(size, size[i]) + 1e-9)
        # each edit changes two letter counts at most
        near = np.flatnonzero((np.abs(size - size[i]) <= most) & (np.abs(letters - letters[i]).sum(axis=1) <= 2 * most))
        out |= {(min(i, j), max(i, j)) for j in near.tolist() if j != i and L.similar(text[i], text[j])}
    return sorted(out)


@pytest.mark.parametrize("sf, part", [("sf0.001", 1), ("sf0.01", 8)])
def test_recall_against_all_pairs(spark, sf, part):
    texts = [r.text for r in spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").select("text").collect()]
    lines = sorted({x for t in texts for x in L.normalise(t) if x})
    pairs = similar_pairs(lines, random.Random(4).sample(range(len(lines)), len(lines) // part))
    fp, size, keys, ends = L.Hasher().hashes(lines)
    own = [set(x.tolist()) for x in np.split(keys, ends[:-1])]
    i, j = np.array(pairs).T
    meet = np.array([bool(own[a] & own[b]) for a, b in pairs]) & L._near(fp, size, i, j, L.SIMILARITY)
    print(sf, "pairs", len(pairs), "recall", meet.mean())
    assert len(pairs) > 20 and meet.mean() >= 0.9


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    want = brute(docs)
    got = {r.doc_id: (r.n_lines, r.n_removed, r.kept_sha256) for r in L.op5_line_dedup(spark, sf).collect()}
    for i, text in docs:
        left = want[i, text]
        lines, stay = text.split("\n"), left.split("\n") if left else []
        assert got[i] == (len(lines), len(lines) - len(stay), hashlib.sha256(left.encode()).hexdigest()), i
    assert sum(n for _, n, _ in got.values()) > 100


def test_no_block_of_a_line_is_left_out():
    """Lines that are alike only in words whose hashes are high have these in blocks of high numbers, under which they meet as well."""
    rng = random.Random(8)
    for n in (80, 300, 20_000):
        every = sorted({words(rng, 1) + str(i).translate(str.maketrans("0123456789", "abcdefghij")) for i in range(2 * n)}, key=lambda w: brute_words(w.encode()))
        low, high = every[:n], every[n:]
        a, b = (" ".join([*low[i :: 2], *high]).encode() for i in (0, 1))
        _, _, keys, ends = L.Hasher().hashes([a, b])
        x, y = (set(k.tolist()) for k in np.split(keys, ends[:-1]))
        assert x & y and len(x) <= 2 * L.MOST, n


def test_distances_of_many_pairs_match_those_of_each():
    rng = random.Random(12)
    for n in (0, 1, 2, 40):
        pairs = [tuple("".join(rng.choice("ab é") for _ in range(rng.choice([0, 1, 7, 8, 9, 63, 64, 65]))) for _ in range(2)) for _ in range(n)]
        assert L.edit_distances(pairs) == [brute_distance(a, b) for a, b in pairs]


def test_pairs_that_meet_earlier():
    rng = np.random.default_rng(4)
    lists = [sorted(set(rng.integers(-40, 40, rng.integers(1, 12)).tolist())) for _ in range(60)]
    here = np.array([x[len(x) // 2] for x in lists])
    i, j = np.triu_indices(60, 1)
    got = L._Earlier(L.pa.array(lists, L.pa.list_(L.pa.int64())), here)(i, j)
    # rows that meet have one key; where they don't, less than its own counts for each
    want = [bool({k for k in lists[a] if k < here[a]} & {k for k in lists[b] if k < here[b]}) for a, b in zip(i.tolist(), j.tolist(), strict=True)]
    assert got.tolist() == want and 0 < sum(want) < len(want)


def test_keys_are_dealt_out_in_rows_for_tasks_not_for_keys(spark):
    """A line's repeats are no partners; lines of one fingerprint are; a key with more lines than meet in a task keeps all."""
    at = lambda *keys: np.array(keys, dtype="<i8").tobytes()
    rows = [(b"a", 1, 50, at(5, -7)), (b"a", 1, 50, at(5, -7)), (b"b", 1, 50, at(-7)), (b"c", -1, 50, at(5)), (b"d", 9, 50, at(11)), (b"d", 9, 50, at(11))]
    placed = spark.createDataFrame(rows, "key binary, fp long, size int, at binary").repartition(3)
    assert {tuple(r) for r in L.near_lines(placed).collect()} == {(1, -7)}
    batch = L.pa.RecordBatch.from_pydict({"fp": list(range(5000)), "size": [50] * 5000, "at": [at(*range(k, k + 10)) for k in range(5000)], "k": list(range(5000))})
    dealt = list(L._deal(4)([batch]))
    assert sum(b.num_rows for b in dealt) == 4 and sum(len(x.as_py()) for b in dealt for x in b["places"]) == 50_000 * L._PLACE.itemsize
    hot = np.zeros(L.CHUNK + 1, dtype=L._PLACE)
    hot["fp"] = hot["k"] = np.arange(L.CHUNK + 1)
    (kept_all,) = L._partners(L.SIMILARITY)([L.pa.RecordBatch.from_pydict({"places": [hot.tobytes()]})])
    assert kept_all.num_rows == L.CHUNK + 1
    assert list(L._partners(L.SIMILARITY)([])) == []
