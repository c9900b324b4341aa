"""Languages by profiles of letter groups, fitted by aggregation and applied in one pass over the texts.

A profile is a language's most frequent groups of three letters with their log
probabilities: ``GROUPS`` rows a language, whatever the corpus, so every task holds it. A text is of the language
under which its groups are likeliest. Groups are counted as arrays of numbers in the tasks that read the texts, so only counts
of groups are shuffled, and no text's.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GROUPS = 3000  # of a language
LEAST_CHARS = 30
FLOOR = -14.0  # log probability of a group that a profile doesn't have
PIECE = 1 << 21  # characters counted at once, about
DENSE = 1 << 23  # entries of a table of all groups of a profile's letters; with more letters groups are looked up by bisection
_BITS = 21  # of a code point


def _flat(text: Column) -> Column:
    """A text's letters in lower case, words parted by one blank."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}]+", " ")), F.lit(" "))


def _pieces(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray]]:
    """(from, to, code points) of rows of about ``PIECE`` characters; a line break ends each row, and nulls are empty."""
    rows = [x or "" for x in texts.to_pylist()]
    at = 0
    while at < len(rows):
        upto, held = at, 0
        while upto < len(rows) and (upto == at or held + len(rows[upto]) <= PIECE):
            held += len(rows[upto]) + 1
            upto += 1
        yield at, upto, np.frombuffer("\n".join([*rows[at:upto], ""]).encode("utf-32-le"), dtype="<u4")
        at = upto


def _groups(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, rows): where all groups of three start that lie in one row, and the number of that row."""
    ends = codes == 10
    inside = ~(ends[:-2] | ends[1:-1] | ends[2:]) if len(codes) > 2 else np.zeros(0, dtype=bool)
    at = np.flatnonzero(inside)
    return at, np.cumsum(ends)[at]


def _numbers(codes: np.ndarray, at: np.ndarray) -> np.ndarray:
    c = codes.astype(np.int64)
    return ((c[at] << _BITS | c[at + 1]) << _BITS) | c[at + 2]


def _tally(codes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(numbers, counts) of the groups that start ``at`` these places: counted in a table where few letters occur, else sorted."""
    seen = np.zeros(0x110000, dtype=bool)
    seen[codes] = True
    letters = np.flatnonzero(seen)
    if len(letters) > 1 << 15 or len(letters) ** 3 > min(DENSE, 4 * len(at) + 64):
        return np.unique(_numbers(codes, at), return_counts=True)
    kind = np.zeros(0x110000, dtype=np.int32)
    kind[letters] = np.arange(len(letters))
    k, size = kind[codes], len(letters)
    n = np.bincount(((k[:-2] * size + k[1:-1]) * size + k[2:])[at])
    found = np.flatnonzero(n)
    a, b, c = letters[found // size**2], letters[found // size % size], letters[found % size]
    return (a << _BITS | b) << _BITS | c, n[found]


def _text(number: int) -> str:
    mask = (1 << _BITS) - 1
    return chr(number >> 2 * _BITS) + chr(number >> _BITS & mask) + chr(number & mask)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, gram, n) of pieces of rows (lang, flat)."""
    for batch in batches:
        names = batch.column(0).dictionary_encode()
        lang = names.indices.to_numpy()
        for start, end, codes in _pieces(batch.column(1)):
            at, row = _groups(codes)
            of = lang[start:end][row]
            for i in np.unique(lang[start:end]).tolist():
                found, n = _tally(codes, at[of == i])
                yield pa.RecordBatch.from_arrays([names.dictionary.take(pa.array([i] * len(found), pa.int64())), pa.array(map(_text, found.tolist()), pa.string()), pa.array(n)], ["lang", "gram", "n"])


def fit(docs: DataFrame, text: str, lang: str, groups: int = GROUPS) -> DataFrame:
    """(lang, gram, weight): the profile of every language that the rows are labelled with; null labels and texts teach nothing."""
    rows = docs.where(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(F.col(lang).cast("string").alias("lang"), _flat(F.col(text)).alias("flat"))
    counts = rows.mapInArrow(_count, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    by = Window.partitionBy("lang").orderBy(F.desc("n"), F.asc("gram"))
    top = counts.withColumn("place", F.row_number().over(by)).where(F.col("place") <= groups)
    return top.join(F.broadcast(totals), "lang").select("lang", "gram", F.greatest(F.ln(F.col("n") / F.col("total")), F.lit(FLOOR)).alias("weight"))


class _Profile:
    """Gains of a profile's groups by language, found by the code points of a group."""

    def __init__(self, rows: list[tuple[str, str, float]]):
        self.langs = sorted({lang for lang, _, _ in rows})
        grams = sorted({gram for _, gram, _ in rows})
        place = {gram: i for i, gram in enumerate(grams)}
        # the last row is of all groups that no language has
        self.gains = np.full((len(self.langs), len(grams) + 1), np.nan)
        for lang, gram, weight in rows:
            self.gains[self.langs.index(lang), place[gram]] = weight - FLOOR
        points = np.array([[ord(c) for c in gram] for gram in grams], dtype=np.int64).reshape(-1, 3)
        letters = np.unique(points)
        self.dense = len(letters) < 1 << 15 and (len(letters) + 1) ** 3 <= DENSE
        if self.dense:
            self.kinds = len(letters) + 1  # kind 0: letters of no group
            self.kind = np.zeros(0x110000, dtype=np.int32)
            self.kind[letters] = np.arange(1, self.kinds)
            self.table = np.full(self.kinds**3, len(grams), dtype=np.int32)
            k = self.kind[points]
            self.table[(k[:, 0] * self.kinds + k[:, 1]) * self.kinds + k[:, 2]] = np.arange(len(grams))
        else:
            self.numbers = (points[:, 0] << _BITS | points[:, 1]) << _BITS | points[:, 2]  # in the order of the groups

    def find(self, codes: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The place of each group; one beyond the last of those that aren't there."""
        if self.dense:
            k = self.kind[codes]
            return self.table[((k[:-2] * self.kinds + k[1:-1]) * self.kinds + k[2:])[at]]
        numbers = _numbers(codes, at)
        i = np.searchsorted(self.numbers, numbers).clip(max=len(self.numbers) - 1)
        return np.where(self.numbers[i] == numbers, i, len(self.numbers))

    def scores(self, codes: np.ndarray, n: int) -> pa.Array:
        """Of each of ``n`` rows the sum of gains by language; null where it has none of a language's groups."""
        at, row = _groups(codes)
        place = self.find(codes, at)
        held = np.flatnonzero(place < self.gains.shape[1] - 1)
        place, row = place[held], row[held]
        out, none = np.empty((n, len(self.langs))), np.empty((n, len(self.langs)), dtype=bool)
        for i, gains in enumerate(self.gains):
            out[:, i] = np.bincount(row, np.nan_to_num(gains)[place], minlength=n)
            none[:, i] = out[:, i] == 0
            if none[:, i].any():  # a group's gain may be 0
                none[:, i] &= np.bincount(row, ~np.isnan(gains)[place], minlength=n) == 0
        return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * len(self.langs)), pa.array(out.ravel(), mask=none.ravel()))


def detect(docs: DataFrame, profile: DataFrame, id_col: str, text: str) -> DataFrame:
    """(id_col, language) of every row: unknown for texts of under ``LEAST_CHARS`` characters or with no known group. Ties go to the first name.

    The profile is read when this is called.
    """
    known = [tuple(r) for r in profile.select("lang", "gram", "weight").collect()]  # GROUPS rows a language
    if not known:
        return docs.select(id_col, F.lit("unknown").alias("language"))
    long_ = F.length(F.trim(F.col(text))) >= LEAST_CHARS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Profile(known)
        for batch in batches:
            for start, end, codes in _pieces(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, end - start), held.scores(codes, end - start)], ["id", "scores"])

    rows = docs.select(F.col(id_col).alias("id"), F.when(long_, _flat(F.col(text))).alias("flat"))
    scored = rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, scores array<double>")
    names = F.array(*map(F.lit, sorted({lang for lang, _, _ in known})))
    ranked = F.transform("scores", lambda s, i: F.when(s.isNotNull(), F.struct((-F.round(s, 6)).alias("score"), F.get(names, i).alias("lang"))))
    best = F.array_min(F.filter(ranked, lambda x: x.isNotNull()))["lang"]
    return scored.select(F.col("id").alias(id_col), F.coalesce(best, F.lit("unknown")).alias("language"))
