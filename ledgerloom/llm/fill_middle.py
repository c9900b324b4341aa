"""Fill-in-the-middle: a text's middle units go to its end, behind sentinels.

One Aho-Corasick automaton reads each whole text once. It finds the ASCII characters
that change the class of what follows (line breaks, white space) and the sentinels;
between two such events the number of units is known by arithmetic, so the unit with
a given rank is looked up in the sparse list of events, and no unit is ever cut out.
Texts that hold a sentinel stay as they are, so every output can be taken back.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SENTINELS = ("<P>", "<S>", "<M>")  # before the prefix, the suffix and the middle
SEED, RATE, SPM_RATE = 7, 100, 50  # the last two of 100
SPACES = "\t\n\x0b\x0c\r "
#: Which characters are events of a unit.
CLASSES = {"line": "\n", "word": SPACES, "char": ""}
ADDED = "n_units long, form string, prefix_chars long, middle_chars long, fim_text string"


def _checked(sentinels: Sequence[str]) -> None:
    for a in sentinels:
        for b in sentinels:
            if not a or (a != b and a in b) or any(a[-k:] == b[:k] for k in range(1, min(len(a), len(b)))):
                raise ValueError("sentinels must not be empty, hold or overlap each other")
    if len(set(sentinels)) != 3:
        raise ValueError("three different sentinels are needed")


class Scanner:
    """Counts a text's units and finds where the k-th one ends, from the automaton's events."""

    def __init__(self, unit: str = "line", sentinels: Sequence[str] = SENTINELS):
        import ahocorasick

        self.unit, self.automaton = unit, ahocorasick.Automaton()
        for c in CLASSES[unit]:
            self.automaton.add_word(c, False)
        for s in sentinels:
            self.automaton.add_word(s, True)
        self.automaton.make_automaton()

    def scan(self, text: str) -> tuple[int, np.ndarray | None, bool]:
        """(units, ends of all units but the last or None where they are one character each, whether a sentinel occurs)."""
        events = [(at, mark) for at, mark in self.automaton.iter(text)]
        marked = any(mark for _, mark in events)
        if self.unit == "char":
            return len(text), None, marked
        ends = np.array([at for at, mark in events if not mark], dtype=np.int64) + 1
        if self.unit == "word" and len(ends):
            # a run of white space ends a word where a word stands before and behind it
            last = np.append(ends[1:] != ends[:-1] + 1, True)
            lead = int(np.argmax(last)) if ends[0] == 1 else -1
            ends = np.delete(ends[last], 0) if lead >= 0 else ends[last]
        ends = ends[ends < len(text)]
        return len(ends) + bool(text), ends, marked

    @staticmethod
    def place(k: int, units: int, ends: np.ndarray | None, length: int) -> int:
        """How many characters the first ``k`` units have."""
        if k <= 0:
            return 0
        return length if k >= units else k if ends is None else int(ends[k - 1])


def _draws(id_col: str, seed: int) -> Column:
    """Four numbers of 32 bits from the id; null for a null id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")), 256)
    return F.when(F.col(id_col).isNotNull(), F.array(*(F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4))))


def fill_middle(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: str = "line", rate: int = RATE, spm_rate: int = SPM_RATE,
    seed: int = SEED, sentinels: Sequence[str] = SENTINELS,
) -> DataFrame:
    """``docs`` with n_units, form (plain, psm or spm), prefix_chars, middle_chars (code points) and fim_text.

    ``unit`` is line (with its line break), word (with the white space behind it; white
    space at the start is part of the first one) or char. The four draws come from the
    id alone, so a lost task gives the same rows again and repeated ids have the same
    draws. Plain are empty and null texts (0 units, empty output), texts that hold a
    sentinel, rows with a null id (no draws) and what ``rate`` leaves out; their
    lengths are null. One text is handled whole, in about 30 bytes a character of it.
    Columns of ``docs`` with the new names are replaced. Empty table: no rows.
    """
    _checked(sentinels)
    pre, suf, mid = sentinels
    new = T.StructType.fromDDL(ADDED)
    names = {f.name for f in new}
    own = [c for c in docs.columns if c.lower() not in names]
    rows = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("__text"), _draws(id_col, seed).alias("__draws"), *own)
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in rows.schema.fields[2:]] + new.fields)

    def one(scanner: Scanner, text: str, draws: list[int] | None) -> tuple:
        units, ends, marked = scanner.scan(text)
        if not text or marked or draws is None or draws[2] % 100 >= rate:
            return units, "plain", None, None, text
        lo, hi = sorted(scanner.place(draws[i] % (units + 1), units, ends, len(text)) for i in (0, 1))
        a, b, c = text[:lo], text[lo:hi], text[hi:]
        if draws[3] % 100 < spm_rate:
            return units, "spm", lo, hi - lo, f"{suf}{c}{pre}{a}{mid}{b}"
        return units, "psm", lo, hi - lo, f"{pre}{a}{suf}{c}{mid}{b}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(unit, sentinels)
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]
        for batch in batches:
            found = [one(scanner, t.as_py(), d.as_py()) for t, d in zip(batch.column(0), batch.column(1), strict=True)]
            columns = zip(*found, strict=True) if found else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([*batch.columns[2:], *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], schema.names)

    return rows.mapInArrow(run, schema)


def restored(output: Column, form: Column, sentinels: Sequence[str] = SENTINELS) -> Column:
    """The text that an output of the form was made from."""
    parts = F.split(output, "|".join(re.escape(s) for s in sentinels), -1)
    join = lambda *at: F.concat(*(F.get(parts, F.lit(i)) for i in at))
    return F.when(form == "psm", join(1, 3, 2)).when(form == "spm", join(2, 3, 1)).otherwise(output)


def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digest of every document's transformed and restored text."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    made = fill_middle(docs)
    return made.select(
        "doc_id", F.col("n_units").alias("n"), "form", "prefix_chars", "middle_chars", F.sha2("fim_text", 256).alias("output_sha256"),
        F.sha2(restored(F.col("fim_text"), F.col("form")), 256).alias("restored_sha256"),
    )


ORACLE = """
with t as (select doc_id, coalesce(text, '') as text, sha256('7:' || doc_id) as h from documents),
u as (
  select doc_id, text, ('0x' || h[1:8])::bigint as h1, ('0x' || h[9:16])::bigint as h2, ('0x' || h[17:24])::bigint as h3, ('0x' || h[25:32])::bigint as h4,
    string_split(text, chr(10)) as lines, len(string_split(text, chr(10))) - case when text = '' or right(text, 1) = chr(10) then 1 else 0 end as n from t),
c as (
  select *, least(h1 % (n + 1), h2 % (n + 1)) as lo, greatest(h1 % (n + 1), h2 % (n + 1)) as hi,
    text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or h3 % 100 >= 100 as plain from u),
e as (
  select *, case when lo = n then length(text) when lo = 0 then 0 else length(array_to_string(lines[1:lo], chr(10))) + 1 end as a,
    case when hi = n then length(text) when hi = 0 then 0 else length(array_to_string(lines[1:hi], chr(10))) + 1 end as b from c),
p as (select *, substring(text, 1, a) as pre, substring(text, a + 1, b - a) as mid, substring(text, b + 1) as suf,
  case when plain then 'plain' when h4 % 100 < 50 then 'spm' else 'psm' end as form from e)
select doc_id, n::bigint as n, form, case when not plain then a end::bigint as prefix_chars, case when not plain then b - a end::bigint as middle_chars,
  sha256(case form when 'plain' then text when 'psm' then '<P>' || pre || '<S>' || suf || '<M>' || mid else '<S>' || suf || '<P>' || pre || '<M>' || mid end) as output_sha256,
  sha256(text) as restored_sha256 from p
"""
