"""Quality rules whose cutoffs are chosen with a guaranteed limit on false rejections.

Each rule scores a document; it rejects scores at or above a cutoff. Cutoffs are
chosen per stratum along a path of ever stricter sets of cutoffs. The path is laid
without the good labels: from the bad ones and the unlabelled documents, each
rule's cutoffs that lie on the concave hull of (documents rejected, bad ones rejected)
are ordered by how many bad ones each rejects for a document. The labelled good
documents are the holdout. For each set on the path, in that fixed order, the
hypothesis "these rules together reject more than alpha of the good documents" is
tested with the exact binomial tail, at level delta shared over the strata
(Bonferroni); the fixed order needs no further share, and its tests end at the first that fails.
So with probability 1 - delta no stratum loses more than alpha of its good documents
to these rules, whichever proven set is taken: the one that rejects most bad documents,
less ``weight`` times the good ones. Where none is proven or none helps, nothing is rejected.

The base rules (few words, repeated words) are fixed and outside this bound: cutoffs are
chosen among documents that pass them, and the bound is on the good ones among those.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import rows, store

STEPS = 1000  # cutoffs of a score between 0 and 1
NEVER = 1 << 30
ALPHA = 0.02
DELTA = 0.05
WEIGHT = 20
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50

SPACE = " \t\n\r\x0b\x0c"
SYMBOLS = "#*$%&|<>"
FIELDS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_upper long, n_lines long"

#: rule: (part, whole), a share between 0 and 1
RULES = {
    "symbols": ("n_symbols", "word_chars"),
    "capitals": ("n_upper", "word_chars"),
    "repeats": ("n_repeat_words", "n_words"),
    "lines": ("n_dup_lines", "n_lines"),
}


def repeat_words(words: list[bytes], width: int = 3) -> int:
    """Words that lie in a ``width``-word window found twice or more."""
    if len(words) <= width:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), dtype=np.int64, count=len(words))
    code = ids[: len(ids) - width + 1]
    for k in range(1, width):
        pair = code * len(number) + ids[k : len(ids) - width + 1 + k]
        code = np.unique(pair, return_inverse=True)[1] if k + 1 < width else pair
    order = np.argsort(code, kind="stable")
    equal = code[order][1:] == code[order][:-1]
    again = np.zeros(len(code), dtype=bool)
    again[order[1:]] |= equal
    again[order[:-1]] |= equal
    hit = np.zeros(len(words), dtype=bool)
    for k in range(width):
        hit[k : k + len(code)] |= again
    return int(hit.sum())


def measure(text: str | None) -> tuple[int, ...]:
    """The figures of FIELDS for one whole text; all zero without words."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    lines = [x for x in text.split("\n") if x.strip(SPACE)]
    octets = np.frombuffer(raw, dtype=np.uint8)
    return (
        len(words),
        len(text) - sum(map(text.count, SPACE)),
        sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeat_words(words),
        int(((octets >= 65) & (octets <= 90)).sum()),
        len(lines),
    )


def features(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with the columns of FIELDS, counted over whole texts (null: no words)."""

    def compute(texts: list[str | None]) -> list[pa.Array]:
        table = np.array([measure(t) for t in texts], dtype=np.int64).reshape(-1, len(FIELDS.split(",")))
        return [pa.array(np.ascontiguousarray(c)) for c in table.T]

    return rows.add_columns(docs, text_col, FIELDS, compute)


def beta_share(x: float, a: float, b: float) -> float:
    """Regularised incomplete beta function, by its continued fraction (modified Lentz)."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_share(1 - x, b, a)
    tiny, c, d, h = 1e-300, 1.0, 0.0, 1.0
    for m in range(1_000_000):
        even = [m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))] if m else []
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        for top in [*even, odd]:
            d = 1 / ((1 + top * d) or tiny)
            c = (1 + top / c) or tiny
            h *= c * d
        if m and abs(c * d - 1) < 1e-14:
            break
    front = math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    return math.exp(front) / (a * h)


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(X <= k) for X binomial(n, p)."""
    if k >= n:
        return 1.0
    return beta_share(1 - p, n - k, k + 1)


def most_allowed(n: int, p: float, level: float) -> int:
    """The largest k with P(X <= k) <= level, or -1: that many rejected good documents still prove a rate under p."""
    lo, hi = -1, n
    while hi - lo > 1:
        mid = (lo + hi) // 2
        if binomial_tail(mid, n, p) <= level:
            lo = mid
        else:
            hi = mid
    return lo


def _step(rule: str) -> Column:
    part, whole = RULES[rule]
    return F.when(F.col(whole) > 0, F.least(F.floor(F.col(part) * STEPS / F.col(whole)), F.lit(STEPS))).otherwise(0).cast("int")


def _stratum(col: str) -> Column:
    return F.coalesce(F.col(col).cast("string"), F.lit("\0"))


def _base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def hull(step: np.ndarray, everyone: np.ndarray, bad: np.ndarray) -> list[tuple[float, int]]:
    """(bad ones rejected for a document, cutoff), strictest last, of the cutoffs on the upper hull from (0, 0).

    ``everyone`` and ``bad``: documents of each score, by descending ``step``; the bad are among everyone.
    """
    points = [(0, 0, 0)]
    for x, y, c in zip(np.cumsum(everyone).tolist(), np.cumsum(bad).tolist(), step.tolist(), strict=True):
        if y == points[-1][1]:
            continue
        while len(points) > 1 and (points[-1][1] - points[-2][1]) * (x - points[-1][0]) <= (y - points[-1][1]) * (points[-1][0] - points[-2][0]):
            points.pop()
        points.append((x, y, c))
    return [((q[1] - p[1]) / (q[0] - p[0]), q[2]) for p, q in zip(points, points[1:], strict=False)]


def lay_path(table: pd.DataFrame) -> list[tuple[int, int]]:
    """(rule, cutoff) of each step of a stratum's path, from (rule, step, everyone, bad) rows."""
    found = []
    for rule, own in table[table["step"] > 0].sort_values("step", ascending=False).groupby("rule"):
        found += [(-slope, int(rule), -cutoff) for slope, cutoff in hull(*(own[c].to_numpy() for c in ("step", "everyone", "bad")))]
    return [(rule, -cutoff) for _, rule, cutoff in sorted(found)]


def choose_cutoffs(
    measured: DataFrame, labels: DataFrame, stratum_col: str = "lang", id_col: str = "doc_id", label_col: str = "quality",
    alpha: float = ALPHA, delta: float = DELTA, weight: float = WEIGHT,
) -> DataFrame:
    """(stratum, rule, cutoff) for every rule that may and does reject something.

    ``measured`` has the columns of FIELDS and is read three times. Documents that
    fail the base rules don't count. Every label row of a document counts; rows
    with a null label or id don't.
    """
    names = list(RULES)
    scored = measured.where(~_base_failed()).select(
        F.col(id_col).alias("id"), _stratum(stratum_col).alias("stratum"), F.array(*map(_step, names)).alias("steps")
    )
    marks = labels.select(F.col(id_col).alias("id"), (F.col(label_col) > 0).alias("good")).where("good is not null")
    marked = store.keep(scored.join(marks, "id").drop("id"), "marked")

    def histogram(rows: DataFrame, *counts: Column) -> DataFrame:
        return rows.select("*", F.posexplode("steps").alias("rule", "step")).groupBy("stratum", "rule", "step").agg(*counts)

    good, bad = (F.sum(F.when(F.col("good") == g, 1).otherwise(0)) for g in (True, False))
    every = histogram(scored, F.count("*").alias("n")).join(
        histogram(marked, good.alias("good"), bad.alias("bad")), ["stratum", "rule", "step"], "left"
    ).na.fill(0, ["good", "bad"])
    # without the good ones; more label rows than documents leave the bad ones
    table = every.select("stratum", "rule", "step", "bad", F.greatest(F.col("n") - F.col("good"), F.col("bad")).alias("everyone"))

    def lay(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        path = lay_path(group)
        enters = [np.full(STEPS + 1, NEVER) for _ in names]
        for k, (rule, cutoff) in reversed(list(enumerate(path))):
            enters[rule][cutoff:] = k
        rules, cutoffs = zip(*path, strict=True) if path else ((), ())
        out = {"stratum": [key[0]], "enters": [[x.tolist() for x in enters]], "rules": [list(rules)], "cutoffs": [list(cutoffs)]}
        return pd.DataFrame(out)[: len(path) and 1]

    # at most STEPS + 1 rows for each stratum and rule go in, one row a stratum comes out
    paths = store.keep(
        table.groupBy("stratum").applyInPandas(lay, "stratum string, enters array<array<int>>, rules array<int>, cutoffs array<int>"), "paths"
    )
    level = delta / max(1, paths.count())
    index = F.array_min(F.transform("steps", lambda s, r: F.get(F.get("enters", r), s)))
    entered = marked.join(paths.select("stratum", "enters"), "stratum").select("stratum", index.alias("k"), "good").groupBy("stratum", "k").agg(
        good.alias("good"), bad.alias("bad")
    )
    entered = entered.join(paths.select("stratum", "rules", "cutoffs"), "stratum")

    def pick(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        rules, cutoffs = group["rules"].iloc[0], group["cutoffs"].iloc[0]
        n = len(rules)
        counts = group[group["k"] < n].set_index("k")[["good", "bad"]].reindex(range(n), fill_value=0).cumsum()
        proven = counts[counts["good"] <= most_allowed(int(group["good"].sum()), alpha, level)]
        gain = proven["bad"] - weight * proven["good"]
        took = gain.to_numpy().argmax() + 1 if len(gain) and gain.max() > 0 else 0
        last = {names[r]: int(c) for r, c in zip(rules[:took], cutoffs[:took], strict=True)}
        out = {"stratum": [key[0]] * len(last), "rule": list(last), "cutoff": list(last.values())}
        return pd.DataFrame(out, dtype=object)

    # a row for each step of the stratum's path
    return entered.groupBy("stratum").applyInPandas(pick, "stratum string, rule string, cutoff int")


def judge(measured: DataFrame, cutoffs: DataFrame, stratum_col: str = "lang") -> DataFrame:
    """``measured`` with base_failed, failed_rules (names) and kept."""
    limits = cutoffs.groupBy("stratum").agg(F.map_from_entries(F.collect_list(F.struct("rule", "cutoff"))).alias("__limits"))
    over = F.filter(F.array(*(
        F.when(_step(r) >= F.col("__limits").getItem(r), F.lit(r)) for r in RULES
    )), lambda r: r.isNotNull())
    own = [c for c in measured.columns if c.lower() not in ("base_failed", "failed_rules", "kept")]
    return (
        measured.select(*own, _stratum(stratum_col).alias("__stratum"))
        .join(limits.withColumnRenamed("stratum", "__stratum"), "__stratum", "left")
        .select(*own, _base_failed().alias("base_failed"), F.coalesce(over, F.array().cast("array<string>")).alias("failed_rules"))
        .withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))
    )


def quality_filter(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang", label_col: str = "quality",
    alpha: float = ALPHA, delta: float = DELTA,
) -> DataFrame:
    """``docs`` with FIELDS, base_failed, failed_rules and kept.

    base_failed: under 50 words or over half of the words repeated. A null or
    empty text has no words and fails. Null strata are a stratum of their own;
    null ids have no labels; repeated rows are judged alike. Without labels, or
    with too few for the bound, only the base rules reject. Empty table: no
    rows. Columns of ``docs`` with the new names are replaced. ``docs`` are
    measured once, stored with their figures, and never shuffled.
    """
    measured = store.keep(features(docs, text_col), "measured")
    cutoffs = store.keep(choose_cutoffs(measured, labels, stratum_col, id_col, label_col, alpha, delta), "cutoffs")
    return judge(measured, cutoffs, stratum_col)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's figures and verdict."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    measured = store.keep(features(docs).drop("text"), "measured")
    cutoffs = store.keep(choose_cutoffs(measured, labels), "cutoffs")
    return judge(measured, cutoffs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failed_rules"
    )
