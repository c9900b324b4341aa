"""Bootstrapped contextual extraction of personal data, in DataFrame operations only.

Seeds are what the kinds' expressions find (e-mail and network addresses, card
and phone numbers, assigned secrets). Seeds and unknown identifiers come from one
list of candidates: words with an ``@`` or a digit, numbers joined by blanks being
one. Each occurrence has two patterns: the two words before it, and its form (digits
as 9, runs of letters as a). Patterns and identifiers make a graph that is scored
in turns. A pattern's confidence in a kind is the sum of its distinct identifiers'
scores in that kind for each known one, where an unknown one counts ``UNKNOWN``; one that
a kind's expression matches whole and its check rejects (a card number with a wrong
check digit) counts in full against that kind's patterns and is never found as it. An unknown
identifier's score is 1 - prod(1 - confidence) over its trusted patterns; one that
reaches ``ACCEPT`` is found, keeps that kind and score, and supports patterns in the
next turn. Turns end when one finds nothing. What is stored and joined are short
occurrences; the texts are read once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import store

SUPPORT = 3  # distinct identifiers of a kind that a trusted pattern must have
TRUST = 0.8  # confidence of a trusted pattern
ACCEPT = 0.9  # score of a found identifier
UNKNOWN = 1 / 3  # what an unknown identifier counts against a pattern, where one of another kind counts 1
SLACK = 1e-9  # for sums in another order
BLOCK = 256  # running sums are made within blocks and over them, which keeps long texts near linear

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "secret")

#: The kinds' expressions; possessive and anchored at the start of a run, so no
#: text makes them go back over what they have read. Same matches as the plain ones.
EXPRESSIONS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
    # the value behind a credential's name and = or :, in quotes, with a digit
    "secret": r"""(?<=(?i:token|secret|password|passwd|api.?key) {0,2}[=:] {0,2}["'])(?=[^"'\s]*[0-9])[A-Za-z0-9_+/=.-]{12,}+(?=["'])""",
}
_PART = "0*(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
#: A text without these has no match.
NEEDS = {"email": "@", "ip": "[0-9]", "card": "[0-9]", "phone": r"\+", "secret": "[=:] {0,2}[\"']"}

_SPACE = r" \t\n\x0B\f\r"
_END = rf"""(?=["'.,;:!?)\]>}}]*+(?:[{_SPACE}]|\z))"""
_NUMBER = "[0-9][0-9()./-]*+"
#: From the start of a word: numbers that stand alone, joined by single blanks; or a word with a digit or @.
CANDIDATE = (
    rf"(?<![^{_SPACE}])(?:[(+]*+{_NUMBER}{_END}(?: [(]?{_NUMBER}{_END})*+|[^{_SPACE}0-9@]*+[0-9@][^{_SPACE}]*+)"
)
#: What stands before the identifier itself in a candidate, and punctuation behind it.
_LEAD = r"""^[^0-9@]*[:="'](?=[^:="']*[0-9@])|^["'(<\[{]+"""
_TAIL = r"""["'.,;:!?)\]>}]+$"""
SPAN = "struct<start:int,end:int,value:string,words:string>"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.transform(F.array(value), body).getItem(0)


def _running_sums(numbers: Column) -> Column:
    """array<int>: the sums of the first 1, 2, ... numbers."""

    def step(s: Column, x: Column, upto: Column) -> Column:
        return F.struct((s["sum"] + x).alias("sum"), F.array_append(s["out"], upto).alias("out"))

    zero = F.struct(F.lit(0).alias("sum"), F.array().cast("array<int>").alias("out"))

    def whole(n: Column) -> Column:
        blocks = F.transform(
            F.sequence(F.lit(0), F.floor(F.greatest(F.size(n) - 1, F.lit(0)) / BLOCK).cast("int")),
            lambda b: F.aggregate(F.slice(n, b * BLOCK + 1, F.lit(BLOCK)), zero, lambda s, x: step(s, x, s["sum"] + x)),
        )
        return _let(blocks, lambda bs: _let(
            F.aggregate(bs, zero, lambda s, x: step(s, x["sum"], s["sum"]))["out"],
            lambda before: F.flatten(F.transform(bs, lambda x, b: F.transform(x["out"], lambda e: e + F.get(before, b)))),
        ))

    return _let(numbers, whole)


def _matches(expression: str, body: Callable[[Column, Column], Column]) -> Column:
    """``body(m, ends)`` of all matches in ``t``: m.hits, the m.gaps before, between and behind them, and where they end."""
    found = F.struct(
        F.regexp_extract_all("t", F.lit(expression), F.lit(0)).alias("hits"), F.split("t", expression, -1).alias("gaps")
    )
    return _let(found, lambda m: _let(
        _running_sums(F.transform(m["hits"], lambda h, i: F.length(F.get(m["gaps"], i)) + F.length(h))), lambda ends: body(m, ends)
    ))


def _right(kind: str, value: Column) -> Column:
    """Whether a match of the kind's expression counts."""
    digits = F.regexp_replace(value, "[^0-9]", "")
    return {
        "ip": value.rlike(rf"^({_PART}\.){{3}}{_PART}$"),
        "card": F.length(digits).between(16, 19) & F.call_function("luhn_check", digits),
        "phone": F.length(digits).between(8, 15),
    }.get(kind, F.lit(True))


def _rejects(value: Column) -> Column:
    """The kinds whose expression matches all of the value and whose check it fails."""
    plain = {"ip": r"[0-9]++(?:\.[0-9]++){3}", "card": r"[0-9](?:[ -]?[0-9])++", "phone": r"\+[0-9][ ().0-9-]+[0-9]"}
    return F.array_compact(F.array(*(F.when(value.rlike(f"^(?:{e})$") & ~_right(k, value), k) for k, e in plain.items())))


def _base(kind: str) -> Column:
    def spans(m: Column, ends: Column) -> Column:
        every = F.transform(m["hits"], lambda h, i: F.struct(
            (F.get(ends, i) - F.length(h)).alias("start"), F.get(ends, i).alias("end"), h.alias("value"), F.lit("").alias("words")
        ))
        return F.filter(every, lambda x: _right(kind, x["value"]))

    return F.when(F.col("t").rlike(NEEDS[kind]), _matches(EXPRESSIONS[kind], spans)).otherwise(F.array().cast(f"array<{SPAN}>"))


def _last_at_most(starts: Column, place: Column) -> Column:
    """The index of the last of the ascending ``starts`` that is at most ``place``, by halving."""
    n = F.size(starts)

    def halve(s: Column, _: Column) -> Column:
        middle = F.floor((s["lo"] + s["hi"]) / 2).cast("int")
        low = F.get(starts, middle) <= place
        return F.struct(F.when(low, middle).otherwise(s["lo"]).alias("lo"), F.when(low, s["hi"]).otherwise(middle).alias("hi"))

    rounds = F.sequence(F.lit(0), F.ceil(F.log2(n + 1)).cast("int"))
    return F.aggregate(rounds, F.struct(F.lit(0).alias("lo"), n.alias("hi")), halve)["lo"]


def _words_before(m: Column, i: Column, lead: Column) -> Column:
    """The two words before candidate i, of which what leads up to the identifier in its own word may be one."""
    empty = F.lit("")
    # two candidates and the text around them hold two words at least
    text = F.concat(
        F.coalesce(F.get(m["hits"], i - 2), empty), F.coalesce(F.get(m["gaps"], i - 1), empty),
        F.coalesce(F.get(m["hits"], i - 1), empty), F.get(m["gaps"], i), F.lit(" "),
        F.when(lead.rlike(r"[\p{L}0-9]"), lead).otherwise(empty),
    )
    words = F.filter(F.split(F.lower(text), f"[{_SPACE}]+"), lambda w: w != "")
    return F.array_join(_let(words, lambda w: F.slice(w, F.greatest(F.size(w) - 1, F.lit(1)), F.lit(2))), " ")


def _with_words() -> Column:
    """(<kind> ..., unknown): the base spans with the words before them, and the candidates that are none of them."""

    def both(m: Column, ends: Column) -> Column:
        starts = F.transform(m["hits"], lambda h, i: F.get(ends, i) - F.length(h))

        def of(starts: Column) -> Column:
            def seed(x: Column) -> Column:
                return _let(_last_at_most(starts, x["start"]), lambda i: F.struct(
                    x["start"], x["end"], F.lower(x["value"]).alias("value"),
                    _words_before(m, i, F.substr(F.get(m["hits"], i), F.lit(1), x["start"] - F.get(starts, i))).alias("words"),
                ))

            def candidate(i: Column) -> Column:
                hit = F.get(m["hits"], i)
                lead = F.regexp_extract(hit, _LEAD, 0)
                value = F.regexp_replace(F.substr(hit, F.length(lead) + 1), _TAIL, "")
                return F.struct(
                    (F.get(starts, i) + F.length(lead)).alias("start"), (F.get(starts, i) + F.length(lead) + F.length(value)).alias("end"),
                    value.alias("value"), lead.alias("words"), i.alias("i"),
                )

            def unknown(x: Column) -> Column:
                return F.struct(x["start"], x["end"], F.lower(x["value"]).alias("value"), _words_before(m, x["i"], x["words"]).alias("words"))

            known = F.flatten(F.transform(F.concat(*KINDS), lambda x: F.sequence(
                _last_at_most(starts, x["start"]), _last_at_most(starts, x["end"] - 1)
            )))
            open_ = F.array_except(F.sequence(F.lit(0), F.size(starts) - 1), known)
            likely = F.filter(F.transform(open_, candidate), lambda x: (F.length(x["value"]) >= 5) & (
                F.contains(x["value"], F.lit("@")) | (F.length(F.regexp_replace(x["value"], "[^0-9]", "")) >= 4)
            ))
            return F.struct(*(F.transform(k, seed).alias(k) for k in KINDS), F.transform(likely, unknown).alias("unknown"))

        return F.when(F.size(starts) > 0, _let(starts, of))

    return F.when(F.col("t").rlike("[0-9@]"), _matches(CANDIDATE, both))


def find(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, <kind> for each of KINDS, unknown): arrays of (start, end, value, words) in each whole text."""
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    rows = rows.select("id", "t", *(_base(k).alias(k) for k in KINDS)).select("id", *KINDS, _with_words().alias("w"))
    none = F.array().cast(f"array<{SPAN}>")
    return rows.select("id", *(F.coalesce(F.col(f"w.{k}"), k).alias(k) for k in KINDS), F.coalesce("w.unknown", none).alias("unknown"))


def _form(value: str) -> Column:
    return F.concat(F.lit("form "), F.regexp_replace(F.regexp_replace(value, r"\p{L}+", "a"), "[0-9]", "9"))


def bootstrap(occurrences: DataFrame) -> DataFrame:
    """(value, kind, score) of the unknown values that are found, from (kind or null, value, words) occurrences."""
    patterns = F.array(F.concat(F.lit("words "), "words"), _form("value"))
    edges = occurrences.groupBy("value", "words").agg(F.max("kind").alias("kind")).select("value", "kind", F.explode(patterns).alias("pattern"))
    edges = store.keep(edges.groupBy("pattern", "value").agg(F.max("kind").alias("kind")), "edges")
    seeds = edges.where("kind is not null").groupBy("value").agg(F.max("kind").alias("seed"))
    # only the patterns of some seed can ever be trusted by seeds, but a found value may lend its trust to others
    graph = edges.drop("kind").join(seeds, "value", "left")
    graph = store.keep(graph.withColumn("rejects", F.when(F.col("seed").isNull(), _rejects(F.col("value"))).otherwise(F.array().cast("array<string>"))), "graph")
    rejected = graph.select("pattern", F.explode("rejects").alias("kind")).groupBy("pattern", "kind").agg(F.count("*").alias("rejected"))
    totals = graph.groupBy("pattern").agg(F.count("*").alias("total"))
    found = store.keep(graph.sparkSession.createDataFrame([], "value string, kind string, score double"), "found")
    while True:
        known = graph.where("seed is not null").select("pattern", F.col("seed").alias("kind"), F.lit(1.0).alias("score"), "rejects")
        known = known.unionByName(graph.where("seed is null").join(found, "value").select("pattern", "kind", "score", "rejects"))
        sums = known.groupBy("pattern", "kind").agg(F.sum("score").alias("sum"), F.count("*").alias("n"))
        whole = sums.groupBy("pattern").agg(F.sum("n").alias("known"))
        # of what a kind rejects, what has become another kind is among the known ones
        other = known.select("pattern", F.explode("rejects").alias("kind")).groupBy("pattern", "kind").agg(F.count("*").alias("other"))
        against = rejected.join(other, ["pattern", "kind"], "left").select("pattern", "kind", (F.col("rejected") - F.coalesce("other", F.lit(0))).alias("against"))
        failing = F.coalesce("against", F.lit(0))
        share = F.col("sum") / (F.col("known") + failing + UNKNOWN * (F.col("total") - F.col("known") - failing))
        trusted = (
            sums.where(F.col("n") >= SUPPORT).join(whole, "pattern").join(totals, "pattern").join(against, ["pattern", "kind"], "left")
            .select("pattern", "kind", F.least(share, F.lit(1 - 1e-9)).alias("confidence")).where(F.col("confidence") >= TRUST - SLACK)
        )
        votes = graph.where("seed is null").join(found, "value", "left_anti").join(trusted, "pattern").where(~F.array_contains("rejects", F.col("kind")))
        votes = votes.groupBy("value", "kind").agg((1 - F.exp(F.sum(F.log1p(-F.col("confidence"))))).alias("score"))
        best = votes.groupBy("value").agg(F.max(F.struct("score", "kind")).alias("b")).select("value", "b.kind", "b.score")
        new = store.keep(best.where(F.col("score") >= ACCEPT - SLACK), "new")
        if not new.take(1):
            break
        before, found = found, store.keep(found.unionByName(new), "found")
        store.drop(before)
        store.drop(new)
    store.drop(edges)
    store.drop(graph)
    return found


def _as_occurrences(column: str, kind: str | None) -> Column:
    return F.transform(column, lambda x: F.struct(F.lit(kind).cast("string").alias("kind"), x["start"], x["end"], x["value"], x["words"]))


def _as_spans(kind: str, rank: int) -> Column:
    return F.transform(kind, lambda x: F.struct(F.lit(rank).alias("rank"), x["start"], x["end"], F.lit(kind).alias("kind")))


def extract_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, base, spans): arrays of (rank, start, end, kind), by kind as listed in KINDS, then start.

    ``base``: what the kinds' expressions find; ``spans``: these and what the
    trusted patterns find besides. Places count characters (code points), ends
    are exclusive. Null or empty texts have none; null ids and repeated rows are
    each returned (repeated texts are one identifier each to the graph). Extra
    columns are ignored. Empty table: no rows. A text is worked on in time near
    linear in its matches, and its spans are one row.
    """
    found_in = find(docs, id_col, text_col).withColumn("row", F.monotonically_increasing_id())
    seen = store.keep(found_in, "pii")
    every = F.concat(*(_as_occurrences(k, k) for k in KINDS), _as_occurrences("unknown", None))
    occurrences = store.keep(seen.select("row", F.explode(every).alias("x")).select("row", "x.*"), "occurrences")
    found = bootstrap(occurrences.select("kind", "value", "words"))

    rank = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).cast("int")
    added = occurrences.where("kind is null").drop("kind").join(found.select("value", "kind"), "value").groupBy("row").agg(
        F.collect_list(F.struct(rank.alias("rank"), "start", "end", "kind")).alias("added")
    )
    base = F.concat(*(_as_spans(k, i + 1) for i, k in enumerate(KINDS)))
    none = F.array().cast("array<struct<rank:int,start:int,end:int,kind:string>>")
    return seen.select("row", "id", base.alias("base")).join(added, "row", "left").select(
        F.col("id").alias(id_col), "base", F.array_sort(F.concat("base", F.coalesce("added", none))).alias("spans")
    )


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and digests of every document's spans of the four base kinds; the number of spans, and secrets with theirs, follow."""
    out = extract_pii(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    secret = lambda x: x["kind"] == "secret"
    written = lambda c, which: F.array_join(
        F.transform(F.filter(c, which), lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ","
    )

    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return out.select(
        "doc_id", *map(count, BASE_KINDS), F.sha2(written("base", lambda x: ~secret(x)), 256).alias("base_sha256"),
        written("spans", lambda x: ~secret(x)).alias("spans"), written("spans", secret).alias("secrets"),
        F.size(F.filter("spans", lambda x: ~secret(x))).cast("long").alias("n_spans"), F.size(F.filter("spans", secret)).cast("long").alias("n_secrets"),
    )
