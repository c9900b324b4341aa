"""Routing of events to a unit, a building or the owners' association."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.functions import text

# Fixed values of the alias score and of the least token overlap.
ALIAS_BASE, ALIAS_LENGTH, ALIAS_MOST = 0.6, 60, 0.39
LEAST_OVERLAP = 0.3
STARTS = 1 << 16  # first letters of aliases that are broadcast, at most
GRAMS = (8, 6, 4, 2, 1)  # how many first letters
#: What Python's strip() takes off.
BLANK_ENDS = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"


def alias_score(alias: Column) -> Column:
    return F.lit(ALIAS_BASE) + F.least(F.length(alias) / ALIAS_LENGTH, F.lit(ALIAS_MOST))


def python_score(length: int) -> float:
    return ALIAS_BASE + min(length / ALIAS_LENGTH, ALIAS_MOST)


def _starts(names: DataFrame, limit: int) -> list[tuple[str, list[int]]]:
    """(start, lengths): the first letters of all aliases, as many as keep this list under ``limit``, and how long the aliases are that begin so."""
    for gram in GRAMS:
        found = names.select(F.substring("__low", 1, gram).alias("start"), F.length("__low").alias("n")).distinct().groupBy("start").agg(F.collect_list("n").alias("lengths"))
        rows = found.limit(limit + 1).collect()
        if len(rows) <= limit or gram == GRAMS[-1]:  # first letters are as many as an alphabet has
            return [(r["start"], sorted(r["lengths"])) for r in rows]
    return []


def _pieces(texts: DataFrame, id_col: str, starts: list[tuple[str, list[int]]]) -> DataFrame:
    """(id_col, __low): the distinct parts of each text (id_col, __text) that begin as an alias does and are as long as one."""
    held = texts.sparkSession.sparkContext.broadcast(starts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for start, lengths in held.value:
            automaton.add_word(start, (len(start) - 1, lengths))
        if len(automaton):
            automaton.make_automaton()
        for batch in batches:
            which, parts = [], []
            for i, text in enumerate(batch.column(1).to_pylist() if len(automaton) else ()):
                own = {text[end - back : end - back + n] for end, (back, lengths) in automaton.iter(text) for n in lengths if end - back + n <= len(text)}
                which += [i] * len(own)
                parts += own
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(which, pa.int64())), pa.array(parts, pa.string())], [id_col, "__low"])

    return texts.mapInArrow(run, T.StructType([texts.schema[id_col], T.StructField("__low", T.StringType())]))


def alias_matches(texts: DataFrame, aliases: DataFrame, id_col: str, text_col: str, name_id: str, alias_col: str, limit: int = STARTS) -> DataFrame:
    """Of each text the alias it contains with the best score (longest; ties to the smaller id): (id_col, name_id, alias_col, score).

    Aliases are compared lower-cased and trimmed; blank ones match nothing. Equal aliases are one, the least name's. A
    text is read once for the places where an alias may begin (``limit`` such starts at most are broadcast); its parts
    there, as long as aliases with that start are, meet the aliases as equal strings. So aliases that start alike don't
    come to a text that only has their start.
    """
    names = aliases.select(name_id, alias_col, F.regexp_replace(F.lower(alias_col), BLANK_ENDS, "").alias("__low")).where("__low <> ''")
    names = names.groupBy("__low").agg(F.min(F.struct(name_id, alias_col)).alias("__n"))
    low = texts.select(id_col, F.lower(text_col).alias("__text")).where("__text is not null")
    met = _pieces(low, id_col, _starts(names, limit)).join(names, "__low")
    best = met.groupBy(id_col).agg(F.min_by(F.struct("__n.*", "__low"), F.struct(-F.length("__low"), "__n")).alias("__n"))
    return best.select(id_col, f"__n.{name_id}", f"__n.{alias_col}", alias_score(F.col("__n.__low")).alias("score"))


def structured_route(events: DataFrame) -> DataFrame:
    """Adds method, reason and the target columns by the first reference that resolves.

    Columns read: eh_id, mie_id, invoice_ref, haus_id (references), unit_by_eh,
    unit_by_mie, invoice_target, building_by_haus (what they resolve to, null if
    nothing), association (null unless there is exactly one), category, words, source.
    """
    category = F.lower(F.trim(F.coalesce("category", F.lit(""))))
    by_category = category.isin(*(c for c in text.ASSOCIATION_CATEGORIES if c != "hausgeld"))
    keyword = text.first_match(F.col("words"), text.any_word(text.ASSOCIATION_KEYWORDS))
    has = F.col("association").isNotNull()
    rules = [
        (F.col("unit_by_eh").isNotNull(), "eh_alias", F.concat(F.lit("matched "), F.col("eh_id")), "unit", F.col("unit_by_eh")),
        (F.col("unit_by_mie").isNotNull(), "mie_to_eh", F.concat(F.lit("matched "), F.col("mie_id")), "unit", F.col("unit_by_mie")),
        (F.col("invoice_target").isNotNull(), "inherit_from_invoice", F.concat(F.lit("linked via "), F.col("invoice_ref")), "inherited", F.col("invoice_target")),
        (F.col("building_by_haus").isNotNull(), "haus_alias", F.concat(F.lit("matched "), F.col("haus_id")), "building", F.col("building_by_haus")),
        (has & by_category, "weg_kategorie", F.concat(F.lit("kategorie="), category), "association", F.col("association")),
        (has & keyword.isNotNull(), "weg_keyword", F.concat(F.lit("keyword '"), keyword, F.lit("'")), "association", F.col("association")),
        (has & F.coalesce(F.col("source") == "invoice", F.lit(False)), "weg_invoice", F.lit("invoice without per-unit attribution"), "association", F.col("association")),
    ]
    seen = F.concat_ws(", ", "eh_id", "mie_id", "invoice_ref", "haus_id")
    nothing = (seen == "") & (category == "")
    why = F.when(nothing, "no EH-/MIE-/INV-/HAUS-/kategorie in metadata").otherwise(F.concat(
        F.lit("refs "), F.coalesce(F.nullif(seen, F.lit("")), F.lit("(none)")), F.lit(" kat="), F.coalesce(F.nullif(category, F.lit("")), F.lit("(none)")), F.lit(" unresolved")
    ))
    return (
        events.withColumn("method", text.first_label([(r[0], r[1]) for r in rules], "unrouted"))
        .withColumn("reason", text.first_label([(r[0], r[2]) for r in rules], why))
        .withColumn("scope", text.first_label([(r[0], r[3]) for r in rules]))
        .withColumn("target", text.first_label([(r[0], r[4]) for r in rules]))
    )


def text_route(events: DataFrame) -> DataFrame:
    """Adds method and scope for free text: an association word without a unit reference, then the alias or token match, the building, the word.

    Columns read: words, alias_target, token_target, building_target, association.
    """
    weg = F.col("words").rlike(text.any_word(text.ASSOCIATION_KEYWORDS)) & F.col("association").isNotNull()
    unit = F.col("words").rlike("(?iu)" + text.UNIT_REFERENCE)
    rules = [
        (weg & ~unit, "weg_keyword", "association"), (F.col("alias_target").isNotNull(), "alias", "unit"), (F.col("token_target").isNotNull(), "tokens", "unit"),
        (F.col("building_target").isNotNull(), "haus", "building"), (weg, "weg_fallback", "association"),
    ]
    return events.withColumn("method", text.first_label([(c, m) for c, m, _ in rules], "unrouted")).withColumn("scope", text.first_label([(c, s) for c, _, s in rules]))


def only_one(associations: DataFrame, id_col: str) -> DataFrame:
    """One row: the id where the table has exactly one, else null."""
    return associations.agg(F.when(F.count("*") == 1, F.min(id_col)).alias("association"))
