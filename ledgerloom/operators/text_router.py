"""Routing of mails in one pass over their texts, and of references by pointer jumping.

All aliases are one Aho-Corasick automaton, so a text is read once whatever the number
of aliases. The names are broadcast only while their bytes are under a limit that is
checked first; beyond it they meet the texts by equal parts and tokens in joins.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ledgerloom.functions import text
from ledgerloom.operators import relate, routing
from ledgerloom.sources import scratch

LIMIT = 32 << 20  # bytes of names that are broadcast, at most
INVOICE_SECTION = {"unit": "maintenance", "building": "building_maintenance", "association": "liegenschaft_maintenance"}
_TOKEN = re.compile("[A-Za-zÄÖÜäöüß0-9]{2,}")


class Matcher:
    """The best alias in a lower-cased text, else the name with the largest share of its tokens there."""

    def __init__(self, names: list[tuple], least: float):
        import ahocorasick

        self.automaton, self.least, self.places, tokens = ahocorasick.Automaton(), least, {}, {}
        for name, alias, low in sorted(names, key=lambda x: (x[0], x[1])):
            if low and not self.automaton.exists(low):  # of equal aliases the least name's
                self.automaton.add_word(low, (len(low), name, alias))
            tokens.setdefault(name, set()).update(self.tokens(alias))
        among = Counter(t for own in tokens.values() for t in own)
        self.own, alike = tokens, set()
        for name, own in tokens.items():  # in order: of names with the same common tokens and as many tokens the least one is met under these
            shared = frozenset(t for t in own if among[t] > relate.COMMON)
            for t in own if (shared, len(own)) not in alike else own - shared:
                self.places.setdefault(t, []).append(name)
            alike.add((shared, len(own)))
        if len(self.automaton):
            self.automaton.make_automaton()

    @staticmethod
    def tokens(value: str) -> set[str]:
        return {t.lower() for t in _TOKEN.findall(value)} - set(text.STOPWORDS)

    def alias(self, low: str) -> tuple | None:
        """(name, alias) of the longest alias; of equally long ones, of those beyond the score's ceiling too, the least name's."""
        if not len(self.automaton):
            return None
        found = {hit for _, hit in self.automaton.iter(low)}
        return min(((-routing.python_score(k), -k, n, a) for k, n, a in found), default=(None,) * 4)[2:]

    def by_tokens(self, value: str) -> tuple | None:
        said = self.tokens(value)
        met = {name for t in said for name in self.places.get(t, ())}
        share, name = min(((-len(self.own[n] & said) / len(self.own[n]), n) for n in met), default=(0.0, None))
        return (name, -share) if name is not None and -share >= self.least else None


def _by_automaton(texts: DataFrame, names: DataFrame, id_col: str, text_col: str, name_id: str, alias_col: str, least: float) -> DataFrame:
    rows = names.collect()  # under the limit
    held = texts.sparkSession.sparkContext.broadcast([(r[name_id], r[alias_col], r["__low"]) for r in rows])
    kind = names.schema[name_id].dataType
    schema = T.StructType([texts.schema[id_col], T.StructField("alias_target", kind), T.StructField("alias", T.StringType()), T.StructField("token_target", kind), T.StructField("token_score", T.DoubleType())])
    arrow = [to_arrow_type(f.dataType) for f in schema.fields[1:]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(held.value, least)
        for batch in batches:
            found = []
            for low, value in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                best = matcher.alias(low or "")
                best = best if best and best[0] is not None else None
                other = matcher.by_tokens(value or "") if best is None else None
                found.append((*(best or (None, None)), *(other or (None, None))))
            columns = zip(*found, strict=True) if found else [[]] * 4
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(list(c), t) for c, t in zip(columns, arrow, strict=True))], schema.names)

    return texts.select(id_col, F.lower(text_col).alias("__low"), text_col).mapInArrow(run, schema)


def _by_joins(texts: DataFrame, names: DataFrame, id_col: str, text_col: str, name_id: str, alias_col: str, least: float) -> DataFrame:
    best = routing.alias_matches(texts, names, id_col, text_col, name_id, alias_col)
    best = scratch.keep(best.select(id_col, F.col(name_id).alias("alias_target"), F.col(alias_col).alias("alias")), "alias-matches")
    left = texts.join(best, id_col, "left_anti").select(id_col, text.tokens(F.col(text_col)).alias("tokens"))
    own = names.groupBy(name_id).agg(F.array_distinct(F.flatten(F.collect_list(text.tokens(F.col(alias_col))))).alias("own"))
    other = relate.token_matches(left, own, id_col, "tokens", name_id, "own", least).select(id_col, F.col(name_id).alias("token_target"), F.col("score").alias("token_score"))
    return texts.select(id_col).join(best, id_col, "left").join(other, id_col, "left")


def property_matches(
    texts: DataFrame, aliases: DataFrame, id_col: str, text_col: str, name_id: str, alias_col: str, least: float = routing.LEAST_OVERLAP, limit: int = LIMIT
) -> DataFrame:
    """(id_col, alias_target, alias, token_target, token_score) of every text; ids are distinct.

    The longest alias that a text contains (lower-cased, trimmed) decides; only where none is
    there, the name with the largest share of its tokens, at least ``least``. Ties go to the smaller
    name. Blank aliases match nothing; null texts have neither.
    """
    names = aliases.where(F.col(name_id).isNotNull() & F.col(alias_col).isNotNull())
    names = names.select(name_id, alias_col, F.regexp_replace(F.lower(alias_col), routing.BLANK_ENDS, "").alias("__low"))
    size = names.agg(F.sum(F.octet_length(alias_col) + F.octet_length("__low") + 64)).first()[0] or 0
    how = _by_automaton if size <= limit else _by_joins
    return how(texts.select(id_col, text_col), names, id_col, text_col, name_id, alias_col, least)


def route_texts(
    events: DataFrame, aliases: DataFrame, buildings: DataFrame, associations: DataFrame, id_col: str, text_col: str, name_id: str, alias_col: str,
    least: float = routing.LEAST_OVERLAP, limit: int = LIMIT,
) -> DataFrame:
    """``events`` with method, scope, target and reason, the first rule that holds.

    An association's word without a unit reference; the alias; the tokens; the building named by its id (``buildings``:
    haus_id, building); the word with a unit reference. The association counts only if ``associations`` (association)
    has exactly one. Rows without any stay unrouted; ``structured`` can route those by their references.
    """
    matches = property_matches(events, aliases, id_col, text_col, name_id, alias_col, least, limit)
    one = routing.only_one(associations.select("association"), "association").first()["association"]
    words = F.coalesce(F.col(text_col), F.lit(""))
    by_id = buildings.select(F.upper("haus_id").alias("__haus"), F.col("building").alias("__building")).dropDuplicates(["__haus"])
    # what the rules ask of the text is found before the joins, so that these move no text that the caller doesn't want
    said = events.withColumns({
        "__haus": F.upper(text.first_match(words, "(?iu)" + text.BUILDING_ID)), "__keyword": text.first_match(words, text.any_word(text.ASSOCIATION_KEYWORDS)),
        "__unit": words.rlike("(?iu)" + text.UNIT_REFERENCE),
    })
    rows = said.join(matches, id_col, "left").join(by_id, "__haus", "left")
    keyword, unit = F.col("__keyword"), F.col("__unit")
    has = F.lit(one is not None) & keyword.isNotNull()
    rules = [
        (has & ~unit, "text_weg_keyword", "association", F.lit(one), F.concat(F.lit("keyword '"), keyword, F.lit("' (no unit ref)"))),
        (F.col("alias_target").isNotNull(), "text_alias", "unit", F.col("alias_target"), F.concat(F.lit("matched alias '"), F.col("alias"), F.lit("'"))),
        (F.col("token_target").isNotNull(), "text_tokens", "unit", F.col("token_target"), F.concat(F.lit("matched tokens "), F.round("token_score", 2).cast("string"))),
        (F.col("__building").isNotNull(), "text_haus", "building", F.col("__building"), F.concat(F.lit("matched "), F.col("__haus"), F.lit(" in body"))),
        (has, "text_weg_keyword", "association", F.lit(one), F.concat(F.lit("keyword '"), keyword, F.lit("' (fallback)"))),
    ]
    return rows.select(
        *events.columns, text.first_label([(r[0], r[1]) for r in rules], "unrouted").alias("method"), text.first_label([(r[0], r[2]) for r in rules]).alias("scope"),
        text.first_label([(r[0], r[3].cast("string")) for r in rules]).alias("target"),
        text.first_label([(r[0], r[4]) for r in rules], "no property alias / token / HAUS- / WEG-keyword match").alias("reason"),
    )


def resolved(edges: DataFrame) -> DataFrame:
    """(ref, target): what each reference comes to in the end, from (ref, to) edges, by pointer jumping.

    Every round doubles how far all pointers reach, so a chain of n references takes log2(n)
    joins. A reference has one edge (the least ``to`` of several). A chain must end in a target ('unit:7'):
    one that runs in a circle, or to a reference that leads nowhere, has none.
    """
    now = scratch.keep(edges.where("ref is not null and to is not null").groupBy("ref").agg(F.min("to").alias("to")), "pointers")
    moving, still = now, None  # pointers that moved in the last round; one that didn't has come to its end
    for _ in range(now.count().bit_length() + 1):
        ahead = now.select(F.col("ref").alias("to"), F.col("to").alias("__next"))
        after = moving.join(ahead, "to", "left").select("ref", F.coalesce("__next", "to").alias("to"), (F.coalesce("__next", "to") != F.col("to")).alias("moved"))
        after = scratch.keep(after, "pointers")
        done = after.where("not moved").select("ref", "to")
        still = done if still is None else still.unionByName(done)
        moving = after.where("moved").select("ref", "to")
        now = still.unionByName(moving)
        if not moving.take(1):
            break
    ends = now.join(now.select(F.col("ref").alias("to")), "to", "left_anti")  # what is itself a reference is in a circle
    return ends.where(F.contains("to", F.lit(":"))).select("ref", F.col("to").alias("target"))


def structured(events: DataFrame, pointers: DataFrame, association: str | None) -> DataFrame:
    """``routing.structured_route`` of events whose eh_id, mie_id, invoice_ref and haus_id are resolved through ``pointers`` (ref, target)."""
    of = {"eh_id": "unit_by_eh", "mie_id": "unit_by_mie", "invoice_ref": "invoice_target", "haus_id": "building_by_haus"}
    n = sum(F.col(c).isNotNull().cast("int") for c in of)
    none, one, more = events.where(n == 0), events.where(n == 1), events.where(n > 1)
    # most events have one reference: these meet the pointers once, and events without any never do
    met = one.withColumn("__ref", F.coalesce(*of)).join(pointers.select(F.col("ref").alias("__ref"), F.col("target").alias("__target")), "__ref", "left")
    met = met.select(*events.columns, *(F.when(F.col(c).isNotNull(), F.col("__target")).alias(into) for c, into in of.items()))
    for column, into in of.items():
        more = more.join(pointers.select(F.col("ref").alias(column), F.col("target").alias(into)), column, "left")
    none = none.withColumns({into: F.lit(None).cast("string") for into in of.values()})
    rows = met.unionByName(more).unionByName(none)
    return routing.structured_route(rows.withColumn("association", F.lit(association).cast("string")))


def invoice_facts(routed: DataFrame) -> DataFrame:
    """The fact that an invoice adds at its scope: section, field, value and confidence in hundredths; rows without a scope add none.

    Columns read: target ('unit:7'), dl_id, filename, document_type. The contractor is ``dl_id``, else what the file name says.
    """
    scope = F.substring_index("target", ":", 1)
    contractor = F.coalesce("dl_id", text.first_match(F.coalesce("filename", F.lit("")), text.CONTRACTOR_ID.replace(r"\b", "")))
    value = F.concat(F.coalesce("document_type", F.lit("invoice")), F.lit(" from contractor "), F.coalesce(contractor, F.lit("(unknown)")), F.lit(" — "), F.coalesce("filename", F.lit("unknown invoice")))
    section = text.first_label([(scope == s, x) for s, x in INVOICE_SECTION.items()])
    return routed.withColumns({"section": section, "field": F.lit("last_contractor_invoice"), "value": value, "contractor": contractor, "confidence": F.lit(90)}).where("section is not null")
