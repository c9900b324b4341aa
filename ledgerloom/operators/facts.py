"""The fact store: proposals folded into a chain of versions for each (scope, section, field)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions import text

# The rank of each source and the lead that a weaker one needs (hundredths).
SOURCE_RANK = {"pdf": 5, "erp": 4, "email": 3, "slack": 2, "web": 1, "debug": 0}
WEAKER_LEAD = 10
FLOOR = 70
AUTHORITATIVE = ("structural_permit", "vermessungsprotokoll", "kaufvertrag")
TOLERANCE_PERCENT = 5.0
HOT = 100_000  # actions on one item that aren't sorted together


def source_rank(source: Column) -> Column:
    return text.first_label([(source == s, r) for s, r in SOURCE_RANK.items()], 0)


def supersede_runs(log: DataFrame, key: Sequence[str], value: str, order: Sequence[str]) -> DataFrame:
    """Versions of structured facts: a row opens one where its trimmed value differs from the row before.

    Adds valid_to (the next version's first ``order`` column, null while current)
    and is_current. Null values are values; equal rows never open a version.
    """
    by = Window.partitionBy(*key).orderBy(*order)
    trimmed = F.trim(F.col(value))
    opened = log.withColumn("__n", F.row_number().over(by)).withColumn("__was", F.lag(trimmed).over(by))
    opened = opened.where((F.col("__n") == 1) | ~trimmed.eqNullSafe(F.col("__was"))).drop("__n", "__was")
    return opened.withColumn("valid_to", F.lead(order[0]).over(by)).withColumn(
        "is_current", F.row_number().over(Window.partitionBy(*key).orderBy(*(F.col(c).desc() for c in order))) == 1
    )


def fold(
    log: DataFrame, key: Sequence[str], order: Sequence[str], value: str = "value", rank: str = "rank", confidence: str = "confidence",
    human: str | None = None, state: DataFrame | None = None,
) -> DataFrame:
    """The current fact of each key after replacing in ``order``: (*key, value, rank, confidence, last order columns, n_versions, n_inputs).

    A proposal replaces the current fact unless that was edited by a person, has the
    same trimmed value, comes from a stronger source and is not led by WEAKER_LEAD,
    or has an equal rank and more confidence. The relation isn't transitive, so the
    rows of a key are folded in their order; keys run apart from each other.
    ``confidence`` is an integer of hundredths. A hot key's rows are first thinned
    out losslessly: a row equal in value, rank and confidence to the row before it
    can't change anything.

    ``state``: what an earlier fold gave for some keys, whose rows in ``log`` all come
    after those it saw; their fold goes on from there. ``human`` isn't kept in it.
    """
    if state is not None:
        mine = {c: state[c] for c in (*key, *order, value, rank, confidence)}
        log = log.select(*mine).withColumn("__versions", F.lit(None).cast("long")).withColumn("__inputs", F.lit(1).cast("long")).unionByName(
            state.select(*mine, F.col("n_versions").alias("__versions"), F.col("n_inputs").alias("__inputs"))
        )
    else:
        log = log.withColumn("__versions", F.lit(None).cast("long")).withColumn("__inputs", F.lit(1).cast("long"))
    by = Window.partitionBy(*key).orderBy(*order)
    touched = F.col(human) if human else F.lit(False)
    same = F.lit(True)
    for c in (F.trim(F.col(value)), F.col(rank), F.col(confidence), touched):
        same = same & c.eqNullSafe(F.lag(c).over(by))
    thin = log.withColumn("__same", same & (F.row_number().over(by) > 1)).withColumns({"__n": F.sum("__inputs").over(Window.partitionBy(*key)), "__v": F.max("__versions").over(Window.partitionBy(*key))})
    row = F.struct(
        *(F.col(c).alias(f"o{i}") for i, c in enumerate(order)), F.col(value).alias("value"), F.trim(F.col(value)).alias("bare"),
        F.col(rank).cast("int").alias("rank"), F.col(confidence).cast("int").alias("confidence"), touched.alias("human"),
    )
    lists = thin.where(~F.col("__same")).groupBy(*key).agg(F.array_sort(F.collect_list(row)).alias("rows"), F.max("__n").alias("n_inputs"), F.max("__v").cast("int").alias("__v"))

    def step(state: Column, new: Column) -> Column:
        cur = state.cur
        keep = (
            cur.human | cur.bare.eqNullSafe(new.bare)
            | ((new.rank < cur.rank) & (new.confidence < cur.confidence + WEAKER_LEAD))
            | ((new.rank == cur.rank) & (new.confidence < cur.confidence))
        ) & ~new.human
        return F.when(keep, state).otherwise(F.struct(new.alias("cur"), (state.versions + 1).alias("versions")))

    start = F.struct(F.element_at("rows", 1).alias("cur"), F.coalesce("__v", F.lit(1)).alias("versions"))
    done = lists.withColumn("__state", F.aggregate(F.slice("rows", F.lit(2), F.size("rows")), start, step))
    return done.select(
        *key, F.col("__state.cur.value").alias(value), F.col("__state.cur.rank").alias(rank), F.col("__state.cur.confidence").alias(confidence),
        *(F.col(f"__state.cur.o{i}").alias(c) for i, c in enumerate(order)), F.col("__state.versions").cast("long").alias("n_versions"), "n_inputs",
    )


def confidence_floor(proposals: DataFrame, confidence: str = "confidence", floor: int = FLOOR) -> DataFrame:
    """Adds ``uncertain``: below the floor; the floor itself is kept as a fact."""
    return proposals.withColumn("uncertain", F.coalesce(F.col(confidence) < floor, F.lit(True)))


def _verdict(passed: Column, review: Column) -> Column:
    return F.when(passed, "passed").when(review, "needs_review").otherwise("rejected")


def verdicts(proposals: DataFrame) -> DataFrame:
    """Adds constraint, verdict (passed, needs_review, rejected) and required_source to proposals.

    Columns read: section, field, value, current_value, master_value, source,
    document_type. The named rule of a key comes before the rule of its section.
    """
    src, doc = F.coalesce(F.col("source"), F.lit("")), F.coalesce(F.col("document_type"), F.lit(""))
    key = F.concat_ws(".", "section", "field")
    first, has = F.col("current_value").isNull(), F.col("current_value").isNotNull()
    contradicts = F.col("master_value").isNotNull() & ~text.comparable(F.col("value")).eqNullSafe(text.comparable(F.col("master_value")))
    pdf = src == "pdf"
    a, b = text.first_number(F.col("current_value")), text.first_number(F.col("value"))
    within = (F.abs(b - a) / F.abs(a) * 100 <= TOLERANCE_PERCENT) | a.isNull() | b.isNull() | (a == 0)
    compliance = F.col("section").isin("compliance", "liegenschaft_compliance")
    rules = [
        ("building_address_immutable", key == "building_overview.address", first & ~contradicts, pdf & doc.isin(*AUTHORITATIVE), "|".join(AUTHORITATIVE)),
        ("building_floor_count_immutable", key == "building_overview.floor_count", first & ~contradicts, pdf & (doc == "structural_permit"), "structural_permit"),
        ("building_year_built_immutable", key == "building_overview.year_built", first & ~contradicts, F.lit(False), None),
        ("owner_change", key == "overview.owner_name", first, pdf & (doc == "kaufvertrag"), "kaufvertrag"),
        ("area_tolerance", key == "overview.square_meters_qm", first | within | (pdf & (doc == "vermessungsprotokoll")), has, "vermessungsprotokoll"),
        ("rent_change", key == "financials.rent_amount", first, pdf & (doc == "lease_addendum"), "lease_addendum"),
        ("tenant_change", key == "tenants.current_tenant_name", first, pdf & (doc == "lease"), "lease"),
        ("compliance_source", compliance, (src == "web") | (pdf & doc.isin(*AUTHORITATIVE)), pdf & doc.isin("", "other", "unknown"), "web|" + "|".join(AUTHORITATIVE)),
    ]
    name = text.first_label([(holds, n) for n, holds, *_ in rules])
    verdict = text.first_label([(holds, _verdict(ok, review)) for _, holds, ok, review, _ in rules], "passed")
    needs = text.first_label([(holds, F.lit(r).cast("string")) for _, holds, _, _, r in rules])
    out = proposals.withColumn("constraint", name).withColumn("verdict", verdict)
    return out.withColumn("required_source", F.when(F.col("verdict") != "passed", needs))


def promote(uncertain: DataFrame, actions: DataFrame, key: str) -> DataFrame:
    """Review actions on open items: adds outcome and final_value.

    A promotion takes the action's value, else the item's hypothesis; without either
    it is unprocessable, and on an item that isn't open a conflict.
    """
    # keys of very many actions are few: their items come to the actions, which then needn't be sorted in one task
    often = F.broadcast(actions.groupBy(key).agg(F.count("*").alias("__n")).where(F.col("__n") > HOT).select(key))
    met = actions.join(often, key, "left_anti").join(uncertain, key, "left")
    met = met.unionByName(actions.join(often, key, "left_semi").join(F.broadcast(uncertain.join(often, key, "left_semi")), key, "left"))
    value = F.coalesce(F.nullif("given_value", F.lit("")), F.nullif("hypothesis", F.lit("")))
    outcome = (
        F.when(F.col("status").isNull(), "not_found").when(F.col("status") != "open", "conflict")
        .when((F.col("action") == "promote") & value.isNull(), "unprocessable").otherwise(F.col("action"))
    )
    return met.withColumn("outcome", outcome).withColumn("final_value", F.when(F.col("outcome") == "promote", value))
