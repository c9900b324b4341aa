"""Preference formatting: a shared prompt and two masked completions for each pair of conversations.

All in DataFrame operations. The longest common prefix needs no walk along the
turns: it ends before the least turn that the two sides don't have alike, so one
aggregation finds the rows that only one side has, and a second one the least turn
among them. Both sum before they shuffle, whatever a pair's number of turns. A pair
is rendered in blocks of ``BLOCK`` turns, so no row holds an unbounded conversation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCK = 256  # turn numbers rendered in one row

#: Fixed values of the chat format.
OPEN, MIDDLE, CLOSE = "<|im_start|>", "\n", "<|im_end|>\n"

FIRST = -(1 << 63)  # the turn number that a null one counts as


def _rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(OPEN), t.role, F.lit(MIDDLE), t.text, F.lit(CLOSE))), "")


def _mask(turns: Column, learned: str) -> Column:
    """start:end of each learned turn's text and closing mark in the rendered text, comma-joined, in code points."""
    head = len(OPEN) + len(MIDDLE)

    def step(state: Column, t: Column) -> Column:
        start = state.at + F.length(t.role) + head
        end = start + F.length(t.text) + len(CLOSE)
        span = F.concat_ws(":", start.cast("string"), end.cast("string"))
        return F.struct(
            end.alias("at"), F.when(t.role == learned, F.concat(state.spans, F.array(span))).otherwise(state.spans).alias("spans")
        )

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("spans"))
    return F.aggregate(turns, start, step, lambda s: F.array_join(s.spans, ","))


def preference_pairs(
    turns: DataFrame, pair_col: str = "pair_id", side_col: str = "side", turn_col: str = "turn", role_col: str = "role",
    text_col: str = "text", learned: str = "assistant", block: int = BLOCK,
) -> DataFrame:
    """(pair_col, block, n_common, prompt, chosen, chosen_mask, rejected, rejected_mask) from the turns of both sides.

    ``side_col`` is ``chosen`` or ``rejected``; other rows don't count. Turns go by
    their number; the rows of one number are one turn, in the order of role and
    text, and are common if both sides have the same ones. ``prompt`` renders the
    common prefix once; the completions hold the rest, and their masks the texts of
    ``learned`` turns, closing mark included. Opening marks inside texts lose their
    force ("<|" becomes "< |"). A block holds ``block`` turn numbers (block = turn
    div ``block``); a pair with more has several rows, to be joined in order;
    n_common counts the common turn rows in its block.

    A null turn number comes before all others; a null role or text is empty; rows
    without a pair id are in no pair and left out. Exact repeats of a row count
    once. A side without turns has an empty completion; equal sides have two. Extra
    columns are ignored. Empty table: no rows.
    """
    rows = turns.where(F.col(pair_col).isNotNull() & F.col(side_col).isin("chosen", "rejected")).select(
        F.col(pair_col).alias("pair"),
        F.coalesce(F.col(turn_col).cast("long"), F.lit(FIRST)).alias("turn"),
        F.replace(F.coalesce(F.col(role_col), F.lit("")), F.lit("<|"), F.lit("< |")).alias("role"),
        F.replace(F.coalesce(F.col(text_col), F.lit("")), F.lit("<|"), F.lit("< |")).alias("text"),
        F.when(F.col(side_col) == "chosen", 1).otherwise(2).alias("side"),
    )
    once = rows.groupBy("pair", "turn", "role", "text").agg(F.bit_or("side").alias("sides"))
    ends = once.where("sides <> 3").groupBy("pair").agg(F.min("turn").alias("end"))
    common = F.col("end").isNull() | (F.col("turn") < F.col("end"))
    part = once.join(ends, "pair", "left").select(
        "pair", F.floor(F.col("turn") / block).cast("long").alias("block"),
        F.struct("turn", "role", "text", F.when(common, 0).otherwise(F.col("sides")).alias("sides")).alias("t"),
    )
    held = part.groupBy("pair", "block").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    prompt = F.filter("turns", lambda t: t.sides == 0)
    chosen = F.filter("turns", lambda t: t.sides.bitwiseAND(1) == 1)
    rejected = F.filter("turns", lambda t: t.sides.bitwiseAND(2) == 2)
    return held.select("pair", "block", prompt.alias("p"), chosen.alias("c"), rejected.alias("r")).select(
        F.col("pair").alias(pair_col), "block", F.size("p").cast("long").alias("n_common"), _rendered(F.col("p")).alias("prompt"),
        _rendered(F.col("c")).alias("chosen"), _mask(F.col("c"), learned).alias("chosen_mask"),
        _rendered(F.col("r")).alias("rejected"), _mask(F.col("r"), learned).alias("rejected_mask"),
    )


def swapped_replies(conversations: DataFrame) -> DataFrame:
    """Turns (pair_id, side, turn, role, text) that pair each conversation with a worse one.

    The table has no preferences. Chosen is the conversation as it is; in the
    rejected one the last assistant turn has the text of conversation ``conv_id`` +
    1's last assistant turn (empty without one). Of rows with one turn number the
    largest text is the last.
    """
    said = conversations.where("role = 'assistant' and conv_id is not null").groupBy("conv_id").agg(
        F.max(F.struct("turn", "text")).alias("last")
    )
    other = said.select((F.col("conv_id") - 1).alias("conv_id"), F.col("last.text").alias("other"))
    own = said.select("conv_id", F.col("last.turn").alias("last_turn"), F.col("last.text").alias("last_text"))
    rows = conversations.select("conv_id", "turn", "role", "text").join(own, "conv_id", "left").join(other, "conv_id", "left")
    is_last = (
        F.coalesce(F.col("role") == "assistant", F.lit(False))
        & F.col("turn").eqNullSafe(F.col("last_turn")) & F.col("text").eqNullSafe(F.col("last_text"))
    )
    sides = F.array(
        F.struct(F.lit("chosen").alias("side"), F.col("text")),
        F.struct(F.lit("rejected").alias("side"), F.when(is_last, F.coalesce("other", F.lit(""))).otherwise(F.col("text")).alias("text")),
    )
    return rows.select(F.col("conv_id").alias("pair_id"), "turn", "role", F.explode(sides).alias("s")).select(
        "pair_id", "s.side", "turn", "role", "s.text"
    )


def op1_preference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A prompt and two masked completions for every conversation and the one with the next reply."""
    return preference_pairs(swapped_replies(spark.read.parquet(f"{sf_dir}/conversations.parquet")))


#: The same on DuckDB.
ORACLE = r"""
with said as (
  select conv_id, max(struct_pack(t := turn, x := text)) as last
  from conversations where role = 'assistant' and conv_id is not null group by conv_id
), rows_ as (
  select c.conv_id, coalesce(c.turn, -9223372036854775808) as turn, c.role, c.text,
    case when coalesce(c.role = 'assistant', false) and c.turn is not distinct from own.last.t and c.text is not distinct from own.last.x
      then coalesce(other.last.x, '') else c.text end as swapped
  from conversations c left join said own on own.conv_id = c.conv_id left join said other on other.conv_id = c.conv_id + 1
  where c.conv_id is not null
), sides as (
  select conv_id, turn, replace(coalesce(role, ''), '<|', '< |') as role, replace(coalesce(x, ''), '<|', '< |') as text, bit_or(side) as sides
  from (select conv_id, turn, role, text as x, 1 as side from rows_ union all select conv_id, turn, role, swapped, 2 from rows_)
  group by all
), ends as (
  select conv_id, min(turn) as e from sides where sides <> 3 group by conv_id
), marked as (
  select s.conv_id, s.turn, s.role, s.text, cast(floor(s.turn / 256) as bigint) as block,
    case when e is null or s.turn < e then 0 else s.sides end as sides,
    '<|im_start|>' || s.role || chr(10) || s.text || '<|im_end|>' || chr(10) as said
  from sides s left join ends using (conv_id)
), parts as (
  select *, unnest([0, 1, 2]) as part from marked
), placed as (
  select *, sum(length(said)) over (partition by conv_id, block, part order by turn, role, text) as upto
  from parts where case part when 0 then sides = 0 else (sides & part) = part end
)
select conv_id as pair_id, block, count(*) filter (part = 0) as n_common,
  coalesce(string_agg(said, '' order by turn, role, text) filter (part = 0), '') as prompt,
  coalesce(string_agg(said, '' order by turn, role, text) filter (part = 1), '') as chosen,
  coalesce(string_agg(cast(upto - 11 - length(text) as bigint) || ':' || cast(upto as bigint), ',' order by turn, role, text) filter (part = 1 and role = 'assistant'), '') as chosen_mask,
  coalesce(string_agg(said, '' order by turn, role, text) filter (part = 2), '') as rejected,
  coalesce(string_agg(cast(upto - 11 - length(text) as bigint) || ':' || cast(upto as bigint), ',' order by turn, role, text) filter (part = 2 and role = 'assistant'), '') as rejected_mask
from placed group by conv_id, block
"""
