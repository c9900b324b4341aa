"""Consistent-hash ring with virtual nodes and bounded loads, in DataFrame operations only.

Keys are placed in ring order. A key belongs to the arc that ends in the first
virtual node at or after its hash; where that node's shard is full, it goes on
clockwise to the next shard with room. All keys of an arc see the same order of
shards, so the placing needs only the number of keys in each arc: a table of
``shards * vnodes`` rows, whatever the size of the input. The fold over that
table gives each arc a few (shard, rank interval) quotas, and the rows find
theirs by their rank within the arc. Only (key, hash, size) rows are shuffled,
spread over all arcs; the texts stay where they are read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CELL_BITS = 12

#: Places the arcs one after another. ``arcs``: the key counts in ring order;
#: ``ring``: the shard of each arc's node; ``caps``: the shards' capacities.
_FOLD = """
aggregate(
  sequence(1, size(arcs)),
  named_struct('loads', transform(caps, c -> 0L),
               'quotas', cast(array() as array<struct<arc:int,shard:int,lo:bigint,hi:bigint,slot0:bigint>>)),
  (state, i) -> if(arcs[i - 1] = 0, state,
    transform(array(aggregate(
      if(state.loads[ring[i - 1]] + arcs[i - 1] <= caps[ring[i - 1]], array(ring[i - 1]),
         array_distinct(slice(concat(ring, ring), i, size(ring)))),
      named_struct('loads', state.loads, 'quotas', state.quotas, 'left', arcs[i - 1]),
      (s, shard) -> if(s.left = 0 or s.loads[shard] >= caps[shard], s,
        named_struct(
          'loads', transform(s.loads, (load, k) -> if(k = shard, load + least(s.left, caps[k] - load), load)),
          'quotas', concat(s.quotas, array(named_struct(
             'arc', i - 1, 'shard', shard,
             'lo', arcs[i - 1] - s.left,
             'hi', arcs[i - 1] - s.left + least(s.left, caps[shard] - s.loads[shard]),
             'slot0', s.loads[shard]))),
          'left', s.left - least(s.left, caps[shard] - s.loads[shard])))
    )), s -> named_struct('loads', s.loads, 'quotas', s.quotas))[0])
).quotas
"""


def ring(spark: SparkSession, shards: int, vnodes: int) -> DataFrame:
    """(arc, pos, shard) of every virtual node, arcs numbered in ring order."""
    nodes = spark.range(shards * vnodes).select(
        (F.col("id") / vnodes).cast("int").alias("shard"), (F.col("id") % vnodes).alias("copy")
    )
    nodes = nodes.select("shard", F.xxhash64(F.lit("node"), "shard", "copy").alias("pos"))
    return nodes.select(
        (F.row_number().over(Window.orderBy("pos", "shard")) - 1).alias("arc"), "pos", "shard"
    )


def _cells(nodes: DataFrame) -> DataFrame:
    """For each of 2**CELL_BITS equal pieces of the ring, its nodes and the first arc behind it."""
    cell = F.shiftright("pos", 64 - CELL_BITS).cast("int")
    inside = nodes.groupBy(cell.alias("cell")).agg(
        F.sort_array(F.collect_list(F.struct("pos", "arc"))).alias("here"), F.min("arc").alias("first")
    )
    half = 1 << (CELL_BITS - 1)
    after = Window.orderBy("cell").rowsBetween(1, Window.unboundedFollowing)
    return (
        nodes.sparkSession.range(-half, half).select(F.col("id").cast("int").alias("cell"))
        .join(inside, "cell", "left")
        .select("cell", "here", F.coalesce(F.min("first").over(after), F.lit(0)).alias("behind"))
    )


def bounded_ring(
    df: DataFrame, key: str = "doc_id", shards: int = 40, vnodes: int = 128, load_factor: float = 1.0,
    ties: tuple[str, ...] = (),
) -> DataFrame:
    """Put every row of ``df`` on a shard; adds ``shard`` (int) and ``slot`` (long, gapless from 0 in a shard).

    ``load_factor`` c bounds each shard to ceil(c * n / shards) rows; at exactly
    1.0 the first n mod shards shards hold one row more than the others, so all
    counts are at most one apart. ``ties`` orders rows of an equal key.

    Nulls: a null key is a key like any other. Repeated rows: each is placed.
    Empty table: no rows. Columns named shard or slot in ``df`` are replaced; names
    that begin with two underscores are taken.
    """
    spark = df.sparkSession
    df = df.drop("shard", "slot")
    nodes = ring(spark, shards, vnodes)
    hashed = df.withColumn("__h", F.xxhash64(F.lit("key"), F.col(key)))

    def arcs_of(rows: DataFrame) -> DataFrame:
        at = rows.withColumn("__cell", F.shiftright("__h", 64 - CELL_BITS).cast("int"))
        cells = F.broadcast(_cells(nodes).toDF("__cell", "__here", "__behind"))  # 2**CELL_BITS rows
        return at.join(cells, "__cell").withColumn(
            "__arc",
            F.coalesce(F.expr("get(filter(__here, x -> x.pos >= __h), 0).arc"), F.col("__behind")),
        ).drop("__cell", "__here", "__behind")

    counts = arcs_of(hashed.select("__h")).groupBy(F.col("__arc").alias("arc")).agg(F.count("*").alias("n"))
    table = (
        nodes.join(counts, "arc", "left")
        .agg(F.sort_array(F.collect_list(F.struct("arc", "shard", F.coalesce("n", F.lit(0)).alias("n")))).alias("t"))
        .select(F.expr("transform(t, x -> x.n)").alias("arcs"), F.expr("transform(t, x -> x.shard)").alias("ring"))
        .withColumn("total", F.expr("aggregate(arcs, 0L, (a, x) -> a + x)"))
    )
    if load_factor == 1.0:
        caps = F.expr(f"transform(sequence(0, {shards - 1}), s -> total div {shards} + if(s < total % {shards}, 1L, 0L))")
    else:
        caps = F.expr(f"transform(sequence(0, {shards - 1}), s -> cast(ceil({load_factor}D * total / {shards}) as bigint))")
    quotas = table.withColumn("caps", caps).select(F.explode(F.expr(_FOLD)).alias("q")).select(
        F.col("q.arc").alias("__arc"), F.col("q.shard").alias("__shard"), F.col("q.lo").alias("__lo"), F.col("q.hi").alias("__hi"), F.col("q.slot0").alias("__slot0")
    )  # shards * vnodes arcs, each with at most `shards` quotas
    order = Window.partitionBy("__arc").orderBy("__h", key, *ties)
    ranked = arcs_of(hashed).withColumn("__rank", F.row_number().over(order) - 1)
    hit = (F.col("__rank") >= F.col("__lo")) & (F.col("__rank") < F.col("__hi"))
    placed = ranked.join(F.broadcast(quotas), "__arc").where(hit)
    return placed.select(
        *df.columns, F.col("__shard").alias("shard"), (F.col("__slot0") + F.col("__rank") - F.col("__lo")).cast("long").alias("slot")
    )


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Law ``rows``: every document on one of 40 shards, counts at most one apart."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
    )
    return bounded_ring(docs, "doc_id", shards=40, ties=("text_crc32", "size")).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
