"""Structural helpers shared by the operators: checked broadcasts, prefix sums over split groups, components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corrobora.session import cut_lineage

#: Rows of a few numbers each that every executor may hold; beyond it joins shuffle.
SMALL_ROWS = 1_000_000


def small_batches(spark: SparkSession, rows: int = 1_000) -> None:
    """Sends at most ``rows`` rows at a time to Python tasks of this session, unless the session says otherwise already.

    Texts are long, so the default of 10,000 rows would hold tens of megabytes several times over in every task.
    """
    name, usual = "spark.sql.execution.arrow.maxRecordsPerBatch", "10000"
    if spark.conf.get(name, usual) == usual:
        spark.conf.set(name, str(rows))


def small(df: DataFrame, rows: int = SMALL_ROWS) -> DataFrame:
    """``df`` with a broadcast hint when a count proves that it has at most ``rows`` rows, else ``df`` itself.

    Either way the join gives the same rows; only the physical join differs.
    """
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def sample_by_hash(df: DataFrame, column: str, rows: int) -> DataFrame:
    """The ``rows`` distinct values of ``column`` with the smallest hashes: the same ones however the table is split.

    Only hashes are ranked; the values themselves leave a task when their hash is below the rank's edge, copies once.
    """
    hashed = df.select(column, F.xxhash64(column).alias("_h"))
    edge = hashed.select("_h").distinct().orderBy("_h").limit(rows).agg(F.max("_h")).first()[0]
    return hashed.where(F.col("_h") <= F.lit(edge)).dropDuplicates(["_h"]).select(column)


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once per row, however often ``body`` mentions it."""
    return F.transform(F.array(value), body)[0]


def placed_by(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """``df`` range-partitioned on (keys, order) and written, with the partition number in ``_pid``.

    A hot key spans many partitions, so no later step needs a whole key in one task.
    """
    return cut_lineage(
        df.repartitionByRange(*[F.col(c) for c in [*keys, *order]]).withColumn("_pid", F.spark_partition_id())
    )


def sums_before(placed: DataFrame, keys: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """Adds ``name``: the sum of ``value`` over the rows of the same keys that come earlier in ``order``.

    ``placed`` comes from ``placed_by`` with the same keys and order. Every partition sums its own rows; the totals of
    the partitions, one row per key and partition that holds it, give the offsets. Keys may be null.
    """
    local = Window.partitionBy(*keys, "_pid").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy(*keys).orderBy("_pid").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    offsets = placed.groupBy(*keys, "_pid").agg(F.sum(value).alias("_total")).select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_pid").alias("_p"),
        (F.sum("_total").over(before) - F.col("_total")).alias("_offset"),
    )
    on = F.col("_pid") == F.col("_p")
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    own = placed.withColumn("_own", F.sum(value).over(local) - F.col(value))
    return (
        own.join(small(offsets), on, "left").withColumn(name, F.col("_own") + F.col("_offset"))
        .drop("_own", "_offset", "_total", "_p", "_pid", *[f"_k{i}" for i in range(len(keys))])
    )


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the undirected ``edges(a, b)``; the root is the smallest node reachable.

    Alternates large-star and small-star steps; each keeps at most as many edges as there are nodes and links, groups
    are only aggregated, never gathered. Every iteration reads a written table. It is done when every node has one
    parent and no parent has one.
    """
    flat = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct()
    while True:
        flat = cut_lineage(flat)
        ends = flat.select(F.col("b").alias("node"), F.lit(1).alias("child"), F.lit(0).alias("parent")).union(
            flat.select("a", F.lit(0), F.lit(1))
        )
        roles = ends.groupBy("node").agg(F.sum("child").alias("child"), F.max("parent").alias("parent"))
        if roles.where("child > 1 or (child > 0 and parent > 0)").isEmpty():
            return flat.select(F.col("b").alias("node"), F.col("a").alias("root")).union(
                flat.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct()
            )
        both = flat.select(F.col("a").alias("u"), F.col("b").alias("v")).union(flat.select("b", "a"))
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        large = (
            both.where("v > u").join(least, "u").select(F.least("u", "m").alias("a"), F.col("v").alias("b")).distinct()
        )
        least = large.groupBy("b").agg(F.min("a").alias("m"))
        flat = (
            large.join(least, "b").where("a <> m").select(F.col("m").alias("a"), F.col("a").alias("b"))
            .union(least.select("m", "b")).distinct()
        )
