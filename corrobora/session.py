"""Session helpers: checkpointing and small structural utilities shared by the operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def checkpoint_dir(spark: SparkSession) -> str:
    """The reliable checkpoint folder of this session.

    The cluster names a shared folder in ``spark.checkpoint.dir``. Only a local session that has
    none gets a scratch folder; on a cluster a missing setting is an error, because a machine-local
    folder would be lost together with its executor.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        configured = tempfile.mkdtemp(prefix="corrobora-checkpoint-")
    sc.setCheckpointDir(configured)
    return configured


def cut_lineage(df: DataFrame) -> DataFrame:
    """``df`` written once as a table in the shared checkpoint folder.

    Later steps of an iterative plan read that table: their plans stay flat, lost executors only cost a re-read, and,
    unlike an RDD checkpoint, the table has columns to prune and a size the join planner can trust.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def first_by(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """One row per key, the first in ``order``.

    ``row_number() = 1`` becomes a per-partition group limit before the shuffle, so a hot key sends
    one row per map task instead of its whole group.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def top_by(df: DataFrame, keys: list[str], order: list, k: int, rank: str = "rank") -> DataFrame:
    """The first ``k`` rows per key with their 1-based rank (same group limit as ``first_by``)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= k)


def running_before(df: DataFrame, keys: list[str], order: list[str], value: Column, name: str) -> DataFrame:
    """Adds ``name``: the sum of ``value`` over the rows of the same key that come earlier in ``order``.

    No key is brought into one task. Rows are range-partitioned on (key, order), so a hot key spans many tasks. Each task
    sums its own rows; only keys cut by a partition boundary need an offset, and there are fewer of those than partitions,
    which bounds the table that is broadcast. Rows of a null key keep their own sums apart per partition.
    """
    placed = cut_lineage(
        df.withColumn("_value", value).repartitionByRange(*[F.col(c) for c in [*keys, *order]]).withColumn("_pid", F.spark_partition_id())
    )
    local = Window.partitionBy(*keys, "_pid").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    numbered = placed.withColumn(name, F.sum("_value").over(local) - F.col("_value"))
    sizes = placed.groupBy(*keys, "_pid").agg(F.sum("_value").alias("_n"))
    spanning = sizes.groupBy(*keys).agg(F.count(F.lit(1)).alias("_parts")).filter("_parts > 1").drop("_parts")
    before = Window.partitionBy(*keys).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    cut = sizes.join(F.broadcast(spanning), keys, "left_semi") if keys else sizes
    offsets = cut.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    return (
        numbered.join(F.broadcast(offsets), [*keys, "_pid"], "left")
        .withColumn(name, (F.col(name) + F.coalesce("_before", F.lit(0))).cast("long"))
        .drop("_pid", "_before", "_value")
    )


def ordinal_within(df: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
    """0-based position of every row inside its key, without bringing a key into one task."""
    return running_before(df, keys, order, F.lit(1).cast("long"), name)
