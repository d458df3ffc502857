"""Distributed dense numbering of a distinct key set.

``dense_rank() OVER (ORDER BY key)`` without PARTITION BY runs in a single task. Here the keys are
range-partitioned and sorted, each partition numbers its rows locally, and a tiny per-partition
count table (one row per partition, a proven bound) supplies each partition's starting offset.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpoint as _ckpt

_LOCAL_BITS = 33  # monotonically_increasing_id = (partition id << 33) + row number in partition


def dense_ids(values: DataFrame, key: str, id_col: str, num_partitions: int | None = None, id_type: str = "bigint") -> DataFrame:
    """Number the distinct values of ``key`` (a struct orders by its fields) 0..n-1 in ascending (binary)
    order. ``id_type="int"`` is for keys with a proven bound, such as a vocabulary.

    ``values`` must already be distinct on ``key``. The tagged table is checkpointed into the
    shared checkpoint folder, so the two uses below read the same numbering and a lost executor
    does not re-run the range sample and sort.
    """
    spark = values.sparkSession
    n = num_partitions or max(spark.sparkContext.defaultParallelism, 1)
    tagged = (
        values.repartitionByRange(n, F.col(key))
        .sortWithinPartitions(key)
        .select("*", F.spark_partition_id().alias("_pid"), F.monotonically_increasing_id().alias("_mid"))
        .transform(_ckpt)
    )
    counts = tagged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_pid", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_off"))
    local = F.col("_mid") - F.shiftleft(F.col("_pid").cast("long"), _LOCAL_BITS)
    return (
        tagged.join(F.broadcast(offsets), "_pid")
        .withColumn(id_col, (F.col("_off") + local).cast(id_type))
        .drop("_pid", "_mid", "_off")
    )
