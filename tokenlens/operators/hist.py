"""Hit counts per shard and per (label, shard): the numbers behind the histograms."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as C


def shard_count(corpus: DataFrame | None = None, n_shards: int = C.N_SHARDS) -> int:
    """Number of shard slots to zero-fill: the fixed shard count, or more if the corpus has
    more shards. ``max(shard)`` reads partition values only."""
    if corpus is None:
        return n_shards
    m = corpus.agg(F.max("shard")).first()[0]
    return max(n_shards, (m + 1) if m is not None else 0)


def shard_histogram(hits: DataFrame, n_shards: int) -> DataFrame:
    """A1 + J11: hits per shard, zero-filled over shards 0..n-1. Counts are made map-side; the
    count table has at most one row per shard (a bounded broadcast)."""
    spark = hits.sparkSession
    counts = hits.groupBy("shard").agg(F.count(F.lit(1)).alias("n"))
    slots = spark.range(n_shards).select(F.col("id").cast("int").alias("shard"))
    return slots.join(F.broadcast(counts), "shard", "left").select(
        "shard", F.coalesce("n", F.lit(0)).cast("long").alias("n_hits"))


def stacked_histogram(labelled: DataFrame, n_shards: int, labels: DataFrame | None = None) -> DataFrame:
    """A2 + W2 + U3: hits per (label, shard) for every label and shard slot, with the stack base:
    the sum of earlier labels' counts in that shard (``label_ord`` gives the stacking order).
    Slots are generated per label by ``explode(sequence(..))``; the counts side is bounded by
    labels x shards. ``labels`` (label, label_ord) lists the labels to show, so that one without
    hits has its zeros and the search above ``labelled`` runs once."""
    counts = labelled.groupBy("label", "label_ord", "shard").agg(F.count(F.lit(1)).alias("n"))
    shown = labelled if labels is None else labels
    slots = shown.select("label", "label_ord").distinct().select(
        "label", "label_ord", F.explode(F.sequence(F.lit(0), F.lit(n_shards - 1))).alias("shard"))
    # counts is an aggregation result: AQE measures it after its shuffle and broadcasts it when
    # small (at most labels x shards rows); no count job re-runs the plan above it
    full = slots.join(counts, ["label", "label_ord", "shard"], "left").select(
        "label", "label_ord", "shard", F.coalesce("n", F.lit(0)).cast("long").alias("n_hits"))
    w = Window.partitionBy("shard").orderBy("label_ord").rowsBetween(Window.unboundedPreceding, -1)
    return full.withColumn("bottom", F.coalesce(F.sum("n_hits").over(w), F.lit(0)).cast("long"))


def hit_totals(labelled: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """A3: hits per label and overall (``label`` null on the overall row); with ``labels``, zeros for
    those without hits."""
    per = labelled.groupBy("label", "label_ord").agg(F.count(F.lit(1)).alias("n_hits"))
    if labels is not None:
        per = labels.join(per, ["label", "label_ord"], "left").select("label", "label_ord", F.coalesce("n_hits", F.lit(0)).alias("n_hits"))
    tot = labelled.agg(F.count(F.lit(1)).alias("n_hits")).select(
        F.lit(None).cast("string").alias("label"), F.lit(None).cast("int").alias("label_ord"), "n_hits")
    return per.unionByName(tot)


def stack_headroom(stacked: DataFrame) -> DataFrame:
    """A4: the tallest stack and the axis limit with headroom (0 when there are no hits)."""
    heights = stacked.groupBy("shard").agg(F.sum("n_hits").alias("h"))
    m = F.coalesce(F.max("h"), F.lit(0)).cast("long")
    return heights.agg(m.alias("max_height"), (m * F.lit(C.HEADROOM)).cast("double").alias("y_limit"))
