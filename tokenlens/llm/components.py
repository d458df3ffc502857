"""Connected components of an edge list by minimum labels, with bounded rounds of joins.

Every round, each component hooks onto the smallest label next to it and labels jump once along the
hooks; each round is written to the shared folder. Look-ups of a hub vertex or of a component that
holds many vertices go through ``attach``, so neither has to fit in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, attach


def connected_components(edges: DataFrame, scratch: Scratch, name: str = "components") -> DataFrame:
    """vertex, component (its smallest vertex) of every vertex in ``edges`` (a, b: any order, with
    repeats)."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = scratch.write(both.where("a <> b").distinct(), f"{name}-edges")
    labels = scratch.write(both.groupBy("a").agg(F.count(F.lit(1)).alias("degree"), F.least(F.col("a"), F.min("b")).alias("component"))
                           .select(F.col("a").alias("vertex"), "component", "degree"), f"{name}-0")
    n_edges, n = both.count(), labels.count()
    if not n_edges:
        return labels.select("vertex", "component")
    step = 0
    while True:
        step += 1
        next_to = attach(both.withColumnRenamed("b", "vertex"), labels, ["vertex"], "degree", n_edges)
        seen = next_to.groupBy(F.col("a").alias("vertex")).agg(F.min("component").alias("seen"))
        hooks = (labels.join(seen, "vertex").groupBy("component")
                 .agg(F.min(F.least("seen", "component")).alias("hook"), F.count(F.lit(1)).alias("size")))
        hooks = scratch.write(hooks, f"{name}-hooks-{step}")
        if not hooks.where("hook < component").limit(1).count():
            return labels.select("vertex", "component")
        far = hooks.join(hooks.select(F.col("component").alias("hook"), F.col("hook").alias("next")), "hook", "left")
        far = far.select("component", "size", F.least("hook", F.coalesce("next", "hook")).alias("to"))
        moved = attach(labels, far, ["component"], "size", n)
        labels = scratch.write(moved.select("vertex", F.col("to").alias("component"), "degree"), f"{name}-{step}")
        if step > 1:
            scratch.drop(f"{name}-{step - 1}", f"{name}-hooks-{step - 1}")
