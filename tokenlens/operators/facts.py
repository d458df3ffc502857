"""Fact grid (facts x checkpoints), token-boundary validation, quarantine, resume and the
per-step result sink."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import constants as C


def steps_column(start: int = C.FACT_STEP_START, end: int = C.FACT_STEP_END, by: int = C.FACT_STEP_BY):
    """Steps ``start <= step < end`` by ``by`` as an array literal expression."""
    return F.sequence(F.lit(start), F.lit(end - by), F.lit(by))


def fact_grid(facts: DataFrame, variant: str = C.FACT_VARIANT, **steps) -> DataFrame:
    """Every fact at every checkpoint step. The step list is a bounded literal exploded per
    fact row, so there is no join at all."""
    return facts.select("*", F.lit(variant).alias("variant"), F.explode(steps_column(**steps)).alias("step"))


def remaining_steps(grid: DataFrame, done: DataFrame | None) -> DataFrame:
    """Grid rows whose step has no written result yet (skip-if-done)."""
    if done is None:
        return grid
    return grid.join(done.select("step").distinct(), "step", "left_anti")


def validate_checkpoints(cands: DataFrame) -> DataFrame:
    """Checks a (variant, revision) pair; ``reason`` is null for a valid one."""
    variants = F.array(*[F.lit(v) for v in C.MODEL_VARIANTS])
    bad_variant = ~F.coalesce(F.array_contains(variants, F.col("variant")), F.lit(False))
    r = F.col("revision")
    bad_rev = ~(r.between(C.REVISION_MIN, C.REVISION_MAX) & (F.pmod(r, F.lit(C.REVISION_STEP)) == 0))
    reason = (F.when(bad_variant, F.format_string("Invalid model variant: %s", F.col("variant")))
              .when(bad_rev, F.format_string("Invalid revision: %d. (Should be a number from 0 to 143000 divisible by 1000).", r)))
    return cands.select("*", reason.alias("reason"), reason.isNull().alias("valid"))


def word_spans(texts: DataFrame, key: list[str], text_col: str = "text") -> DataFrame:
    """Token spans of space-separated words: ``(key.., pos, start, end)`` in characters
    (0-based, end exclusive); empty words between repeated spaces are not tokens."""
    ex = texts.select(*key, F.posexplode(F.split(F.col(text_col), " ", -1)).alias("wpos", "w"))
    w = Window.partitionBy(*key).orderBy("wpos").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("w") + 1).over(w), F.lit(0)).cast("int")
    spans = ex.select(*key, "wpos", "w", start.alias("start")).where(F.length("w") > 0)
    w2 = Window.partitionBy(*key).orderBy("wpos")
    return spans.select(*key, (F.row_number().over(w2) - 1).cast("int").alias("pos"), "start",
                        (F.col("start") + F.length("w")).cast("int").alias("end"))


def boundary_check(facts: DataFrame, spans: DataFrame, key: list[str]) -> DataFrame:
    """Where does the suffix start, and is the prefix/suffix split on a token boundary?
    ``reason`` names the first failing rule (straddle, no suffix token, suffix at token 0)."""
    plen = F.length("prefix")
    j = facts.select(*key, plen.alias("plen")).join(spans, key, "left")
    agg = j.groupBy(*key, "plen").agg(
        F.max(F.when((F.col("start") < F.col("plen")) & (F.col("plen") < F.col("end")), F.col("pos"))).alias("straddle_pos"),
        F.min(F.when(F.col("start") >= F.col("plen"), F.col("pos"))).alias("suffix_start"),
        F.count("pos").alias("n_tokens"),
    )
    reason = (F.when(F.col("straddle_pos").isNotNull(), F.lit("prefix and suffix straddle a token boundary"))
              .when(F.col("suffix_start").isNull(), F.lit("no suffix tokens"))
              .when(F.col("suffix_start") == 0, F.lit("suffix starts at token 0: prefix is empty")))
    return agg.select(*key, F.col("plen").cast("int").alias("prefix_len"), F.col("n_tokens").cast("int").alias("n_tokens"),
                      F.when(reason.isNull(), F.col("suffix_start")).cast("int").alias("suffix_start"), reason.alias("reason"))


def write_step_results(stats: DataFrame, path: str) -> None:
    """K6: per-step result files; a step's folder is replaced as a whole when rewritten
    (dynamic partition overwrite), other steps are left alone."""
    (stats.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("step").json(path))


def read_step_results(spark: SparkSession, path: str, schema) -> DataFrame | None:
    from ..session import path_exists
    if not path_exists(spark, path):
        return None
    return spark.read.schema(schema).json(path)
