"""Logits stand-in derived from the ``embeddings`` table, and facts derived from
``conversations``.

``embedding`` is read as the logit vector over a vocabulary of its length, ``label`` as the
token at that position, ``vec_id div 8`` as the text and ``vec_id mod 8`` as the position.
Facts: each conversation turn is split at its middle character into (prefix, suffix)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import read_table

POSITIONS_PER_TEXT = 8
SUFFIX_START = 4


def logits_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read_table(spark, sf_dir, "embeddings")
    return e.select(
        F.floor(F.col("vec_id") / POSITIONS_PER_TEXT).cast("long").alias("text_id"),
        F.pmod(F.col("vec_id"), F.lit(POSITIONS_PER_TEXT)).cast("int").alias("pos"),
        F.col("label").cast("int").alias("token_id"),
        F.col("embedding").cast("array<double>").alias("logits"),
    )


def conversation_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read_table(spark, sf_dir, "conversations")
    half = F.floor(F.length("text") / 2).cast("int")
    return c.select("conv_id", "turn", "text",
                    F.substring(F.col("text"), F.lit(1), half).alias("prefix"),
                    F.expr("substring(text, floor(length(text) / 2) + 1)").alias("suffix"))
