"""Operator 10: line deduplication with levelled sorted runs of line hashes.

Documents come in batches of ascending doc_id. The keys seen so far are sorted runs in the shared
folder, in levels: each batch merge-anti-joins its keys with all runs, its new keys become a run of
level 0, and ``fanout`` runs of one level are compacted into one of the next. As ids ascend, the
run that holds a key was added by the smallest document with it, so a key found in the runs is a
repeat, and of a key that is new the batch's smallest document keeps its lines.

A key is the line, stripped of white space at both ends and with A-Z lower-cased, as two 64-bit
hashes of different seed; keys of fewer than ``min_chars`` code points are never dropped.

Lines are counted by key before any shuffle, keys that hold a large share of the lines are joined
by broadcast (their number is bounded), and a document's dropped line numbers meet its text once.

Null text is one empty line; a null doc_id comes after all others; rows that repeat a doc_id are
one document whose lines do not drop each other; an empty table gives an empty result. Only
``doc_id`` and ``text`` are read, other columns may have any name.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, attach, documents, id_of, lower_ascii, original_id, strip_ws, text_of

KEY = ["h1", "h2"]


def line_key(line: Column) -> Column:
    return lower_ascii(strip_ws(line))


def line_table(docs: DataFrame, cuts: list[int], min_chars: int) -> DataFrame:
    """One row per line that could be dropped: batch, doc_id, text_id, pos, h1, h2. text_id tells
    apart rows that repeat a doc_id with another text."""
    text = text_of()
    batch = reduce(lambda a, c: a + F.when(id_of() > c, 1).otherwise(0), cuts, F.lit(0))
    lines = docs.select(batch.alias("batch"), id_of().alias("doc_id"), F.xxhash64(text).alias("text_id"),
                        F.posexplode(F.split(text, "\n")).alias("pos", "line"))
    lines = lines.withColumn("key", line_key(F.col("line"))).where(F.length("key") >= min_chars)
    return lines.select("batch", "doc_id", "text_id", "pos", F.xxhash64("key").alias("h1"),
                        F.xxhash64(F.lit(1), "key").alias("h2"))


class Runs:
    """Sorted runs of keys by level, in the shared folder."""

    def __init__(self, scratch: Scratch, fanout: int):
        self.scratch, self.fanout, self.levels, self.made = scratch, fanout, {}, 0

    def keys(self) -> DataFrame | None:
        runs = [self.scratch.read(n, "h1 bigint, h2 bigint") for names in self.levels.values() for n in names]
        return reduce(DataFrame.unionByName, runs) if runs else None

    def add(self, keys: DataFrame, level: int = 0) -> None:
        self.made += 1
        name = f"run-{level}-{self.made}"
        self.scratch.write(keys.repartitionByRange(*KEY).sortWithinPartitions(*KEY), name)
        names = self.levels.setdefault(level, [])
        names.append(name)
        if len(names) >= self.fanout:
            merged = reduce(DataFrame.unionByName, [self.scratch.read(n, "h1 bigint, h2 bigint") for n in names])
            self.levels[level] = []
            self.add(merged, level + 1)
            self.scratch.drop(*names)


def dropped_lines(docs: DataFrame, n_batches: int = 4, fanout: int = 3, min_chars: int = 10) -> DataFrame:
    """doc_id, text_id, pos of every line that goes."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "line-dedup")
    shares = [i / n_batches for i in range(1, n_batches)]
    cuts = docs.agg(F.percentile_approx(id_of(), shares, 1000)).first()[0] or []
    lines = scratch.write(line_table(docs, sorted(set(cuts)), min_chars), "lines", ["batch"])
    runs, out = Runs(scratch, fanout), []
    for b in range(len(set(cuts)) + 1):
        batch = lines.where(F.col("batch") == b).drop("batch")
        found = batch.groupBy(*KEY).agg(F.min("doc_id").alias("owner"), F.max("doc_id").alias("last"), F.count(F.lit(1)).alias("n"))
        before = runs.keys()
        found = (found.withColumn("seen", F.lit(False)) if before is None else
                 found.join(before.withColumn("seen", F.lit(True)), KEY, "left").withColumn("seen", F.coalesce("seen", F.lit(False))))
        found = scratch.write(found, f"found-{b}")
        runs.add(found.where("NOT seen").select(*KEY))
        total = found.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        repeated = found.where("seen OR owner < last").select(*KEY, "owner", "seen", "n")
        out.append(attach(batch, repeated, KEY, "n", total).where("seen OR doc_id > owner").select("doc_id", "text_id", "pos"))
    return reduce(DataFrame.unionByName, out)


def deduplicate_lines(docs: DataFrame, n_batches: int = 4, fanout: int = 3, min_chars: int = 10) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_lines, n_dropped, text (what is left)."""
    drops = (dropped_lines(docs, n_batches, fanout, min_chars)
             .groupBy("doc_id", "text_id").agg(F.collect_set("pos").alias("drops")))
    texts = docs.select(id_of().alias("doc_id"), text_of().alias("text")).withColumn("text_id", F.xxhash64("text"))
    lines = (texts.join(drops, ["doc_id", "text_id"], "left")
             .select("doc_id", F.split("text", "\n").alias("lines"), F.coalesce("drops", F.array().cast("array<int>")).alias("drops")))
    # array_except on integers is one hash pass
    left = lines.withColumn("stay", F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "drops"))
    return left.select(original_id().alias("doc_id"), F.size("lines").cast("bigint").alias("n_lines"),
                       F.size("drops").cast("bigint").alias("n_dropped"),
                       F.expr("array_join(transform(stay, p -> lines[p]), '\n')").alias("text"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = deduplicate_lines(documents(spark, sf_dir))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


ORACLE_SQL = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
k AS (
  SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (
  SELECT *, length(key) >= 10 AND min(doc_id) OVER (PARTITION BY key) < doc_id AS gone FROM k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM f GROUP BY doc_id
"""
