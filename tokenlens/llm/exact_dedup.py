"""Operator 5: exact deduplication with an extendible-hash index on shared files.

Keys are 64-bit hashes of the normalised text. The index starts as one bucket; every bucket that
holds more than ``capacity`` distinct keys is split by one more leading bit of the key, and the
directory doubles whenever a bucket at full depth must split, up to ``max_depth`` bits; what is
still overfull then is chained in its bucket. Texts of one key are told apart by their bytes.

How it runs:

1. one scan writes ``(doc_id, key)``; the histogram of distinct keys over the 2**max_depth leading
   bit patterns (a fixed number of rows) drives the doubling;
2. copies collapse by (bucket, key, text) before and after the shuffle, so that a text that a third
   of all rows share travels once per task; owner tasks, each holding whole buckets, chain the
   texts of a key in order of their smallest id and write the index, sorted;
3. rows look their key up. Keys whose chain has several texts compare the bytes of every row.

Null text is empty; a null doc_id comes after all others; rows that repeat a doc_id each count in
``group_size`` and get the same verdict; an empty table gives an empty result. Only ``doc_id`` and
``text`` are read, so other columns may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WS_CLASS, Scratch, attach, documents, has_repeats, id_of, keep_rows, original_id, text_of


def normalised(text: Column) -> Column:
    """Every run of white space becomes one space (single spaces are left untouched)."""
    return F.regexp_replace(text, r"[\x09-\x0D]" + WS_CLASS + r"*|\x20" + WS_CLASS + "+", " ")


def text_key(text: Column) -> Column:
    return F.xxhash64(text)


def grow_directory(histogram: dict[int, int], capacity: int, max_depth: int) -> list[tuple[int, int]]:
    """Directory of an extendible hash: (leading bits, bucket) for each of 2**max_depth patterns.
    A bucket is numbered by its depth and bits, so numbers stay valid when others split."""
    buckets, depth = [(0, 0, histogram)], 0
    done: list[tuple[int, int, dict[int, int]]] = []
    while buckets and depth < max_depth:
        depth += 1  # the directory doubles
        split = []
        for d, bits, held in buckets:
            if sum(held.values()) <= capacity:
                done.append((d, bits, held))
                continue
            halves: tuple[dict, dict] = ({}, {})
            for pattern, n in held.items():
                halves[pattern >> (max_depth - depth) & 1][pattern] = n
            split += [(depth, bits * 2 + i, half) for i, half in enumerate(halves)]
        buckets = split
    out = []
    for d, bits, _ in done + buckets:
        width = 1 << (max_depth - d)
        out += [(pattern, (1 << d) + bits) for pattern in range(bits * width, (bits + 1) * width)]
    return sorted(out)


def build_index(docs: DataFrame, scratch: Scratch, capacity: int = 512, max_depth: int = 16, key=text_key):
    """(entries, index): entries ``doc_id, key`` of every row; index ``bucket, key, link, links,
    keep_id, group_size, text_sha256``, one row per different text, in sorted shared files."""
    spark = docs.sparkSession
    texts = docs.select(id_of().alias("doc_id"), normalised(text_of()).alias("text"))
    texts = texts.withColumn("key", key(F.col("text")).cast("bigint"))
    leaf = F.shiftrightunsigned("key", 64 - max_depth).cast("int")
    entries = scratch.write(texts.select("doc_id", "key"), "entries")
    per_leaf = entries.groupBy("key").agg(F.count(F.lit(1)).alias("n")).groupBy(leaf.alias("leaf")).count()
    directory = grow_directory({r[0]: r[1] for r in per_leaf.collect()}, capacity, max_depth)  # 2**max_depth rows at most
    directory = spark.createDataFrame(directory, "leaf int, bucket int")
    groups = (texts.groupBy("key", "text").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
              .select("key", leaf.alias("leaf"), "keep_id", "group_size", F.sha2("text", 256).alias("text_sha256"))
              .join(F.broadcast(directory), "leaf").drop("leaf"))
    chain = "PARTITION BY bucket, key"
    chained = (groups.repartition("bucket")
               .withColumn("link", F.expr(f"row_number() OVER ({chain} ORDER BY keep_id)"))
               .withColumn("links", F.expr(f"count(1) OVER ({chain})")))
    return entries, scratch.write(chained.sortWithinPartitions("bucket", "key", "link"), "index")


def deduplicate(docs: DataFrame, capacity: int = 512, max_depth: int = 16, key=text_key) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256."""
    scratch = Scratch(docs.sparkSession, "exact-dedup")
    entries, index = build_index(docs, scratch, capacity, max_depth, key)
    total, collided = index.agg(F.coalesce(F.sum("group_size"), F.lit(0)), F.count(F.when(F.col("links") > 1, 1))).first()
    single = index.where("links = 1").select("key", "keep_id", "group_size", "text_sha256")
    out = attach(entries, single, ["key"], "group_size", total).drop("key")
    if collided:  # different texts under one key: every row of theirs compares its bytes
        keys = index.where("links > 1").select("key").distinct()
        texts = docs.select(id_of().alias("doc_id"), normalised(text_of()).alias("text"))
        texts = texts.withColumn("key", key(F.col("text")).cast("bigint")).join(keys, "key", "left_semi")
        groups = texts.groupBy("text").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        groups = groups.withColumn("text_sha256", F.sha2("text", 256))
        out = out.unionByName(attach(texts.drop("key"), groups, ["text"], "group_size", total).drop("text"))
    return out.select(original_id().alias("doc_id"), original_id("keep_id").alias("keep_id"), "group_size",
                      (F.col("doc_id") == F.col("keep_id")).alias("kept"), "text_sha256")


def keep_first(docs: DataFrame, capacity: int = 512, max_depth: int = 16, key=text_key) -> DataFrame:
    """The rows of ``docs`` that stay, one per different text, with all their columns. A row is told
    by its id and the key of its text (by the text's SHA-256 where different texts share a key), so
    different texts under one id, or without one, all stay."""
    entries, index = build_index(docs, Scratch(docs.sparkSession, "exact-dedup"), capacity, max_depth, key)
    text = normalised(text_of())
    collided = index.where("links > 1").limit(1).count()
    told_by = F.sha2(text, 256) if collided else key(text).cast("bigint")
    firsts = index.select(F.col("keep_id").alias("doc_id"), F.col("text_sha256" if collided else "key").alias("key"))
    return keep_rows(docs, firsts, told_by, has_repeats(entries, "key"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicate(documents(spark, sf_dir))


ORACLE_SQL = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM n
"""
