"""Corpus-level operators: slices, point lookups, the separated stream, document addressing
and training-step provenance."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import checkpoint as _ckpt
from .. import constants as C
from ..functions.arrays import slice0
from ..plans.strategy import checked_broadcast


def shard_slice(corpus: DataFrame, shard: int) -> DataFrame:
    """One shard; on the shard-partitioned table this is a directory prune."""
    return corpus.where(F.col("shard") == F.lit(shard))


def sample_lookup(corpus: DataFrame, keys: DataFrame) -> DataFrame:
    """The samples named in ``keys(shard, sample_index)``. A left-semi join: keys are
    deduplicated by the join itself and only the corpus rows asked for come back; Catalyst adds
    dynamic partition pruning on ``shard``. The key set is broadcast when its size check
    passes, so corpus rows are filtered where they are read instead of being shuffled."""
    # materialized once: the broadcast and the partition-pruning subquery both read it
    k, _ = checked_broadcast(keys.select("shard", "sample_index").distinct().transform(_ckpt))
    return corpus.join(k, ["shard", "sample_index"], "left_semi")


def position_slice(corpus: DataFrame, start: int, end: int) -> DataFrame:
    """Tokens ``start .. end-1`` of every sample (clipped at the sample's end)."""
    return corpus.select("shard", "sample_index",
                         slice0(F.col("token_ids"), F.lit(start), F.lit(end - start)).alias("tokens"))


OFFSET_BLOCK = 65536   # samples per block of the two-level prefix sum


def separated_stream(corpus: DataFrame, fixed_length: int | None = None, block: int = OFFSET_BLOCK) -> DataFrame:
    """K2: each sample prefixed with the separator id, and its byte offset inside its shard's
    stream (2 bytes per token).

    Fixed-length corpora use the closed form ``sample_index * 2 * (L + 1)``: no shuffle at all.
    Variable-length corpora use a two-level prefix sum on a narrow ``(shard, sample_index,
    bytes)`` projection, so no group grows with the shard: samples fall into blocks of
    ``block`` indexes; block totals are summed per shard (one row per block), running sums run
    inside a block (at most ``block`` rows), and offset = earlier blocks + earlier samples in the
    block. The offsets are joined back on the sample key."""
    tokens = F.concat(F.array(F.lit(C.SEPARATOR_ID)), F.col("token_ids")).alias("tokens")
    if fixed_length is not None:
        off = F.col("sample_index").cast("long") * (C.TOKEN_BYTES * (fixed_length + 1))
        return corpus.select("shard", "sample_index", tokens, off.alias("byte_offset"))
    sizes = corpus.select("shard", "sample_index", F.floor(F.col("sample_index") / block).alias("blk"),
                          ((F.size("token_ids") + 1) * C.TOKEN_BYTES).cast("long").alias("b"))
    totals = sizes.groupBy("shard", "blk").agg(F.sum("b").alias("t"))
    wb = Window.partitionBy("shard").orderBy("blk").rowsBetween(Window.unboundedPreceding, -1)
    block_base = totals.select("shard", "blk", F.coalesce(F.sum("t").over(wb), F.lit(0)).alias("base"))
    wi = Window.partitionBy("shard", "blk").orderBy("sample_index").rowsBetween(Window.unboundedPreceding, -1)
    inner = sizes.select("shard", "sample_index", "blk", F.coalesce(F.sum("b").over(wi), F.lit(0)).alias("inner"))
    offsets = inner.join(block_base, ["shard", "blk"]).select(
        "shard", "sample_index", (F.col("base") + F.col("inner")).cast("long").alias("byte_offset"))
    return corpus.select("shard", "sample_index", tokens).join(offsets, ["shard", "sample_index"])


def file_index_to_shard(spark: SparkSession, n_shards: int = C.N_SHARDS) -> DataFrame:
    """T5: index files are numbered in lexicographic order of their names
    (``tokenized.0``, ``tokenized.1``, ``tokenized.10``, ...). One row per shard: a proven bound."""
    names = spark.range(n_shards).select(F.col("id").cast("int").alias("shard"),
                                         F.concat(F.lit(C.SHARD_FILE_PREFIX), F.col("id").cast("string")).alias("file_name"))
    w = Window.orderBy("file_name")
    return names.select((F.row_number().over(w) - 1).cast("int").alias("file_index"), "shard", "file_name")


def doc_address(docs: DataFrame, file_map: DataFrame, samples_per_shard: int = C.SAMPLES_PER_SHARD) -> DataFrame:
    """Global document number -> (file index, shard, sample_index)."""
    d = docs.select("doc_ix", (F.col("doc_ix") / samples_per_shard).cast("long").cast("int").alias("file_index"),
                    F.pmod(F.col("doc_ix"), F.lit(samples_per_shard)).cast("int").alias("sample_index"))
    # the file map has one row per shard: a bounded broadcast
    return d.join(F.broadcast(file_map.select("file_index", "shard")), "file_index", "left")


def hit_steps(hits: DataFrame, samples_per_shard: int = C.SAMPLES_PER_SHARD) -> DataFrame:
    """Training provenance of each hit: global sequence index, the step that read it, the
    first checkpoint that has seen it, and whether it is past the first epoch."""
    g = F.col("shard").cast("long") * samples_per_shard + F.col("sample_index")
    step = F.floor(g / C.BATCH_SIZE)
    return hits.select(
        *hits.columns,
        g.alias("global_idx"),
        step.cast("long").alias("train_step"),
        ((F.floor(step / C.CHECKPOINT_INTERVAL) + 1) * C.CHECKPOINT_INTERVAL).cast("long").alias("first_checkpoint"),
        (g >= F.lit(C.FIRST_REPEATED_SEQ_IDX)).alias("already_seen"),
    )
