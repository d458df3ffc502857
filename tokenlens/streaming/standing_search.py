"""A standing set of token sequences searched over corpus shards as they arrive.

``readStream`` over the corpus folder (new shard files are new input), ``foreachBatch`` runs the
batch search (J6) on each micro-batch and writes its deduplicated hits under the batch's epoch
id with dynamic overwrite, so a retried batch replaces its own output instead of duplicating
it. The streaming checkpoint records which files were processed: it replaces the original's
skip-if-the-output-exists. Every sample arrives in exactly one file, so deduplication by
location inside a batch is deduplication overall.

A batch has a fixed cost (its job, its commit), so it takes files of about ``BATCH_BYTES`` at a time: the
number of batches follows the size of the corpus, not its number of files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..operators import find as find_ops

BATCH_BYTES = 64 << 20

HIT_COLS = ["shard", "sample_index", "token_offset", "seq_ord", "sequence"]


def run_standing_search(spark: SparkSession, corpus_dir: str, sequences: DataFrame, out_dir: str, checkpoint_dir: str,
                        token_stats: DataFrame | None = None, max_files_per_trigger: int | None = None,
                        max_bytes_per_trigger: int | None = None) -> DataFrame:
    """Process every shard file not yet seen (``availableNow``), then return all hits so far. A batch is
    bounded by files or by bytes; one larger file is a batch of its own."""
    if max_files_per_trigger and max_bytes_per_trigger:
        raise ValueError("bound a batch by files or by bytes, not both")
    needles, n = find_ops.prepare_needles(sequences, token_stats)     # checkpointed once, reused by every batch
    reader = spark.readStream.schema(schemas.CORPUS)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    if max_bytes_per_trigger:
        reader = reader.option("maxBytesPerTrigger", max_bytes_per_trigger)
    stream = reader.parquet(corpus_dir).select("shard", "sample_index", "token_ids")

    def batch(df: DataFrame, epoch_id: int) -> None:
        hits = find_ops.dedup_hits(find_ops.search_prepared(df, needles, n, mark_first=True)).select(*HIT_COLS)
        (hits.withColumn("epoch", F.lit(epoch_id)).write.mode("overwrite")
         .option("partitionOverwriteMode", "dynamic").partitionBy("epoch").parquet(out_dir))

    q = (stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint_dir)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    from ..session import path_exists
    if not path_exists(spark, out_dir):
        return spark.createDataFrame([], schemas.HITS)
    return spark.read.parquet(out_dir).select(*HIT_COLS)
