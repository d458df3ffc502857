"""Token corpus: raw macro-step shard files in, a shard-partitioned corpus table out.

Corpus table: ``(shard INT, sample_index INT, token_ids ARRAY<INT>)``, parquet, partitioned on
``shard`` so that a shard slice is a directory prune, sorted on ``sample_index`` within a shard.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as C
from .. import schemas
from ..session import path_exists


class SourceMissing(RuntimeError):
    pass


def require_source(spark: SparkSession, path: str, hint: str = "") -> None:
    """Fail before planning when the raw shard folder is absent (names what to provide)."""
    if not path_exists(spark, path):
        raise SourceMissing(
            f"{path} not found. Provide the tokenized macro-step parquet files "
            f"(train-001000.parquet ... train-095000.parquet) in that folder. {hint}".strip()
        )


def shard_from_file_name(file_name: Column, pattern: str = C.SHARD_FILE_PATTERN) -> Column:
    """``train-{i*1000:06}`` holds macro step i, which becomes shard i-1."""
    step = F.regexp_extract(file_name, pattern, 1).cast("int")
    return (F.floor(step / C.STEPS_PER_CHECKPOINT) - 1).cast("int")


def read_token_shards(spark: SparkSession, path: str) -> DataFrame:
    """Scan raw macro-step files (S1/D2). Shard comes from the file name, sample_index from the
    row's position in its file (``_metadata.row_index``), never from listing order.

    The element type of ``token_ids`` may be uint16 in the files; it is read as INT
    (Spark has no unsigned types and SMALLINT would overflow above 32,767).
    """
    require_source(spark, path)
    raw = spark.read.schema(schemas.RAW_SHARD).parquet(path)
    return raw.select(
        shard_from_file_name(F.col("_metadata.file_name")).alias("shard"),
        F.col("_metadata.row_index").cast("int").alias("sample_index"),
        F.col("token_ids"),
    )


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """Corpus reader (S4): explicit schema, shard as partition column (pruned by ``where shard = k``)."""
    return spark.read.schema(schemas.CORPUS).parquet(path).select("shard", "sample_index", "token_ids")


def write_corpus(df: DataFrame, path: str, num_partitions: int | None = None, max_records_per_file: int = 200_000) -> None:
    """Write the corpus (K1): range-partitioned on (shard, sample_index) so every task writes a
    contiguous run of few shards, partitioned on disk by shard, overwriting only the shards
    present in ``df`` (dynamic partition overwrite)."""
    spark = df.sparkSession
    n = num_partitions or max(spark.sparkContext.defaultParallelism, 1)
    (
        df.select("shard", "sample_index", "token_ids")
        .repartitionByRange(n, "shard", "sample_index")
        .sortWithinPartitions("shard", "sample_index")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .option("maxRecordsPerFile", max_records_per_file)
        .partitionBy("shard")
        .parquet(path)
    )


def by_shard(docs: DataFrame, samples_per_shard: int, id_col: str = "doc_id") -> DataFrame:
    """``shard, sample_index`` and the other columns of ``docs``, all rows of a shard in one task."""
    rest = [c for c in docs.columns if c != id_col]
    return docs.select(F.floor(F.col(id_col) / samples_per_shard).cast("int").alias("shard"),
                       F.pmod(F.col(id_col), F.lit(samples_per_shard)).cast("int").alias("sample_index"), *rest).repartition("shard")


def write_whole_shards(df: DataFrame, path: str, max_records_per_file: int = 200_000) -> None:
    """Write a corpus whose shards are each in one task already (:func:`by_shard`, then any work within
    the rows): like :func:`write_corpus`, but tokens are sorted locally and not shuffled, and the plan
    above runs once (a range partitioning samples it first)."""
    (df.select("shard", "sample_index", "token_ids").sortWithinPartitions("shard", "sample_index").write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").option("maxRecordsPerFile", max_records_per_file)
     .partitionBy("shard").parquet(path))


def ingest_token_shards(spark: SparkSession, raw_dir: str, out_path: str, max_records_per_file: int = 200_000) -> DataFrame:
    """S1 -> K1 without a shuffle: every raw file holds one shard with its samples in order, so
    each read task writes its own rows into its shard's folder after a local sort; no corpus-wide
    exchange (a range repartition would move the whole corpus once more). Only the shards present
    in ``raw_dir`` are replaced (dynamic partition overwrite)."""
    df = read_token_shards(spark, raw_dir)
    (df.sortWithinPartitions("shard", "sample_index").write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").option("maxRecordsPerFile", max_records_per_file)
     .partitionBy("shard").parquet(out_path))
    return read_corpus(spark, out_path)


def contract_report(corpus: DataFrame, seq_length: int | None = None, samples_per_shard: int | None = None) -> DataFrame:
    """Shape/dtype contract (S3) as one row per shard: sample count, length violations, ids out
    of the uint16 range, and whether sample indexes are dense. Partial aggregation runs map-side."""
    length_bad = (F.size("token_ids") != F.lit(seq_length)) if seq_length else F.lit(False)
    id_bad = F.exists("token_ids", lambda x: (x < 0) | (x > C.MAX_TOKEN_ID))
    agg = corpus.groupBy("shard").agg(
        F.count(F.lit(1)).alias("n_samples"),
        F.sum(length_bad.cast("long")).alias("n_bad_length"),
        F.sum(id_bad.cast("long")).alias("n_bad_ids"),
        F.min("sample_index").alias("min_sample"),
        F.max("sample_index").alias("max_sample"),
        F.sum(F.size("token_ids").cast("long")).alias("n_tokens"),
    )
    dense = (F.col("min_sample") == 0) & (F.col("max_sample") == F.col("n_samples") - 1)
    full = (F.col("n_samples") == F.lit(samples_per_shard)) if samples_per_shard else F.lit(True)
    return agg.withColumn("ok", dense & full & (F.col("n_bad_length") == 0) & (F.col("n_bad_ids") == 0))
