"""Explicit schemas of the library's tables (no inference anywhere)."""

from pyspark.sql import types as T

CORPUS = T.StructType([
    T.StructField("sample_index", T.IntegerType(), False),
    T.StructField("token_ids", T.ArrayType(T.IntegerType(), False), False),
    T.StructField("shard", T.IntegerType(), False),
])

VOCAB = T.StructType([
    T.StructField("token", T.StringType(), False),
    T.StructField("token_id", T.IntegerType(), False),
    T.StructField("token_bytes", T.BinaryType(), True),
])

COUNTED_VOCAB = T.StructType([*VOCAB.fields, T.StructField("n", T.LongType(), False)])

MERGES = T.StructType([
    T.StructField("rank", T.IntegerType(), False),
    T.StructField("left", T.StringType(), False),
    T.StructField("right", T.StringType(), False),
])

SEQUENCES = T.StructType([
    T.StructField("seq_ord", T.LongType(), False),
    T.StructField("seq", T.ArrayType(T.IntegerType(), False), False),
])

CONTEXT = T.StructType([
    T.StructField("before", T.StringType(), True),
    T.StructField("match", T.StringType(), True),
    T.StructField("after", T.StringType(), True),
])

HITS = T.StructType([
    T.StructField("shard", T.IntegerType(), False),
    T.StructField("sample_index", T.IntegerType(), False),
    T.StructField("token_offset", T.IntegerType(), False),
    T.StructField("seq_ord", T.LongType(), False),
    T.StructField("sequence", T.ArrayType(T.IntegerType(), False), False),
])

# Raw shard files: one list column per row (the parquet element type may be uint16).
RAW_SHARD = T.StructType([
    T.StructField("token_ids", T.ArrayType(T.IntegerType(), True), True),
])

FACTS = T.StructType([
    T.StructField("fact_id", T.IntegerType(), False),
    T.StructField("prefix", T.StringType(), False),
    T.StructField("suffix", T.StringType(), False),
])

COMPLETION_STATS = T.StructType([
    T.StructField("total_surprisal", T.DoubleType(), True),
    T.StructField("avg_surprisal", T.DoubleType(), True),
    T.StructField("perplexity", T.DoubleType(), True),
    T.StructField("token_surprisals", T.ArrayType(T.DoubleType()), True),
    T.StructField("tokens", T.ArrayType(T.StringType()), True),
])
