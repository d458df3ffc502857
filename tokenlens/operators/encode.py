"""batch tokenization of a text column with a tokenizer file, as a mapInArrow job.

The tokenizer JSON travels as a broadcast variable; each Python worker builds the tokenizer
once and reuses it for every batch (Arrow batches in, id arrays out). This is the one place the
library needs per-text Python: encoding is the tokenizer library's job.

An encoding takes a hundred times the memory of its text, so a batch is encoded in slices of about
``SLICE_CHARS`` characters (a longer text is a slice of its own): a worker's memory does not depend on
the number or length of the texts that Spark puts in a batch."""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

SLICE_CHARS = 1 << 18

_CACHE: dict[str, object] = {}


def _tokenizer(text: str, key: str):
    tok = _CACHE.get(key)
    if tok is None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        tok = _CACHE[key] = Tokenizer.from_str(text)
    return tok


def text_slices(batch: pa.RecordBatch, text_col: str, most: int) -> Iterator[pa.RecordBatch]:
    """``batch`` cut into runs of rows with at most ``most`` characters of text, one row at least."""
    lengths = pc.fill_null(pc.utf8_length(batch.column(text_col)), 0).to_numpy(zero_copy_only=False)
    ends, start = np.cumsum(lengths, dtype=np.int64), 0
    while start < len(ends):
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def encode_texts(df: DataFrame, keys: list[str], text_col: str, tok_json: str, offsets: bool = False,
                 tokens: bool = False, out: str = "ids", slice_chars: int = SLICE_CHARS) -> DataFrame:
    """``keys..., ids ARRAY<INT>`` (+ ``tokens ARRAY<STRING>``, + ``offsets ARRAY<STRUCT<start,end>>``
    in characters) for every text; special tokens are not added."""
    from ..sources.vocab import tokenizer_key
    spark = df.sparkSession
    key = tokenizer_key(tok_json)
    bc = spark.sparkContext.broadcast(tok_json)
    base = df.select(*keys, *([text_col] if text_col not in keys else []))
    fields = [f for f in base.schema.fields if f.name in keys]
    fields.append(T.StructField(out, T.ArrayType(T.IntegerType())))
    if tokens:
        fields.append(T.StructField("tokens", T.ArrayType(T.StringType())))
    if offsets:
        fields.append(T.StructField("offsets", T.ArrayType(T.StructType([
            T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))))
    schema = T.StructType(fields)

    def lists(encs, values: pa.Array) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, encs)]), pa.int32()), values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = _tokenizer(bc.value, key)
        encode = tok.encode_batch if offsets or tokens else tok.encode_batch_fast     # the fast one gives ids alone
        for batch in batches:
            for part in text_slices(batch, text_col, slice_chars):
                encs = encode([t or "" for t in part.column(text_col).to_pylist()], add_special_tokens=False)
                cols = [part.column(k) for k in keys]
                cols.append(lists(encs, pa.array([i for e in encs for i in e.ids], pa.int32())))
                if tokens:
                    cols.append(lists(encs, pa.array([t for e in encs for t in e.tokens], pa.string())))
                if offsets:
                    ends = np.array([o for e in encs for o in e.offsets], np.int32).reshape(-1, 2)
                    cols.append(lists(encs, pa.StructArray.from_arrays(
                        [pa.array(ends[:, 0].copy()), pa.array(ends[:, 1].copy())], names=["start", "end"])))
                yield pa.RecordBatch.from_arrays(cols, names=schema.names)

    return base.mapInArrow(run, schema)


def roundtrip_ok(df: DataFrame, keys: list[str], text_col: str, ids_col: str, tok_json: str) -> DataFrame:
    """Rows whose text re-encodes to exactly ``ids_col``."""
    from pyspark.sql import functions as F
    enc = encode_texts(df.select(*keys, text_col), keys, text_col, tok_json, out="_re")
    return df.join(enc, keys).where(F.col("_re") == F.col(ids_col)).drop("_re")
