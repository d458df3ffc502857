"""K4: positional postings ``(token_id, shard, sample_index, positions ARRAY<INT>)``, in order of tokens,
and the same for pairs of neighbouring tokens ``(token_id, next_id, ...)``.

One row per (token, sample): a sample is one row of the corpus, and its positions are grouped within
that row (numpy, a few samples at a time), so nothing is aggregated and the only shuffle is the one that
puts finished rows in order: one row per distinct token of a sample, never one per position.

The table is range-partitioned and sorted by (token, shard, sample): a hot token is spread over
several files, a rare one lies in one place of one file. Row groups are small, so a reader that
wants some tokens skips the rest by the groups' token ranges (:func:`of_tokens`)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import is_done, mark_done

ROW_GROUP_BYTES = 1 << 20
MOST_RANGES = 16
# A token set is read to the driver only up to this many ids (eight bytes each).
MOST_TOKENS = 1_000_000
# Samples are grouped for about so many positions at a time.
GROUP_TOKENS = 1 << 20
NO_TOKEN = np.iinfo(np.int32).min     # stands for a null while grouping


def sample_runs(batch: pa.RecordBatch, most: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Runs of rows with about ``most`` positions: rows, their numbers of tokens, all tokens."""
    ends, start = np.cumsum(pc.fill_null(pc.list_value_length(batch.column("token_ids")), 0).to_numpy(zero_copy_only=False), dtype=np.int64), 0
    while start < len(ends):
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + most, side="right")))
        part = batch.slice(start, stop - start)
        yield part, np.diff(ends[start:stop], prepend=before), pc.fill_null(pc.list_flatten(part.column("token_ids")), NO_TOKEN).to_numpy()
        start = stop


def _grouped(corpus: DataFrame, pairs: bool) -> DataFrame:
    keys = ["token_id", "next_id"] if pairs else ["token_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, n, tokens in sample_runs(batch, GROUP_TOKENS):
                row = np.repeat(np.arange(len(n)), n)
                pos = (np.arange(len(tokens)) - np.repeat(np.cumsum(n) - n, n)).astype(np.int32)
                if pairs:
                    after = np.append(tokens[1:], np.int32(NO_TOKEN))
                    kept = (pos + 1 < np.repeat(n, n)) & (after != NO_TOKEN)
                    row, pos, columns = row[kept], pos[kept], [tokens[kept], after[kept]]
                else:
                    columns = [tokens]
                order = np.lexsort([*columns[::-1], row])          # stable: positions stay in order
                row, columns = row[order], [c[order] for c in columns]
                new = np.ones(len(row), bool)
                new[1:] = np.any([c[1:] != c[:-1] for c in (row, *columns)], axis=0)
                first = np.flatnonzero(new)
                at = pa.array(row[first])
                lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(row)).astype(np.int32)), pa.array(pos[order]))
                yield pa.RecordBatch.from_arrays(
                    [*[pa.array(c[first], mask=c[first] == NO_TOKEN) for c in columns], part.column("shard").take(at), part.column("sample_index").take(at), lists],
                    names=[*keys, "shard", "sample_index", "positions"])

    schema = ", ".join(f"{c} int" for c in [*keys, "shard", "sample_index"]) + ", positions array<int>"
    return corpus.select("shard", "sample_index", "token_ids").mapInArrow(run, schema)


def postings_of(corpus: DataFrame) -> DataFrame:
    return _grouped(corpus, pairs=False)


def pair_postings_of(corpus: DataFrame) -> DataFrame:
    """Positions of the first token of every pair of neighbours."""
    return _grouped(corpus, pairs=True)


def _build(rows: DataFrame, keys: list[str], path: str) -> DataFrame:
    """The table at ``path``, written unless a finished copy is there."""
    spark, order = rows.sparkSession, [*keys, "shard", "sample_index"]
    if not is_done(spark, path):
        (rows.repartitionByRange(*order).sortWithinPartitions(*order)
         .write.mode("overwrite").option("parquet.block.size", str(ROW_GROUP_BYTES)).parquet(path))
        mark_done(spark, path)
    return spark.read.schema(", ".join(f"{c} INT" for c in order) + ", positions ARRAY<INT>").parquet(path)


def build_postings(corpus: DataFrame, path: str) -> DataFrame:
    return _build(postings_of(corpus), ["token_id"], path)


def build_pair_postings(corpus: DataFrame, path: str) -> DataFrame:
    return _build(pair_postings_of(corpus), ["token_id", "next_id"], path)


def token_ranges(tokens: list[int], most: int = MOST_RANGES) -> list[tuple[int, int]]:
    """At most ``most`` ranges that hold all of the sorted, distinct ``tokens``: the widest gaps stay out."""
    gaps = sorted(range(1, len(tokens)), key=lambda k: tokens[k - 1] - tokens[k])[:most - 1]
    cuts = [0, *sorted(k for k in gaps if tokens[k] - tokens[k - 1] > 1), len(tokens)]
    return [(tokens[a], tokens[b - 1]) for a, b in zip(cuts, cuts[1:])] if tokens else []


def in_ranges_of(tokens: DataFrame) -> Column:
    """A condition on token_id that holds around ``tokens`` (token_id) and is pushed down to the row
    groups; callers still join on the token. Beyond MOST_TOKENS tokens it holds everywhere."""
    wanted = tokens.select("token_id").distinct().limit(MOST_TOKENS + 1).collect()
    if len(wanted) > MOST_TOKENS:
        return F.lit(True)
    inside: Column = F.lit(False)
    for low, high in token_ranges(sorted(r[0] for r in wanted)):
        inside = inside | ((F.col("token_id") == low) if low == high else F.col("token_id").between(low, high))
    return inside


def of_tokens(postings: DataFrame, tokens: DataFrame) -> DataFrame:
    """``postings`` cut down, as it is read, to the token ranges around ``tokens``."""
    return postings.where(in_ranges_of(tokens))
