"""Array expressions used by search, repair and context (all native higher-order functions)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


class Ranks:
    """Places of ids in a sorted set of ids, from a bit and a count per 64 ids: a look-up takes a few steps
    on arrays whatever the size of the set, and an eighth of a byte and a bit more per id up to the largest."""

    def __init__(self, ids: np.ndarray):
        self.size = int(ids[-1]) + 1 if len(ids) else 0
        bits = np.zeros(self.size // 64 * 64 + 64, np.uint8)
        bits[ids] = 1
        self.bits = np.packbits(bits, bitorder="little").view("<u8")
        counts = np.bitwise_count(self.bits)
        self.before = (np.cumsum(counts) - counts).astype(np.int32)

    def at(self, ids: np.ndarray) -> np.ndarray:
        """The place of each id, -1 where it is not in the set."""
        inside = np.where((ids >= 0) & (ids < self.size), ids, self.bits.size * 64 - 1)
        block, bit = inside >> 6, (inside & 63).astype(np.uint64)
        word = self.bits[block]
        there = (word >> bit) & np.uint64(1) == 1
        below = np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1)))
        return np.where(there, self.before[block] + below, -1)


def slice0(arr: Column, start0: Column, length: Column) -> Column:
    """``arr[start0 : start0 + length]`` with 0-based ``start0``. Never raises under ANSI mode:
    start is clamped to >= 1 and length to >= 0; ``slice`` clips on the right by itself."""
    return F.slice(arr, F.greatest(start0, F.lit(0)) + 1, F.greatest(length, F.lit(0)))


def matches_at(tokens: Column, offset0: Column, seq: Column) -> Column:
    """True when ``seq`` occurs in ``tokens`` starting at 0-based ``offset0``."""
    return (offset0 >= 0) & (slice0(tokens, offset0, F.size(seq)) == seq)


def first_match(tokens: Column, seq: Column) -> Column:
    """0-based offset of the first occurrence of ``seq`` in ``tokens`` (null when absent).
    ``sequence(0, -1)`` would yield ``[0, -1]``, so the range is built only when it is non-empty."""
    return F.try_element_at(all_matches(tokens, seq), F.lit(1))


def all_matches(tokens: Column, seq: Column) -> Column:
    """Every 0-based offset of ``seq`` in ``tokens`` (overlaps included)."""
    last = F.size(tokens) - F.size(seq)
    starts = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    head = F.element_at(seq, 1)
    # the slice is only built where the first token already matches (AND short-circuits)
    return F.filter(starts, lambda i: (F.element_at(tokens, i + 1) == head) & (F.slice(tokens, i + 1, F.size(seq)) == seq))


def is_subsequence(sub: Column, arr: Column) -> Column:
    """Contiguous-subsequence test: ``sub`` appears as a run inside ``arr``."""
    return F.size(all_matches(arr, sub)) > 0


def drop_index(arr: Column, k: Column) -> Column:
    """``arr`` without its element at 0-based index ``k`` (keeps equal elements elsewhere,
    unlike ``array_except``)."""
    return F.filter(arr, lambda x, j: j != k)


def leave_one_out(arr: Column) -> Column:
    """All arrays obtained by deleting one element, in index order."""
    n = F.size(arr)
    idx = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(idx, lambda k: drop_index(arr, k))


def context_slices(tokens: Column, offset0: Column, n: Column, context_len: int) -> tuple[Column, Column, Column]:
    """(before, match, after) token slices around a hit, clipped to the sample: before starts at
    ``max(0, offset - c)``, after ends at ``min(len, offset + n + c)``."""
    start = F.greatest(offset0 - F.lit(context_len), F.lit(0))
    before = slice0(tokens, start, offset0 - start)
    match = slice0(tokens, offset0, n)
    after = slice0(tokens, offset0 + n, F.lit(context_len))
    return before, match, after
