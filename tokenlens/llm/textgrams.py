"""Numpy over Arrow text batches: words, 64-bit word hashes and word shingles of whole texts.

A batch is cut into blocks of whole documents of about ``BLOCK`` bytes, so that a task's memory
follows its largest document, not its partition. Words are maximal runs of bytes other than the six
ASCII white-space bytes (those never occur inside a multi-byte UTF-8 character).
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK = 1 << 19
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
TO_LOWER = np.arange(256, dtype=np.uint8)
TO_LOWER[ord("A"):ord("Z") + 1] += 32
#: Odd base of the polynomial word hash and its inverse modulo 2**64.
BASE = np.uint64(0x9E3779B97F4A7C15)
BASE_INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
_tables: dict[str, np.ndarray] = {}


class Block(NamedTuple):
    first: int            # row of the batch at which the block begins
    data: np.ndarray      # uint8
    offsets: np.ndarray   # int64, one more than there are documents, from 0


def blocks(column: pa.Array | pa.ChunkedArray, size: int = BLOCK) -> Iterator[Block]:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks)
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(column)
    if not n:
        return
    _, at, buf = column.buffers()
    offsets = np.frombuffer(at, np.int64)[column.offset:column.offset + n + 1]
    data = np.frombuffer(buf, np.uint8) if buf is not None else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + size, "right")) - 1)
        yield Block(row, data[offsets[row]:offsets[end]], offsets[row:end + 1] - offsets[row])
        row = end


def mixed(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int, base: np.uint64, name: str) -> np.ndarray:
    if name not in _tables or len(_tables[name]) < n:
        table = np.full(max(n, BLOCK) + 1, base, np.uint64)
        table[0] = 1
        _tables[name] = np.multiply.accumulate(table)
    return _tables[name]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """c such that (c[j] - c[i]) * BASE**-i is the polynomial hash of data[i:j]."""
    c = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(len(data), BASE, "up")[:len(data)], out=c[1:])
    return c


def span_hash(c: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return mixed((c[end] - c[start]) * powers(len(c), BASE_INVERSE, "down")[start])


class Words(NamedTuple):
    start: np.ndarray
    end: np.ndarray
    document: np.ndarray  # of each word
    counts: np.ndarray    # words of each document


def words(block: Block) -> Words:
    space = IS_SPACE[block.data]
    n, docs = len(space), len(block.offsets) - 1
    edge = np.zeros(n + 1, bool)
    edge[block.offsets] = True
    before = np.ones(n, bool)
    before[1:] = space[:-1]
    after = np.ones(n, bool)
    after[:-1] = space[1:]
    start = np.flatnonzero(~space & (before | edge[:-1]))
    end = np.flatnonzero(~space & (after | edge[1:])) + 1
    cuts = np.searchsorted(start, block.offsets)
    counts = np.diff(cuts)
    return Words(start, end, np.repeat(np.arange(docs), counts), counts)


def word_hashes(block: Block, w: Words, lower: bool = True) -> np.ndarray:
    return span_hash(prefix_hash(TO_LOWER[block.data] if lower else block.data), w.start, w.end)


def shingle_sets(block: Block, width: int = 5) -> list[np.ndarray]:
    """The sorted distinct hashes (uint64) of each document's ``width``-word shingles, lower-cased.
    Fewer words make one shingle of them all, no words an empty set."""
    w = words(block)
    h = word_hashes(block, w)
    keys = mixed(np.arange(1, width + 2, dtype=np.uint64)) | np.uint64(1)
    whole = max(0, len(h) - width + 1)
    grams = np.zeros(whole, np.uint64)
    for k in range(width):
        grams += h[k:k + whole] * keys[k]
    grams = mixed(grams)
    out, at = [], 0
    for n in w.counts.tolist():
        if n >= width:
            out.append(np.unique(grams[at:at + n - width + 1]))
        elif n:
            out.append(mixed((h[at:at + n] * keys[:n]).sum(dtype=np.uint64, keepdims=True) + keys[width:width + 1] * np.uint64(n)))
        else:
            out.append(np.zeros(0, np.uint64))
        at += n
    return out
