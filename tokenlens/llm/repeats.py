"""Operator 4: removal of repeated byte strings by column-wise multi-document construction.

A byte goes if it lies in a string of ``LENGTH`` bytes that starts anywhere else too. Repeats are
found in collections of aligned pieces of text:

1. Anchors. In every string of LENGTH bytes, the ``ANCHOR``-byte substring with the least hash is an
   anchor, so equal strings have an equal anchor at the same place. A piece is an anchor with all
   the strings around it, at most LENGTH - ANCHOR bytes before it and LENGTH from its start on.
   Anchors that occur once are dropped, equal pieces of one anchor become one with a weight.
2. A piece that all occurrences of its anchor share repeats as a whole. Other pieces go, whole
   anchors together, into collections that are built column by column, right to left: each round
   inserts one symbol of every piece into the collection's Burrows-Wheeler transform, orders the
   suffixes by the symbols' ranks, and updates the common prefixes from the range minima between
   neighbours. Runs of common prefixes of LENGTH or more are the repeated strings. As pieces are
   aligned, the transform is kept by column (a positional transform).
3. An anchor with more than ``GROUP`` different pieces (a passage that very many documents share)
   doesn't become one large collection: its strings are halved by place, and each half has a longer
   part that its equal strings must share, by which its pieces are grouped anew. At the last, that
   part is the string itself.
4. Repeated ranges go back to all places of a piece; a document's ranges are merged and cut out.

A collection has at most ``COLLECTION`` pieces (or one group more) of at most 2 * LENGTH - ANCHOR
bytes, so its transform is held in a task's memory; what is larger than memory (anchors, pieces,
ranges) is in tables in the shared folder. Strings are judged on the input. A hash collision of two
anchors or pieces would take equal 64-bit hashes of both.

Null text is empty; a null doc_id is a document; rows that repeat a doc_id are documents of their own
whose equal strings count; an empty table gives an empty result. Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, attach, documents, has_repeats, id_of, original_id, text_of
from .textgrams import Block, blocks, prefix_hash, span_hash

LENGTH, ANCHOR = 200, 48
GROUP, COLLECTION = 256, 4096
PLACE = ["doc_id", "text_id"]
PIECE = ["anchor", "print", "before", "after"]


# -- anchors -----------------------------------------------------------------------------------

def window_min(a: np.ndarray, width: int) -> np.ndarray:
    """out[i] = min(a[i:i + width]), by doubling."""
    out, done = a, 1
    while done < width:
        step = min(done, width - done)
        out = np.minimum(out[:-step], out[step:])
        done += step
    return out


def anchors(block: Block, length: int, anchor: int) -> tuple[np.ndarray, ...]:
    """(document, start in it, bytes before, bytes after, anchor hash, piece hash) of the anchors."""
    data, at = block.data, block.offsets
    n, width = len(data), length - anchor + 1
    if n < length:
        return tuple(np.zeros(0, np.int64) for _ in range(6))
    c = prefix_hash(data)
    starts = np.arange(n - anchor + 1)
    h = span_hash(c, starts, starts + anchor)
    doc = np.repeat(np.arange(len(at) - 1), np.diff(at))
    end = at[1:][doc]
    low = (h >> np.uint64(33)).astype(np.uint32) + np.uint32(1)
    low[starts + anchor > end[:len(starts)]] = np.uint32(0xFFFFFFFF)  # runs out of its document
    least = window_min(low, width)
    least[np.arange(len(least)) + length > end[:len(least)]] = 0
    around = np.concatenate([np.zeros(width - 1, np.uint32), least, np.zeros(width - 1, np.uint32)])
    most = ~window_min(~around, width)  # the largest of the minima of the windows that hold a start
    p = np.flatnonzero(most[:len(low)] == low)
    d = doc[p]
    before = np.minimum(p - at[d], length - anchor)
    after = np.minimum(at[d + 1] - p, length)
    return d, p - at[d], before, after, h[p].view(np.int64), span_hash(c, p - before, p + after).view(np.int64)


def anchor_table(texts: DataFrame, length: int, anchor: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(2)):
                d, start, before, after, h, piece = anchors(block, length, anchor)
                rows = pa.array(d + block.first)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(rows), batch.column(1).take(rows), pa.array(start.astype(np.int64)), pa.array(before.astype(np.int32)),
                     pa.array(after.astype(np.int32)), pa.array(h), pa.array(piece)],
                    names=[*PLACE, "start", "before", "after", "anchor", "print"])

    return texts.mapInArrow(run, "doc_id long, text_id long, start long, before int, after int, anchor long, print long")


# -- the collection's transform ----------------------------------------------------------------

def repeated_in_collection(pieces: list[bytes], groups: np.ndarray, weights: np.ndarray, columns: np.ndarray,
                           length: int) -> list[np.ndarray]:
    """For each piece the places (0 is its first byte) at which a string of ``length`` bytes starts
    that repeats in its group: at the same column of another piece, or in a piece of weight over 1.
    ``columns``: the column of each piece's first byte.

    Columns are taken from the last to the first. A round inserts the symbol of every piece at its
    column before the suffixes of the column behind it: the symbols, in those suffixes' order, are
    the column's part of the transform; ranking them gives the order of the new suffixes, and the
    common prefix of two neighbours with the same symbol is one more than the least common prefix
    between their old places. Equal strings stand in the same column, so no round needs more than
    the column behind its own."""
    m = len(pieces)
    sizes = np.array([len(p) for p in pieces])
    text = np.frombuffer(b"".join(pieces) + b"\0", np.uint8)
    first = np.concatenate([[0], np.cumsum(sizes)[:-1]]) - columns     # of column 0
    ends = columns + sizes
    rank = np.unique(groups, return_inverse=True)[1]
    low = int(columns.min())
    found = np.zeros((m, max(1, int((ends - length).max()) - low + 1)), bool)
    order = np.zeros(0, np.int64)                                       # pieces by group, then suffix
    common = np.zeros(0, np.uint8)                                      # with the suffix before, up to length
    entering = np.argsort(-ends, kind="stable")
    entry_ends, entered = -ends[entering], 0
    for column in range(int(ends.max()) - 1, low - 1, -1):
        upto = int(np.searchsorted(entry_ends, -column))                # pieces that end behind this column
        if upto > entered:                                              # their empty suffixes come first
            order = np.concatenate([entering[entered:upto], order])
            common = np.concatenate([np.zeros(upto - entered, np.uint8), common])
            entered = upto
        here = columns[order] <= column
        if not here.all():                                              # pieces that begin behind it leave
            common = _without(common, here)
            order = order[here]
        if not len(order):
            continue
        symbol = text[first[order] + column]
        sort = np.argsort(symbol, kind="stable")
        sort = sort[np.argsort(rank[order[sort]].astype(np.uint16 if m < 65536 else np.int64), kind="stable")]
        order, symbol = order[sort], symbol[sort]
        same = (symbol[1:] == symbol[:-1]) & (rank[order[1:]] == rank[order[:-1]])
        grown = np.zeros(len(order), np.uint8)
        grown[1:][same] = common_range(common, sort[:-1][same], sort[1:][same], length)
        common = grown
        if column - low < found.shape[1]:
            runs = np.flatnonzero(common < length)
            total = np.add.reduceat(np.minimum(weights[order], 2), runs)
            repeated = np.repeat(total > 1, np.diff(np.append(runs, len(order)))) & (ends[order] - column >= length)
            found[order[repeated], column - low] = True
    return [np.flatnonzero(row) + low - at for row, at in zip(found, columns)]


def _without(common: np.ndarray, stay: np.ndarray) -> np.ndarray:
    """Common prefixes after some suffixes have left: the least up to the one that stays."""
    kept = np.flatnonzero(stay)
    if not len(kept):
        return common[:0]
    return np.minimum.reduceat(common[:kept[-1] + 1], np.concatenate([[0], kept[:-1] + 1]))


def common_range(common: np.ndarray, lower: np.ndarray, upper: np.ndarray, cap: int) -> np.ndarray:
    """1 + the least of common[lower + 1 .. upper], at most ``cap``."""
    if not len(lower):
        return np.zeros(0, np.uint8)
    edges = np.stack([lower + 1, upper + 1], 1).ravel()
    least = np.minimum.reduceat(np.append(common, np.uint8(0)), edges)[::2]
    return np.minimum(least + np.uint8(1), np.uint8(cap))


def ranges(places: np.ndarray) -> list[dict]:
    """Sorted places as ranges {lo, hi}, both included."""
    if not len(places):
        return []
    cuts = np.flatnonzero(np.diff(places) > 1)
    return [{"lo": int(a), "hi": int(b)} for a, b in zip(places[np.append(0, cuts + 1)], places[np.append(cuts, len(places) - 1)])]


RANGES = "array<struct<lo: int, hi: int>>"


def collections(rows: DataFrame, length: int) -> DataFrame:
    """gid, f, found (repeated ranges) of the pieces of small groups: gid, f, lo, bytes, weight."""
    parts = max(1, rows.count() // (4 * COLLECTION) + 1)
    schema = pa.schema([("gid", pa.int64()), ("f", pa.int64()), ("found", pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())])))])

    def solve(batch: pa.Table) -> pa.RecordBatch:
        gid, lo = batch["gid"].to_numpy(), batch["lo"].to_numpy().astype(np.int64)
        repeated = repeated_in_collection(batch["bytes"].to_pylist(), gid, batch["weight"].to_numpy(), lo, length)
        found = [ranges(x + at) for x, at in zip(repeated, lo)]
        rows = [{"gid": g, "f": f, "found": r} for g, f, r in zip(gid.tolist(), batch["f"].to_pylist(), found) if r]
        return pa.RecordBatch.from_pylist(rows, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:  # sorted by group; a collection ends where a group does
            new = pa.Table.from_batches([batch])
            held = new if held is None else pa.concat_tables([held, new])
            while held.num_rows > COLLECTION:
                gid = held["gid"].to_numpy()
                cut = int(np.searchsorted(gid, gid[COLLECTION], "left")) or int(np.searchsorted(gid, gid[0], "right"))
                if cut >= held.num_rows:
                    break
                yield solve(held.slice(0, cut))
                held = held.slice(cut)
        if held is not None and held.num_rows:
            yield solve(held)

    dealt = rows.select("gid", "f", "lo", "weight", "bytes").repartition(parts, "gid").sortWithinPartitions("gid")
    return dealt.mapInArrow(run, f"gid long, f long, found {RANGES}")


# -- the whole job -----------------------------------------------------------------------------

def solve_groups(rows: DataFrame, scratch: Scratch, length: int, group: int, level: int = 0) -> DataFrame:
    """gid, f, found for pieces gid, f, k (pieces of the group), a, b (places that the group is about),
    lo, hi (those of them that the piece has), bytes (from lo to the end of the string at hi), weight."""
    alone = rows.where("k = 1 AND weight > 1").select("gid", "f", F.array(F.struct("lo", "hi")).alias("found"))
    found = scratch.write(collections(rows.where(F.col("k").between(2, group)), length), f"found-{level}")
    found = found.unionByName(alone)
    large = rows.where(F.col("k") > group)
    if not large.limit(1).count():
        return found
    middle = F.floor((F.col("a") + F.col("b")) / 2).cast("int")
    halves = large.select("gid", "f", "lo", "hi", "bytes", "weight", F.explode(F.array(
        F.struct(F.col("a").alias("a"), middle.alias("b")), F.struct((middle + 1).alias("a"), F.col("b").alias("b")))).alias("half"))
    halves = halves.select("gid", "f", F.col("lo").alias("from"), "bytes", "weight", "half.a", "half.b",
                           F.greatest("lo", "half.a").alias("lo"), F.least("hi", "half.b").alias("hi")).where("lo <= hi AND a <= b")
    halves = halves.withColumn("bytes", F.expr(f"substring(bytes, lo - from + 1, hi - lo + {length})"))
    shared = F.expr(f"substring(bytes, b - lo + 1, a - b + {length})")  # in every string from a to b
    halves = halves.select(F.col("gid").alias("up_gid"), F.col("f").alias("up_f"), F.xxhash64("gid", "a", shared).alias("gid"),
                           F.xxhash64("lo", "hi", "bytes").alias("f"), "a", "b", "lo", "hi", "bytes", "weight")
    halves = scratch.write(halves, f"halves-{level}")
    below = halves.groupBy("gid", "f").agg(
        F.first("a").alias("a"), F.first("b").alias("b"), F.first("lo").alias("lo"), F.first("hi").alias("hi"),
        F.first("bytes").alias("bytes"), F.sum("weight").alias("weight"), F.count(F.lit(1)).alias("links"))
    below = scratch.write(below, f"below-{level}")
    sizes = below.groupBy("gid").agg(F.count(F.lit(1)).alias("k"))
    pieces = scratch.write(attach(below.drop("links"), sizes, ["gid"], "k", below.count()), f"pieces-{level + 1}")
    solved = solve_groups(pieces, scratch, length, group, level + 1)
    solved = solved.join(below.select("gid", "f", "links"), ["gid", "f"])
    back = attach(halves.select("gid", "f", "up_gid", "up_f"), solved, ["gid", "f"], "links", halves.count())
    back = back.select(F.col("up_gid").alias("gid"), F.col("up_f").alias("f"), "found")
    return scratch.write(found.unionByName(back), f"all-{level}")


def piece_bytes(pieces: DataFrame, texts: DataFrame, length: int) -> DataFrame:
    """The pieces with their bytes, from lo to the end of the string at hi, cut from one place of each."""
    fields = ["gid", "f", "lo", "hi", "weight", "k", "start"]
    wanted = pieces.groupBy("at.doc_id", "at.text_id").agg(F.collect_list(F.struct(
        "gid", "f", "lo", "hi", "weight", "k", F.col("at.start").alias("start"))).alias("wanted"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                text, held = batch.column(0)[i].as_buffer().to_pybytes(), batch.column(1).slice(i, 1).flatten()
                columns = [held.field(n) for n in fields]
                lo, hi, start = (columns[k].to_numpy() for k in (2, 3, 6))
                cut = [text[s + a:s + b + length] for s, a, b in zip(start.tolist(), lo.tolist(), hi.tolist())]
                yield pa.RecordBatch.from_arrays([*columns[:6], pa.array(cut, pa.binary())], names=[*fields[:6], "bytes"])

    both = texts.join(wanted, PLACE).select("text", "wanted")
    return both.mapInArrow(run, "gid long, f long, lo int, hi int, weight long, k long, bytes binary")


def repeated_spans(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR, group: int = GROUP) -> tuple[DataFrame, DataFrame]:
    """(texts, spans): doc_id, text_id, text of every row; doc_id, text_id and the array of (lo, hi)
    byte spans, overlapping and unordered, of those with repeats."""
    scratch = Scratch(docs.sparkSession, "repeats")
    texts = docs.select(id_of().alias("doc_id"), text_of().alias("text"))
    same_ids = has_repeats(texts.select("doc_id"))
    texts = texts.select("doc_id", (F.xxhash64("text") if same_ids else F.lit(0).cast("bigint")).alias("text_id"), "text")
    found = scratch.write(anchor_table(texts, length, anchor), "anchors")
    often = scratch.write(found.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "often")
    places = scratch.write(attach(found, often, ["anchor"], "n", found.count()).drop("n"), "places")
    scratch.drop("anchors", "often")
    pieces = places.groupBy(*PIECE).agg(F.count(F.lit(1)).alias("weight"), F.min(F.struct(*PLACE, "start")).alias("at"))
    pieces = pieces.withColumn("lo", -F.col("before")).withColumn("hi", F.col("after") - length).where("lo <= hi")
    pieces = scratch.write(pieces.withColumn("f", F.xxhash64("print", "before", "after")).withColumnRenamed("anchor", "gid"), "pieces")
    kinds = pieces.groupBy("gid").agg(F.count(F.lit(1)).alias("k"))
    pieces = scratch.write(attach(pieces, kinds, ["gid"], "k", pieces.count()), "pieces-of-anchors")
    whole = pieces.where("k = 1 AND weight > 1").select("gid", "f", F.array(F.struct("lo", "hi")).alias("found"))
    several = scratch.write(piece_bytes(pieces.where("k > 1"), texts, length), "pieces-0")
    several = several.withColumn("a", F.lit(anchor - length)).withColumn("b", F.lit(0))
    solved = solve_groups(several, scratch, length, group).unionByName(whole)
    solved = solved.groupBy("gid", "f").agg(F.flatten(F.collect_list("found")).alias("found"))
    weighed = scratch.write(solved.join(pieces.select("gid", "f", "weight", *PIECE[1:]), ["gid", "f"]).drop("f"), "solved")
    scratch.drop("pieces-0", "halves-0", "below-0", "pieces-1")  # the large ones, no longer read
    held = attach(places.withColumnRenamed("anchor", "gid"), weighed, ["gid", *PIECE[1:]], "weight", places.count())
    spans = held.select(*PLACE, F.expr(f"transform(found, r -> named_struct('lo', start + r.lo, 'hi', start + r.hi + {length}))").alias("s"))
    return texts, spans.groupBy(*PLACE).agg(F.flatten(F.collect_list("s")).alias("spans"))


def remove_repeats(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR, group: int = GROUP) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept (the remaining bytes)."""
    texts, spans = repeated_spans(docs, length, anchor, group)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, column, held = (batch.column(n) for n in ("doc_id", "text", "spans"))
            rows: list[tuple] = []
            for i in range(batch.num_rows):
                text = column[i].as_buffer().to_pybytes()
                kept, spans, removed, at = [], 0, 0, 0
                if held[i].is_valid:
                    both = held.slice(i, 1).flatten()
                    lo, hi = both.field("lo").to_numpy(), both.field("hi").to_numpy()
                    for a, b in merged_spans(lo, hi):
                        kept.append(text[at:a])
                        spans, removed, at = spans + 1, removed + b - a, b
                kept.append(text[at:])
                rows.append((ids[i].as_py(), len(text), removed, spans, b"".join(kept)))
                if len(rows) == 256 or i + 1 == batch.num_rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (*[pa.int64()] * 4, pa.binary()))],
                                                     names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])
                    rows = []

    both = texts.join(spans, PLACE, "left").select("doc_id", "text", "spans")
    out = both.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
    return out.withColumn("doc_id", original_id())


def merged_spans(lo: np.ndarray, hi: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs covered by the spans."""
    sort = np.argsort(lo)
    lo, reach = lo[sort], np.maximum.accumulate(hi[sort])
    new = np.append(True, lo[1:] > reach[:-1])
    return list(zip(lo[new].tolist(), reach[np.append(np.flatnonzero(new)[1:] - 1, len(lo) - 1)].tolist()))


def op4_repeated_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(documents(spark, sf_dir))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
