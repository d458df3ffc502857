"""Operator 7: best-two-fit packing of tokenised documents into sequences.

1. One scan tokenises the texts and writes a row per piece (documents over the capacity are cut).
2. What packing needs to know of the corpus is how many pieces there are of each length: at most
   ``capacity`` counts, whatever the corpus size. Bins are planned on these counts, many equal bins
   at a time: fill greedily with the longest length that fits, then replace the bin's smallest
   document by two unpacked ones that fit the expanded gap more tightly, if there are such.
3. Pieces of one length are interchangeable: the plan's slots are rank ranges of each length, so a
   piece finds its sequence and offset from its rank among the pieces of its length. Ranks are
   counted in ``CHUNKS`` parts per length, so a length that a third of all pieces share is spread.

The plan's size follows the number of different lengths, not of pieces: each step uses up all but a
remainder of one length.

Null text is empty (one piece that holds the closing 0 only); a null doc_id is a document; repeated
rows are packed each; an empty table gives no pieces. Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import json
import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, documents
from .textgrams import blocks

CAPACITY, END_ID, CHUNKS = 2048, 0, 256
#: Parts of one generation of a worker's encoder: fewer take less memory and more time.
KEEP = 400_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class PlainEncoder:
    """Packed little-endian ids of whole texts by the tokenizer itself."""

    def __init__(self, tokenizer):
        self.tokenizer = tokenizer

    def block(self, texts: list[bytes]) -> list[bytes]:
        whole = [text.decode("utf-8", "replace") for text in texts]
        return [_packed(x.ids) for x in self.tokenizer.encode_batch_fast(whole, add_special_tokens=False)]


#: The rules of the tokenizers whose words WordEncoder may cut out of a text.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
WORD_RULES = (["NFC", "Replace", "Lowercase"], ["Split", "ByteLevel"], WORD_PATTERN, "BPE", "</w>")


def word_rules(tokenizer) -> tuple:
    """A tokenizer's normalizers, pre-tokenizers, pattern, model and word end, as in WORD_RULES."""
    held = json.loads(tokenizer.to_str())
    before, cut = ((held[k] or {}).get(inner, []) for k, inner in (("normalizer", "normalizers"), ("pre_tokenizer", "pretokenizers")))
    pattern = next((x["pattern"].get("Regex") for x in cut if x["type"] == "Split"), None)
    return [x["type"] for x in before], [x["type"] for x in cut], pattern, held["model"]["type"], held["model"].get("end_of_word_suffix")


class WordEncoder:
    """The same for a tokenizer of WORD_RULES, by white-space separated part: its rules never look
    across white space, so each different part is encoded once and kept. A word of letters is kept
    apart from the ASCII marks that follow it, which the tokenizer splits off too. Two generations of
    ``keep`` parts bound the memory."""

    marks = bytes(b for b in range(0x21, 0x7F) if not chr(b).isalnum())

    def __init__(self, tokenizer, keep: int = KEEP):
        self.tokenizer, self.keep = tokenizer, keep
        self.now: dict[bytes, bytes] = {}
        self.before: dict[bytes, bytes] = {}
        vocab = tokenizer.get_vocab()
        self.ends_word = np.zeros(max(vocab.values()) + 1, bool)
        self.ends_word[[i for token, i in vocab.items() if token.endswith("</w>")]] = True

    def ids(self, texts: list[bytes]) -> list[bytes]:
        return PlainEncoder.block(self, texts) if texts else []

    def stem_ids(self, stems: list[bytes]) -> list[bytes]:
        """Words of letters. The tokenizer's model takes lower-case ASCII words as they are; others
        go through the whole tokenizer together, where each has one token that ends a word."""
        tokenize, out, rest = self.tokenizer.model.tokenize, {}, []
        for stem in stems:
            if stem.isascii():
                out[stem] = _packed([token.id for token in tokenize(stem.decode())])
            else:
                rest.append(stem)
        if rest:
            joined = b" ".join(rest).decode("utf-8", "replace")
            ids = np.array(self.tokenizer.encode_batch_fast([joined], add_special_tokens=False)[0].ids, "<u4")
            cuts = np.flatnonzero(self.ends_word[ids]) + 1
            each = [p.tobytes() for p in np.split(ids, cuts[:-1])] if len(cuts) == len(rest) else self.ids(rest)
            out.update(zip(rest, each))
        return [out[stem] for stem in stems]

    def known(self, keys: set[bytes]) -> list[bytes]:
        """Those of ``keys`` that no generation holds; those that the older one holds are kept on."""
        new = keys.difference(self.now)
        old = {k: self.before[k] for k in new if k in self.before}  # (an intersection would walk the whole of ``before``)
        self.now.update(old)
        return list(new.difference(old))

    def learn(self, parts: set[bytes]) -> None:
        """Makes ``now`` hold all of ``parts``."""
        if len(self.now) > self.keep:
            self.now, self.before = {}, self.now
        split, lows, ends, whole, stems = [], [], [], [], set()
        for part in self.known(parts):
            stem = part.rstrip(self.marks)
            if stem.isalpha():  # ASCII letters
                low = stem.lower()
                if low == part:
                    stems.add(part)
                    continue
            elif not stem.isascii() and stem.decode("utf-8", "replace").lower().isalpha():
                # letters in lower case too: one letter's lower case has a combining mark, which joins what follows
                low = stem
            else:
                whole.append(part)
                continue
            split.append(part)
            lows.append(low)
            ends.append(part[len(stem):])
        self.now[b""] = b""
        new = self.known(stems.union(lows))
        self.now.update(zip(new, self.stem_ids(new)))
        whole += self.known(set(ends))
        self.now.update(zip(whole, self.ids(whole)))
        now = self.now.__getitem__
        self.now.update(zip(split, map(bytes.__add__, map(now, lows), map(now, ends))))

    def block(self, texts: list[bytes]) -> list[bytes]:
        split = [text.split() for text in texts]  # at ASCII white space
        self.learn(set().union(*split))
        known = self.now.__getitem__
        return [b"".join(map(known, parts)) for parts in split]


def _packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


_encoders: dict[str, PlainEncoder | WordEncoder] = {}


def encoder(path: str, keep: int = KEEP) -> PlainEncoder | WordEncoder:
    """One per Python worker, kept for its later tasks. Tokenizers of other rules than WORD_RULES encode
    whole texts."""
    if path not in _encoders:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        tokenizer = Tokenizer.from_file(path)
        _encoders[path] = WordEncoder(tokenizer) if word_rules(tokenizer) == WORD_RULES else PlainEncoder(tokenizer)
    _encoders[path].keep = keep
    return _encoders[path]


def word_bpe_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


def tokenised_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, keep: int = KEEP) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece."""

    end, width = np.array([END_ID], "<u4").tobytes(), 4 * capacity

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer_path, keep)
        for batch in batches:
            doc_ids = batch.column(0)
            for block in blocks(batch.column(1)):
                data, at = block.data.tobytes(), block.offsets.tolist()
                at_row, starts, parts = [], [], []
                for i, ids in enumerate(encode.block([data[a:b] for a, b in zip(at, at[1:])]), block.first):
                    ids += end
                    if len(ids) <= width:
                        at_row.append(i)
                        starts.append(0)
                        parts.append(ids)
                        continue
                    cut = range(0, len(ids), width)
                    at_row += [i] * len(cut)
                    starts += cut
                    parts += [ids[k:k + width] for k in cut]
                start = np.array(starts, np.int64) // 4
                yield pa.RecordBatch.from_arrays(
                    [doc_ids.take(pa.array(at_row, pa.int64())), pa.array((start // capacity).astype(np.int32)), pa.array(start),
                     pa.array(np.array([len(x) for x in parts], np.int64) // 4), pa.array(list(map(zlib.crc32, parts)), pa.int64())],
                    names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(run, PIECES)


def plan_bins(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a bin, number of such bins), until every count is used up."""
    left = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        left[length] = n
    plan = []
    while (lengths := np.flatnonzero(left)).size:
        used, gap = [], capacity
        while lengths.size and lengths[0] <= gap:  # greedily, the longest that fits
            best = int(lengths[np.searchsorted(lengths, gap, "right") - 1])
            n = min(gap // best, int(left[best]))
            used += [best] * n
            left[best] -= n
            gap -= best * n
            if not left[best]:
                lengths = lengths[lengths != best]
        if gap and len(used) > 1:
            pair = tighter_pair(left, lengths, used[-1], gap + used[-1])
            if pair:
                left[used.pop()] += 1
                used += sorted(pair, reverse=True)
                for length in pair:
                    left[length] -= 1
        # the same bin again, as often as its lengths last
        size, per_bin = np.unique(used, return_counts=True)
        again = int((left[size] // per_bin).min())
        left[size] -= again * per_bin
        plan.append((tuple(used), again + 1))
    return plan


def tighter_pair(left: np.ndarray, lengths: np.ndarray, smallest: int, gap: int) -> tuple[int, int] | None:
    """The two unpacked lengths with the largest sum in (smallest, gap], if any."""
    small = lengths[lengths < gap]
    if not small.size:
        return None
    at = np.searchsorted(small, gap - small, "right") - 1
    ok = at >= 0
    first, second = small[ok], small[at[ok]]
    twice = (first == second) & (left[first] < 2)
    lower = np.where(at[ok] > 0, small[np.maximum(at[ok] - 1, 0)], 0)  # the next shorter one if there is only one
    second = np.where(twice, lower, second)
    total = np.where(second > 0, first + second, 0)
    if not total.size or total.max() <= smallest:
        return None
    k = int(total.argmax())
    return int(first[k]), int(second[k])


def slot_rows(plan: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, last rank, sequence of the first, offset) of every slot of the plan."""
    taken: dict[int, int] = {}
    rows, sequence = [], 0
    for used, bins in plan:
        offset = 0
        for length in used:
            first = taken.get(length, 0)
            rows.append((length, first, first + bins - 1, sequence, offset))
            taken[length] = first + bins
            offset += length
        sequence += bins
    return rows


def ranked(pieces: DataFrame) -> DataFrame:
    """Adds ``rank``: 0, 1, ... among the pieces of each length. Only pieces that agree in all of
    ``told_by`` can change places, and those are alike."""
    told_by = [c for c in ("doc_id", "piece", "start", "ids_crc32") if c in pieces.columns]
    parts = pieces.withColumn("chunk", F.pmod(F.xxhash64(*told_by), F.lit(CHUNKS)).cast("int"))
    before = (parts.groupBy("length", "chunk").agg(F.count(F.lit(1)).alias("n")).withColumn(
        "before", F.expr("sum(n) OVER (PARTITION BY length ORDER BY chunk ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - n")))
    parts = parts.withColumn("k", F.expr(f"row_number() OVER (PARTITION BY length, chunk ORDER BY {', '.join(told_by)}) - 1"))
    return parts.join(before.drop("n"), ["length", "chunk"]).withColumn("rank", F.col("before") + F.col("k")).drop("chunk", "k", "before")


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to every row; ``pieces`` has doc_id, piece, start and length (at
    most ``capacity``) and is read several times, so it should be a written table."""
    spark = pieces.sparkSession
    counts = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}  # a row per length
    slots = spark.createDataFrame(slot_rows(plan_bins(counts, capacity)),
                                  "slot_length long, first long, last long, sequence long, offset long")
    rows = ranked(pieces)
    at = (F.col("length") == F.col("slot_length")) & F.col("rank").between(F.col("first"), F.col("last"))
    return (rows.join(F.broadcast(slots), at)  # bounded: see the module's text
            .withColumn("sequence_id", F.col("sequence") + F.col("rank") - F.col("first"))
            .drop("slot_length", "first", "last", "sequence", "rank"))


def pack_documents(docs: DataFrame, tokenizer_path: str | None = None, capacity: int = CAPACITY, keep: int = KEEP) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece."""
    pieces = Scratch(docs.sparkSession, "packing").write(
        tokenised_pieces(docs, tokenizer_path or word_bpe_path(), capacity, keep), "pieces")
    return pack(pieces, capacity).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(documents(spark, sf_dir))
