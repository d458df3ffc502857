"""Operator 12: groups of spelling variants by PartEnum signatures.

1. One scan cuts the texts into runs of letters, applies the contract's deletions and counts words in
   the task; partial counts meet by word.
2. A word's letter multiset is a binary vector with a dimension for the k-th occurrence of a letter. One
   inserted or deleted letter changes one dimension, a replaced one changes two. PartEnum splits the
   dimensions into parts (balanced by how many words have them) and enumerates the choices of parts
   that may be left alone: words of one length (distance 2) share one of the 6 choices of 2 out of 4
   parts, words of neighbouring lengths (distance 1) one of the 3 choices of 2 out of 3. A signature is
   the vector's projection on the choice, exactly, as a 64-bit hash that only ever adds candidates.
   Every signature goes once with the first half of the word and once with its last half (of the
   shorter of neighbouring lengths): one edit leaves at least one half alone. This keeps groups of
   anagrams apart, which share all signatures.
3. Signatures are equi-joined and candidates verified by their edit distance; a pair that shares several
   signatures is counted once.
4. Of a word's near words the most frequent is its form if it is ``ratio`` times as frequent; forms of
   forms are followed by doubling, at most log2(log10 n) rounds as counts grow tenfold by step.

Very frequent words are counted in the tasks before they meet; a signature's group holds words that
share a half and most of their letters, one row each, however frequent they are. Roots that very many
words share are a row in the looked-up table and skewed joins are split by AQE.

Null texts have no words; a null doc_id is written as empty in the key of the deletions; rows that
repeat an id count each; an empty table or one without words gives no rows; very long texts are cut by
document, very long runs are words as others. Bytes that are not UTF-8 end a run. Only ``doc_id`` and
``text`` are read.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, documents
from .textgrams import TO_LOWER, Block, blocks, mixed

LEAST_LENGTH, LEAST_COUNT, RATIO, DELETE_EVERY = 7, 2, 10, 31
#: (parts, parts that must agree) by the distance of the vectors.
SAME_LENGTH, NEXT_LENGTH = (4, 2), (3, 2)
#: Occurrences of a letter that are told apart when dimensions are dealt to parts.
MOST_OCCURRENCES = 8
FLUSH = 200_000
MAX_BROADCAST = 500_000


def runs(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(lower-cased bytes, start, end, document) of the maximal runs of A-Z, a-z and U+00C0 to U+00FF,
    whose two bytes are C3 and any continuation."""
    data, n = block.data, len(block.data)
    lower = TO_LOWER[data]
    lead = data == 0xC3
    after_lead = np.zeros(n, bool)
    after_lead[1:] = lead[:-1]
    inside = ((lower >= 0x61) & (lower <= 0x7A)) | lead | after_lead
    edge = np.zeros(n + 1, bool)
    edge[block.offsets] = True
    before, after = np.zeros(n, bool), np.zeros(n, bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    start = np.flatnonzero(inside & (~before | edge[:-1]))
    end = np.flatnonzero(inside & (~after | edge[1:])) + 1
    leads = np.concatenate([[0], np.cumsum(lead)])
    long = (end - start) - (leads[end] - leads[start]) >= LEAST_LENGTH
    start, end = start[long], end[long]
    return lower, start, end, np.searchsorted(block.offsets, start, "right") - 1


def occurrences(block: Block, ids: list[str]) -> Iterator[bytes]:
    """The words of the block, deletions applied, in UTF-8; ``ids`` are the documents' ids as text."""
    lower, start, end, document = runs(block)
    data, crc32 = lower.tobytes(), zlib.crc32
    prefixes = [crc32(f"{x}:".encode()) for x in ids]
    for s, e, d in zip(start.tolist(), end.tolist(), document.tolist()):
        run = data[s:e]
        h = crc32(run, prefixes[d])
        if h % DELETE_EVERY:
            yield run
        else:
            text = run.decode("utf-8", "ignore")
            k = h % len(text)
            if len(text) > LEAST_LENGTH:
                yield (text[:k] + text[k + 1:]).encode()


def word_counts(docs: DataFrame) -> DataFrame:
    """word, n of every word that occurs often enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()

        def out() -> pa.RecordBatch:
            rows = pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.binary()).cast(pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"])
            held.clear()
            return rows

        for batch in batches:
            ids = ["" if x is None else str(x) for x in batch.column(0).to_pylist()]
            for block in blocks(batch.column(1)):
                held.update(occurrences(block, ids[block.first:block.first + len(block.offsets) - 1]))
                if len(held) > FLUSH:
                    yield out()
        yield out()

    text = F.make_valid_utf8(F.col("text").cast("string"))
    parts = docs.select(F.col("doc_id").cast("bigint"), text).mapInArrow(run, "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


class Letters:
    """The dimensions of a batch of words: ``letter`` and ``occurrence`` (from 0) of every letter, by
    word, letters in order within a word."""

    def __init__(self, words: list[str]):
        self.length = np.array([len(w) for w in words], np.int64)
        self.points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.uint64)
        self.first = np.cumsum(self.length) - self.length
        self.word = np.repeat(np.arange(len(words)), self.length)
        order = np.lexsort((self.points, self.word))
        self.letter = self.points[order]
        new = np.ones(len(order), bool)
        new[1:] = (self.word[1:] != self.word[:-1]) | (self.letter[1:] != self.letter[:-1])
        at = np.arange(len(order))
        self.occurrence = at - np.maximum.accumulate(np.where(new, at, 0))


def dealt_letters(words: DataFrame) -> list[tuple[int, int, int]]:
    """(letter, occurrence, words with it): at most 128 letters times MOST_OCCURRENCES rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = Letters(batch.column(0).to_pylist())
            few = own.occurrence < MOST_OCCURRENCES
            key, n = np.unique(own.letter[few] * np.uint64(MOST_OCCURRENCES) + own.occurrence[few].astype(np.uint64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(key.astype(np.int64)), pa.array(n, pa.int64())], names=["key", "n"])

    counts = words.select("word").mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).collect()
    return [(key // MOST_OCCURRENCES, key % MOST_OCCURRENCES, n) for key, n in counts]


def parts_of(dealt: list[tuple[int, int, int]], total: int, n_parts: int) -> dict[tuple[int, int], int]:
    """A part for every dimension: those that tell most words apart first, each to the lightest part."""
    weight = {(letter, k): min(n, total - n) for letter, k, n in dealt}
    load, out = [0] * n_parts, {}
    for dim in sorted(weight, key=lambda d: (-weight[d], d)):
        out[dim] = load.index(min(load))
        load[out[dim]] += weight[dim] + 1
    return out


def projections(letters: Letters, parts: dict[tuple[int, int], int], shape: tuple[int, int]) -> np.ndarray:
    """(choices, words): the hash of each word's vector on each choice of parts."""
    n_parts, agree = shape
    table = np.full((256, MOST_OCCURRENCES), -1, np.int64)
    for (letter, k), part in parts.items():
        table[letter, k] = part
    seen = np.where(letters.occurrence < MOST_OCCURRENCES, table[letters.letter.astype(np.int64), np.minimum(letters.occurrence, MOST_OCCURRENCES - 1)], -1)
    h = mixed(letters.letter * np.uint64(1 << 32) + letters.occurrence.astype(np.uint64) + np.uint64(1))
    part = np.where(seen >= 0, seen, (h % np.uint64(n_parts)).astype(np.int64))
    each = np.zeros((n_parts, len(letters.length)), np.uint64)
    for p in range(n_parts):
        own = np.concatenate([np.zeros(1, np.uint64), np.cumsum(np.where(part == p, h, np.uint64(0)), dtype=np.uint64)])
        each[p] = mixed((own[letters.first + letters.length] - own[letters.first]) + np.uint64(p))
    return np.stack([sum((each[p] for p in choice), np.uint64((2 * k + 1) * 0x9E3779B97F4A7C15 % (1 << 64)))
                     for k, choice in enumerate(combinations(range(n_parts), agree))])


def halves(letters: Letters, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the first and of the last ``length // 2`` letters of each word."""
    h = np.zeros((2, len(length)), np.uint64)
    size = length // 2
    for k in range(int(size.max()) if len(size) else 0):
        on = size > k
        h[0, on] = mixed(h[0, on] + letters.points[letters.first[on] + k])
        h[1, on] = mixed(h[1, on] + letters.points[(letters.first + letters.length)[on] - 1 - k])
    return h[0], h[1] ^ np.uint64(0x5555555555555555)


def signatures(words: DataFrame, dealt: list[tuple[int, int, int]], total: int) -> DataFrame:
    """signature, word, n: all signatures of every word. Words of one length meet under it, words of
    neighbouring lengths under the shorter one."""
    same, following = (parts_of(dealt, total, shape[0]) for shape in (SAME_LENGTH, NEXT_LENGTH))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 4096):
                rows = batch.slice(k, 4096)
                letters = Letters(rows.column(0).to_pylist())
                out = []
                for kind, parts, shape, shorter in ((0, same, SAME_LENGTH, 0), (1, following, NEXT_LENGTH, 0), (1, following, NEXT_LENGTH, 1)):
                    length = letters.length - shorter
                    own = projections(letters, parts, shape) + mixed((length * 2 + kind).astype(np.uint64))
                    out += [mixed(x + half) for x in own for half in halves(letters, length)]
                values = np.concatenate(out).view(np.int64)
                at = pa.array(np.tile(np.arange(rows.num_rows), len(out)))
                yield pa.RecordBatch.from_arrays([pa.array(values), rows.column(0).take(at), rows.column(1).take(at)], names=["signature", "word", "n"])

    return words.mapInArrow(run, "signature long, word string, n long")


def near_pairs(signed: DataFrame) -> DataFrame:
    """word, n, near, near_n: both directions of every pair at edit distance one. ``signed`` is a written
    table, so that both sides of the join are one and the same shuffle."""
    a, b = signed.alias("a"), signed.alias("b")
    close = a.join(b, F.col("a.signature") == F.col("b.signature")).where(
        (F.col("a.word") < F.col("b.word")) & (F.levenshtein("a.word", "b.word", 1) == 1))
    once = close.groupBy(F.col("a.word").alias("word"), F.col("b.word").alias("near")).agg(
        F.first("a.n").alias("n"), F.first("b.n").alias("near_n"))
    both = F.array(F.struct("word", "n", "near", "near_n"), F.struct(
        F.col("near").alias("word"), F.col("near_n").alias("n"), F.col("word").alias("near"), F.col("n").alias("near_n")))
    return once.select(F.inline(both))


def roots(scratch: Scratch, forms: DataFrame) -> DataFrame:
    """word, root of every word that has a form. ``forms`` is a written table of word and form."""
    small = forms.count() <= MAX_BROADCAST
    known, k = forms.select("word", F.col("form").alias("root")), 0
    while True:
        ahead = known.select(F.col("word").alias("root"), F.col("root").alias("further"))
        ahead = F.broadcast(ahead) if small else ahead
        found = known.join(ahead, "root", "left").select(
            "word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved"))
        found = scratch.write(found, f"roots-{k}")
        if not found.where("moved").limit(1).count():
            return found.select("word", "root")
        known, k = found.select("word", "root"), k + 1


def variants(docs: DataFrame, ratio: int = RATIO) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word."""
    scratch = Scratch(docs.sparkSession, "spelling_variants")
    words = scratch.write(word_counts(docs), "words")
    signed = scratch.write(signatures(words, dealt_letters(words), words.count()), "signatures")
    pairs = near_pairs(signed)
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("form")))
    found = scratch.write(pairs.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"), F.first("n").alias("n")).select(
        "word", "n_near", F.when(-F.col("best.less") >= ratio * F.col("n"), F.struct(F.col("best.form").alias("form"), (-F.col("best.less")).alias("form_n"))).alias("to")), "near")
    scratch.drop("signatures")
    forms = scratch.write(found.where("to IS NOT NULL").select("word", "to.form"), "forms")
    out = words.join(found, "word", "left").join(roots(scratch, forms), "word", "left")
    return out.select("word", F.col("to.form").alias("form"), F.coalesce("root", "word").alias("root"), "n",
                      F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), F.col("to.form_n").alias("form_n"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(documents(spark, sf_dir))
