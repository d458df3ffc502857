"""Operator 13: alignment of two tokenizers over the same texts, by their tokens' spans.

Tokenizer A is a byte-level BPE of ``tokenizers``, B a sentencepiece model with byte fallback; both
read space + text (B adds the space itself). The spans that the libraries report are coarse cuts:
A's are in characters, so tokens that share a multi-byte character report the same one, and B's
byte-fallback pieces report an empty span but for the last. Such tokens are cut by the number of
their decoded bytes, and every token's bytes are compared with the text's bytes in its span. (The
installed sentencepiece calls its span-carrying result ``proto``; the older ``immutable_proto`` is
refused there.) Byte offsets where tokens of both end cut the tokens into groups; tokens of A and B
whose byte ranges overlap are linked.

Neither tokenizer has a token that goes on over a hard cut (from a character other than white space to
a space or line feed, from a Latin letter to an ASCII mark), so a text is a sequence of chunks that
align on their own; B's pieces are checked for this when the model is loaded, and where that doesn't
hold, or a chunk doesn't begin as expected, the whole text is one chunk. A worker aligns each different chunk once and keeps it,
``KEEP`` chunks at most.

1. One scan writes per document its counts, digest, and its distinct pairs of ids with the number of
   links of each.
2. The documents that hold a pair are counted by an aggregation with partial sums in the tasks.
3. Each document's pairs look up their counts and add up. The table of pairs is broadcast if it has
   at most ``MAX_BROADCAST`` rows (counted first), and joined by shuffle beyond, where the pairs that
   very many documents hold (at most 1 / HOT_SHARE of them) are joined apart by broadcast.

A document is a row: rows that repeat a doc_id count each, null ids included. Null and empty texts
have no tokens: all counts 0 and an empty digest column; so do texts whose joined tokens of A or B
are not space + text (e.g. those with U+2581). Bytes that are not UTF-8 read as U+FFFD. Very long
texts are one row of arrays. Only ``doc_id`` and ``text`` are read; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import os
import re
from array import array
from collections.abc import Iterator
from itertools import accumulate
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, attach, documents
from .textgrams import blocks

KEEP = 400_000
TOGETHER = 2000
MAX_BROADCAST = 4_000_000
SHIFT = 32
LATIN = "A-Za-zÀ-ÖØ-öø-ɏ"
MARKS = r"!-/:-@\[-`{-~"
#: Hard cuts: before a space or line feed that follows another character than white space, and between a
#: Latin letter and an ASCII mark. A's words never go on over them, and none of B's pieces may.
CUT = re.compile(rf"(?<=\S)(?=[ \n])|(?<=[{LATIN}])(?=[{MARKS}])")
NO_PIECE = re.compile(rf"[^▁]▁|[{LATIN}][{MARKS}]")
ALIGNED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, links array<int>"


def byte_alphabet() -> dict[str, int]:
    """The characters by which byte-level BPE writes bytes: printable Latin-1 characters stand for
    themselves, the other bytes in order for the characters from U+0100 on."""
    own = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b <= 0xFF]
    others = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(others)}


def same_spans(tokens: list[bytes], ends: list[int], raw: bytes) -> bool:
    """Whether the tokens' bytes are the text and end where ``ends`` says."""
    return b"".join(tokens) == raw and list(accumulate(map(len, tokens))) == ends


class Aligned(NamedTuple):
    """One chunk: token counts, the groups' text (with a semicolon after each), and the pair of ids of
    every link."""

    n_a: int
    n_b: int
    n_groups: int
    text: str
    pairs: bytes  # packed, so that a large cache has no objects for the garbage collector to visit


class Tokens(NamedTuple):
    """One tokenizer's tokens of many chunks: chunk of each, id, number of bytes, byte end in its chunk."""

    chunk: np.ndarray
    ids: np.ndarray
    size: np.ndarray
    end: np.ndarray

    def only(self, good: np.ndarray) -> Tokens:
        on = good[self.chunk]
        return Tokens(*(x[on] for x in self))


def decoded(chunk: np.ndarray, ids: np.ndarray, size: np.ndarray, n: int) -> Tokens:
    """Ends by the tokens' own bytes."""
    total = np.concatenate([[0], np.cumsum(size)])
    return Tokens(chunk, ids, size, total[1:] - total[np.searchsorted(chunk, np.arange(n))][chunk])


def aligned_together(a: Tokens, b: Tokens, starts: np.ndarray, names: tuple[np.ndarray, ...]) -> list[Aligned]:
    """All chunks at once; ``starts`` are the chunks' places one after the other, ``names`` the ids as
    text with the separators that may follow."""
    n, a_end, b_end = len(starts), a.end + starts[a.chunk], b.end + starts[b.chunk]
    first, last = np.searchsorted(b_end, a_end - a.size, "right"), np.searchsorted(b_end, a_end)  # of the tokens of B under each of A
    width = last - first + 1
    of_a = np.repeat(np.arange(len(width)), width)
    of_b = np.arange(len(of_a)) - np.repeat(np.cumsum(width) - width - first, width)
    pairs = ((a.ids[of_a] << SHIFT) | b.ids[of_b]).tobytes()
    pair_cuts = (8 * np.searchsorted(a.chunk[of_a], np.arange(n + 1))).tolist()
    a_last, b_last = b_end[last] == a_end, a_end[np.searchsorted(a_end, b_end)] == b_end
    group = np.concatenate([2 * (np.cumsum(a_last) - a_last), 2 * (np.cumsum(b_last) - b_last) + 1])
    order = np.argsort(group, kind="stable")
    text = np.concatenate([np.where(a_last, names[1][a.ids], names[0][a.ids]), np.where(b_last, names[2][b.ids], names[0][b.ids])])[order].tolist()
    cuts = np.searchsorted(np.concatenate([a.chunk, b.chunk])[order], np.arange(n + 1)).tolist()
    counts = [np.bincount(x, minlength=n).tolist() for x in (a.chunk, b.chunk, a.chunk[a_last])]
    return [Aligned(n_a, n_b, n_groups, "".join(text[x:y]), pairs[p:q]) for n_a, n_b, n_groups, x, y, p, q
            in zip(*counts, cuts, cuts[1:], pair_cuts, pair_cuts[1:])]


def aligned(a_ids: list[int], a_ends: list[int], b_ids: list[int], b_ends: list[int]) -> Aligned:
    if a_ends == b_ends:  # token by token
        return Aligned(len(a_ids), len(b_ids), len(a_ids), "".join([f"{a}|{b};" for a, b in zip(a_ids, b_ids)]),
                       array("q", [(a << SHIFT) | b for a, b in zip(a_ids, b_ids)]).tobytes())
    n_a, n_b, groups, pairs = len(a_ids), len(b_ids), [], []
    i = j = first_a = first_b = 0
    while i < n_a:
        pairs.append((a_ids[i] << SHIFT) | b_ids[j])
        end_a, end_b = a_ends[i], b_ends[j]
        if end_a == end_b:
            i, j = i + 1, j + 1
            groups.append(f"{','.join(map(str, a_ids[first_a:i]))}|{','.join(map(str, b_ids[first_b:j]))};")
            first_a, first_b = i, j
        elif end_a < end_b:
            i += 1
        else:
            j += 1
    return Aligned(n_a, n_b, len(groups), "".join(groups), array("q", pairs).tobytes())


class Aligner:
    def __init__(self, a_path: str, b_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer
        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        alphabet = byte_alphabet()
        self.a_bytes = {i: bytes(alphabet[c] for c in t) for t, i in self.a.get_vocab(with_added_tokens=False).items()}
        self.b = SentencePieceProcessor(model_file=b_path)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_is_byte = [self.b.is_byte(i) for i in range(len(pieces))]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if own else p.replace("▁", " ").encode()
                        for p, own in zip(pieces, self.b_is_byte)]
        #: a line feed is a token of its own, and no piece goes on over a hard cut
        plain = [p for i, p in enumerate(pieces) if not (self.b_is_byte[i] or self.b.is_unknown(i) or self.b.is_control(i))]
        self.chunked = not any("\n" in p or NO_PIECE.search(p) for p in plain)
        self.a_size, self.b_size = np.zeros(max(self.a_bytes) + 1, np.int64), np.array([len(x) for x in self.b_bytes])
        self.a_size[list(self.a_bytes)] = [len(x) for x in self.a_bytes.values()]
        self.a_table = [self.a_bytes.get(i, b"") for i in range(len(self.a_size))]
        self.b_byte = np.array(self.b_is_byte)
        self.names = tuple(np.array([f"{i}{after}" for i in range(max(len(self.a_size), len(pieces)))], object) for after in ",|;")
        self.kept: dict[str, Aligned | None] = {}

    def a_ends(self, ids: list[int], offsets: list[tuple[int, int]], text: str, raw: bytes) -> list[int] | None:
        """Byte ends of A's tokens, None where the tokens are not the text."""
        ends = [end for _, end in offsets]
        own = [self.a_bytes.get(i, b"") for i in ids]
        if len(raw) != len(text):
            at = [0, *accumulate(1 + (c > "\x7f") + (c > "\u07ff") + (c > "\uffff") for c in text)]
            before, last = 0, len(ids) - 1
            for k, end in enumerate(ends):
                # if the next token has a part of this one's last character, this one ends inside it
                before = before + len(own[k]) if k < last and offsets[k + 1][0] < end else at[end]
                ends[k] = before
        return ends if same_spans(own, ends, raw) else None

    def b_ends(self, ids: list[int], ends: list[int], raw: bytes) -> list[int] | None:
        """Byte ends of B's tokens, likewise. Fallback bytes but the last of a character have no span."""
        own = [self.b_bytes[i] for i in ids]
        if raw.isascii():
            return ends if same_spans(own, ends, raw) else None
        before, out = 0, []
        for token, end in zip(ids, ends):
            before = before + 1 if self.b_is_byte[token] else end
            out.append(before)
        return out if same_spans(own, out, raw) else None

    def align(self, chunks: list[str]) -> list[Aligned | None]:
        """Chunks between hard cuts, many at a time; None where one has no tokens or has to be read in
        its text."""
        out: list[Aligned | None] = []
        for k in range(0, len(chunks), TOGETHER):
            out += self._align(chunks[k:k + TOGETHER])
        return out

    def _align(self, chunks: list[str]) -> list[Aligned | None]:
        n, raws = len(chunks), [c.encode() for c in chunks]
        raw, sizes = b"".join(raws), np.array([len(x) for x in raws])
        starts = np.cumsum(sizes) - sizes

        got = self.a.encode_batch([chunks], is_pretokenized=True, add_special_tokens=False)[0]
        ids, chunk = np.array(got.ids, np.int64), np.array(got.word_ids, np.int64)
        a = decoded(chunk, ids, self.a_size[ids], n)
        spans = np.array(got.offsets, np.int64).reshape(-1, 2)  # in the characters of each chunk
        at = np.append(np.flatnonzero((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80), len(raw))  # byte of every character
        coarse = at[np.searchsorted(at, starts)[chunk] + spans[:, 1]] - starts[chunk]
        # where the next token has a part of this one's last character, this one ends inside it
        inside = np.append((chunk[1:] == chunk[:-1]) & (spans[1:, 0] < spans[:-1, 1]), False)
        good = np.bincount(chunk[~inside & (coarse != a.end)], minlength=n) == 0

        # a line feed before each chunk keeps it apart from the others and from B's own space
        pieces = [(p.id, p.end) for p in self.b.encode_as_proto("\n" + "\n".join(chunks)).pieces]
        ids, ends = np.array(pieces, np.int64).T
        begin = starts + np.arange(1, n + 1)
        feeds = np.searchsorted(ends, begin)
        counts = np.diff(np.append(feeds, len(ids))) - 1
        own = np.ones(len(ids), bool)
        own[:feeds[0] + 1], own[feeds] = False, False
        ids, ends, chunk = ids[own], ends[own], np.repeat(np.arange(n), counts)
        b = decoded(chunk, ids, self.b_size[ids], n)
        # a character's fallback bytes but the last have no span
        good &= np.bincount(chunk[~self.b_byte[ids] & (ends - begin[chunk] != b.end)], minlength=n) == 0

        for tokens, table in ((a, self.a_table), (b, self.b_bytes)):
            parts = [table[i] for i in tokens.ids.tolist()]
            if b"".join(parts) != raw or good.sum() < n:
                cuts = np.searchsorted(tokens.chunk, np.arange(n + 1)).tolist()
                good &= [b"".join(parts[x:y]) == r for x, y, r in zip(cuts, cuts[1:], raws)]
        if not good.any():
            return [None] * n
        found = aligned_together(a.only(good), b.only(good), starts, self.names)
        return [x if ok else None for x, ok in zip(found, good.tolist())]

    def whole(self, text: str) -> Aligned | None:
        """Of a text that is not cut into chunks: B adds its space itself."""
        raw = (" " + text).encode()
        pieces = self.b.encode(text, return_type="proto").pieces
        # B's spans are of the text without the space
        b_ends = self.b_ends([p.id for p in pieces], [p.end + 1 for p in pieces], raw)
        a = self.a.encode(" " + text, add_special_tokens=False)
        a_ends = self.a_ends(a.ids, a.offsets, " " + text, raw)
        return aligned(a.ids, a_ends, [p.id for p in pieces], b_ends) if a_ends is not None and b_ends is not None else None

    def documents(self, texts: list[str]) -> list[list[Aligned] | None]:
        """The chunks of each text in order; None where it has no tokens."""
        if not self.chunked:
            return [[x] if t and (x := self.whole(t)) else None for t in texts]
        split = [CUT.split(" " + t) if t else [] for t in texts]
        wanted = set().union(*split)
        if len(self.kept) + len(wanted) > KEEP:
            self.kept = {c: x for c in wanted if (x := self.kept.get(c)) is not None}
        new = list(wanted.difference(self.kept))
        self.kept.update(zip(new, self.align(new)))
        known, out = self.kept.__getitem__, []
        for text, chunks in zip(texts, split):
            found = list(map(known, chunks))
            if None in found:
                one = self.whole(text)
                found = [one] if one else []
            out.append(found or None)
        return out


_aligners: dict[tuple[str, str], Aligner] = {}


def aligner(a_path: str, b_path: str) -> Aligner:
    """One per Python worker, kept for its later tasks."""
    if (a_path, b_path) not in _aligners:
        _aligners[a_path, b_path] = Aligner(a_path, b_path)
    return _aligners[a_path, b_path]


def _row(chunks: list[Aligned] | None) -> tuple:
    if not chunks:
        return 0, 0, 0, 0, "", [], []
    n_a, n_b, n_groups, texts, packed = zip(*chunks)
    keys = np.frombuffer(b"".join(packed), np.int64)
    pairs, links = np.unique(keys, return_counts=True)
    digest = hashlib.sha256("".join(texts)[:-1].encode()).hexdigest()
    return sum(n_a), sum(n_b), sum(n_groups), len(keys), digest, pairs, links.astype(np.int32)


def _lists(values: list, kind: pa.DataType, dtype) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(v) for v in values])]).astype(np.int32)
    flat = np.concatenate([np.asarray(v, dtype) for v in values]) if values else np.zeros(0, dtype)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, kind))


def tokenizer_paths() -> tuple[str, str]:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def aligned_documents(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """Per row: counts, digest, distinct ``pairs`` (A's id shifted by 32 bits, plus B's id) and the
    number of ``links`` of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = aligner(a_path, b_path)
        for batch in batches:
            for block in blocks(batch.column(1)):
                data, at = block.data.tobytes(), block.offsets.tolist()
                texts = [data[x:y].decode("utf-8", "replace") for x, y in zip(at, at[1:])]
                rows = [_row(x) for x in own.documents(texts)]
                if not rows:
                    continue
                n_a, n_b, n_groups, n_links, digest, pairs, links = zip(*rows)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(block.first, len(rows)), *(pa.array(c, pa.int64()) for c in (n_a, n_b, n_groups, n_links)),
                     pa.array(digest, pa.string()), _lists(pairs, pa.int64(), np.int64), _lists(links, pa.int32(), np.int32)],
                    names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "links"])

    text = F.make_valid_utf8(F.col("text").cast("string"))
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text.alias("text")).mapInArrow(run, ALIGNED)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """pair and count, the number of documents that hold it."""
    return aligned.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("count"))


def with_best(counts: DataFrame) -> DataFrame:
    """Adds ``best``: the count is the highest of its A id. There are no more A ids than A has tokens,
    so their maxima are broadcast."""
    a = F.shiftright("pair", SHIFT).alias("a")
    top = counts.groupBy(a).agg(F.max("count").alias("top"))
    return counts.withColumn("a", a).join(F.broadcast(top), "a").select("pair", "count", (F.col("count") == F.col("top")).alias("best"))


def align(docs: DataFrame, a_path: str, b_path: str, max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every row."""
    scratch = Scratch(docs.sparkSession, "token_alignment")
    # the number of a row is made as it is written, and read from there alone
    rows = scratch.write(aligned_documents(docs, a_path, b_path).withColumn("row", F.monotonically_increasing_id()), "aligned")
    counts = scratch.write(pair_counts(rows), "counts")
    pairs = with_best(counts)
    held = rows.select("row", F.explode(F.arrays_zip("pairs", "links")).alias("x")).select(
        "row", F.col("x.pairs").alias("pair"), F.col("x.links").alias("links"))
    size, total = counts.agg(F.count(F.lit(1)), F.coalesce(F.sum("count"), F.lit(0))).first()
    found = held.join(F.broadcast(pairs), "pair") if size <= max_broadcast else attach(held, pairs, ["pair"], "count", total)
    sums = found.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("links")).otherwise(0)).alias("n_best"),
                                    F.sum(F.col("links") * F.col("count")).alias("count_sum"))
    zero = lambda c: F.coalesce(F.col(c).cast("bigint"), F.lit(0).cast("bigint")).alias(c)
    return rows.drop("pairs", "links").join(sums, "row", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256")


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(documents(spark, sf_dir), *tokenizer_paths())
