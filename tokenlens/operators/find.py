"""Exact token-sequence search over the corpus, deduplication and offset repair.

Hits schema: ``shard, sample_index, token_offset, seq_ord, sequence`` (+ optional context id
arrays). ``seq_ord`` is the position of a sequence in the caller's list; it replaces the order of
arrival of the original tool and decides which sequence survives deduplication.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint as _ckpt, ship_package
from ..functions.arrays import Ranks, context_slices
from ..plans.strategy import checked_broadcast
from .decode import WORDS, words_at, words_between
from .postings import NO_TOKEN, sample_runs

LOCATION = ["shard", "sample_index", "token_offset"]
# A scan searches samples of about so many tokens at a time, with so many candidates, and hands on so many hits.
SEARCH_TOKENS, CANDIDATES, HITS = 1 << 20, 1 << 20, 1 << 12


def check_sequences(sequences: DataFrame) -> DataFrame:
    """Reject empty sequences: an empty needle would match everywhere."""
    seq = F.when(F.size("seq") > 0, F.col("seq")).otherwise(
        F.raise_error(F.lit("empty token sequence in search input")).cast("array<int>")
    )
    return sequences.select(F.col("seq_ord").cast("long").alias("seq_ord"), seq.alias("seq"))


def choose_anchors(sequences: DataFrame, token_stats: DataFrame | None, n_tokens: int | None = None) -> DataFrame:
    """Pick, per sequence, the token to join the corpus on: its rarest token (fewest corpus
    occurrences, then the earliest). Anchoring on the rarest token keeps a hot token (a third
    of all positions) from multiplying candidate rows. A sequence holding a token the corpus
    never has cannot occur and is dropped here. Without statistics the first token is used.

    The exploded sequence tokens are the broadcast side (checked; ``n_tokens`` when known
    avoids a counting job) and the statistics are streamed past them: an inner join, so the
    statistics table is never shuffled."""
    seqs = check_sequences(sequences)
    base = seqs.select("seq_ord", "seq", F.size("seq").alias("n"))
    if token_stats is None:
        return base.select("*", F.lit(0).alias("anchor_idx"), F.col("seq")[0].alias("anchor_token"))
    toks = seqs.select("seq_ord", F.posexplode("seq").alias("i", "token_id"))
    if n_tokens is not None:
        toks, _ = checked_broadcast(toks, known_rows=n_tokens)
    # (without a known size, AQE turns this into a broadcast join at run time when the token
    # side measures small after its shuffle stage)
    freq = token_stats.select("token_id", F.col("n").alias("f")).join(toks, "token_id")
    best = freq.groupBy("seq_ord").agg(F.min(F.struct("f", "i")).alias("m"), F.count(F.lit(1)).alias("present"))
    return (
        base.join(best, "seq_ord")
        .where(F.col("present") == F.col("n"))
        .select("seq_ord", "seq", "n", F.col("m.i").alias("anchor_idx"))
        .withColumn("anchor_token", F.element_at("seq", F.col("anchor_idx") + 1))
    )


def prepare_needles(sequences: DataFrame, token_stats: DataFrame | None) -> tuple[DataFrame, int]:
    """Anchored needle table, checkpointed once into the shared folder, and its row count.

    The search input is small next to the corpus but is read several times (size check,
    broadcast); materializing it once keeps its derivation from running per use. The number of its tokens
    is counted, so that the statistics are streamed past them and not shuffled."""
    seqs = sequences.select("seq_ord", "seq").transform(_ckpt)
    n_tokens = seqs.agg(F.sum(F.greatest(F.size("seq"), F.lit(0)))).first()[0] or 0
    needles = choose_anchors(seqs, token_stats, n_tokens).transform(_ckpt)
    return needles, needles.count()


def equal_at(tokens: np.ndarray, places: np.ndarray, wanted: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Whether ``tokens`` from each place on equal ``wanted`` from each start on, for each length."""
    ok, left, k = np.ones(len(places), bool), np.arange(len(places)), 0
    while len(left):
        left = left[lengths[left] > k]
        same = tokens[places[left] + k] == wanted[starts[left] + k]
        ok[left[~same]] = False
        left, k = left[same], k + 1
    return ok


@dataclass
class Needles:
    """The needle table as arrays in the order of anchor tokens, for the workers."""
    ranks: Ranks            # of the distinct anchor tokens
    first: np.ndarray       # of each anchor's needles, and their number
    count: np.ndarray
    seq_ord: np.ndarray
    n: np.ndarray
    anchor_idx: np.ndarray
    tokens: np.ndarray      # of all sequences, and where each begins
    start: np.ndarray

    @classmethod
    def of(cls, needles: DataFrame) -> Needles:
        table = needles.select("seq_ord", "seq", "anchor_idx", "anchor_token").where("anchor_token IS NOT NULL").toArrow()
        table = table.take(pc.sort_indices(table["anchor_token"])).combine_chunks()
        n = table["seq"].combine_chunks() if isinstance(table["seq"], pa.ChunkedArray) else table["seq"]
        n = n if isinstance(n, pa.Array) else pa.concat_arrays(n.chunks)
        lengths = pc.list_value_length(n).to_numpy(zero_copy_only=False).astype(np.int64)
        anchors, first, count = np.unique(table["anchor_token"].to_numpy(), return_index=True, return_counts=True)
        return cls(Ranks(anchors), first, count, table["seq_ord"].to_numpy(), lengths, table["anchor_idx"].to_numpy().astype(np.int64),
                   pc.fill_null(pc.list_flatten(n), NO_TOKEN).to_numpy(zero_copy_only=False).astype(np.int32), np.cumsum(lengths) - lengths)

    def hits_in(self, tokens: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where in ``tokens`` (samples from ``begins`` to ``ends``) which needle occurs, in order of places
        and there of ``seq_ord``. Candidates are taken apart ``CANDIDATES`` at a time."""
        if not len(self.first) or not len(tokens):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        which = self.ranks.at(tokens)
        at = np.flatnonzero(which >= 0)
        which = which[at]
        row = np.searchsorted(ends, at, side="right")
        total = np.cumsum(self.count[which])
        found, start = [], 0
        while start < len(at):
            before = total[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(total, before + CANDIDATES, side="right")))
            some, times = which[start:stop], self.count[which[start:stop]]
            of = np.repeat(np.arange(start, stop), times)
            needle = np.arange(len(of)) - np.repeat(total[start:stop] - times - before, times) + np.repeat(self.first[some], times)
            place = at[of] - self.anchor_idx[needle]
            ok = (place >= begins[row[of]]) & (place + self.n[needle] <= ends[row[of]])
            place, needle = place[ok], needle[ok]
            same = equal_at(tokens, place, self.tokens, self.start[needle], self.n[needle])
            found.append((place[same], needle[same]))
            start = stop
        place, needle = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 2
        order = np.lexsort((self.seq_ord[needle], place))
        return place[order], needle[order]


def _slices(tokens: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> pa.ListArray:
    """``tokens[begin:end]`` for each pair."""
    n = ends - begins
    stops = np.cumsum(n)
    values = tokens[np.arange(stops[-1] if len(n) else 0) + np.repeat(begins - (stops - n), n)]
    return pa.ListArray.from_arrays(pa.array(np.append(0, stops).astype(np.int32)), pa.array(values, mask=values == NO_TOKEN))


def find_sequences_scan(corpus: DataFrame, needles: DataFrame, context_len: int = 0, n_needles: int | None = None,
                        mark_first: bool = False) -> DataFrame:
    """Strategy 1 (one pass over the corpus, no shuffle): the needles go to every worker as arrays, and
    a sample's positions meet them on the anchor token; candidates are confirmed token by token.
    A sample is never copied per position or hit, so memory follows ``SEARCH_TOKENS`` and ``HITS``.
    Context slices are cut while the sample is at hand. ``mark_first`` adds ``first_here``, false
    where another hit of that location has an earlier ``seq_ord``: all hits of a location are in one sample.
    A column ``words`` of the corpus (:func:`~tokenlens.operators.decode.with_words`) goes along: of
    each hit, those in its context."""
    _, ok = checked_broadcast(needles, known_rows=n_needles)
    if not ok:
        raise ValueError("needle table too large to broadcast; use strategy='postings'")
    shared = corpus.sparkSession.sparkContext.broadcast(Needles.of(needles))
    ship_package(corpus.sparkSession)
    columns = ["shard", "sample_index", "token_ids"]
    schema = "shard int, sample_index int, token_offset int, seq_ord bigint, sequence array<int>"
    if context_len > 0:
        schema += ", before_ids array<int>, match_ids array<int>, after_ids array<int>"
    if mark_first:
        schema += ", first_here boolean"
    with_words = context_len > 0 and "words" in corpus.columns
    if with_words:
        columns, schema = [*columns, "words"], schema + f", words {WORDS}"
    names = [f.split(" ")[0] for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            for part, n, tokens in sample_runs(batch, SEARCH_TOKENS):
                ends = np.cumsum(n)
                begins = ends - n
                places, needle_of = known.hits_in(tokens, begins, ends)
                rows = np.searchsorted(ends, places, side="right")
                located = words_at(part.column("words"), np.repeat(np.arange(len(n)), n), tokens) if with_words else None
                new = np.append(True, places[1:] != places[:-1]) if len(places) else np.zeros(0, bool)
                for k in range(0, len(places), HITS):
                    place, needle, row = places[k:k + HITS], needle_of[k:k + HITS], rows[k:k + HITS]
                    length, at = known.n[needle], pa.array(row)
                    first = known.start[needle]
                    out = [part.column("shard").take(at), part.column("sample_index").take(at), pa.array((place - begins[row]).astype(np.int32)),
                           pa.array(known.seq_ord[needle]), _slices(known.tokens, first, first + length)]
                    if context_len > 0:
                        left, right = np.maximum(place - context_len, begins[row]), np.minimum(place + length + context_len, ends[row])
                        out += [_slices(tokens, left, place), _slices(tokens, place, place + length), _slices(tokens, place + length, right)]
                    if mark_first:
                        out.append(pa.array(new[k:k + HITS]))
                    if with_words:
                        out.append(words_between(located, left, right))
                    yield pa.RecordBatch.from_arrays(out, names=names)

    return corpus.select(*columns).mapInArrow(run, schema)


def find_sequences_postings(corpus: DataFrame, postings: DataFrame, needles: DataFrame, context_len: int = 0,
                            pairs: DataFrame | None = None, n_needles: int | None = None) -> DataFrame:
    """Strategy 2 (indexed): candidate starts of a sequence come from the postings of a pair of
    neighbours that holds its rarest token, and a candidate is a hit when the postings of the
    sequence's other pairs have the right positions (positional intersection); sequences of one token
    read that token's postings. Every read skips the row groups of other tokens. The corpus itself is
    read only to cut contexts, and only past a broadcast of the hits' samples while those are few.

    The small sides (needles, candidates) are broadcast below the checked bound; beyond it the joins
    shuffle on the token pair or on (pair, sample), and AQE splits skewed partitions."""
    from .postings import in_ranges_of, pair_postings_of

    pairs = pair_postings_of(corpus) if pairs is None else pairs
    ones = needles.where("n = 1").select("seq_ord", "n", F.lit(0).alias("i"), F.col("anchor_token").alias("token_id"))
    parts = needles.where("n > 1").select("seq_ord", "n", "seq", F.least("anchor_idx", F.col("n") - 2).alias("first"),
                                          F.posexplode("seq").alias("i", "token_id")).where(F.col("i") < F.col("n") - 1)
    parts = parts.withColumn("next_id", F.get("seq", F.col("i") + 1)).drop("seq").transform(_ckpt)

    def starts_of(index: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
        wb, _ = checked_broadcast(wanted, known_rows=n_needles)   # a row per needle at most
        return (index.join(wb, keys)
                .select("shard", "sample_index", "seq_ord", "n", "i", F.explode("positions").alias("pos"))
                .select("shard", "sample_index", (F.col("pos") - F.col("i")).cast("int").alias("token_offset"), "seq_ord", "n")
                .where(F.col("token_offset") >= 0))

    pair = ["token_id", "next_id"]
    pairs = pairs.where(in_ranges_of(parts))
    single = starts_of(postings.where(in_ranges_of(ones)), ones, ["token_id"])
    starts = starts_of(pairs, parts.where(F.col("i") == F.col("first")).drop("first"), pair).transform(_ckpt)
    # pairs that overlap a checked one on both sides add nothing, but a sequence has few
    others = parts.where(F.col("i") != F.col("first")).drop("first", "n")
    ob, _ = checked_broadcast(others)
    wanted = starts.where("n > 2").join(ob, "seq_ord").transform(_ckpt)
    wb, _ = checked_broadcast(wanted)
    met = (
        pairs.join(wb, [*pair, "shard", "sample_index"])
        .where(F.array_contains("positions", F.col("token_offset") + F.col("i")))
        .groupBy("shard", "sample_index", "token_offset", "seq_ord").agg(F.count(F.lit(1)).alias("met"), F.first("n").alias("n"))
        .where(F.col("met") == F.col("n") - 2)
    )
    at = ["shard", "sample_index", "token_offset", "seq_ord"]
    hits = single.select(*at).unionByName(starts.where("n = 2").select(*at)).unionByName(met.select(*at))
    nd, _ = checked_broadcast(needles.select("seq_ord", F.col("seq").alias("sequence"), "n"), known_rows=n_needles)
    hits = hits.join(nd, "seq_ord")
    if context_len <= 0:
        return hits.select(*at, "sequence")
    hb, _ = checked_broadcast(hits.transform(_ckpt))
    b, m, a = context_slices(F.col("token_ids"), F.col("token_offset"), F.col("n"), context_len)
    return corpus.select("shard", "sample_index", "token_ids").join(hb, ["shard", "sample_index"]).select(
        *at, "sequence", b.alias("before_ids"), m.alias("match_ids"), a.alias("after_ids"))


def find_sequences(corpus: DataFrame, sequences: DataFrame, token_stats: DataFrame | None = None,
                   postings: DataFrame | None = None, strategy: str = "auto", context_len: int = 0,
                   pairs: DataFrame | None = None, mark_first: bool = False) -> DataFrame:
    """All exact, contiguous occurrences (overlaps included) of every sequence: J5/J6 before dedup.

    ``sequences``: ``(seq_ord BIGINT, seq ARRAY<INT>)``. ``strategy``: ``scan`` (broadcast needles,
    one corpus pass), ``postings`` (index join), or ``auto`` (scan when the needle table passes the
    broadcast check, else postings). ``mark_first``: the scan adds ``first_here``, with which
    :func:`dedup_hits` needs no shuffle."""
    needles, n_needles = prepare_needles(sequences, token_stats)
    return search_prepared(corpus, needles, n_needles, postings, strategy, context_len, pairs, mark_first)


def search_prepared(corpus: DataFrame, needles: DataFrame, n_needles: int, postings: DataFrame | None = None,
                    strategy: str = "auto", context_len: int = 0, pairs: DataFrame | None = None, mark_first: bool = False) -> DataFrame:
    """The search for needles that :func:`prepare_needles` made, by either strategy."""
    if strategy == "auto":
        _, small = checked_broadcast(needles, known_rows=n_needles)
        strategy = "scan" if small else "postings"
    if strategy == "scan":
        return find_sequences_scan(corpus, needles, context_len, n_needles, mark_first)
    if postings is None:       # too many needles to broadcast and no index given: index now
        from .postings import postings_of
        postings = postings_of(corpus)
    return find_sequences_postings(corpus, postings, needles, context_len, pairs, n_needles)


def dedup_hits(hits: DataFrame) -> DataFrame:
    """First hit per location over all sequences, the earliest ``seq_ord`` winning.

    Implemented as an aggregation rather than ``row_number``: all hits of one location come from
    the same sample and so from the same scan task, where partial aggregation already collapses
    them; only one row per location crosses the shuffle. Hits that say ``first_here`` are only filtered."""
    if "first_here" in hits.columns:
        return hits.where("first_here").drop("first_here")
    rest = ["seq_ord", *[c for c in hits.columns if c not in (*LOCATION, "seq_ord")]]   # compared in this order
    picked = hits.groupBy(*LOCATION).agg(F.min(F.struct(*rest)).alias("_w"))
    return picked.select(*LOCATION, *[F.col(f"_w.{c}").alias(c) for c in rest])


def first_occurrence(hits: DataFrame) -> DataFrame:
    """One row per (sequence, sample): the first offset there and how many times it occurs."""
    return hits.groupBy("seq_ord", "shard", "sample_index").agg(
        F.min("token_offset").alias("first_offset"), F.count(F.lit(1)).alias("n_occurrences")
    )


def sequence_counts(hits: DataFrame) -> DataFrame:
    """Hits and distinct samples per sequence."""
    per_sample = hits.groupBy("seq_ord", "shard", "sample_index").agg(F.count(F.lit(1)).alias("c"))
    return per_sample.groupBy("seq_ord").agg(F.sum("c").alias("n_hits"), F.count(F.lit(1)).alias("n_samples"))


def repair_offsets(reported: DataFrame, corpus: DataFrame) -> DataFrame:
    """Offset repair (P13): keep the reported offset when the sequence is there, else the one
    before it, else the first occurrence in the sample; drop the hit when the sample lacks the
    sequence. Then one hit per (sequence, location), as the original did per sequence.

    ``reported``: ``shard, sample_index, reported_offset, seq_ord, sequence``. A report concerns one sample, and so
    do all reports of a repaired location: samples and reports meet in one shuffle by sample, where both checks, the
    search and the deduplication run on arrays (:func:`repaired`). Nothing else is written; a task holds the
    reports of a few samples at a time. A report
    without an offset is searched; an empty sequence is found nowhere."""
    place, report = ["shard", "sample_index"], "struct<reported_offset:int,seq_ord:bigint,sequence:array<int>>"
    ship_package(corpus.sparkSession)
    reports = reported.where(F.col("shard").isNotNull() & F.col("sample_index").isNotNull()).select(
        *place, F.lit(None).cast("array<int>").alias("token_ids"), F.struct("reported_offset", "seq_ord", "sequence").cast(report).alias("report"))
    rows = corpus.select(*place, "token_ids", F.lit(None).cast(report).alias("report")).unionByName(reports)
    met = rows.repartition(*place).groupBy(*place).agg(F.first("token_ids", ignorenulls=True).alias("token_ids"), F.collect_list("report").alias("reports"))
    names = ["seq_ord", *place, "token_offset", "sequence", "reported_offset"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, n, tokens in sample_runs(batch, SEARCH_TOKENS):
                reports = pc.list_flatten(part.column("reports"))
                row = np.repeat(np.arange(len(n)), pc.list_value_length(part.column("reports")).to_numpy(zero_copy_only=False))
                reported, seq_ord, sequence = (pc.struct_field(reports, k) for k in ("reported_offset", "seq_ord", "sequence"))
                length = pc.fill_null(pc.list_value_length(sequence), -1).to_numpy(zero_copy_only=False).astype(np.int64)
                known = np.maximum(length, 0)
                offset = repaired(tokens, n, row, pc.fill_null(reported, NO_TOKEN).to_numpy(zero_copy_only=False).astype(np.int64),
                                  pc.fill_null(pc.list_flatten(sequence), NO_TOKEN).to_numpy(zero_copy_only=False), np.cumsum(known) - known, length)
                # the smallest reported offset of each (sequence, location), those without one last
                first = pc.fill_null(reported, np.iinfo(np.int32).max).to_numpy(zero_copy_only=False)
                ords = seq_ord.to_numpy(zero_copy_only=False)
                order = np.lexsort((first, offset, ords, row))
                order = order[offset[order] >= 0]
                key = np.stack([row[order], ords[order], offset[order]])
                at = order[np.append(True, (key[:, 1:] != key[:, :-1]).any(axis=0))] if len(order) else order
                some, of = pa.array(at), pa.array(row[at])
                yield pa.RecordBatch.from_arrays([seq_ord.take(some), part.column("shard").take(of), part.column("sample_index").take(of),
                                                  pa.array(offset[at].astype(np.int32)), sequence.take(some), reported.take(some)], names=names)

    return met.where(F.col("token_ids").isNotNull() & (F.size("reports") > 0)).mapInArrow(
        run, "seq_ord bigint, shard int, sample_index int, token_offset int, sequence array<int>, reported_offset int")


def repaired(tokens: np.ndarray, n: np.ndarray, row: np.ndarray, reported: np.ndarray, wanted: np.ndarray, start: np.ndarray,
             length: np.ndarray) -> np.ndarray:
    """The repaired offset, -1 for none, of each report (sample ``row``, offset or NO_TOKEN, sequence of ``length`` from
    ``start`` in ``wanted``) in samples of ``n`` tokens. A sequence is searched from the occurrences of its token that
    is rarest in the sample, ``CANDIDATES`` at a time."""
    begins, out = np.cumsum(n) - n, np.full(len(row), -1, np.int64)

    def there(some: np.ndarray, offset: np.ndarray) -> np.ndarray:
        inside = (offset >= 0) & (length[some] >= 0) & ((offset + length[some] <= n[row[some]]) | (length[some] == 0))
        here = some[inside]
        inside[inside] = equal_at(tokens, begins[row[here]] + offset[inside], wanted, start[here], length[here])
        return inside

    every = np.arange(len(row))
    for back in (0, 1):
        left = every[(out < 0) & (reported >= back)]
        ok = there(left, reported[left] - back)
        out[left[ok]] = reported[left[ok]] - back
    left = every[(out < 0) & (length > 0)]
    left = left[wanted[start[left]] != NO_TOKEN] if len(left) else left
    if not len(left) or not len(tokens):
        return out
    key = np.repeat(np.arange(len(n)), n) << 32 | (tokens.astype(np.int64) & 0xFFFFFFFF)
    order = np.argsort(key, kind="stable")
    key = key[order]
    # occurrences of each token of each sequence in its sample: the fewest of them are the candidates
    of = np.repeat(np.arange(len(left)), length[left])
    i = np.arange(len(of)) - np.repeat(np.cumsum(length[left]) - length[left], length[left])
    token = row[left][of] << 32 | (wanted[start[left][of] + i].astype(np.int64) & 0xFFFFFFFF)
    low = np.searchsorted(key, token)
    times = np.searchsorted(key, token, side="right") - low
    rarest = np.lexsort((times, of))
    rarest = rarest[np.append(True, of[rarest][1:] != of[rarest][:-1])]
    low, times, i = low[rarest], times[rarest], i[rarest]
    total, begin = np.cumsum(times), 0
    first = np.full(len(left), np.iinfo(np.int64).max)
    while begin < len(left):
        before = total[begin - 1] if begin else 0
        stop = max(begin + 1, int(np.searchsorted(total, before + CANDIDATES, side="right")))
        some = np.repeat(np.arange(begin, stop), times[begin:stop])
        at = order[low[some] + np.arange(len(some)) - (total[some] - times[some] - before)]
        offset = at - begins[row[left[some]]] - i[some]
        ok = there(left[some], offset)
        np.minimum.at(first, some[ok], offset[ok])
        begin = stop
    found = first < np.iinfo(np.int64).max
    out[left[found]] = first[found]
    return out
