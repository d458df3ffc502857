"""Text query -> covering token sequences -> hits with context, many queries at once.

One plan serves a whole table of queries (``qid, target``): candidate generation is a set of
joins against the vocabulary, distinct candidate sequences are searched in one corpus pass,
hits are deduplicated per (query, location), context is decoded and tested against the query's
regex, and the result is ordered by (query, shard, sample)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint as _ckpt
from ..functions.ranking import dense_ids
from ..functions.pyregex import py_boundary_pattern, py_regex_search
from ..operators import context as ctx_ops
from ..operators import cover
from ..operators import find as find_ops
from ..plans.strategy import checked_broadcast
from ..sources.wordcorpus import TokenCorpus, WordCorpus, split_words
from .needles import CHUNK, chunk_spec, numbered_chunks


def passage_targets(passages: DataFrame, lengths=(4, 2), id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """Query strings cut from every passage: consecutive chunks of ``k`` words for each k, whole
    passages covered. ``qid`` follows the same numbering as ``passage_sequences``."""
    occ = passages.select(F.col(id_col).alias("item_id"), F.posexplode(split_words(text_col)).alias("pos", "word"))
    spec = chunk_spec(lengths)
    ch = occ.select("*", F.explode(spec).alias("L")).select(
        "item_id", "pos", "word", F.col("L.r").alias("r"), F.floor(F.col("pos") / F.col("L.k")).alias("chunk"))
    g = ch.groupBy(*CHUNK).agg(F.array_sort(F.collect_list(F.struct("pos", "word"))).alias("p"))
    g = g.join(numbered_chunks(occ, lengths), CHUNK)
    return g.select(F.col("ord").alias("qid"),
                    F.array_join(F.transform("p", lambda x: x["word"]), " ").alias("target"))


def query_pattern(regex: str | None, literal: bool):
    """The pattern of a text search, for covers and contexts alike, in Python's dialect: the
    caller's, or word boundaries around the query (``literal`` takes the query as it stands)."""
    return F.lit(regex) if regex is not None else py_boundary_pattern(F.col("target"), literal)


def word_targets(queries: DataFrame) -> DataFrame:
    """Word vocabulary: the surface of a query is the query itself; its own encoding has one
    token per space-separated word, so ``max_depth`` = words + 3."""
    return queries.select("qid", "target", F.col("target").alias("surface"),
                          (F.size(split_words("target")) + 3).alias("max_depth"))


def roundtrip_words(cands: DataFrame, joiner: str = " ") -> DataFrame:
    """P11 for a joiner vocabulary: re-splitting the joined text gives the same tokens back
    (fails only for tokens that contain the joiner). A row expression on the carried tokens."""
    ok = F.split(F.array_join("toks", joiner), joiner, -1) == F.col("toks")
    return cands.where(ok)


def word_encoder(vocab: DataFrame, joiner: str = " "):
    """Encoder of a joiner vocabulary: split on the joiner, look each word up; a text with a word
    outside the vocabulary has no encoding (empty ids)."""
    def enc(df: DataFrame) -> DataFrame:
        w = df.select("qid", "d", F.posexplode(F.split("d", joiner, -1)).alias("pos", "word"))
        v, _ = checked_broadcast(vocab.select(F.col("token").alias("word"), "token_id"))
        g = w.join(v, "word", "left").groupBy("qid", "d").agg(
            F.array_sort(F.collect_list(F.struct("pos", "token_id", "word"))).alias("p"),
            F.count(F.lit(1)).alias("n"), F.count("token_id").alias("k"))
        ids = F.when(F.col("n") == F.col("k"), F.transform("p", lambda x: x["token_id"])).otherwise(
            F.array().cast("array<int>"))
        return g.select("qid", "d", ids.alias("ids"), F.transform("p", lambda x: x["word"]).alias("tokens"))
    return enc


def minimal_covers(tc: TokenCorpus, targets: DataFrame, regex: str | None = None, literal: bool = False,
                   merges: DataFrame | None = None, with_text: bool = False, plan: str = "enumerate") -> DataFrame:
    """Minimal covers ``(qid, seq)`` of every query.

    ``plan="enumerate"`` (default for word tokens, whose tails are unique: nothing to save)
    generates every candidate and filters; ``plan="canonical"`` (``operators/canonical.py``)
    tests one text per (query, first token, split) and verifies its encoding -- the better plan
    when many segmentations share a text, as with byte-level BPE. Both give the same set."""
    if plan == "enumerate":
        return minimal_covers_enumerated(tc, targets, regex, literal, merges, with_text)
    from ..operators.canonical import canonical_minimal_covers

    def rx(df):
        return df.where(py_regex_search(F.col("d"), query_pattern(regex, literal)))

    sfx = affix_table(tc, "suffix")
    out = canonical_minimal_covers(targets, tc.vocab, merges, tc.joiner, False, word_encoder(tc.vocab, tc.joiner), rx, sfx)
    cols = ["qid", "seq", "toks", "decoded"] if with_text else ["qid", "seq"]
    return out.select(*cols).transform(_ckpt)


def minimal_covers_enumerated(tc: TokenCorpus, targets: DataFrame, regex: str | None = None, literal: bool = False,
                              merges: DataFrame | None = None, with_text: bool = False) -> DataFrame:
    """Candidates -> dedup -> round trip -> regex -> minimality: ``(qid, seq)``. The filters
    are row expressions on the token strings each candidate carries: no further joins."""
    sfx = affix_table(tc, "suffix")
    cands = cover.cover_candidates(targets, tc.vocab, merges, tc.joiner, sfx=sfx)
    cands = roundtrip_words(cands, tc.joiner)
    dec = cover.decode_sequences(cands, tc.joiner, byte_level=False)
    tb, _ = checked_broadcast(targets.select("qid", "target"))
    j = dec.join(tb, "qid")
    passed = j.where(py_regex_search(F.col("decoded"), query_pattern(regex, literal)))   # compiled once per worker
    mini = passed.where(cover.is_minimal(F.col("toks"), F.col("bts"), F.col("target"), tc.joiner, False))
    cols = ["qid", "seq", "toks", "decoded"] if with_text else ["qid", "seq"]
    return mini.select(*cols).transform(_ckpt)


def affix_table(tc: TokenCorpus, kind: str) -> DataFrame:
    """K5: suffix/prefix index of the vocabulary, written once next to it (the folder is keyed by
    the corpus fingerprint, so another vocabulary never reuses it)."""
    from ..session import materialize
    fn = cover.suffix_index if kind == "suffix" else cover.prefix_index
    return materialize(fn(tc.vocab), f"{tc.root}/{kind}_index_v2")


def sequence_owners(covers: DataFrame, sequences: DataFrame) -> DataFrame:
    """``(qid, seq_ord)``: whose hits a sequence's (``k, seq_ord``) are. Of a query's sequences at one location
    the shortest wins; they begin alike there, so a sequence that begins with another one of its query
    has no hit of its own, and what is left never shares a location: hits need no deduplication."""
    own = covers.select("qid", "seq").distinct()
    heads = own.where(F.size("seq") > 1).select("qid", F.col("seq").alias("whole"), F.explode(F.sequence(F.lit(1), F.size("seq") - 1)).alias("n"))
    beaten = heads.select("qid", F.slice("whole", F.lit(1), F.col("n")).alias("seq"), "whole").join(own, ["qid", "seq"]).select("qid", F.col("whole").alias("seq"))
    left = own.join(beaten, ["qid", "seq"], "left_anti")
    return left.select("qid", F.array_join("seq", ",").alias("k")).join(sequences.select("k", "seq_ord"), "k").drop("k").transform(_ckpt)


def search_text(tc: WordCorpus, targets: DataFrame, context_len: int = 50, regex: str | None = None,
                literal: bool = False, merges: DataFrame | None = None) -> DataFrame:
    """Hits of every query: ``qid, shard, sample_index, token_offset, sequence, context_ok,
    before, match, after`` (context null where the regex fails; ``context_len = 0`` skips it)."""
    targets = targets.transform(_ckpt)
    covers = minimal_covers(tc, targets, regex, literal, merges)
    # Each distinct sequence is searched once, whatever number of queries produced it.
    distinct = covers.select(F.array_join(F.col("seq"), ",").alias("k"), "seq").distinct()
    ided = dense_ids(distinct, "k", "sid").select(F.col("sid").cast("long").alias("seq_ord"), "seq", "k")
    corpus, vocab = tc.decodable if context_len > 0 else (tc.corpus, tc.vocab)
    raw = find_ops.find_sequences(corpus, ided.select("seq_ord", "seq"), tc.token_counts, context_len=context_len)
    ob, _ = checked_broadcast(sequence_owners(covers, ided))
    rkey = ["shard", "sample_index", "token_offset", "seq_ord"]
    if context_len > 0:
        # context is decoded once per raw hit, before the fan-out to the queries sharing it
        raw = ctx_ops.hit_context(raw, vocab, tc.joiner, key=rkey)
    hits = raw.join(ob, "seq_ord").drop("seq_ord")
    hits = hits.select("qid", *[c for c in hits.columns if c != "qid"])
    if context_len <= 0:
        return hits.orderBy("qid", "shard", "sample_index", "token_offset")
    tb, _ = checked_broadcast(targets.select("qid", "target"))
    ctx = hits.join(tb, "qid")
    out = ctx_ops.context_regex(ctx, query_pattern(regex, literal), py_regex_search).drop("target")
    return out.orderBy("qid", "shard", "sample_index", "token_offset")
