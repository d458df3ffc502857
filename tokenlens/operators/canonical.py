"""Minimal covers without enumerating every segmentation.

Every k >= 2 candidate is a first token f (its surface ends with ``S[:i]``) followed by a tail
that spells the rest of S exactly, so its decoded text depends only on (f, i):
``decode(bytes(f) + bytes(S[i:]))`` (with a joiner: ``f + J + S[next:]``). The round-trip filter
keeps a candidate only if it *is* the tokenizer's encoding of its own decoded text, so at most
one candidate per decoded text survives: ``e = encode(d)``. Hence

    result = { e = encode(d) : d a candidate text, e a valid candidate, regex(d), minimal(e) }

and "e is a valid candidate" is decidable from e alone (first token ends with the part of S its
tail does not spell, tail tokens spell the rest exactly, no merge pair between neighbours, at
most ``max_depth`` tokens; or a single token containing S). Work is proportional to the first-
token candidates, not to the product of first tokens and tail segmentations. The result equals
generate-then-filter (``cover.cover_candidates`` + filters); tests compare both.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.strategy import checked_broadcast
from .cover import decoded_text, first_token_candidates, is_minimal, single_token_cover
from ..sources.vocab import surface_to_bytes


def candidate_texts(targets: DataFrame, vocab: DataFrame, joiner: str, byte_level: bool, sfx: DataFrame | None = None) -> DataFrame:
    """``(qid, d)``: every distinct decoded text a candidate of the query can have."""
    firsts = first_token_candidates(targets, vocab, joiner, sfx)
    tb, _ = checked_broadcast(targets.select("qid", "surface", "target"))
    f = firsts.join(tb, "qid")
    rest = F.expr("substring(surface, next + 1)")
    if byte_level:
        # surface character k stands for byte k of the query's UTF-8 encoding, so the bytes of
        # the rest of the surface are a byte range of the query itself (binary substring)
        rest_bytes = F.expr("substring(encode(target, 'UTF-8'), next + 1)")
        raw = F.concat(F.col("token_bytes"), rest_bytes)
        d = F.make_valid_utf8(raw.cast("string"))
    else:
        d = F.when(F.col("next") >= F.length("surface"), F.col("token")).otherwise(
            F.concat(F.col("token"), F.lit(joiner), rest))
    multi = f.select("qid", d.alias("d"))
    single = single_token_cover(targets, vocab, sfx, joiner).select(
        "qid", decoded_text(F.col("toks"), F.col("bts"), joiner, byte_level).alias("d"))
    return multi.unionByName(single).distinct()


def is_candidate(toks: Column, surface: Column, max_depth: Column, joiner: str) -> Column:
    """Row test: is the token-surface array ``toks`` a cover candidate of ``surface``?"""
    n = F.size(toks)
    tail = F.slice(toks, 2, F.greatest(n - 1, F.lit(0)))
    tail_text = F.array_join(tail, joiner)
    L = F.length(surface)
    cut = L - F.length(tail_text) - F.lit(len(joiner))           # i: where the first token's part ends
    first = F.element_at(toks, 1)
    first_part = F.substring(surface, F.lit(1), cut)
    first_ok = (cut >= 1) & (F.substring(first, F.length(first) - cut + 1, cut) == first_part) & (F.length(first) >= cut)
    sep_ok = F.lit(True) if joiner == "" else (F.substring(surface, cut + 1, len(joiner)) == F.lit(joiner))
    tail_ok = (F.substring(surface, cut + 1 + len(joiner), L) == tail_text) & F.forall(tail, lambda t: F.length(t) > 0)
    multi = (n >= 2) & (n <= max_depth) & first_ok & sep_ok & tail_ok
    single = (n == 1) & (F.instr(first, surface) > 0) & (L > 0)
    return single | multi


def no_merge_pairs(df: DataFrame, merges: DataFrame | None, key: list[str]) -> DataFrame:
    """Drop rows whose token array ``toks`` has a neighbour pair in the merge table."""
    if merges is None:
        return df
    n = F.size("toks")
    idx = F.when(n > 1, F.sequence(F.lit(1), n - 1)).otherwise(F.array().cast("array<int>"))
    pairs = df.select(*key, F.explode(F.transform(idx, lambda i: F.struct(
        F.element_at("toks", i).alias("l"), F.element_at("toks", i + 1).alias("r")))).alias("p"))
    m = merges.select(F.col("left").alias("l"), F.col("right").alias("r"))
    mb, _ = checked_broadcast(m)
    bad = pairs.select(*key, "p.l", "p.r").join(mb, ["l", "r"], "left_semi").select(*key).distinct()
    return df.join(bad, key, "left_anti")


def canonical_minimal_covers(targets: DataFrame, vocab: DataFrame, merges: DataFrame | None, joiner: str,
                             byte_level: bool, encoder, regex_filter=None, sfx: DataFrame | None = None) -> DataFrame:
    """``(qid, seq, toks, decoded)`` -- the same set as candidates -> dedup -> round trip ->
    regex -> minimality. ``encoder(df(qid, d)) -> df(qid, d, ids, tokens)``; ``regex_filter``
    maps ``(qid, d, target)`` rows to the ones that pass (None: no regex)."""
    texts = candidate_texts(targets, vocab, joiner, byte_level, sfx)
    tb, _ = checked_broadcast(targets.select("qid", "target", "surface", "max_depth"))
    texts = texts.join(tb, "qid")
    if regex_filter is not None:
        texts = regex_filter(texts)
    enc = encoder(texts.select("qid", "d"))
    j = texts.join(enc, ["qid", "d"]).where(F.size("ids") > 0)
    j = j.where(is_candidate(F.col("tokens"), F.col("surface"), F.col("max_depth"), joiner))
    j = j.select("qid", "d", "target", F.col("ids").alias("seq"), F.col("tokens").alias("toks"))
    j = no_merge_pairs(j, merges, ["qid", "d"])
    if byte_level:
        bts = F.transform("toks", lambda t: surface_to_bytes(t))
    else:
        bts = F.transform("toks", lambda t: F.encode(t, "UTF-8"))
    j = j.withColumn("bts", bts).where(is_minimal(F.col("toks"), F.col("bts"), F.col("target"), joiner, byte_level))
    return j.select("qid", "seq", "toks", F.col("d").alias("decoded"))
