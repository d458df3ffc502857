"""String -> the minimal token sequences whose decoded text contains it ("cover" search).

Semantics (per target string S, in the vocabulary's surface space):

* k = 1: every token whose surface contains S.
* k >= 2: a first token whose surface *ends with* ``S[:i]`` (it may overhang on the left),
  followed by a tail of tokens that spell the rest of S exactly (later tokens never overhang);
  at most ``max_depth`` tokens in all (``max_depth`` = tokens of S's own encoding + 3).
  With a joiner J (word tokens: J = ' '), consecutive tokens are separated by J in S.
* adjacent pairs present in the merge table are pruned (the tokenizer would have merged them).
* candidates are deduplicated, then filtered: round trip (re-encoding the decoded text gives
  the same ids), an optional regex on the decoded text, and minimality (deleting any one token
  loses S from the decoded text).

Plan: the suffix index and the lattice edges (substrings of S that are whole tokens) are
equi-joins against the vocabulary. Tails are grown backwards from the end of S, one join per
token of depth -- a loop bounded by ``max_depth`` -- so every partial row is a finished tail.
Each round is checkpointed into the shared folder to cut lineage.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.strategy import checked_broadcast
from ..session import checkpoint as _ckpt


def _seq_len(c):
    return F.when(F.length(c) > 0, F.sequence(F.lit(1), F.length(c))).otherwise(F.array().cast("array<int>"))


def suffix_index(vocab: DataFrame) -> DataFrame:
    """``(affix, token_id)`` for every non-empty suffix of every token surface (with the
    token's surface and bytes alongside, so candidate plans need no join back)."""
    return vocab.select("token_id", "token", "token_bytes", F.explode(_seq_len(F.col("token"))).alias("i")).select(
        F.expr("right(token, i)").alias("affix"), "token_id", "token", "token_bytes")


def prefix_index(vocab: DataFrame) -> DataFrame:
    """``(affix, token_id)`` for every non-empty prefix of every token surface."""
    return vocab.select("token_id", "token", F.explode(_seq_len(F.col("token"))).alias("i")).select(
        F.expr("left(token, i)").alias("affix"), "token_id")


def affix_groups(index: DataFrame) -> DataFrame:
    """A10: the nested form of an affix index, ``affix -> ARRAY<token_id>`` (ids sorted). Partial
    aggregation collects map-side; one group holds the tokens sharing an affix (bounded by the
    vocabulary)."""
    return index.groupBy("affix").agg(F.array_sort(F.collect_list("token_id")).alias("token_ids"))


def _boundary_ok(surface: Column, end: Column, joiner: str) -> Column:
    """A token may end at ``end`` (0-based exclusive) when that is the end of S or J follows."""
    if joiner == "":
        return F.lit(True)
    return (end == F.length(surface)) | (F.substring(surface, end + 1, len(joiner)) == F.lit(joiner))


def _start_ok(surface: Column, start: Column, joiner: str) -> Column:
    """A tail token may start at ``start`` when it is the start of S or J precedes it."""
    if joiner == "":
        return F.lit(True)
    return (start == 0) | (F.substring(surface, start - len(joiner) + 1, len(joiner)) == F.lit(joiner))


def _next_start(surface: Column, end: Column, joiner: str) -> Column:
    return F.when(end == F.length(surface), end).otherwise(end + F.lit(len(joiner)))


def joiner_free(vocab: DataFrame, joiner: str) -> bool:
    """True when no token contains the joiner (one short job; word vocabularies split on it)."""
    return bool(joiner) and vocab.where(F.instr("token", joiner) > 0).limit(1).count() == 0


def single_token_cover(targets: DataFrame, vocab: DataFrame, sfx: DataFrame | None = None,
                       joiner: str = "") -> DataFrame:
    """P7 (k = 1): tokens whose surface contains S. An equi-join, not a nested loop: every
    suffix of a token is cut to each target length in use and matched against S. The set of
    distinct target lengths is bounded by the longest target, so it is read to the driver and
    becomes a literal array."""
    sfx = (suffix_index(vocab) if sfx is None else sfx).select("affix", "token_id")
    if joiner_free(vocab, joiner):
        # no token contains the joiner, so no token contains a query that does
        targets = targets.where(F.instr("surface", joiner) == 0)
    # a token cannot contain a longer string: only lengths up to the longest token matter, so
    # the list read to the driver is bounded by the vocabulary, not by the queries
    longest = int(vocab.agg(F.max(F.length("token"))).first()[0] or 0)
    lengths = sorted(r[0] for r in targets.select(F.length("surface").alias("L"))
                     .where((F.col("L") > 0) & (F.col("L") <= longest)).distinct().collect())
    if not lengths:
        return targets.sparkSession.createDataFrame([], "qid long, seq array<int>, toks array<string>, bts array<binary>")
    lens = F.array(*[F.lit(x) for x in lengths])
    cut = sfx.select("token_id", "affix", F.explode(F.filter(lens, lambda n: n <= F.length("affix"))).alias("L")).select(
        F.expr("left(affix, L)").alias("piece"), "token_id")
    t = targets.select("qid", F.col("surface").alias("piece")).where(F.length("piece") > 0)
    tb, _ = checked_broadcast(t)
    # a token containing S twice yields the pair twice: deduplicate after the (selective) join
    hits = cut.join(tb, "piece").select("qid", "token_id").distinct()
    return hits.join(vocab.select("token_id", "token", "token_bytes"), "token_id").select(
        "qid", F.array(F.col("token_id")).alias("seq"), F.array(F.col("token")).alias("toks"),
        F.array(F.col("token_bytes")).alias("bts"))


def first_token_candidates(targets: DataFrame, vocab: DataFrame, joiner: str = "", sfx: DataFrame | None = None) -> DataFrame:
    """For every split i of S, tokens whose surface ends with ``S[:i]``; ``next`` is where
    the tail must start."""
    s = F.col("surface")
    splits = targets.select("qid", "surface", "max_depth", F.explode(_seq_len(s)).alias("i")).where(
        _boundary_ok(s, F.col("i"), joiner))
    splits = splits.select("qid", "max_depth", "i", F.expr("left(surface, i)").alias("affix"),
                           _next_start(s, F.col("i"), joiner).alias("next"))
    sb, _ = checked_broadcast(splits)
    sfx = suffix_index(vocab) if sfx is None else sfx
    return sfx.join(sb, "affix").select("qid", "i", "next", "max_depth", "token_id", "token", "token_bytes")


def lattice_edges(targets: DataFrame, vocab: DataFrame, joiner: str = "", max_token_len: int | None = None) -> DataFrame:
    """Edges ``(qid, a, next, token_id, token)``: ``S[a:b]`` is exactly a token and may end at b."""
    s = F.col("surface")
    L = F.length(s)
    starts = targets.select("qid", "surface", F.explode(
        F.when(L > 0, F.sequence(F.lit(0), L - 1)).otherwise(F.array().cast("array<int>"))).alias("a")).where(
        _start_ok(s, F.col("a"), joiner))
    top = L if max_token_len is None else F.least(L, F.col("a") + F.lit(max_token_len))
    pairs = starts.select("qid", "surface", "a", F.explode(F.sequence(F.col("a") + 1, top)).alias("b")).where(
        _boundary_ok(s, F.col("b"), joiner))
    pieces = pairs.select("qid", "a", _next_start(s, F.col("b"), joiner).alias("next"),
                          F.expr("substring(surface, a + 1, b - a)").alias("token"))
    pb, _ = checked_broadcast(pieces)
    return vocab.select("token", "token_id", "token_bytes").join(pb, "token").select(
        "qid", "a", "next", "token_id", "token", "token_bytes")


def _not_merged(left_tok: Column, right_tok: Column, merges: DataFrame | None, df: DataFrame) -> DataFrame:
    """Drop rows whose adjacent pair (left, right) is a merge (left-anti join on both strings)."""
    if merges is None:
        return df
    m = merges.select(F.col("left").alias("_ml"), F.col("right").alias("_mr"))
    mb, _ = checked_broadcast(m)
    return df.join(mb, (left_tok == F.col("_ml")) & (right_tok == F.col("_mr")), "left_anti")


def tail_paths(targets: DataFrame, edges: DataFrame, merges: DataFrame | None = None, max_rounds: int | None = None) -> DataFrame:
    """J2 + J3: every token path from a start position to the end of S, at most
    ``max_depth - 1`` tokens, no merge pair inside. ``(qid, start, depth, seq, first_token)``.

    One equi-join per round (bounded by the largest ``max_depth``); each round's frontier is
    checkpointed into the shared folder, so lineage never grows with the number of rounds."""
    empty = targets.select("qid", F.length("surface").alias("start"), F.lit(0).alias("depth"),
                           F.array().cast("array<int>").alias("seq"), F.array().cast("array<string>").alias("toks"),
                           F.array().cast("array<binary>").alias("bts"), F.lit(None).cast("string").alias("first_token"),
                           "max_depth")
    if max_rounds is None:
        max_rounds = int(targets.agg(F.max("max_depth")).first()[0] or 1) - 1
    frontier = empty.transform(_ckpt)
    parts = [frontier]
    e = edges.alias("e")
    for _ in range(max(max_rounds, 0)):
        f = frontier.alias("f")
        grown = e.join(f, (F.col("e.qid") == F.col("f.qid")) & (F.col("e.next") == F.col("f.start"))).where(
            F.col("f.depth") + 1 <= F.col("f.max_depth") - 1)
        grown = _not_merged(F.col("e.token"), F.col("f.first_token"), merges, grown)
        frontier = grown.select(F.col("e.qid").alias("qid"), F.col("e.a").alias("start"),
                                (F.col("f.depth") + 1).alias("depth"),
                                F.concat(F.array(F.col("e.token_id")), F.col("f.seq")).alias("seq"),
                                F.concat(F.array(F.col("e.token")), F.col("f.toks")).alias("toks"),
                                F.concat(F.array(F.col("e.token_bytes")), F.col("f.bts")).alias("bts"),
                                F.col("e.token").alias("first_token"), F.col("f.max_depth").alias("max_depth")
                                ).transform(_ckpt)
        if frontier.isEmpty():
            break
        parts.append(frontier)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.drop("max_depth")


def shared_tails(targets: DataFrame, vocab: DataFrame, merges: DataFrame | None = None, joiner: str = "",
                 max_token_len: int | None = None) -> DataFrame:
    """J2 + J3 with the tails kept in common: the same rows as ``tail_paths``, grown over the distinct
    remainders of all queries. What spells a remainder doesn't depend on the query it is the end of, so
    each remainder's paths are grown once, up to the depth that any of its queries allows, and every
    (query, start) looks its own up.

    Remainders are the nodes of a graph whose edges are tokens; one equi-join on the remainder per
    token of depth, from the empty remainder backwards, checkpointed by round."""
    if max_token_len is None:
        max_token_len = int(vocab.agg(F.max(F.length("token"))).first()[0] or 1)
    s, rest = F.col("surface"), F.col("rest")
    L = F.length(s)
    starts = targets.select("qid", "surface", "max_depth", F.explode(F.sequence(F.lit(0), L)).alias("start")).where(
        (F.col("start") == L) | _start_ok(s, F.col("start"), joiner))
    starts = starts.select("qid", F.col("start").cast("int").alias("start"), F.expr("substring(surface, start + 1)").alias("rest"),
                           "max_depth").transform(_ckpt)
    nodes = starts.groupBy("rest").agg(F.max("max_depth").alias("deepest"))
    cuts = F.when(F.length(rest) > 0, F.sequence(F.lit(1), F.least(F.length(rest), F.lit(max_token_len)))).otherwise(F.array().cast("array<int>"))
    pieces = nodes.select("rest", "deepest", F.explode(cuts).alias("b")).where(_boundary_ok(rest, F.col("b"), joiner)).select(
        "rest", "deepest", F.expr("left(rest, b)").alias("token"), _next_start(rest, F.col("b"), joiner).alias("next"))
    edges = pieces.join(vocab.select("token", "token_id", "token_bytes"), "token").select(
        "rest", "deepest", F.expr("substring(rest, next + 1)").alias("after"), "token", "token_id", "token_bytes").transform(_ckpt)
    none = lambda kind: F.array().cast(f"array<{kind}>")
    frontier = nodes.where("rest = ''").select(F.lit("").alias("spelt"), F.lit(0).alias("depth"), none("int").alias("seq"), none("string").alias("toks"),
                                               none("binary").alias("bts"), F.lit(None).cast("string").alias("first_token")).transform(_ckpt)
    found = frontier
    while not frontier.isEmpty():
        e, f = edges.alias("e"), frontier.alias("f")
        grown = e.join(f, F.col("e.after") == F.col("f.spelt")).where(F.col("f.depth") + 1 <= F.col("e.deepest") - 1)
        grown = _not_merged(F.col("e.token"), F.col("f.first_token"), merges, grown)
        before = lambda one, many: F.concat(F.array(F.col(one)), F.col(many))
        frontier = grown.select(F.col("e.rest").alias("spelt"), (F.col("f.depth") + 1).alias("depth"),
                                before("e.token_id", "f.seq").alias("seq"), before("e.token", "f.toks").alias("toks"),
                                before("e.token_bytes", "f.bts").alias("bts"), F.col("e.token").alias("first_token")).transform(_ckpt)
        found = found.unionByName(frontier)
    return starts.join(found, F.col("rest") == F.col("spelt")).where((F.col("depth") == 0) | (F.col("depth") <= F.col("max_depth") - 1)).select(
        "qid", "start", "depth", "seq", "toks", "bts", "first_token")


def joiner_tails(targets: DataFrame, vocab: DataFrame, joiner: str) -> DataFrame:
    """J2 for a joiner vocabulary whose tokens never contain the joiner (e.g. words split on
    spaces): a tail can only be the exact tokens of the pieces from some piece to the end of S,
    so tails are computed directly -- no round-by-round join. Same rows as ``tail_paths``.

    Pieces are looked up with one join to the words of the vocabulary that occur in a target (the
    vocabulary is streamed past these, not shuffled); each query's pieces regroup into an id array (a bounded
    group: one query), and the tail from piece j is the slice from j when every piece from j on
    is a known, non-empty token."""
    pieces = targets.select("qid", "surface", "max_depth",
                            F.posexplode(F.split(F.col("surface"), joiner, -1)).alias("j", "w"))
    words = pieces.select("w").distinct()
    n_words = words.count()
    wb, _ = checked_broadcast(words, known_rows=n_words)
    v, _ = checked_broadcast(vocab.select(F.col("token").alias("w"), "token_id").join(wb, "w", "left_semi"), known_rows=n_words)
    known = pieces.join(v, "w", "left").withColumn(
        "token_id", F.when(F.length("w") > 0, F.col("token_id")))
    g = known.groupBy("qid", "surface", "max_depth").agg(
        F.array_sort(F.collect_list(F.struct("j", "w", "token_id"))).alias("p"))
    n = F.size("p")
    # start of piece j = total length of the pieces before it plus one joiner each
    starts = F.transform("p", lambda x, i: F.aggregate(F.slice("p", 1, i), F.lit(0),
                                                        lambda acc, y: acc + F.length(y["w"]) + F.lit(len(joiner))))
    ex = g.select("qid", "max_depth", "p", F.posexplode(starts).alias("i", "start"))
    rest = F.slice(F.col("p"), F.col("i") + 1, n - F.col("i"))
    ok = F.forall(rest, lambda x: x["token_id"].isNotNull())
    depth = n - F.col("i")
    tails = ex.where(ok & (depth <= F.col("max_depth") - 1)).select(
        "qid", F.col("start").cast("int").alias("start"), depth.cast("int").alias("depth"),
        F.transform(rest, lambda x: x["token_id"]).alias("seq"),
        F.transform(rest, lambda x: x["w"]).alias("toks"),
        F.transform(rest, lambda x: F.encode(x["w"], "UTF-8")).alias("bts"),
        F.element_at(rest, 1)["w"].alias("first_token"))
    empty = targets.select("qid", F.length("surface").cast("int").alias("start"), F.lit(0).alias("depth"),
                           F.array().cast("array<int>").alias("seq"), F.array().cast("array<string>").alias("toks"),
                           F.array().cast("array<binary>").alias("bts"), F.lit(None).cast("string").alias("first_token"))
    return empty.unionByName(tails)


def tails_for(targets: DataFrame, vocab: DataFrame, merges: DataFrame | None, joiner: str,
              max_token_len: int | None = None) -> DataFrame:
    """Tail paths: direct for a joiner vocabulary without merges whose tokens never contain the
    joiner (checked with one short job), the bounded join loop otherwise."""
    if merges is None and joiner_free(vocab, joiner):
        return joiner_tails(targets, vocab, joiner)
    return shared_tails(targets, vocab, merges, joiner, max_token_len)


def multi_token_candidates(firsts: DataFrame, tails: DataFrame, merges: DataFrame | None = None) -> DataFrame:
    """First token + tail, ``1 + depth <= max_depth``, no merge at the seam. Tails follow the queries,
    first tokens the vocabulary: the tails are broadcast past them (checked)."""
    f = firsts.alias("f")
    t = checked_broadcast(tails.transform(_ckpt))[0].alias("t")
    j = f.join(t, (F.col("f.qid") == F.col("t.qid")) & (F.col("f.next") == F.col("t.start"))).where(
        F.col("t.depth") + 1 <= F.col("f.max_depth"))
    j = _not_merged(F.col("f.token"), F.col("t.first_token"), merges, j)
    return j.select(F.col("f.qid").alias("qid"), F.concat(F.array(F.col("f.token_id")), F.col("t.seq")).alias("seq"),
                    F.concat(F.array(F.col("f.token")), F.col("t.toks")).alias("toks"),
                    F.concat(F.array(F.col("f.token_bytes")), F.col("t.bts")).alias("bts"))


def cover_candidates(targets: DataFrame, vocab: DataFrame, merges: DataFrame | None = None, joiner: str = "",
                     max_token_len: int | None = None, sfx: DataFrame | None = None) -> DataFrame:
    """U1 + A9: k = 1 and k >= 2 candidates, distinct per target."""
    tails = tails_for(targets, vocab, merges, joiner, max_token_len)
    firsts = first_token_candidates(targets, vocab, joiner, sfx)
    multi = multi_token_candidates(firsts, tails, merges)
    single = single_token_cover(targets, vocab, sfx, joiner)
    # Distinct without an aggregation: first tokens are distinct per (query, split), tails are
    # distinct paths and fix the split, so multi-token candidates never repeat; a one-token
    # "multi" candidate (empty tail) ends with S and so is already a k = 1 candidate.
    return single.unionByName(multi.where(F.size("seq") >= 2))


def decoded_text(toks: Column, bts: Column, joiner: str, byte_level: bool) -> Column:
    """Decoded text of a candidate from the token strings/bytes it carries (no join):
    byte-level tokens concatenate bytes and decode once; word tokens join with the joiner."""
    if byte_level:
        raw = F.aggregate(bts, F.lit(b"").cast("binary"), lambda acc, b: F.concat(acc, b))
        return F.make_valid_utf8(raw.cast("string"))
    return F.array_join(toks, joiner)


def decode_sequences(cands: DataFrame, joiner: str, byte_level: bool) -> DataFrame:
    """Adds ``decoded`` to candidates carrying ``toks`` / ``bts``."""
    return cands.withColumn("decoded", decoded_text(F.col("toks"), F.col("bts"), joiner, byte_level))


def is_minimal(toks: Column, bts: Column, target: Column, joiner: str, byte_level: bool) -> Column:
    """P12 as one row expression: no single-token deletion still contains the target text."""
    n = F.size(toks)
    idx = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))

    def without(k):
        t = F.filter(toks, lambda x, j: j != k)
        b = F.filter(bts, lambda x, j: j != k)
        return decoded_text(t, b, joiner, byte_level)

    return ~F.exists(idx, lambda k: F.instr(without(k), target) > 0)


def minimal_filter(cands: DataFrame, targets: DataFrame, joiner: str, byte_level: bool) -> DataFrame:
    """Keep candidates for which no single-token deletion still contains the target."""
    t = targets.select("qid", "target")
    tb, _ = checked_broadcast(t)
    j = cands.join(tb, "qid")
    return j.where(is_minimal(F.col("toks"), F.col("bts"), F.col("target"), joiner, byte_level)).drop("target")
