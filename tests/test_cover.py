"""Cover search checked against an independent brute-force enumeration on a tiny vocabulary."""

import pytest
from pyspark.sql import functions as F

from tokenlens.operators import cover as cov

# tiny vocabulary (F-D): surface strings; ids are list positions
TOKENS = ["h", "e", "l", "o", "he", "ll", "lo", "hel", "hell", "hello", "ello", "el", ".h", ".", " ",
          " h", " he", " hello", "w", "or", "ld", "world", " w", " wor", " world", "lo ", "x", "xhe", "ohe", "d", "r"]
MERGES = [("h", "e"), ("l", "l"), ("l", "o"), ("he", "l"), ("hel", "lo"), ("e", "l"), (" ", "h"), (" h", "e"),
          ("w", "or"), ("or", "ld")]
TARGETS = ["hello", " hello", "ell", "lo ", "hello world", "oh", "hehe", "xhel", "", "zz"]


def brute(target, max_depth, merges=True):
    vocab = {t: i for i, t in enumerate(TOKENS)}
    mset = set(MERGES) if merges else set()
    found = set()
    if target:
        found |= {(i,) for t, i in vocab.items() if target in t}

    def tails(rest, prev, budget):
        if not rest:
            yield ()
            return
        if budget <= 0:
            return
        for cut in range(1, len(rest) + 1):
            piece = rest[:cut]
            if piece in vocab and (prev, piece) not in mset:
                for more in tails(rest[cut:], piece, budget - 1):
                    yield (vocab[piece],) + more

    for i in range(1, len(target) + 1):
        for t, tid in vocab.items():
            if t.endswith(target[:i]):
                for tail in tails(target[i:], t, max_depth - 1):
                    found.add((tid,) + tail)
    return found


def minimal(seq, target):
    text = "".join(TOKENS[i] for i in seq)
    for k in range(len(seq)):
        if target in "".join(TOKENS[i] for j, i in enumerate(seq) if j != k):
            return False
    return target in text or True


@pytest.fixture(scope="module")
def tiny(spark):
    vocab = spark.createDataFrame([(t, i, t.encode()) for i, t in enumerate(TOKENS)],
                                  "token string, token_id int, token_bytes binary")
    merges = spark.createDataFrame([(r, a, b) for r, (a, b) in enumerate(MERGES)], "rank int, left string, right string")
    depth = {t: max(len(t), 1) // 2 + 3 for t in TARGETS}   # any bound works: both sides use it
    targets = spark.createDataFrame([(q, t, t, depth[t]) for q, t in enumerate(TARGETS)],
                                    "qid long, target string, surface string, max_depth int")
    return vocab, merges, targets, depth


@pytest.mark.parametrize("with_merges", [True, False])
def test_candidates_equal_brute_force(spark, tiny, with_merges):
    vocab, merges, targets, depth = tiny
    got = {}
    for r in cov.cover_candidates(targets, vocab, merges if with_merges else None, "").collect():
        got.setdefault(r.qid, set()).add(tuple(r.seq))
    for q, t in enumerate(TARGETS):
        assert got.get(q, set()) == brute(t, depth[t], with_merges), t


def test_merge_pruning_removes_candidates(spark, tiny):
    vocab, merges, targets, depth = tiny
    a = cov.cover_candidates(targets, vocab, merges, "").count()
    b = cov.cover_candidates(targets, vocab, None, "").count()
    assert a < b


def test_minimality_and_containment(spark, tiny):
    vocab, merges, targets, depth = tiny
    c = cov.cover_candidates(targets, vocab, merges, "")
    m = cov.minimal_filter(c, targets, "", True)
    rows = m.join(targets.select("qid", "target"), "qid").collect()
    assert rows
    for r in rows:
        assert minimal(r.seq, r.target)
    # everything dropped by the filter is really not minimal
    kept = {(r.qid, tuple(r.seq)) for r in rows}
    for r in c.join(targets.select("qid", "target"), "qid").collect():
        if (r.qid, tuple(r.seq)) not in kept:
            assert not minimal(r.seq, r.target)


def test_empty_and_unknown_targets_have_no_candidates(spark, tiny):
    vocab, merges, targets, depth = tiny
    c = cov.cover_candidates(targets, vocab, merges, "")
    assert c.where(F.col("qid").isin(TARGETS.index(""), TARGETS.index("zz"))).count() == 0


def test_affix_indexes(spark, tiny):
    vocab, *_ = tiny
    sfx = {(r.affix, r.token_id) for r in cov.suffix_index(vocab).collect()}
    pfx = {(r.affix, r.token_id) for r in cov.prefix_index(vocab).collect()}
    assert sfx == {(t[-i:], k) for k, t in enumerate(TOKENS) for i in range(1, len(t) + 1)}
    assert pfx == {(t[:i], k) for k, t in enumerate(TOKENS) for i in range(1, len(t) + 1)}


def test_direct_joiner_tails_equal_join_loop(spark):
    from conftest import SF001
    from tokenlens.plans import registry as R
    tc, t = R._targets(spark, SF001)
    direct = {(r.qid, r.start, r.depth, tuple(r.seq)) for r in cov.joiner_tails(t, tc.vocab, " ").collect()}
    mtl = int(tc.vocab.agg(F.max(F.length("token"))).first()[0])
    loop = {(r.qid, r.start, r.depth, tuple(r.seq))
            for r in cov.tail_paths(t, cov.lattice_edges(t, tc.vocab, " ", mtl)).collect()}
    assert direct == loop and len(direct) > t.count()


def test_shared_tails_equal_tails_per_query(spark):
    words = ["ab", "a", "b", "c", "bc", "abc", "ca"]
    vocab = spark.createDataFrame([(i, w, w.encode()) for i, w in enumerate(words)], "token_id int, token string, token_bytes binary")
    merges = spark.createDataFrame([("a", "b"), ("ab", "c"), ("b", "c"), ("c", "a")], "left string, right string")
    targets = spark.createDataFrame([(i, t, t, d) for i, (t, d) in enumerate(
        [("abcabc", 9), ("cabc", 9), ("abc", 2), ("abc", 1), ("xbc", 9), ("", 3), ("aaab", 4)])], "qid long, target string, surface string, max_depth int")
    for m in (None, merges):
        want = cov.tail_paths(targets, cov.lattice_edges(targets, vocab, "", 3), m)
        got = cov.shared_tails(targets, vocab, m)
        key = lambda df: sorted((r.qid, r.start, r.depth, tuple(r.seq), tuple(r.toks), r.first_token or "") for r in df.collect())
        assert key(got) == key(want)
