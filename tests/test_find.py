import random

import pytest
from pyspark.sql import functions as F

from conftest import SF001, corpus_df, seqs_df
from tokenlens.operators import find as fo
from tokenlens.operators.postings import build_pair_postings, build_postings, of_tokens, postings_of, token_ranges
from tokenlens.sources.wordcorpus import token_stats_of, word_corpus


def brute_hits(rows, seqs):
    out = set()
    for shard, sample, toks in rows:
        for k, s in enumerate(seqs):
            for i in range(len(toks) - len(s) + 1):
                if toks[i:i + len(s)] == s:
                    out.add((shard, sample, i, k))
    return out


def test_overlapping_and_repeated_occurrences(spark):
    rows = [(0, 0, [1, 1, 1, 2]), (0, 1, [2, 1, 1]), (1, 0, [3])]
    c = corpus_df(spark, rows)
    hits = fo.find_sequences(c, seqs_df(spark, [[1, 1]]), token_stats_of(c))
    got = {(r.shard, r.sample_index, r.token_offset) for r in hits.collect()}
    assert got == {(0, 0, 0), (0, 0, 1), (0, 1, 1)}


def test_dedup_keeps_earliest_sequence(spark):
    rows = [(0, 0, [5, 6, 7, 8])]
    c = corpus_df(spark, rows)
    hits = fo.find_sequences(c, seqs_df(spark, [[5, 6], [5, 6, 7], [6, 7]]), token_stats_of(c))
    d = {(r.token_offset): (r.seq_ord, list(r.sequence)) for r in fo.dedup_hits(hits).collect()}
    assert d == {0: (0, [5, 6]), 1: (2, [6, 7])}


def test_empty_sequence_rejected(spark):
    c = corpus_df(spark, [(0, 0, [1, 2])])
    with pytest.raises(Exception):
        fo.find_sequences(c, seqs_df(spark, [[]]), None).collect()


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_scan_and_postings_equal_brute_force(spark, seed):
    rnd = random.Random(seed)
    rows = [(s, i, [rnd.randint(0, 6) for _ in range(rnd.randint(0, 40))]) for s in range(3) for i in range(6)]
    seqs = [[rnd.randint(0, 6) for _ in range(rnd.randint(1, 3))] for _ in range(12)]
    c = corpus_df(spark, rows)
    st = token_stats_of(c)
    want = brute_hits(rows, seqs)
    scan = fo.find_sequences(c, seqs_df(spark, seqs), st, strategy="scan")
    post = fo.find_sequences(c, seqs_df(spark, seqs), st, postings=postings_of(c), strategy="postings")
    for df in (scan, post):
        got = {(r.shard, r.sample_index, r.token_offset, r.seq_ord) for r in df.collect()}
        assert got == want
    # no hit lies: the slice at the offset is the sequence
    for r in scan.collect():
        assert rows[r.shard * 6 + r.sample_index][2][r.token_offset:r.token_offset + len(r.sequence)] == list(r.sequence)


def test_repair_offsets_branches(spark):
    toks = [9, 5, 6, 1, 5, 6, 2]
    c = corpus_df(spark, [(0, 0, toks), (0, 1, [1, 2, 3])])
    rep = spark.createDataFrame([
        (0, 0, 1, 0, [5, 6]),   # exact
        (0, 0, 2, 1, [5, 6]),   # one too far -> offset - 1
        (0, 0, 6, 2, [5, 6]),   # far off -> first occurrence (1)
        (0, 1, 0, 3, [5, 6]),   # absent -> dropped
    ], "shard int, sample_index int, reported_offset int, seq_ord long, sequence array<int>")
    got = {(r.seq_ord, r.token_offset) for r in fo.repair_offsets(rep, c).collect()}
    assert got == {(0, 1), (1, 1), (2, 1)}


def test_repair_offsets_against_a_scan(spark):
    import random
    rng = random.Random(5)
    ids = [1, 11, 111, 2, 12, 21]                       # ids whose digits are parts of each other
    samples = {i: [rng.choice(ids) for _ in range(rng.randint(0, 25))] for i in range(40)}
    reports = [(0, i, rng.choice([None, 0, 3, 9, 30]), n, [rng.choice(ids) for _ in range(rng.randint(0, 3))])
               for n, i in enumerate(i for i in samples for _ in range(6))]
    want = set()
    for _, i, o, n, s in reports:
        at = [k for k in range(len(samples[i]) - len(s) + 1) if samples[i][k:k + len(s)] == s]
        if not at or not s:
            continue
        want.add((n, i, o if o in at else o - 1 if o and o - 1 in at else at[0], o))
    rep = spark.createDataFrame(reports, "shard int, sample_index int, reported_offset int, seq_ord long, sequence array<int>")
    got = fo.repair_offsets(rep.where("size(sequence) > 0 or reported_offset is null"), corpus_df(spark, [(0, i, t) for i, t in samples.items()]))
    assert {(r.seq_ord, r.sample_index, r.token_offset, r.reported_offset) for r in got.collect()} == want
    assert fo.repair_offsets(rep.limit(0), corpus_df(spark, [(0, 0, [1])])).count() == 0


def test_planted_spans_found(spark):
    tc = word_corpus(spark, SF001)
    rows = {(r.shard, r.sample_index): list(r.token_ids) for r in tc.corpus.collect()}
    cases = [(0, 0, 10, 20), (1, 5, 20, 30), (0, 10, 50, 60), (1, 0, 10, 20), (0, 20, 5, 15), (1, 50, 0, 10)]
    cases = [c for c in cases if len(rows[(c[0], c[1])]) >= c[3]]
    assert len(cases) >= 4
    seqs = [rows[(s, i)][a:b] for s, i, a, b in cases]
    hits = fo.dedup_hits(fo.find_sequences(tc.corpus, seqs_df(spark, seqs), tc.token_stats)).collect()
    got = {(r.shard, r.sample_index, r.token_offset, tuple(r.sequence)) for r in hits}
    for (s, i, a, _b), seq in zip(cases, seqs):
        assert (s, i, a, tuple(seq)) in got


def test_first_occurrence_and_counts(spark):
    c = corpus_df(spark, [(0, 0, [1, 2, 1, 2, 1]), (0, 1, [2, 1])])
    hits = fo.find_sequences(c, seqs_df(spark, [[1, 2], [2, 1]]), None)
    fo_rows = {(r.seq_ord, r.sample_index): (r.first_offset, r.n_occurrences) for r in fo.first_occurrence(hits).collect()}
    assert fo_rows == {(0, 0): (0, 2), (1, 0): (1, 2), (1, 1): (0, 1)}
    cnt = {r.seq_ord: (r.n_hits, r.n_samples) for r in fo.sequence_counts(hits).collect()}
    assert cnt == {0: (2, 1), 1: (3, 2)}


def test_large_needle_set_takes_the_postings_path(spark):
    rnd = random.Random(7)
    rows = [(s, i, [rnd.randint(0, 5) for _ in range(30)]) for s in range(2) for i in range(4)]
    seqs = [[rnd.randint(0, 5) for _ in range(2)] for _ in range(25)]
    c = corpus_df(spark, rows)
    spark.conf.set("tokenlens.broadcast.maxRows", "10")
    try:
        got = {(r.shard, r.sample_index, r.token_offset, r.seq_ord)
               for r in fo.find_sequences(c, seqs_df(spark, seqs), token_stats_of(c)).collect()}
    finally:
        spark.conf.unset("tokenlens.broadcast.maxRows")
    assert got == brute_hits(rows, seqs)


def test_token_ranges_hold_the_tokens_and_leave_the_widest_gaps_out():
    assert token_ranges([]) == []
    assert token_ranges([5]) == [(5, 5)]
    assert token_ranges([1, 2, 3, 9, 40, 41], most=3) == [(1, 3), (9, 9), (40, 41)]
    assert token_ranges([1, 2, 3, 9, 40, 41], most=2) == [(1, 9), (40, 41)]
    tokens = sorted(random.Random(1).sample(range(10_000), 500))
    ranges = token_ranges(tokens, 50)
    assert len(ranges) <= 50 and all(any(a <= t <= b for a, b in ranges) for t in tokens)


def test_postings_skip_other_tokens_and_the_corpus(spark, tmpdir_path):
    tc = word_corpus(spark, SF001)
    post = build_postings(tc.corpus, f"{tmpdir_path}/postings")
    few = spark.createDataFrame([(3,), (4,), (700,)], "token_id int")
    plan = of_tokens(post, few)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "700" in plan
    assert {r.token_id for r in of_tokens(post, few).select("token_id").distinct().collect()} == {3, 4, 700}
    # the index alone answers a search: a corpus that can't be read is never asked for
    row = next(r.token_ids for r in tc.corpus.collect() if len(r.token_ids) > 12)
    seqs = seqs_df(spark, [list(row[3:7]), list(row[5:7]), [row[0]]])
    gone = tc.corpus.where(F.raise_error(F.lit("read")).isNull())
    needles, n = fo.prepare_needles(seqs, tc.token_stats)
    pairs = build_pair_postings(tc.corpus, f"{tmpdir_path}/pairs")
    hits = fo.search_prepared(gone, needles, n, post, "postings", pairs=pairs)
    scan = fo.search_prepared(tc.corpus, needles, n, None, "scan")
    key = lambda df: {(r.shard, r.sample_index, r.token_offset, r.seq_ord, tuple(r.sequence)) for r in df.collect()}
    assert key(hits) == key(scan) != set()
    context = [sorted(map(repr, fo.search_prepared(tc.corpus, needles, n, post, s, 4).select(
        "shard", "sample_index", "token_offset", "seq_ord", "before_ids", "match_ids", "after_ids").collect())) for s in ("scan", "postings")]
    assert context[0] == context[1]
