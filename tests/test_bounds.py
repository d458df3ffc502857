"""Searches, contexts and repairs that neither copy a sample per position nor shuffle a context or a report twice."""

import random

import pytest

from conftest import SF001, corpus_df, seqs_df
from tokenlens.functions.arrays import Ranks
from tokenlens.operators import decode, find as fo
from tokenlens.operators import context as co
from tokenlens.plans import registry
from tokenlens.sources import wordcorpus


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _random_corpus(rnd, n_tokens=6):
    return [(s, i, [rnd.randint(0, n_tokens) for _ in range(rnd.randint(0, 60))]) for s in range(3) for i in range(5)]


@pytest.mark.parametrize("candidates, hits, tokens", [(1, 1, 1), (7, 3, 100), (1 << 20, 1 << 12, 1 << 20)])
def test_a_search_takes_no_row_per_position(spark, monkeypatch, candidates, hits, tokens):
    monkeypatch.setattr(fo, "CANDIDATES", candidates)
    monkeypatch.setattr(fo, "HITS", hits)
    monkeypatch.setattr(fo, "SEARCH_TOKENS", tokens)
    rnd = random.Random(candidates)
    rows = _random_corpus(rnd, 3)
    seqs = [[rnd.randint(0, 3) for _ in range(rnd.randint(1, 4))] for _ in range(15)] + [[9]]
    got = fo.find_sequences(corpus_df(spark, rows), seqs_df(spark, seqs), wordcorpus.token_stats_of(corpus_df(spark, rows)), context_len=2, mark_first=True)
    assert "Generate" not in _plan(got) and "Exchange" not in _plan(got)
    want = {(s, i, o, k): (t[max(0, o - 2):o], t[o:o + len(q)], t[o + len(q):o + len(q) + 2])
            for s, i, t in rows for k, q in enumerate(seqs) for o in range(len(t) - len(q) + 1) if t[o:o + len(q)] == q}
    found = got.collect()
    assert {(r.shard, r.sample_index, r.token_offset, r.seq_ord): (r.before_ids, r.match_ids, r.after_ids) for r in found} == want
    assert len(found) == len(want)
    for r in found:
        assert r.first_here == (r.seq_ord == min(k for s, i, o, k in want if (s, i, o) == (r.shard, r.sample_index, r.token_offset)))


def test_a_search_needs_the_counts_of_the_vocabulary_only(spark, tmpdir_path):
    """No second pass over the corpus for statistics; the counts are those of the statistics."""
    from tokenlens.session import is_done
    docs = spark.createDataFrame([(0, "a b a"), (101, "b zz"), (101, "b"), (None, "zz a"), (102, None)], "doc_id long, text string")
    tc = wordcorpus.build_word_corpus(spark, docs, tmpdir_path, 100)
    hits = fo.find_sequences(tc.corpus, seqs_df(spark, [[0], [1, 2]]), tc.token_counts)
    assert hits.count() == 4 and not is_done(spark, f"{tmpdir_path}/token_stats")
    assert sorted(map(tuple, tc.token_counts.collect())) == sorted(map(tuple, tc.token_stats.select("token_id", "n").collect()))


def test_contexts_are_decoded_without_a_row_per_token(spark, monkeypatch):
    """With a vocabulary beyond the bound the rare words come to their samples; texts stay the same."""
    read = lambda df: sorted(map(tuple, df.select(*registry.HIT_COLS, "before", "match", "after").collect()))
    wordcorpus._OPENED.clear()
    want = read(registry._context(spark, SF001))
    monkeypatch.setattr(decode, "DENSE_ROWS", 300)
    wordcorpus._OPENED.clear()
    got = registry._context(spark, SF001)
    assert "Generate" not in _plan(got) and _plan(got).count("Exchange hash") <= 3
    assert read(got) == want != []
    wordcorpus._OPENED.clear()


@pytest.mark.parametrize("ids", [[], [0], [63], [64], [5, 63, 64, 127, 128, 700], list(range(192))])
def test_ranks_of_ids(ids):
    import numpy as np
    asked = np.array([-2147483648, -1, *range(800), 2147483647], np.int32)
    assert Ranks(np.array(ids, np.int32)).at(asked).tolist() == [ids.index(a) if a in ids else -1 for a in asked.tolist()]


def test_words_of_a_sample_complete_the_frequent_ones(spark, monkeypatch):
    monkeypatch.setattr(decode, "DENSE_ROWS", 2)
    words, counts = ["a", "é", "c", "d", "e"], [8, 1, 9, 1, 1]
    vocab = spark.createDataFrame([(w, i, w.encode(), n) for i, (w, n) in enumerate(zip(words, counts))], "token string, token_id int, token_bytes binary, n long")
    rows = [(0, 0, [0, 1, 2, 1, 4]), (0, 1, []), (0, 2, [2, 2]), (None, 3, [3, 0])]
    corpus = spark.createDataFrame(rows, "shard int, sample_index int, token_ids array<int>")
    met, frequent = decode.with_words(corpus, vocab)
    assert sorted(r.token for r in frequent.collect()) == ["a", "c"]
    hits = fo.find_sequences(met, seqs_df(spark, [[1, 2], [4], [0]]), None, context_len=2)
    got = {(r.shard, r.sample_index, r.token_offset): r.before + r.match + r.after for r in co.hit_context(hits, frequent).collect()}
    assert got == {(0, 0, 0): "a é c", (0, 0, 1): "a é c é e", (0, 0, 4): "c é e", (None, 3, 1): "d a"}


@pytest.mark.parametrize("candidates", [1, 1 << 20])
def test_reports_and_samples_meet_in_one_shuffle(spark, monkeypatch, candidates):
    monkeypatch.setattr(fo, "CANDIDATES", candidates)
    rnd = random.Random(3)
    rows = _random_corpus(rnd, 3)
    reports = [(s, i, rnd.choice([None, -3, 0, 1, 5, 90]), k, [rnd.randint(0, 3) for _ in range(rnd.randint(1, 3))])
               for k in range(12) for s, i in [(rnd.randint(0, 3), rnd.randint(0, 5))] for _ in range(1)]
    reports += [(s, i, (o or 0) + 1, k, q) for s, i, o, k, q in reports] + [(None, 0, 0, 99, [1])]
    want = {}
    for s, i, o, k, q in reports:
        t = next((t for a, b, t in rows if (a, b) == (s, i)), [])
        at = [p for p in range(len(t) - len(q) + 1) if t[p:p + len(q)] == q]
        if at and s is not None:
            place = (k, s, i, o if o in at else o - 1 if o and o - 1 in at else at[0])
            want[place] = min((x for x in (want.get(place), o) if x is not None), default=None)
    rep = spark.createDataFrame(reports, "shard int, sample_index int, reported_offset int, seq_ord long, sequence array<int>")
    got = fo.repair_offsets(rep, corpus_df(spark, rows))
    assert _plan(got).count("Exchange hash") == 1
    assert {(r.seq_ord, r.shard, r.sample_index, r.token_offset): r.reported_offset for r in got.collect()} == want != {}


def test_shuffle_files_go_with_their_action(spark, tmpdir_path):
    import glob
    import os
    from tokenlens.session import apply_runtime_conf
    apply_runtime_conf(spark)
    folder = os.path.dirname(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()[0])
    count = lambda: len(glob.glob(f"{folder}/blockmgr-*/*/shuffle_*.data"))
    before = count()
    spark.range(1000).repartition(3, "id").write.parquet(f"{tmpdir_path}/t")
    for _ in range(50):
        if count() <= before:
            break
        import time
        time.sleep(0.1)
    assert count() <= before
