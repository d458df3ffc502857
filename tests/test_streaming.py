import os

from conftest import corpus_df, seqs_df
from tokenlens.operators import find as fo
from tokenlens.sources.corpus import write_corpus
from tokenlens.streaming.standing_search import run_standing_search


def test_incremental_runs_equal_one_batch(spark, tmpdir_path):
    rows = [(s, i, [(s * 7 + i * 3 + k) % 5 for k in range(12)]) for s in range(4) for i in range(3)]
    seqs = [[1, 2], [3], [4, 0, 1], [1, 2, 3]]
    src = os.path.join(tmpdir_path, "corpus")
    out, ck = os.path.join(tmpdir_path, "hits"), os.path.join(tmpdir_path, "ck")
    # shards arrive in two deliveries; each run processes only what is new
    write_corpus(corpus_df(spark, [r for r in rows if r[0] < 2]), src, num_partitions=2)
    first = run_standing_search(spark, src, seqs_df(spark, seqs), out, ck, max_files_per_trigger=1).count()
    write_corpus(corpus_df(spark, [r for r in rows if r[0] >= 2]), src, num_partitions=2)
    inc = run_standing_search(spark, src, seqs_df(spark, seqs), out, ck, max_files_per_trigger=1)
    again = run_standing_search(spark, src, seqs_df(spark, seqs), out, ck)          # nothing new: same output
    batch = fo.dedup_hits(fo.find_sequences(corpus_df(spark, rows), seqs_df(spark, seqs), None))
    key = lambda r: (r.shard, r.sample_index, r.token_offset, r.seq_ord)
    want = sorted(map(key, batch.collect()))
    assert 0 < first < len(want)
    assert sorted(map(key, inc.collect())) == want
    assert sorted(map(key, again.collect())) == want
