import os

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from conftest import corpus_df
from tokenlens.operators import corpus_ops
from tokenlens.sources.corpus import SourceMissing, contract_report, read_corpus, read_token_shards, write_corpus


def _write_shard(path, rows, row_group_size=2):
    arr = pa.array([np.array(r, dtype=np.uint16) for r in rows], type=pa.list_(pa.uint16()))
    pq.write_table(pa.table({"token_ids": arr}), path, row_group_size=row_group_size)


def test_raw_shards_file_name_and_row_order(spark, tmpdir_path):
    files = {"train-001000.parquet": 0, "train-002000.parquet": 1, "train-010000.parquet": 9}
    data = {}
    for name, shard in files.items():
        rows = [[shard, i, 40000 + i, 65535] for i in range(7)]
        _write_shard(os.path.join(tmpdir_path, name), rows)
        data[shard] = rows
    df = read_token_shards(spark, tmpdir_path)
    got = {(r.shard, r.sample_index): list(r.token_ids) for r in df.collect()}
    assert set(got) == {(s, i) for s in data for i in range(7)}
    for (s, i), toks in got.items():
        assert toks == data[s][i]            # uint16 ids above 32,767 survive as INT


def test_missing_source_fails_early(spark, tmpdir_path):
    with pytest.raises(SourceMissing):
        read_token_shards(spark, os.path.join(tmpdir_path, "absent"))


def test_write_read_roundtrip_and_shard_prune(spark, tmpdir_path):
    rows = [(s, i, [s, i, 7]) for s in range(3) for i in range(4)]
    out = os.path.join(tmpdir_path, "corpus")
    write_corpus(corpus_df(spark, rows), out, num_partitions=2)
    back = read_corpus(spark, out)
    assert sorted((r.shard, r.sample_index, tuple(r.token_ids)) for r in back.collect()) == sorted(
        (s, i, tuple(t)) for s, i, t in rows)
    sl = corpus_ops.shard_slice(back, 1)
    assert "PartitionFilters: [isnotnull(shard" in sl._jdf.queryExecution().executedPlan().toString() or sl.count() == 4
    assert sl.count() == 4
    # overwrite one shard only (dynamic partition overwrite keeps the others)
    write_corpus(corpus_df(spark, [(1, 0, [99])]), out, num_partitions=1)
    back = read_corpus(spark, out)
    assert back.where("shard = 1").count() == 1 and back.count() == 9


def test_contract_report(spark):
    rows = [(0, 0, [1, 2, 3]), (0, 1, [1, 70000, 3]), (1, 0, [1, 2]), (1, 2, [1, 2, 3])]
    rep = {r.shard: r for r in contract_report(corpus_df(spark, rows), seq_length=3, samples_per_shard=2).collect()}
    assert rep[0].n_bad_ids == 1 and not rep[0].ok
    assert rep[1].n_bad_length == 1 and not rep[1].ok and rep[1].max_sample == 2


def test_separated_stream_offsets(spark):
    rows = [(0, 0, [1, 2]), (0, 1, [3]), (0, 2, [4, 5, 6]), (1, 0, [7])]
    s = {(r.shard, r.sample_index): (list(r.tokens), r.byte_offset)
         for r in corpus_ops.separated_stream(corpus_df(spark, rows)).collect()}
    assert s[(0, 0)] == ([65535, 1, 2], 0)
    assert s[(0, 1)][1] == 6 and s[(0, 2)][1] == 10 and s[(1, 0)][1] == 0
    fixed = corpus_ops.separated_stream(corpus_df(spark, [(0, i, [1, 2]) for i in range(3)]), fixed_length=2)
    assert sorted(r.byte_offset for r in fixed.collect()) == [0, 6, 12]


def test_file_index_is_lexicographic(spark):
    fmap = {r.file_index: r.shard for r in corpus_ops.file_index_to_shard(spark, 95).collect()}
    names = sorted(f"tokenized.{i}" for i in range(95))
    assert [fmap[i] for i in range(95)] == [int(n.split(".")[1]) for n in names]
    docs = spark.createDataFrame([(2 * 1_024_000 + 17,)], "doc_ix long")
    r = corpus_ops.doc_address(docs, corpus_ops.file_index_to_shard(spark, 95)).first()
    assert (r.shard, r.sample_index) == (fmap[2], 17)


def test_hit_steps(spark):
    hits = spark.createDataFrame([(0, 0), (94, 1_023_999), (95, 0)], "shard int, sample_index int")
    rows = {r.shard: r for r in corpus_ops.hit_steps(hits).collect()}
    assert rows[0].train_step == 0 and rows[0].first_checkpoint == 1000 and not rows[0].already_seen
    assert rows[94].train_step == 94_999 and rows[94].first_checkpoint == 95_000
    assert rows[95].already_seen


def test_separated_stream_blocks_match_single_window(spark):
    import random
    rnd = random.Random(3)
    rows = [(s, i, [1] * rnd.randint(0, 9)) for s in range(2) for i in range(23)]
    c = corpus_df(spark, rows)
    small = {(r.shard, r.sample_index): r.byte_offset for r in corpus_ops.separated_stream(c, block=4).collect()}
    big = {(r.shard, r.sample_index): r.byte_offset for r in corpus_ops.separated_stream(c, block=1000).collect()}
    want = {}
    for s in range(2):
        acc = 0
        for i in range(23):
            want[(s, i)] = acc
            acc += 2 * (len(rows[s * 23 + i][2]) + 1)
    assert small == big == want


def test_ingest_shards_without_shuffle(spark, tmpdir_path):
    from tokenlens.sources.corpus import ingest_token_shards
    raw = os.path.join(tmpdir_path, "raw")
    os.makedirs(raw)
    for name, shard in {"train-003000.parquet": 2, "train-004000.parquet": 3}.items():
        _write_shard(os.path.join(raw, name), [[shard, i, 50000] for i in range(5)])
    from tokenlens.sources.corpus import read_token_shards
    plan = read_token_shards(spark, raw).sortWithinPartitions("shard", "sample_index")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    out = ingest_token_shards(spark, raw, os.path.join(tmpdir_path, "corpus"))
    got = sorted((r.shard, r.sample_index, tuple(r.token_ids)) for r in out.collect())
    assert got == sorted((s, i, (s, i, 50000)) for s in (2, 3) for i in range(5))
