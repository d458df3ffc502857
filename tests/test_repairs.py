"""Numbering, invalidation, vocabulary files and patterns at their edges."""

import json
import os
import re

import pytest
from pyspark.sql import functions as F

from tokenlens.functions.pyregex import py_boundary_pattern, py_regex_search
from tokenlens.functions.text import display_line
from tokenlens.operators import find as find_ops
from tokenlens.plans.needles import passage_sequences
from tokenlens.plans.search import passage_targets
from tokenlens.session import fingerprint
from tokenlens.sources.vocab import load_tokenizer_tables

from conftest import corpus_df


def test_numbers_do_not_collide_for_large_item_ids(spark):
    words = ["a", "b", "c", "d", "e", "f", "g", "h"]
    vocab = spark.createDataFrame(list(zip(words, range(8))), "token string, token_id int")
    passages = spark.createDataFrame([(0, "a b c d"), (10000, "e f g h"), (9999, "c d")], "item_id long, text string")
    seqs = passage_sequences(passages, vocab)
    rows = seqs.collect()
    assert len(rows) == len({r.seq_ord for r in rows}) == 8
    assert [r.seq_ord for r in sorted(rows, key=lambda r: (r.r, r.item_id, r.chunk))] == sorted(r.seq_ord for r in rows)
    ids = {(r.qid, r.target) for r in passage_targets(passages).collect()}
    assert len(ids) == 8 and {(r.seq_ord, " ".join(words[t] for t in r.seq)) for r in rows} <= ids
    corpus = corpus_df(spark, [(0, 0, list(range(8)))])
    stats = spark.createDataFrame([(i, 1) for i in range(8)], "token_id int, n long")
    hits = find_ops.find_sequences(corpus, seqs, stats).collect()
    assert sorted((h.token_offset, len(h.sequence)) for h in hits) == [(0, 2), (0, 4), (2, 2), (2, 2), (2, 2), (4, 2), (4, 4), (6, 2)]


def test_the_earliest_sequence_survives_whatever_the_column_order(spark):
    hits = spark.createDataFrame([(0, 0, 5, [9, 9], 1), (0, 0, 5, [1, 1], 2)],
                                 "shard int, sample_index int, token_offset int, sequence array<int>, seq_ord long")
    assert find_ops.dedup_hits(hits).first().seq_ord == 1


def test_search_for_more_needles_than_may_be_broadcast(spark):
    corpus = corpus_df(spark, [(0, 0, [1, 2, 3, 1, 2]), (1, 0, [2, 3])])
    seqs = spark.createDataFrame([(0, [1, 2]), (1, [2, 3]), (2, [3])], "seq_ord long, seq array<int>")
    wanted = sorted(map(tuple, find_ops.find_sequences(corpus, seqs).select("shard", "token_offset", "seq_ord").collect()))
    spark.conf.set("tokenlens.broadcast.maxRows", "1")
    try:
        needles, n = find_ops.prepare_needles(seqs, None)
        got = find_ops.search_prepared(corpus, needles, n).select("shard", "token_offset", "seq_ord")
        assert sorted(map(tuple, got.collect())) == wanted
    finally:
        spark.conf.unset("tokenlens.broadcast.maxRows")


def test_the_fingerprint_follows_every_file(spark, tmp_path):
    folder = tmp_path / "t.parquet" / "day=1"
    folder.mkdir(parents=True)
    (folder / "part-0").write_text("one")
    before = fingerprint(spark, str(tmp_path / "t.parquet"))
    assert before == fingerprint(spark, str(tmp_path / "t.parquet"))
    (folder / "part-0").write_text("three")
    assert before != fingerprint(spark, str(tmp_path / "t.parquet"))


@pytest.mark.parametrize("merges", [["a b", "[ b"], [["a", "b"], ["[", "b"]]])
def test_added_tokens_and_both_forms_of_merges(spark, tmp_path, merges):
    path = os.path.join(tmp_path, "tokenizer.json")
    with open(path, "w") as f:
        json.dump({"model": {"vocab": {"a": 0, "Ġb": 1, "é x": 2}, "merges": merges},
                   "added_tokens": [{"id": 2, "content": "é x", "special": False}, {"id": 7, "content": "<end>", "special": True}]}, f)
    vocab, pairs = load_tokenizer_tables(spark, path)
    got = {r.token_id: (r.token, bytes(r.token_bytes), r.is_special) for r in vocab.collect()}
    assert got == {0: ("a", b"a", False), 1: ("Ġb", b" b", False), 2: ("é x", "é x".encode(), False), 7: ("<end>", b"<end>", True)}
    assert [(r.rank, r.left, r.right) for r in pairs.orderBy("rank").collect()] == [(0, "a", "b"), (1, "[", "b")]


def test_patterns_mean_what_python_means(spark):
    texts = ["é", "a.b", "axb", "x\\Ey", "(1+1)", "[a]-b c"]
    frame = spark.createDataFrame([(t, q) for t in texts for q in texts], "t string, q string")
    rows = frame.select("t", "q", py_regex_search(F.col("t"), F.lit(r"^\w$")).alias("w"),
                        py_regex_search(F.col("t"), py_boundary_pattern(F.col("q"), literal=True)).alias("l")).collect()
    for r in rows:
        assert r.w == bool(re.search(r"^\w$", r.t))
        assert r.l == bool(re.search(r"\b" + re.escape(r.q) + r"\b", r.t)), (r.t, r.q)


def test_a_hit_without_context_is_displayed_as_such(spark):
    row = spark.range(1).select(display_line(F.lit(1), F.lit(2), F.lit(3), *[F.lit(None).cast("string")] * 3).alias("d")).first()
    assert "null" not in row.d and "none" in row.d
