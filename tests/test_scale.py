"""Work and memory that must not grow faster than the input, on small tables."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from conftest import SF001, corpus_df, seqs_df
from tokenlens.operators import encode
from tokenlens.operators import find as fo
from tokenlens.sources import wordcorpus
from tokenlens.sources.bpecorpus import FIXTURE_TOKENIZER
from tokenlens.sources.vocab import tokenizer_json


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_texts_are_encoded_a_few_at_a_time(spark):
    texts = ["", None, "a long text " * 40, "b", "c d", "é" * 30]
    batch = pa.record_batch({"text": pa.array(texts, pa.string())})
    sizes = [[len(t or "") for t in part.column(0).to_pylist()] for part in encode.text_slices(batch, "text", 32)]
    assert sum(sizes, []) == [len(t or "") for t in texts]
    assert all(len(s) == 1 or sum(s) <= 32 for s in sizes) and len(sizes) < len(texts)
    tj, tok = tokenizer_json(FIXTURE_TOKENIZER), Tokenizer.from_file(FIXTURE_TOKENIZER)
    df = spark.createDataFrame(list(enumerate(texts)), "k long, text string").coalesce(1)
    for offsets in (False, True):
        rows = encode.encode_texts(df, ["k"], "text", tj, offsets=offsets, tokens=True, slice_chars=32).collect()
        assert [r.k for r in rows] == list(range(len(texts)))
        for r, t in zip(rows, texts):
            e = tok.encode(t or "", add_special_tokens=False)
            assert (r.ids, r.tokens) == (e.ids, e.tokens)
            assert not offsets or [tuple(o) for o in r.offsets] == e.offsets
    only = encode.encode_texts(df, ["k"], "text", tj, slice_chars=32).collect()
    assert [r.ids for r in only] == [tok.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_token_counts_shuffle_no_row_per_sample(spark):
    rnd = np.random.default_rng(5)
    rows = [(0, i, rnd.integers(0, 6, int(rnd.integers(0, 30))).tolist()) for i in range(40)]
    stats = wordcorpus.token_stats_of(corpus_df(spark, rows))
    want = {t: (sum(r[2].count(t) for r in rows), sum(t in r[2] for r in rows)) for t in range(6)}
    assert _plan(stats).count("Exchange") == 1
    assert {r.token_id: (r.n, r.n_samples) for r in stats.collect()} == want


def test_only_rare_words_leave_their_text(spark, monkeypatch, tmpdir_path):
    """Frequent words are looked up in the text, the others joined: the same corpus for any bound."""
    texts = {0: "a b a  c é", 1: "", 7: None, 102: "b b zz a", 205: " a", 206: "a b " * 30 + "once", 207: "c"}
    docs = spark.createDataFrame([*texts.items(), (207, "b c a")], "doc_id long, text string")   # one id twice
    words = sorted({w for r in docs.collect() if r.text is not None for w in r.text.split(" ")}, key=str.encode)
    want = {}
    for r in docs.collect():
        if r.text is not None:
            want.setdefault((r.doc_id // 100, r.doc_id % 100), []).extend((i, words.index(w)) for i, w in enumerate(r.text.split(" ")))
    want = {k: [t for _, t in sorted(v)] for k, v in want.items()}
    for k, (rows, chars) in enumerate([(0, 1 << 20), (2, 8), (4, 1 << 20), (1 << 18, 8)]):
        monkeypatch.setattr(wordcorpus, "FREQUENT_ROWS", rows)
        monkeypatch.setattr(wordcorpus, "SLICE_CHARS", chars)
        tc = wordcorpus.build_word_corpus(spark, docs, f"{tmpdir_path}/{k}", 100)
        got = [((r.shard, r.sample_index), list(r.token_ids)) for r in tc.corpus.collect()]
        assert len(got) == len(want) and dict(got) == want
        assert [r.token for r in tc.vocab.orderBy("token_id").collect()] == words


def test_hits_are_deduplicated_in_their_sample(spark):
    """The same hits as by location over all of them, without a shuffle."""
    rnd = np.random.default_rng(11)
    corpus = corpus_df(spark, [(s, i, rnd.integers(0, 3, 25).tolist()) for s in range(2) for i in range(4)])
    seqs = [[0, 1, 2], [1], [1, 2], [0, 1], [2, 2, 1, 0], [2, 2], [0, 1], [2], [1, 1, 1], [0, 1, 2, 0], [9]]
    for order in (seqs, seqs[::-1]):
        key = ["shard", "sample_index", "token_offset", "seq_ord"]
        needles, stats = seqs_df(spark, order), wordcorpus.token_stats_of(corpus)
        raw = fo.find_sequences(corpus, needles, stats, context_len=2)
        want = sorted(map(str, fo.dedup_hits(raw).collect()))
        marked = fo.dedup_hits(fo.find_sequences(corpus, needles, stats, context_len=2, mark_first=True))
        assert marked.columns == fo.dedup_hits(raw).columns and "Exchange hash" not in _plan(marked)
        assert sorted(map(str, marked.collect())) == want and raw.count() > len(want)
        assert len({tuple(r) for r in marked.select(*key[:3]).collect()}) == len(want)


def test_standing_search_takes_many_small_files_in_a_batch(spark, tmpdir_path):
    from tokenlens.sources.corpus import write_corpus
    from tokenlens.streaming.standing_search import BATCH_BYTES, run_standing_search
    corpus = corpus_df(spark, [(s, 0, [s % 3, 1, 2]) for s in range(12)])
    write_corpus(corpus, f"{tmpdir_path}/corpus", num_partitions=2)
    seqs = seqs_df(spark, [[1, 2], [1]])
    got = run_standing_search(spark, f"{tmpdir_path}/corpus", seqs, f"{tmpdir_path}/hits", f"{tmpdir_path}/ck", max_bytes_per_trigger=BATCH_BYTES)
    want = fo.dedup_hits(fo.find_sequences(corpus, seqs)).select(*got.columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert spark.read.parquet(f"{tmpdir_path}/hits").select("epoch").distinct().count() == 1


def test_a_sequence_that_begins_with_another_owns_no_hits(spark):
    from tokenlens.plans.search import sequence_owners
    covers = spark.createDataFrame([(0, [1, 2, 3]), (0, [1, 2]), (0, [2]), (0, [2]), (1, [1, 2, 3])], "qid long, seq array<int>")
    ided = spark.createDataFrame([("1,2,3", 7), ("1,2", 8), ("2", 9)], "k string, seq_ord long")
    assert sorted(map(tuple, sequence_owners(covers, ided).select("qid", "seq_ord").collect())) == [(0, 8), (0, 9), (1, 7)]


def test_postings_are_grouped_within_their_sample(spark, monkeypatch):
    from tokenlens.operators import postings as P
    rnd = np.random.default_rng(2)
    rows = [(s, i, rnd.integers(0, 4, int(rnd.integers(0, 20))).tolist()) for s in range(2) for i in range(9)] + [(2, 0, [3, None, 3, 3])]
    corpus = spark.createDataFrame(rows, "shard int, sample_index int, token_ids array<int>")
    one, two = {}, {}
    for s, i, ids in rows:
        for p, t in enumerate(ids):
            one.setdefault((t, s, i), []).append(p)
            if p + 1 < len(ids) and ids[p + 1] is not None:
                two.setdefault((t, ids[p + 1], s, i), []).append(p)
    for most in (1, 7, 1 << 20):
        monkeypatch.setattr(P, "GROUP_TOKENS", most)
        for df, want in ((P.postings_of(corpus), one), (P.pair_postings_of(corpus), two)):
            assert "Exchange" not in _plan(df)
            got = [(tuple(r)[:-1], list(r.positions)) for r in df.collect()]
            assert dict(got) == want and len(got) == len(want)


def test_cover_candidates_do_not_shuffle_the_vocabulary(spark):
    from tokenlens.operators import cover
    words = ["a", "b", "xa", "ya b", "c", "xc", ""]
    vocab = spark.createDataFrame([(w, i, w.encode()) for i, w in enumerate(words)], "token string, token_id int, token_bytes binary")
    targets = spark.createDataFrame([(0, "a b", "a b", 5), (1, "a c b", "a c b", 6), (2, "a d", "a d", 5)],
                                    "qid long, target string, surface string, max_depth int")
    clean = vocab.where("token != 'ya b'")
    tails = cover.joiner_tails(targets, clean, " ")
    multi = cover.multi_token_candidates(cover.first_token_candidates(targets, clean, " "), tails)
    assert "Exchange hash" not in _plan(multi) and "SortMergeJoin" not in _plan(multi)
    got = {(r.qid, " ".join(r.toks)) for r in cover.cover_candidates(targets, clean, None, " ").collect()}
    assert got == {(0, "a b"), (0, "xa b"), (1, "a c b"), (1, "xa c b")}


def test_strings_are_counted_where_their_text_is_read(spark, monkeypatch):
    """The same counts as by words and positions, for any slice; no word of the documents is shuffled."""
    from tokenlens.plans import char_cover
    texts = ["abab ab  abc", "", None, " ", "a", "é\nab\x00\t", "\U0001f600\U0001f601\U0001f600 ß\x00\x00", "abcde" * 9, " zz zz zz ", "ab"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(2)
    words = char_cover._words(docs)
    want = {(r.token, r.c) for k in (1, 2, 3) for r in char_cover._grams(words, k).groupBy("token").agg(F.sum("c").alias("c")).collect()}
    for slice_chars, counters in ((1 << 20, 1 << 20), (1, 1 << 20), (3, 4), (7, 0), (1 << 20, 0)):
        counted = char_cover.gram_counts(docs, slice_chars, counters)
        assert _plan(counted).count("Exchange hash") == 1
        got = [(r.token, r.c) for r in counted.collect()]
        assert len(got) == len(want) and set(got) == want
    assert char_cover.gram_counts(docs.where("text IS NULL")).count() == 0
    plans = []
    monkeypatch.setattr(char_cover, "_ckpt", lambda df: plans.append(_plan(df)) or df)
    monkeypatch.setattr(char_cover, "PAIRS", 2)
    monkeypatch.setattr(char_cover, "TRIPLES", 1)
    vocab = char_cover.char_vocab(docs, spark.createDataFrame([("xab", 1)], "word string, c long"))
    chars = {c for t in texts for c in t or "" if c != " "} | set("xab")
    # 15 and 10 times the pairs ab and bc, 10 times the triple abc; the next come 9 times
    assert [(r.token, r.token_id) for r in vocab.orderBy("token_id").collect()] == [
        (t, i) for i, t in enumerate(sorted(chars | {"ab", "bc", "abc"}, key=str.encode))]
    assert plans and not any("partitioning(word" in p for p in plans)


def test_queries_over_the_vocabulary_build_no_corpus(spark, tmpdir_path):
    """The corpus and its statistics are written when they are first read, and then once."""
    from tokenlens.session import is_done
    docs = spark.createDataFrame([(0, "a b a"), (101, "b zz"), (102, None)], "doc_id long, text string")
    tc = wordcorpus.build_word_corpus(spark, docs, tmpdir_path, 100)
    built = lambda: [t for t in ("vocab", "corpus", "token_stats") if is_done(spark, f"{tmpdir_path}/{t}")]
    assert [r.token for r in tc.vocab.orderBy("token_id").collect()] == ["a", "b", "zz"] and built() == ["vocab"]
    assert sorted(tuple(r) for r in tc.token_stats.collect()) == [(0, 2, 1), (1, 2, 2), (2, 1, 1)]
    assert sorted((r.shard, r.sample_index, r.token_ids) for r in tc.corpus.collect()) == [(0, 0, [0, 1, 0]), (1, 1, [1, 2])]
    assert built() == ["vocab", "corpus", "token_stats"] and tc.corpus_path == f"{tmpdir_path}/corpus" and tc.is_there()


def test_labelled_hits_are_shuffled_once(spark):
    """The labels come by broadcast; what is shuffled are the hits, to their location."""
    from tokenlens.plans import registry
    _, lab, _ = registry._labelled(spark, SF001)
    assert _plan(lab).count("Exchange hash") == 1 and "SortMergeJoin" not in _plan(lab)
    stats = spark.createDataFrame([(t, 1, 1) for t in range(4)], "token_id int, n long, n_samples long")
    seqs = seqs_df(spark, [[0, 1], [2], [3, 9]])
    needles, n = fo.prepare_needles(seqs, stats)
    assert n == 2 and {(r.seq_ord, r.anchor_idx, r.anchor_token) for r in needles.collect()} == {(0, 0, 0), (1, 0, 2)}
