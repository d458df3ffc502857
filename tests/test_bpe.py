"""BPE cover search: the properties the original tests assert, on the fixture tokenizer."""

import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from conftest import SF001
from tokenlens.functions.arrays import is_subsequence
from tokenlens.plans import bpe_search as B
from tokenlens.sources.bpecorpus import FIXTURE_TOKENIZER, bpe_corpus
from tokenlens.sources.vocab import byte_alphabet

TARGETS = ["the", " the", "the ", " the ", "the.", ".the", " the.", ".the ", " th.e ", "tion", "he", "er ", " th", "the and"]


@pytest.fixture(scope="module")
def bpe(spark):
    tc, merges, tj = bpe_corpus(spark, SF001)
    q = spark.createDataFrame(list(enumerate(TARGETS)), "qid long, target string")
    t = B.bpe_targets(q, tj).checkpoint()
    covers = {}
    for r in B.bpe_minimal_covers(tc, merges, t, tj, regex=None).collect():
        covers.setdefault(r.qid, []).append(list(r.seq))
    return tc, merges, tj, covers, Tokenizer.from_file(FIXTURE_TOKENIZER)


def test_every_target_has_minimal_roundtrip_covers(bpe):
    tc, merges, tj, covers, tok = bpe
    for q, target in enumerate(TARGETS):
        assert covers.get(q), target
        for seq in covers[q]:
            text = tok.decode(seq)
            assert target in text
            assert tok.encode(text, add_special_tokens=False).ids == seq
            for k in range(len(seq)):
                assert target not in tok.decode(seq[:k] + seq[k + 1:])


def test_exclusion_and_inclusion(bpe):
    tc, merges, tj, covers, tok = bpe
    q = TARGETS.index("the")
    assert tok.encode(".the ", add_special_tokens=False).ids not in covers[q]
    assert tok.encode("the", add_special_tokens=False).ids in covers[q]


@pytest.mark.parametrize("target,extended", [("the", ".the "), ("tion", ".tion "), (" the", " the ."), ("the.", " the. ")])
def test_some_cover_is_inside_extended_encoding(spark, bpe, target, extended):
    tc, merges, tj, covers, tok = bpe
    ext = tok.encode(extended, add_special_tokens=False).ids
    df = spark.createDataFrame([(s, ext) for s in covers[TARGETS.index(target)]], "s array<int>, e array<int>")
    assert df.where(is_subsequence(F.col("s"), F.col("e"))).count() > 0


def test_vocab_bytes_and_corpus_match_tokenizer(spark, bpe):
    tc, merges, tj, covers, tok = bpe
    alpha = byte_alphabet()
    assert sorted(alpha.values()) == list(range(256))
    for r in tc.vocab.where("not is_special").limit(300).collect():
        assert bytes(r.token_bytes) == bytes(alpha[c] for c in r.token)
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF001}/documents.parquet").limit(5).collect()}
    ids = {(r.shard * 100 + r.sample_index): list(r.token_ids) for r in tc.corpus.collect()}
    for d, text in docs.items():
        assert ids[d] == tok.encode(text, add_special_tokens=False).ids
    assert merges.where("rank = 0").first()["left"] is not None


@pytest.mark.parametrize("regex", ["default", None])
def test_canonical_plan_equals_enumeration(spark, bpe, regex):
    tc, merges, tj, covers, tok = bpe
    q = spark.createDataFrame(list(enumerate(TARGETS + ["and the", "tion er"])), "qid long, target string")
    t = B.bpe_targets(q, tj).checkpoint()
    a = {(r.qid, tuple(r.seq)) for r in B.bpe_minimal_covers(tc, merges, t, tj, regex=regex).collect()}
    b = {(r.qid, tuple(r.seq)) for r in B.bpe_minimal_covers_enumerated(tc, merges, t, tj, regex=regex).collect()}
    assert a == b and len(a) > 0


def test_word_canonical_plan_equals_enumeration(spark):
    from tokenlens.plans import registry as R, search as S
    tc, t = R._targets(spark, SF001)
    a = {(r.qid, tuple(r.seq)) for r in S.minimal_covers(tc, t, plan="canonical").collect()}
    b = {(r.qid, tuple(r.seq)) for r in S.minimal_covers_enumerated(tc, t).collect()}
    assert a == b and len(a) > 0


def test_bpe_queries_take_both_chunk_lengths(spark):
    """surface_form, as merge_pruned_paths, roundtrip_filter and search_text_bpe, on the whole search input."""
    from tokenlens.plans import registry, search
    wanted = {r.target for r in search.passage_targets(spark.read.parquet(f"{SF001}/benchmark.parquet")).collect()}
    got = {r.target for r in registry.surface_form(spark, SF001).collect()}
    assert got == wanted and {2, 4} <= {len(t.split(" ")) for t in got}
