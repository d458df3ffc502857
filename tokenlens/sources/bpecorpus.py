"""Byte-level BPE corpus of a text table: the batch encode job writes the token corpus once.

Same layout as the word corpus (``shard = doc_id div P``, ``sample_index = doc_id mod P``), ids
from the tokenizer file, vocabulary and merges read from the same file. Keyed by the text
table's fingerprint and the tokenizer's content hash."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

from ..operators.encode import encode_texts
from ..session import apply_runtime_conf, fingerprint, is_done, mark_done, materialize, shared_dir
from .corpus import by_shard, read_corpus, write_whole_shards
from .tables import read_table, table_path
from .vocab import load_tokenizer_tables, tokenizer_json, tokenizer_key
from .wordcorpus import DEFAULT_SAMPLES_PER_SHARD, TokenCorpus, token_stats_of

FIXTURE_TOKENIZER = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "resources",
                                 "bytebpe-2k.json")


def bpe_corpus(spark: SparkSession, sf_dir: str, tokenizer_path: str = FIXTURE_TOKENIZER,
               samples_per_shard: int = DEFAULT_SAMPLES_PER_SHARD) -> tuple[TokenCorpus, object, str]:
    """Returns (corpus bundle, merges table, tokenizer JSON text)."""
    apply_runtime_conf(spark)
    tj = tokenizer_json(tokenizer_path)
    src = table_path(sf_dir, "documents")
    key = fingerprint(spark, src, extra=f"bpe:{tokenizer_key(tj)}:{samples_per_shard}:v1")
    root = f"{shared_dir(spark)}/tokenlens/bpe_corpus/{key}"
    vocab, merges = load_tokenizer_tables(spark, tokenizer_path)
    vocab = materialize(vocab, f"{root}/vocab")
    merges = materialize(merges, f"{root}/merges")
    corpus_path = f"{root}/corpus"
    if not is_done(spark, corpus_path):
        docs = by_shard(read_table(spark, sf_dir, "documents").select("doc_id", "text"), samples_per_shard)
        write_whole_shards(encode_texts(docs, ["shard", "sample_index"], "text", tj, out="token_ids"), corpus_path)
        mark_done(spark, corpus_path)
    corpus = read_corpus(spark, corpus_path)
    stats = materialize(token_stats_of(corpus), f"{root}/token_stats")
    return TokenCorpus(corpus, vocab, stats, root, "", samples_per_shard), merges, tj
