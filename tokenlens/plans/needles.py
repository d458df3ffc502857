"""Search input derived from a text table: token sequences cut from every passage.

Every passage of the needle table is tokenized whole and cut into consecutive chunks of each
requested length; chunks holding a word the corpus never saw are dropped (they cannot match).
Chunk lists for successive lengths follow each other in ``seq_ord``, so a shorter chunk that
starts where a longer one already matched loses the deduplication, as later sequences do.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ranking import dense_ids
from ..plans.strategy import checked_broadcast
from ..sources.wordcorpus import split_words

CHUNK = ["r", "item_id", "chunk"]   # rank of the length, passage, chunk of that length in it


def chunk_spec(lengths):
    """(rank, length) of every requested length: a literal array of fixed size, not a join."""
    return F.array(*[F.struct(F.lit(r).alias("r"), F.lit(k).alias("k")) for r, k in enumerate(lengths)])


def numbered_chunks(occ: DataFrame, lengths) -> DataFrame:
    """CHUNK columns and ``ord`` of every chunk of the word occurrences ``item_id, pos``: its place in
    the order of lengths, passages and chunks, counted without gaps for any number of either."""
    words = occ.groupBy("item_id").agg(F.max("pos").alias("last"))
    chunks = words.select("item_id", "last", F.explode(chunk_spec(lengths)).alias("L")).select(
        F.col("L.r").alias("r"), "item_id",
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor(F.col("last") / F.col("L.k")))).alias("chunk"))
    return dense_ids(chunks.select(*CHUNK, F.struct(*CHUNK).alias("key")), "key", "ord").drop("key")


def passage_sequences(passages: DataFrame, vocab: DataFrame, lengths=(4, 2),
                      id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    occ = passages.select(F.col(id_col).alias("item_id"), F.posexplode(split_words(text_col)).alias("pos", "word"))
    # The passage side is normally the small one: broadcast it (size checked) and stream the
    # vocabulary past it; past the bound this is a shuffle join on the word.
    ob, _ = checked_broadcast(occ)
    found = ob.join(vocab.select(F.col("token").alias("word"), "token_id"), "word")
    spec = chunk_spec(lengths)

    def chunked(df):
        return df.select("*", F.explode(spec).alias("L")).select(
            "*", F.col("L.r").alias("r"), F.floor(F.col("pos") / F.col("L.k")).alias("chunk"))

    total = chunked(occ).groupBy("r", "item_id", "chunk").agg(F.count(F.lit(1)).alias("nw"))
    seqs = chunked(found).groupBy("r", "item_id", "chunk").agg(
        F.array_sort(F.collect_list(F.struct("pos", "token_id"))).alias("p"))
    return (
        seqs.join(total, CHUNK)
        .where(F.size("p") == F.col("nw"))
        .join(numbered_chunks(occ, lengths), CHUNK)
        .select(F.col("ord").alias("seq_ord"), F.transform("p", lambda x: x["token_id"]).alias("seq"), *CHUNK)
    )
