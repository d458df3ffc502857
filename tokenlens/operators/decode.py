"""Token ids -> token strings and decoded text, through a join with the vocabulary table.

Byte-level vocabularies decode by concatenating token *bytes* and decoding once
(``make_valid_utf8`` turns split multi-byte characters into U+FFFD, as a lenient decoder does).
Word vocabularies decode by joining token strings with a separator.

Texts of id arrays are decoded inside the row: the vocabulary goes to every Python worker as one array
in the order of ids, and Arrow's kernels look a batch's ids up and join them. So a row is neither
exploded nor shuffled. The array is read to the driver once, behind a check of its rows and bytes
(``DENSE_ROWS``, ``DENSE_BYTES``). Of a larger vocabulary the frequent tokens go to the workers, and the
others are joined to the samples that hold them (:func:`with_words`): a sample is shuffled once, not each
of its contexts. Rows whose samples are not at hand are joined by the token id."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import Ranks
from ..plans.strategy import checked_broadcast
from .postings import GROUP_TOKENS, NO_TOKEN, sample_runs

DENSE_ROWS, DENSE_BYTES = 1 << 20, 16 << 20
WORDS = "array<struct<token_id:int,token:string>>"


def _vocab_side(vocab: DataFrame, bounded: bool) -> DataFrame:
    v = vocab.select("token_id", "token", "token_bytes")
    if bounded:   # e.g. a 16-bit vocabulary: at most 65,536 rows by construction
        return F.broadcast(v)
    return checked_broadcast(v)[0]


def _text_of(toks: Column, part: int, joiner: str, byte_level: bool) -> Column:
    mine = F.filter(toks, lambda x: (x["part"] == part) & x["pos"].isNotNull())
    if byte_level:
        raw = F.aggregate(mine, F.lit(b"").cast("binary"), lambda acc, x: F.concat(acc, F.coalesce(x["token_bytes"], F.lit(b"").cast("binary"))))
        return F.make_valid_utf8(raw.cast("string"))
    return F.array_join(F.transform(mine, lambda x: x["token"]), joiner)


def frequent_from(words: DataFrame, most_rows: int, most_bytes: int) -> int:
    """The power of two from which on a word (``token_bytes, n``) counts as frequent: the smallest with
    at most ``most_rows`` such words of ``most_bytes`` in all. One row per power is read."""
    by_power = words.groupBy((F.length(F.bin("n")) - 1).alias("power")).agg(
        F.count(F.lit(1)).alias("rows"), F.sum(F.length("token_bytes")).alias("size")).collect()
    rows = size = 0
    for r in sorted(by_power, key=lambda r: -r.power):
        rows, size = rows + r.rows, size + r["size"]
        if rows > most_rows or size > most_bytes:
            return 1 << (r.power + 1)
    return 1


def with_words(corpus: DataFrame, vocab: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``corpus`` and the vocabulary (``token, token_id, token_bytes, n``) for decoding parts of its samples. Where
    the vocabulary may not go to every worker, what is returned of it are its frequent tokens, and each
    sample has its other ones in a column ``words``. Of these, a row for each sample and distinct
    token is joined to the vocabulary and meets its sample in one shuffle by sample."""
    least = frequent_from(vocab, DENSE_ROWS, DENSE_BYTES)
    if least == 1:
        return corpus, vocab
    frequent, place = vocab.where(F.col("n") >= least), ["shard", "sample_index"]
    shared = corpus.sparkSession.sparkContext.broadcast(Ranks(np.sort(frequent.select("token_id").toArrow()["token_id"].to_numpy())))

    def rare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, n, tokens in sample_runs(batch, GROUP_TOKENS):
                at = np.flatnonzero(shared.value.at(tokens) < 0)
                pairs = np.unique(np.repeat(np.arange(len(n)), n)[at] << 32 | tokens[at].astype(np.int64))
                row, ids = pa.array(pairs >> 32), (pairs & 0xFFFFFFFF).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column("shard").take(row), part.column("sample_index").take(row), pa.array(ids)],
                                                 names=[*place, "token_id"])

    samples = corpus.select(*place, "token_ids")
    own = samples.mapInArrow(rare, "shard int, sample_index int, token_id int").join(
        vocab.where(F.col("n") < least).select("token_id", "token"), "token_id")
    rows = samples.select("*", F.lit(None).cast("struct<token_id:int,token:string>").alias("word")).unionByName(
        own.select(*place, F.lit(None).cast("array<int>").alias("token_ids"), F.struct("token_id", "token").alias("word")))
    met = rows.repartition(*place).groupBy(*place).agg(F.first("token_ids", ignorenulls=True).alias("token_ids"), F.collect_list("word").alias("words"))
    return met, frequent


def words_at(words: pa.Array, row: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """Which of ``ids`` are among the ``words`` of their ``row``, and these words."""
    own = pc.list_flatten(words)
    n = pc.list_value_length(words).to_numpy(zero_copy_only=False)
    key = np.repeat(np.arange(len(n)), n) << 32 | pc.struct_field(own, "token_id").to_numpy(zero_copy_only=False).astype(np.int64)
    order = np.argsort(key)
    key = key[order]
    wanted = row << 32 | ids.astype(np.int64)
    at = np.searchsorted(key, wanted)
    places = np.flatnonzero(np.append(key, -1)[at] == wanted)
    return places, own.take(pa.array(order[at[places]]))


def words_between(located: tuple[np.ndarray, pa.Array], left: np.ndarray, right: np.ndarray) -> pa.Array:
    """For each pair, the words (of :func:`words_at`) at positions from ``left`` to before ``right``."""
    places, words = located
    low, high = np.searchsorted(places, left), np.searchsorted(places, right)
    ends = np.cumsum(high - low)
    at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(low - (ends - (high - low)), high - low)
    return pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), words.take(pa.array(at)))


def vocabulary_array(vocab: DataFrame, field: str) -> tuple[Ranks, pa.Array] | None:
    """Token ids and their ``field`` in order of ids, if there are few enough."""
    own = vocab.select("token_id", F.col(field).cast("binary").alias("value")).where("token_id >= 0")
    n, size = own.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("value")), F.lit(0))).first()
    if n > DENSE_ROWS or size > DENSE_BYTES:
        return None
    found = own.toArrow()
    found = found.take(pa.array(np.unique(found["token_id"].to_numpy(), return_index=True)[1]))
    values = found["value"].combine_chunks().cast(pa.large_binary())
    return Ranks(found["token_id"].to_numpy()), values if isinstance(values, pa.Array) else pa.concat_arrays(values.chunks)


def joined_tokens(ids: pa.Array, known: tuple[Ranks, pa.Array], separator: bytes, words: pa.Array | None = None) -> pa.Array:
    """Binary texts of a list column of ids, by the vocabulary or else by the row's ``words``; unknown ids
    are left out, a null list is empty."""
    sizes = pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False)
    flat = pc.fill_null(pc.list_flatten(ids), NO_TOKEN).to_numpy(zero_copy_only=False)
    at = known[0].at(flat)
    tokens = known[1].take(pa.array(at, mask=at < 0))
    if words is not None:
        others = np.flatnonzero(at < 0)
        found, own = words_at(words, np.searchsorted(np.cumsum(sizes), others, side="right"), flat[others])
        source = np.full(len(flat), -1, np.int64)
        source[others[found]] = np.arange(len(found))
        tokens = pc.coalesce(tokens, pc.struct_field(own, "token").cast(pa.large_binary()).take(pa.array(source, mask=source < 0)))
    known_here = pc.is_valid(tokens).to_numpy(zero_copy_only=False)
    offsets = np.concatenate([[0], np.cumsum(known_here)])[np.concatenate([[0], np.cumsum(sizes)])]
    lists = pa.LargeListArray.from_arrays(pa.array(offsets, pa.int64()), tokens.drop_null())
    return pc.binary_join(lists, pa.scalar(separator, pa.large_binary()))


def decode_arrays(df: DataFrame, keys: list[str], arrays: list[str], vocab: DataFrame, joiner: str = " ",
                  byte_level: bool = False, suffix: str = "_text", vocab_bounded: bool = False) -> DataFrame:
    """Add ``<array><suffix>`` text columns decoding each id-array column of ``df``. Ids that the
    vocabulary lacks are left out, but for those that a row has in ``words`` (:func:`with_words`, dropped
    here); a null array decodes to an empty text. ``keys`` must identify rows
    where the vocabulary is too large to decode in the row."""
    known = vocabulary_array(vocab, "token_bytes" if byte_level else "token")
    if known is None:
        return decode_arrays_by_join(df, keys, arrays, vocab, joiner, byte_level, suffix, vocab_bounded)
    shared = df.sparkSession.sparkContext.broadcast(known)   # DENSE_BYTES at most
    texts = [c + suffix for c in arrays]
    kept = [c for c in df.columns if c != "words"]
    schema = df.select(*kept, *[F.lit(b"").alias(c) for c in texts]).schema
    separator = b"" if byte_level else joiner.encode()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column("words") if "words" in batch.schema.names else None
            joined = [joined_tokens(batch.column(c), shared.value, separator, words).cast(pa.binary()) for c in arrays]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], *joined], names=[*kept, *texts])

    out = df.mapInArrow(run, schema)
    readable = (lambda c: F.make_valid_utf8(F.col(c).cast("string"))) if byte_level else (lambda c: F.col(c).cast("string"))
    return out.withColumns({c: readable(c) for c in texts})


def decode_arrays_by_join(df: DataFrame, keys: list[str], arrays: list[str], vocab: DataFrame, joiner: str = " ",
                          byte_level: bool = False, suffix: str = "_text", vocab_bounded: bool = False) -> DataFrame:
    """The same by joins. ``keys`` must identify rows. All arrays of a row are exploded together, joined once to the
    vocabulary, and regrouped by the row key (a bounded group: the row's own tokens)."""
    carry = [c for c in df.columns if c not in keys]
    parts = F.array(*[F.struct(F.lit(i).alias("part"), F.col(c).alias("ids")) for i, c in enumerate(arrays)])
    v = _vocab_side(vocab, vocab_bounded)
    # All ids of a row are exploded together and joined once to the vocabulary. The other
    # columns ride on exactly one exploded row (null on the rest), so nothing is joined back,
    # and partial aggregation folds a row's tokens together inside the task that exploded them:
    # the shuffle carries one row per input row.
    ex = df.select(*keys, F.struct(*carry).alias("_c"), F.explode(parts).alias("P")).select(
        *keys, "_c", F.col("P.part").alias("part"), F.posexplode_outer("P.ids").alias("pos", "token_id"))
    lead = (F.col("part") == 0) & (F.col("pos").isNull() | (F.col("pos") == 0))
    ex = ex.select(*keys, F.when(lead, F.col("_c")).alias("_c"), "part", "pos", "token_id")
    # only the field the decode needs travels through the aggregation
    j = ex.join(v.select("token_id", "token_bytes" if byte_level else "token"), "token_id", "left")
    field = "token_bytes" if byte_level else "token"
    g = j.groupBy(*keys).agg(F.first("_c", ignorenulls=True).alias("_c"),
                             F.array_sort(F.collect_list(F.struct("part", "pos", field))).alias("_toks"))
    texts = [_text_of(F.col("_toks"), i, joiner, byte_level).alias(c + suffix) for i, c in enumerate(arrays)]
    return g.select(*keys, *[F.col(f"_c.{c}").alias(c) for c in carry], *texts)


def ids_to_tokens(df: DataFrame, keys: list[str], array_col: str, vocab: DataFrame, out: str = "tokens",
                  vocab_bounded: bool = False) -> DataFrame:
    """An id array -> the array of token strings, order kept."""
    ex = df.select(*keys, F.posexplode_outer(array_col).alias("pos", "token_id"))
    j = ex.join(_vocab_side(vocab, vocab_bounded), "token_id", "left")
    g = j.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("pos", "token"))).alias("_t"))
    toks = F.transform(F.filter("_t", lambda x: x["pos"].isNotNull()), lambda x: x["token"])
    return df.join(g.select(*keys, toks.alias(out)), keys, "left")
