"""Operator 11: language identification by compression.

Each learned language has a raw-content dictionary for zstandard: ``DICTIONARY`` bytes of passages of
its training texts. A text, in lower case and with every run of other characters than letters and
marks as one space, is cut into blocks of ``BLOCK_BYTES`` and every block is compressed with each
dictionary on its own, so that a very long text meets the dictionaries along its whole length and is
not carried by its own repetitions. The language of the smallest sum wins (ties: the first in
code-point order). ``margin`` is how much smaller it is than the second, as a share of the second;
the verdict is rejected (``accepted`` false) where the margin is under ``LEAST_MARGIN``.
``score`` is the winner's share when every two bytes more halve a language's weight.

The training sample is bounded: of every language ``documents_per_language`` rows, the first in hash
order, give passages of ``passage`` bytes in hash order, every document its first before any its
second, until the dictionary is full; of more than ``max_languages`` languages those with the most
rows are learned. So at most max_languages * DICTIONARY bytes reach the driver and the tasks. Only
rows of the training folds (crc32 of the id as text, modulo 3, other than 1) are learned from, and a
text is the only input of a prediction.

Null texts and texts without a letter are ``und`` with score 0, margin 0 and not accepted; so is every
text if there is nothing to learn from. Null langs and ids train nothing (a null id isn't held out);
rows that repeat an id each get a row; equal texts get equal verdicts; an empty table gives no rows.
Bytes that are not UTF-8 read as U+FFFD. Only ``doc_id``, ``text`` and ``lang`` are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, text_of
from .textgrams import blocks
from .toxicity import held_out

DICTIONARY, PASSAGE, BLOCK_BYTES, LEVEL = 1 << 16, 256, 4096, 6
LEAST_MARGIN = 0.02
UNKNOWN = "und"


@lru_cache(1)
def _others():
    import regex
    return regex.compile(r"[^\p{L}\p{M}]+"), regex.compile(r"\p{L}")


def letters(text: str) -> bytes:
    """The text's words of letters in lower case; empty without a letter."""
    others, letter = _others()
    return others.sub(" ", text.lower()).strip().encode() if letter.search(text) else b""


def passages(text: bytes, size: int) -> list[bytes]:
    return [text[k:k + size] for k in range(0, len(text), size)]


def _texts(column: pa.Array) -> Iterator[tuple[int, list[str]]]:
    """(first row, texts) of each block of whole texts."""
    for block in blocks(column):
        data, at = block.data.tobytes(), block.offsets.tolist()
        yield block.first, [data[x:y].decode("utf-8", "replace") for x, y in zip(at, at[1:])]


def training_passages(docs: DataFrame, documents_per_language: int, max_languages: int, passage: int, dictionary: int) -> DataFrame:
    """lang, turn, h, passage of the passages that make the dictionaries."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_of().alias("text"), F.col("lang").cast("string").alias("lang"))
    rows = rows.where("doc_id IS NOT NULL AND lang IS NOT NULL").where(~held_out()).select(
        "lang", F.xxhash64("doc_id", "text").alias("h"), "text")
    keys = rows.select("lang", "h")
    most = keys.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(max_languages)
    # hashes are uniform, so the first of n lie below a small share of their range: few rows meet by language
    share = F.col("h").cast("double") / 2.0 ** 64 + 0.5
    few = keys.join(F.broadcast(most), "lang").where(share <= 4.0 * documents_per_language / F.col("n")).select("lang", "h").distinct()
    first = few.withColumn("k", F.expr("row_number() OVER (PARTITION BY lang ORDER BY h)")).where(
        F.col("k") <= documents_per_language).select("lang", "h")
    sample = rows.join(F.broadcast(first), ["lang", "h"]).dropDuplicates(["lang", "h"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, hashes = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for at, texts in _texts(batch.column(2)):
                out = []
                for k, text in enumerate(texts, at):
                    own = passages(letters(text), passage)
                    # from a place of the text that its hash chooses, so that not only beginnings are learned
                    start = hashes[k] % len(own) if own else 0
                    out += [(langs[k], turn, hashes[k], p) for turn, p in enumerate((own[start:] + own[:start])[:dictionary // passage])]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(
                    zip(*out) if out else ((),) * 4, (pa.string(), pa.int32(), pa.int64(), pa.binary()))], names=["lang", "turn", "h", "passage"])

    found = sample.mapInArrow(run, "lang string, turn int, h long, passage binary")
    return found.withColumn("k", F.expr("row_number() OVER (PARTITION BY lang ORDER BY turn, h)")).where(
        F.col("k") <= dictionary // passage).drop("k")


def train(docs: DataFrame, documents_per_language: int = 1024, max_languages: int = 200, passage: int = PASSAGE,
          dictionary: int = DICTIONARY) -> dict[str, bytes]:
    """The dictionary of each language. What is nearest to its end is found cheapest, so the passages
    that come first in hash order are last."""
    held: dict[str, list] = {}
    for lang, turn, h, text in training_passages(docs, documents_per_language, max_languages, passage, dictionary).collect():
        held.setdefault(lang, []).append((turn, h, bytes(text)))
    return {lang: b" ".join(p for _, _, p in sorted(held[lang], reverse=True)) for lang in sorted(held)}


class Classifier:
    def __init__(self, dictionaries: dict[str, bytes], level: int = LEVEL):
        import zstandard as z
        self.langs, self.compressors = sorted(dictionaries), []
        for lang in self.langs:
            own = z.ZstdCompressionDict(dictionaries[lang], dict_type=z.DICT_TYPE_RAWCONTENT)
            own.precompute_compress(level=level)
            self.compressors.append(z.ZstdCompressor(level=level, dict_data=own, write_content_size=False, write_checksum=False, write_dict_id=False))

    def sizes(self, text: bytes) -> list[int]:
        parts = passages(text, BLOCK_BYTES)
        return [sum(len(c.compress(p)) for p in parts) for c in self.compressors]

    def classify(self, text: str) -> tuple[str, float, float]:
        """(language, score, margin)."""
        clean = letters(text)
        if not clean or not self.langs:
            return UNKNOWN, 0.0, 0.0
        sizes = self.sizes(clean)
        best = min(sizes)
        second = min(sizes[:(k := sizes.index(best))] + sizes[k + 1:], default=None)
        margin = (second - best) / second if second is not None else 1.0
        return self.langs[k], 1 / sum(0.5 ** min(200.0, (s - best) / 2) for s in sizes), margin


def classify(docs: DataFrame, dictionaries: dict[str, bytes], least_margin: float = LEAST_MARGIN) -> DataFrame:
    """doc_id, lang_pred, score, margin and accepted of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(dictionaries)  # bounded: see the module's text
    made: list[Classifier] = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not made:
            made.append(Classifier(shared.value))
        for batch in batches:
            for first, texts in _texts(batch.column(1)):
                langs, scores, margins = zip(*map(made[0].classify, texts))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, len(texts)), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(margins, pa.float64())],
                    names=["doc_id", "lang_pred", "score", "margin"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.make_valid_utf8(text_of()).alias("text"))
    found = rows.mapInArrow(run, "doc_id long, lang_pred string, score double, margin double")
    return found.withColumn("accepted", (F.col("lang_pred") != UNKNOWN) & (F.col("margin") >= least_margin))


def op11_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return classify(docs, train(docs)).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "margin", "accepted")
