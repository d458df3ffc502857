"""A small character vocabulary derived from ``documents``, with merges, and the words of ``benchmark``
as queries: the general cover path (any segmentation, merge pairs pruned) on data that SQL can follow.

The vocabulary has every character of the documents' and queries' words and the most frequent two- and
three-character strings; a pair of tokens whose concatenation is a token is a merge.

A string inside a word is a string of the text without a space, so the documents' strings are counted
where their texts are read; only the counts are shuffled, neither words nor occurrences."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ranking import dense_ids
from ..session import checkpoint as _ckpt
from ..sources.tables import read_table
from ..sources.wordcorpus import split_words
from .oracle_sql import WORDS

PAIRS, TRIPLES = 80, 40   # a fixed bound of the vocabulary
LONGEST = 3
# Strings are counted for so many characters at a time, in an array of so many counters or else sorted.
SLICE_CHARS, COUNTERS = 1 << 21, 1 << 23


def _words(table: DataFrame) -> DataFrame:
    return table.select(F.explode(split_words("text")).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("c"))


def _grams(words: DataFrame, k: int) -> DataFrame:
    at = F.when(F.length("word") >= k, F.sequence(F.lit(1), F.length("word") - k + 1)).otherwise(F.array().cast("array<int>"))
    return words.select(F.explode(F.transform(at, lambda p: F.substring(F.col("word"), p, F.lit(k)))).alias("token"), "c")


def _slices(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[np.ndarray, int]]:
    """Code points of all texts, a space between two, and how many of them strings start at: ``most`` at
    most, with the characters after them that such a string may reach into."""
    def cut(texts: list[str]) -> Iterator[tuple[np.ndarray, int]]:
        joined = " ".join(texts)
        for at in range(0, len(joined), most):
            yield np.frombuffer(joined[at:at + most + LONGEST - 1].encode("utf-32-le"), "<u4"), min(most, len(joined) - at)

    waiting, size = [], 0
    for batch in batches:
        for text in batch.column(0).drop_null():
            waiting.append(text.as_py())
            size += len(waiting[-1])
            if size >= most:
                yield from cut(waiting)
                waiting, size = [], 0
    yield from cut(waiting)


def gram_counts(texts: DataFrame, slice_chars: int = SLICE_CHARS, counters: int = COUNTERS) -> DataFrame:
    """``token, c``: occurrences of every string of 1 to ``LONGEST`` characters inside the words of ``text``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, place = np.zeros(0x110000, bool), np.zeros(0x110000, np.int64)
        for points, starts in _slices(batches, slice_chars):
            seen[points] = True
            chars = np.flatnonzero(seen).astype("<u4")
            seen[chars] = False
            place[chars] = np.arange(len(chars))
            digits = place[points]
            keys = np.zeros(len(digits), np.int64)
            for k in range(1, LONGEST + 1):
                keys = keys[:len(digits) - k + 1] * len(chars) + digits[k - 1:]
                if len(chars) ** k <= counters:
                    n = np.bincount(keys[:starts])
                    found = np.flatnonzero(n)
                    n = n[found]
                else:
                    found, n = np.unique(keys[:starts], return_counts=True)
                spelt = chars[found[:, None] // len(chars) ** np.arange(k - 1, -1, -1) % len(chars)]
                inside = (spelt != ord(" ")).all(axis=1)
                joined = spelt[inside].tobytes().decode("utf-32-le")
                tokens = pa.array([joined[i:i + k] for i in range(0, len(joined), k)], pa.string())
                yield pa.RecordBatch.from_arrays([tokens, pa.array(n[inside])], names=["token", "c"])

    counted = texts.select(F.make_valid_utf8("text").alias("text")).mapInArrow(run, "token string, c long")
    return counted.groupBy("token").agg(F.sum("c").alias("c"))


def char_vocab(documents: DataFrame, queries: DataFrame) -> DataFrame:
    """token, token_id (rank of the token), token_bytes."""
    counts = gram_counts(documents).transform(_ckpt)
    of = lambda k: counts.where(F.length("token") == k)
    tokens = of(1).unionByName(_grams(queries, 1)).select("token").distinct()
    for k, most in ((2, PAIRS), (3, TRIPLES)):
        tokens = tokens.unionByName(of(k).orderBy(F.desc("c"), "token").limit(most).select("token"))
    return dense_ids(tokens, "token", "token_id", id_type="int").select("token", "token_id", F.encode("token", "UTF-8").alias("token_bytes"))


def char_merges(vocab: DataFrame) -> DataFrame:
    """left, right of every pair of tokens that make a token."""
    cuts = vocab.where(F.length("token") > 1).select("token", F.explode(F.sequence(F.lit(1), F.length("token") - 1)).alias("k"))
    pairs = cuts.select(F.expr("left(token, k)").alias("left"), F.expr("substring(token, k + 1)").alias("right"))
    left, right = (vocab.select(F.col("token").alias(side)) for side in ("left", "right"))
    return pairs.join(left, "left", "left_semi").join(right, "right", "left_semi").select("left", "right")


def char_cover_input(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(targets, vocab, merges); a query of n characters may take n div 2 + 2 tokens."""
    words = _words(read_table(spark, sf_dir, "benchmark")).where(F.length("word") >= 3).transform(_ckpt)
    vocab = char_vocab(read_table(spark, sf_dir, "documents"), words).transform(_ckpt)
    numbered = dense_ids(words.select("word"), "word", "qid").select(F.col("qid").cast("long").alias("qid"), F.col("word").alias("target"))
    targets = numbered.select("qid", "target", F.col("target").alias("surface"),
                              (F.floor(F.length("target") / 2) + 2).cast("int").alias("max_depth")).transform(_ckpt)
    return targets, vocab, char_merges(vocab).transform(_ckpt)


CHAR_VOCAB = WORDS.split("vocab AS (")[0] + f"""
dw AS (SELECT word, count(*) AS c FROM words GROUP BY word),
bw AS (SELECT DISTINCT word FROM (SELECT unnest(string_split(text, ' ')) AS word FROM benchmark) WHERE length(word) >= 3),
grams AS (
  SELECT k, substr(word, p, k) AS token, sum(c) AS c
  FROM (SELECT k, word, c, unnest(range(1, length(word) - k + 2)) AS p FROM dw, (VALUES (1), (2), (3)) t(k)) GROUP BY ALL),
tok AS (
  SELECT token FROM grams WHERE k = 1
  UNION SELECT unnest(string_split(word, '')) FROM bw
  UNION (SELECT token FROM grams WHERE k = 2 ORDER BY c DESC, token LIMIT {PAIRS})
  UNION (SELECT token FROM grams WHERE k = 3 ORDER BY c DESC, token LIMIT {TRIPLES})),
cv AS (SELECT token, CAST(row_number() OVER (ORDER BY token) - 1 AS INTEGER) AS token_id FROM tok),
mg AS (SELECT a.token AS l, b.token AS r FROM cv a, cv b, cv c WHERE a.token || b.token = c.token),
tg AS (SELECT CAST(row_number() OVER (ORDER BY word) - 1 AS BIGINT) AS qid, word AS target, length(word) // 2 + 2 AS max_depth FROM bw),
tails AS (
  SELECT qid, target, max_depth, CAST(length(target) AS INTEGER) AS start, CAST(0 AS INTEGER) AS depth,
         CAST([] AS INTEGER[]) AS seq, CAST(NULL AS VARCHAR) AS first_token FROM tg
  UNION ALL
  SELECT t.qid, t.target, t.max_depth, CAST(t.start - length(v.token) AS INTEGER), CAST(t.depth + 1 AS INTEGER),
         list_prepend(v.token_id, t.seq), v.token
  FROM (SELECT tails.*, k FROM tails, (VALUES (1), (2), (3)) n(k) WHERE k <= start AND depth + 1 <= max_depth - 1) t
  JOIN cv v ON v.token = substr(t.target, t.start - t.k + 1, t.k)
  LEFT JOIN mg ON mg.l = v.token AND mg.r = t.first_token
  WHERE mg.l IS NULL)"""

TAILS_SQL = "WITH RECURSIVE " + CHAR_VOCAB + "\nSELECT qid, start, depth, seq FROM tails"

COVERS_SQL = "WITH RECURSIVE " + CHAR_VOCAB + """,
firsts AS (
  SELECT s.qid, s.i, v.token_id, v.token
  FROM (SELECT qid, target, unnest(range(1, length(target) + 1)) AS i FROM tg) s JOIN cv v ON suffix(v.token, substr(s.target, 1, s.i)))
SELECT tg.qid, [v.token_id] AS seq FROM tg JOIN cv v ON contains(v.token, tg.target)
UNION ALL
SELECT f.qid, list_prepend(f.token_id, t.seq) AS seq
FROM firsts f JOIN tails t ON t.qid = f.qid AND t.start = f.i AND t.depth >= 1 AND t.depth + 1 <= t.max_depth
LEFT JOIN mg ON mg.l = f.token AND mg.r = t.first_token
WHERE mg.l IS NULL"""
