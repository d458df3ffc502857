"""Operator 8: quality rules with cross-document line frequency.

Base rules count words, symbols, repeated lines and repeated 3-word windows of each whole text. The
method's own rule looks across documents: lines are normalised and hashed, the distinct documents
of each (host, line) are counted, lines found in more than ``max(min_documents, max_share * the
host's documents)`` documents of their host are removed, and a document is rejected as depleted if
its remaining words are fewer than ``min_words`` or than ``min_left`` of its words.

A document counts each of its lines once before any shuffle and counts are summed map-side, so a
line that a third of all documents share is one row per task; the look-up of removed lines is
salted by document on both sides. Texts never move: only hashes and counts are shuffled.

Null text has no words; a null host is a host of its own; a null doc_id keeps its own row; rows
that repeat a doc_id count as documents of their own; an empty table gives an empty result. Only
``doc_id``, ``text`` and the host column are read, other columns may have any name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WS_CLASS, Scratch, documents, lower_ascii, strip_ws, text_of

SALTS = 32


def _lines_with_words(text: str = "text"):
    return F.filter(F.split(text, "\n"), lambda line: strip_ws(line) != "")


def base_counts(docs: DataFrame) -> DataFrame:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of every row, added to it. The
    steps are separate projections, so that arrays are computed once per row."""
    words = F.when(strip_ws(F.col("text")) == "", F.array().cast("array<string>")).otherwise(
        F.split(strip_ws(F.col("text")), WS_CLASS + "+"))
    out = docs.withColumn("words", words).withColumn("word_lines", _lines_with_words())
    out = (out.withColumn("n_words", F.size("words").cast("bigint"))
           .withColumn("word_chars", F.length(F.array_join("words", "")).cast("bigint"))
           .withColumn("n_symbols", F.length(F.regexp_replace("text", r"[^#*$%&|<>]+", "")).cast("bigint"))
           .withColumn("n_dup_lines", (F.size("word_lines") - F.size(F.array_distinct("word_lines"))).cast("bigint"))
           .withColumn("windows", F.expr("""CASE WHEN size(words) < 3 THEN array() ELSE
               transform(sequence(0, size(words) - 3), i -> xxhash64(words[i], words[i + 1], words[i + 2])) END"""))
           .drop("words", "word_lines"))
    # only texts in which some window is repeated sort their windows to find which
    out = out.withColumn("sorted", F.expr("""CASE WHEN size(array_distinct(windows)) < size(windows)
        THEN array_sort(transform(windows, (h, i) -> named_struct('h', h, 'i', i))) END"""))
    out = out.withColumn("again", F.expr("""filter(transform(sorted, (w, k) ->
        CASE WHEN (k > 0 AND sorted[k - 1].h = w.h) OR (k < size(sorted) - 1 AND sorted[k + 1].h = w.h) THEN w.i END),
        i -> i IS NOT NULL)"""))
    return (out.withColumn("n_repeat_words", F.expr("""coalesce(size(array_distinct(flatten(
        transform(again, i -> array(i, i + 1, i + 2))))), 0)""").cast("bigint"))
        .withColumn("n_repeat_words", F.greatest("n_repeat_words", F.lit(0).cast("bigint")))
        .drop("windows", "sorted", "again"))


def line_profile(docs: DataFrame, host: str) -> DataFrame:
    """One row per row of ``docs``: row_id, doc_id, host, the base counts, and its lines as
    array<struct<h, words>> (hash of the normalised line, number of words)."""
    rows = docs.select(F.monotonically_increasing_id().alias("row_id"), F.col("doc_id"),
                       F.coalesce(F.col(host).cast("string"), F.lit("")).alias("host"), text_of().alias("text"))
    keys = F.filter(F.transform(F.split("text", "\n"), lambda line: F.regexp_replace(
        lower_ascii(strip_ws(line)), WS_CLASS + "+", " ")), lambda key: key != "")
    rows = rows.withColumn("keys", keys)
    lines = F.transform("keys", lambda key: F.struct(F.xxhash64(key).alias("h"), F.size(F.split(key, " ")).alias("words")))
    return base_counts(rows.withColumn("lines", lines).drop("keys")).drop("text")


def frequent_lines(profile: DataFrame, min_documents: int, max_share: float) -> DataFrame:
    """host, h of lines found in more distinct documents of their host than the limit."""
    hosts = profile.groupBy("host").agg(F.count(F.lit(1)).alias("documents"))
    counts = (profile.select("host", F.explode(F.array_distinct("lines.h")).alias("h"))
              .groupBy("host", "h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > min_documents))
    return counts.join(hosts, "host").where(F.col("n") > F.lit(max_share) * F.col("documents")).select("host", "h")


def line_rules(docs: DataFrame, min_documents: int = 20, max_share: float = 0.1, min_words: int = 50,
               min_left: float = 0.5, host: str = "source") -> DataFrame:
    """One row per row of ``docs``: doc_id, the base counts, n_removed_words, base_failed, kept."""
    scratch = Scratch(docs.sparkSession, "line-frequency")
    profile = scratch.write(line_profile(docs, host), "profile")
    removed = scratch.write(frequent_lines(profile, min_documents, max_share), "removed")
    salted = removed.select("host", "h", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    lines = profile.select("row_id", "host", F.pmod("row_id", F.lit(SALTS)).cast("int").alias("salt"), F.explode("lines").alias("line"))
    lines = lines.select("row_id", "host", "salt", "line.h", "line.words")
    gone = lines.join(salted, ["host", "h", "salt"]).groupBy("row_id").agg(F.sum("words").alias("n_removed_words"))
    out = profile.drop("lines").join(gone, "row_id", "left")
    out = out.withColumn("n_removed_words", F.coalesce("n_removed_words", F.lit(0).cast("bigint")))
    left = F.col("n_words") - F.col("n_removed_words")
    failed = (F.col("n_words") < 50) | (F.lit(100) * F.col("n_repeat_words") > F.lit(50) * F.col("n_words"))
    depleted = (left < min_words) | (left < F.lit(min_left) * F.col("n_words"))
    return (out.withColumn("base_failed", failed).withColumn("kept", ~failed & ~depleted)
            .select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                    "base_failed", "kept", "n_removed_words"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_rules(documents(spark, sf_dir))


ORACLE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM d),
win AS (
  SELECT r, i, concat_ws(' ', words[i], words[i + 1], words[i + 2]) AS t
  FROM (SELECT r, words, unnest(range(1, len(words) - 1)) AS i FROM w)),
again AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, t) AS c FROM win) WHERE c > 1),
rep AS (SELECT r, count(DISTINCT i + k) AS n FROM again, (SELECT unnest([0, 1, 2]) AS k) GROUP BY r),
line AS (SELECT r, host, unnest(string_split(text, chr(10))) AS line FROM d),
wordy AS (SELECT *, regexp_replace(regexp_replace(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), '[\x20\x09-\x0D]+', ' ', 'g') AS key FROM line),
keyed AS (SELECT *, len(string_split(key, ' ')) AS n FROM wordy WHERE key <> ''),
dup AS (SELECT r, count(*) - count(DISTINCT line) AS n FROM keyed GROUP BY r),
hosts AS (SELECT host, count(*) AS documents FROM d GROUP BY host),
freq AS (SELECT host, key FROM keyed JOIN hosts USING (host) GROUP BY host, key
  HAVING count(DISTINCT r) > 20 AND count(DISTINCT r) > 0.1 * any_value(documents)),
gone AS (SELECT r, sum(n) AS n FROM keyed JOIN freq USING (host, key) GROUP BY r),
c AS (
  SELECT doc_id, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS n_symbols, coalesce(dup.n, 0) AS n_dup_lines,
    coalesce(rep.n, 0) AS n_repeat_words, CAST(coalesce(gone.n, 0) AS BIGINT) AS n_removed_words
  FROM w LEFT JOIN rep USING (r) LEFT JOIN dup USING (r) LEFT JOIN gone USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_removed_words,
  n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND n_words - n_removed_words >= 50
    AND n_words - n_removed_words >= 0.5 * n_words AS kept
FROM c
"""
