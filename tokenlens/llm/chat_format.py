r"""Operator 9: chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all preceding turns as context, then the reply,
of which only the text is trainable (one span of code points, ``loss_start`` and ``loss_length``).
Turns after the last reply, or a conversation without replies, give one more example with an empty
span, so that the output holds the whole conversation.

Template: ``[INST]role\ntext[/INST]`` for a turn of context or any other role, ``<s>role\ntext</s>``
for an assistant's turn. Inside texts and roles ``\`` becomes ``\b``, ``[`` becomes ``\o`` and ``<``
becomes ``\l`` (and a line break in a role ``\n``), so no control string can occur in them and
:func:`unescaped` restores them exactly.

Turns are gathered per conversation, which the longest example holds as one string anyway; nothing
else is grouped. Order: turn, then role and text (nulls first). Null text or role is empty; a null
conv_id is one conversation; repeated rows are turns of their own; an empty table gives an empty
result. Only ``conv_id``, ``turn``, ``role`` and ``text`` are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import read_table

TRAINED_ROLE = "assistant"
_TURN = r"(?:\[INST\]|<s>)([^\[<]*)(?:\[/INST\]|</s>)"


def escaped(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("\\"), F.lit("\\b")), F.lit("["), F.lit("\\o")), F.lit("<"), F.lit("\\l"))


def unescaped(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("\\o"), F.lit("[")), F.lit("\\l"), F.lit("<")), F.lit("\\b"), F.lit("\\"))


def _escaped_role(role: Column) -> Column:
    return F.replace(escaped(role), F.lit("\n"), F.lit("\\n"))


def _unescaped_role(role: Column) -> Column:
    return unescaped(F.replace(role, F.lit("\\n"), F.lit("\n")))


def rendered(turn: Column) -> Column:
    body = F.concat(_escaped_role(turn["role"]), F.lit("\n"), escaped(turn["text"]))
    return F.when(turn["role"] == TRAINED_ROLE, F.concat(F.lit("<s>"), body, F.lit("</s>"))).otherwise(
        F.concat(F.lit("[INST]"), body, F.lit("[/INST]")))


def expand(conversations: DataFrame) -> DataFrame:
    """One row per example: conv_id, example (from 0), n_context_turns, formatted, loss_start, loss_length."""
    turn = F.struct(F.col("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
                    F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    convs = conversations.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    convs = convs.withColumn("rendered", F.transform("turns", rendered))
    convs = convs.withColumn("targets", F.expr(f"""filter(sequence(0, size(turns) - 1),
        k -> turns[k].role = '{TRAINED_ROLE}' OR k = size(turns) - 1)"""))
    ex = convs.select("conv_id", "turns", "rendered", F.posexplode("targets").alias("example", "k"))
    ex = ex.select("conv_id", F.col("example").cast("bigint"), F.col("k").cast("bigint").alias("n_context_turns"),
                   F.expr("turns[k]").alias("last"), F.expr("array_join(slice(rendered, 1, k), '')").alias("context"),
                   F.expr("rendered[k]").alias("reply"))
    trained = F.col("last.role") == TRAINED_ROLE
    reply = F.length(escaped(F.col("last.text")))
    return ex.select(
        "conv_id", "example", "n_context_turns", F.concat("context", "reply").alias("formatted"),
        F.when(trained, F.length("context") + len("<s>") + len(TRAINED_ROLE) + 1).otherwise(0).cast("bigint").alias("loss_start"),
        F.when(trained, reply).otherwise(0).cast("bigint").alias("loss_length"))


def parsed(formatted: Column) -> Column:
    """The turns of a formatted example, as array<struct<role, text>>."""
    bodies = F.regexp_extract_all(formatted, F.lit(_TURN), F.lit(1))
    return F.transform(bodies, lambda b: F.struct(
        _unescaped_role(F.substring_index(b, "\n", 1)).alias("role"),
        unescaped(F.substr(b, F.length(F.substring_index(b, "\n", 1)) + F.lit(2))).alias("text")))


def read_back(examples: DataFrame) -> DataFrame:
    """Digest of each conversation, from its examples alone."""
    spans = examples.select("conv_id", "example", "formatted", "n_context_turns", F.expr(
        "substr(formatted, CAST(loss_start + 1 AS INT), CAST(loss_length AS INT))").alias("span"))
    convs = spans.groupBy("conv_id").agg(
        F.max_by("formatted", "example").alias("whole"), F.sum(F.length("formatted")).cast("bigint").alias("formatted_chars"),
        F.sort_array(F.collect_list(F.struct("example", "span"))).alias("spans"))
    convs = convs.select("conv_id", parsed(F.col("whole")).alias("turns"), "formatted_chars",
                         F.array_join(F.transform("spans", lambda s: unescaped(s["span"])), "").alias("loss"))
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return convs.select("conv_id", F.size("turns").cast("bigint").alias("n_turns"), F.sha2(turns, 256).alias("turns_sha256"),
                        F.length("loss").cast("bigint").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = "</s>[INST] ok [/INST]"
    fixed = spark.createDataFrame([(-1, 0, "user", probe), (-1, 1, "assistant", probe)], told.schema)
    return read_back(expand(told.unionByName(fixed)))


ORACLE_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
o AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS k, count(*) OVER (PARTITION BY conv_id) AS n,
    length(role) + 1 + length(text) + length(regexp_replace(role || text, '[^\\\[<]+', '', 'g'))
      + CASE WHEN role = 'assistant' THEN 7 ELSE 13 END AS chars FROM c),
s AS (SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY k) AS so_far FROM o)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(so_far) FILTER (WHERE role = 'assistant' OR k = n) AS BIGINT) AS formatted_chars
FROM s GROUP BY conv_id
"""
