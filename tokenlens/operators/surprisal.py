"""Surprisal analytics over a table of logits.

Logits table: ``(text_id, pos, token_id, logits ARRAY<DOUBLE>)`` -- the model output at every
position of a tokenized text (produced by a scorer; see ``scorer.py``). The logits at position
i-1 score the token at position i.

Everything is a per-row array expression (log-sum-exp with the max subtracted) plus one window
per text, so a text is the largest unit ever grouped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.strategy import checked_broadcast


def log_sum_exp(logits: Column) -> Column:
    m = F.array_max(logits)
    s = F.aggregate(logits, F.lit(0.0).cast("double"), lambda acc, x: acc + F.exp(x - m))
    return m + F.log(s)


def log_softmax(logits: Column) -> Column:
    """``x - logsumexp(x)`` for every element."""
    lse = log_sum_exp(logits)
    return F.transform(logits, lambda x: x - lse)


def softmax(logits: Column) -> Column:
    """``exp(log_softmax)``."""
    return F.transform(log_softmax(logits), lambda x: F.exp(x))


def token_surprisal(logits_tbl: DataFrame) -> DataFrame:
    """W3 + A7: surprisal ``-log p(token_i | logits_{i-1})`` for every position but the first.
    The shift is a ``lag`` over the text's positions."""
    w = Window.partitionBy("text_id").orderBy("pos")
    prev = logits_tbl.select("text_id", "pos", "token_id", F.lag("logits").over(w).alias("prev_logits"))
    target = F.try_element_at(F.col("prev_logits"), F.col("token_id") + 1)
    s = -(target - log_sum_exp(F.col("prev_logits")))
    return prev.where(F.col("prev_logits").isNotNull()).select("text_id", "pos", "token_id", s.alias("surprisal"))


def completion_stats(surprisals: DataFrame, suffix_start: DataFrame | None = None, token_names: DataFrame | None = None) -> DataFrame:
    """A5 + A6: per text, over the suffix positions (``pos >= suffix_start``): total and mean
    surprisal, perplexity = exp(mean), and the ordered per-token surprisals and tokens."""
    s = surprisals
    if suffix_start is not None:
        s = s.join(suffix_start, "text_id").where(F.col("pos") >= F.col("suffix_start"))
    tok = F.format_string("<%d>", F.col("token_id"))
    if token_names is not None:
        tn, _ = checked_broadcast(token_names)
        s = s.join(tn, "token_id", "left")
        tok = F.coalesce(F.col("token"), tok)
    g = s.groupBy("text_id").agg(
        F.sum("surprisal").alias("total_surprisal"),
        F.avg("surprisal").alias("avg_surprisal"),
        F.array_sort(F.collect_list(F.struct("pos", F.col("surprisal").alias("s"), tok.alias("t")))).alias("_p"),
    )
    return g.select(
        "text_id", "total_surprisal", "avg_surprisal", F.exp("avg_surprisal").alias("perplexity"),
        F.transform("_p", lambda x: x["s"]).alias("token_surprisals"),
        F.transform("_p", lambda x: x["t"]).alias("tokens"),
    )


def last_position(logits_tbl: DataFrame) -> DataFrame:
    """The logits of each text's last position (what predicts the next token)."""
    return logits_tbl.groupBy("text_id").agg(
        F.max("pos").alias("pos"), F.max_by("logits", "pos").alias("logits"))


def top_n(logits: Column, n: int) -> Column:
    """The n largest logits of one vector as ``ARRAY<STRUCT<rank, token_id, logit, prob>>``,
    ties broken by the smaller id; prob is over the full vector. A per-row sort -- no shuffle."""
    lse = log_sum_exp(logits)
    keyed = F.transform(logits, lambda x, i: F.struct((-x).alias("k"), i.alias("token_id"), x.alias("logit")))
    best = F.slice(F.array_sort(keyed), 1, n)
    return F.transform(best, lambda e, r: F.struct(
        (r + 1).alias("rank"), e["token_id"].alias("token_id"), e["logit"].alias("logit"),
        F.exp(e["logit"] - lse).alias("prob")))
