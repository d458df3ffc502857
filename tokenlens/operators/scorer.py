"""F2: the scorer hook, and a Spark-native stand-in scorer.

A scorer is any callable ``positions -> positions + scores``: ``positions`` has
``step, fact_id, pos, token_id`` (the token at ``pos``) and ``target`` (the token that follows),
and the scorer adds either ``logits ARRAY<DOUBLE>`` -- the model's full next-token logits after
that token at that checkpoint -- or, when it can give them directly, ``target_logit`` and
``log_norm`` (the log-partition ``logsumexp(logits)``); surprisal is ``log_norm - target_logit``.
A real model is plugged in as a ``mapInPandas`` over these rows; the library owns the grid,
boundary validation, softmax math, statistics and resume.

Stand-in: a bigram model of the corpus as seen by checkpoint ``step``: shard k is read by steps
1000k .. 1000k+999, so the checkpoint at ``step`` has seen shards ``< step / 1000``; logits are
``log(1 + count(token -> next))`` over those shards, so ``log_norm = log(V + count(token -> *))``
exactly, without building vocabulary-wide vectors.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..plans.strategy import checked_broadcast
from ..session import ship_package


def bigram_counts(corpus: DataFrame) -> DataFrame:
    """``(shard, prev, next, c)``: adjacent token pairs per shard (partial aggregation first)."""
    n = F.size("token_ids")
    idx = F.when(n > 1, F.sequence(F.lit(0), n - 2)).otherwise(F.array().cast("array<int>"))
    pairs = F.transform(idx, lambda i: F.struct(F.element_at("token_ids", i + 1).alias("prev"),
                                                F.element_at("token_ids", i + 2).alias("next")))
    return (corpus.select("shard", F.explode(pairs).alias("p"))
            .groupBy("shard", F.col("p.prev").alias("prev"), F.col("p.next").alias("next"))
            .agg(F.count(F.lit(1)).alias("c")))


def bigram_scorer(corpus: DataFrame, vocab_size: int):
    counts = bigram_counts(corpus)

    def score(positions: DataFrame) -> DataFrame:
        need = positions.select("step", F.col("token_id").alias("prev")).distinct()
        nb, _ = checked_broadcast(need)
        seen = counts.join(nb, "prev").where(F.col("shard") < F.floor(F.col("step") / C.STEPS_PER_CHECKPOINT))
        pair = seen.groupBy("step", "prev", "next").agg(F.sum("c").alias("c"))
        total = pair.groupBy("step", "prev").agg(F.sum("c").alias("t"))
        p = positions.alias("p")
        j = (p.join(pair.alias("b"), (F.col("p.step") == F.col("b.step")) & (F.col("p.token_id") == F.col("b.prev"))
                    & (F.col("p.target") == F.col("b.next")), "left")
              .join(total.alias("t"), (F.col("p.step") == F.col("t.step")) & (F.col("p.token_id") == F.col("t.prev")), "left"))
        return j.select("p.*", F.log1p(F.coalesce(F.col("b.c"), F.lit(0)).cast("double")).alias("target_logit"),
                        F.log(F.lit(vocab_size) + F.coalesce(F.col("t.t"), F.lit(0))).alias("log_norm"))

    return score


def matrix_state(rows: pa.Table) -> Callable[[np.ndarray], np.ndarray]:
    """State of one checkpoint from its rows ``token_id, logits``: ids to rows of logits (NaN for
    ids that it doesn't know)."""
    known = rows.column("token_id").to_numpy()
    order = np.argsort(known, kind="stable")
    vectors = np.array(rows.column("logits").to_pylist(), float).reshape(len(known), -1)[order]
    known = known[order]

    def logits(ids: np.ndarray) -> np.ndarray:
        if not len(known):
            return np.full((len(ids), 1), np.nan)
        at = np.minimum(np.searchsorted(known, ids), len(known) - 1)
        return np.where((known[at] == ids)[:, None], vectors[at], np.nan)
    return logits


def checkpoint_scorer(states: DataFrame, load: Callable[[pa.Table], Callable[[np.ndarray], np.ndarray]] = matrix_state,
                      rows_per_group: int = 100_000, block: int = 256):
    """Scorer of dense models: ``load`` makes a checkpoint's model of the rows of ``states`` with its
    ``step``, and the model gives a matrix of logits, a row for each id.

    Positions are grouped by step and meet the state there, so a state is loaded once for all
    positions of its step; a step with more than ``rows_per_group`` positions is split, and its state
    loaded once a part. Logits live for ``block`` positions in the worker: what leaves it is the
    target's logit and the log-partition. Positions whose token or target the model doesn't know, or
    whose step has no state, get nulls."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        target, norm = np.full(left.num_rows, np.nan), np.full(left.num_rows, np.nan)
        model = load(right) if left.num_rows and right.num_rows else None
        ids, wanted = left.column("token_id").to_numpy(), left.column("target").to_numpy()
        for i in range(0, left.num_rows if model else 0, block):
            logits = model(ids[i:i + block])
            want = wanted[i:i + block]
            known = (want >= 0) & (want < logits.shape[1])
            top = logits.max(1)
            target[i:i + block] = np.where(known, logits[np.arange(len(logits)), np.where(known, want, 0)], np.nan)
            norm[i:i + block] = top + np.log(np.exp(logits - top[:, None]).sum(1))
        out = left.drop_columns(["part"])
        for name, x in (("target_logit", target), ("log_norm", norm)):
            out = out.append_column(name, pa.array(x, pa.float64(), mask=np.isnan(target)))
        return out

    def score(positions: DataFrame) -> DataFrame:
        ship_package(positions.sparkSession)
        parts = positions.groupBy("step").agg(F.ceil(F.count(F.lit(1)) / rows_per_group).cast("int").alias("parts"))
        pb, _ = checked_broadcast(parts)                              # a row per step
        names = positions.columns
        dealt = positions.join(pb, "step").select(*names, F.pmod(F.xxhash64("fact_id", "pos"), F.col("parts")).cast("int").alias("part"))
        copies = states.join(pb, "step").select(*states.columns, F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
        schema = ", ".join(f"{n} {t}" for n, t in positions.dtypes) + ", target_logit double, log_norm double"
        return dealt.groupBy("step", "part").cogroup(copies.groupBy("step", "part")).applyInArrow(run, schema)

    return score
