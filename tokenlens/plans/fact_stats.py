"""Entry point C: facts x checkpoints -> completion statistics, written per step, resumable.

grid (J9) -> skip steps already written (J10) -> encode prefix+suffix with offsets (P5) ->
boundary check, failures to a quarantine (P19, P21) -> scorer on the scored positions (F2) ->
log-softmax at the target token (A7) -> per-(step, fact) statistics (A5, A6) -> per-step
JSON files (K6)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint as _ckpt
from .. import constants as C
from ..operators import facts as fact_ops
from ..operators.encode import encode_texts
from ..operators.surprisal import log_sum_exp
from ..plans.strategy import checked_broadcast
from ..operators.step_log import run_steps

STATS_SCHEMA = ("fact_id int, total_surprisal double, avg_surprisal double, perplexity double, "
                "token_surprisals array<double>, tokens array<string>, prefix string, suffix string, "
                "variant string, step int")


def tokenize_facts(facts: DataFrame, tok_json: str) -> DataFrame:
    full = facts.select("fact_id", "prefix", "suffix", F.concat("prefix", "suffix").alias("text"))
    enc = encode_texts(full, ["fact_id"], "text", tok_json, offsets=True, tokens=True)
    return full.join(enc, "fact_id")


def check_boundaries(tok: DataFrame) -> DataFrame:
    """P19 on tokenizer offsets: suffix start index and the first failing rule, if any."""
    plen = F.length("prefix")
    spans = F.transform("offsets", lambda o, i: F.struct(i.alias("i"), o["start"].alias("s"), o["end"].alias("e")))
    straddle = F.exists(spans, lambda x: (x["s"] < plen) & (plen < x["e"]))
    after = F.filter(spans, lambda x: x["s"] >= plen)
    first = F.try_element_at(after, F.lit(1))["i"]
    reason = (F.when(straddle, F.lit("prefix and suffix straddle a token boundary"))
              .when(first.isNull(), F.lit("no suffix tokens"))
              .when(first == 0, F.lit("suffix starts at token 0: prefix is empty")))
    return tok.select("*", F.when(reason.isNull(), first).alias("suffix_start"), reason.alias("reason"))


def completion_stats(checked: DataFrame, steps: DataFrame, scorer, vocab: DataFrame) -> DataFrame:
    good = checked.where(F.col("reason").isNull())
    # scored positions: logits at pos score the token at pos + 1, for every suffix token
    n = F.size("ids")
    pos = good.select("fact_id", "ids", F.explode(F.sequence(F.col("suffix_start") - 1, n - 2)).alias("pos"))
    pos = pos.select("fact_id", "pos", F.element_at("ids", F.col("pos") + 1).alias("token_id"),
                     F.element_at("ids", F.col("pos") + 2).alias("target"))
    # every scored position at every pending step: the step list is a bounded literal array
    step_list = [r[0] for r in steps.collect()]            # at most the grid's 56 steps
    positions = pos.select("*", F.explode(F.array(*[F.lit(x) for x in step_list])).alias("step"))
    scored = scorer(positions)
    if "logits" in scored.columns:        # dense logits: log-softmax at the target (A7)
        surprisal = log_sum_exp(F.col("logits")) - F.try_element_at("logits", F.col("target") + 1)
    else:                                 # the scorer gave the target logit and log-partition
        surprisal = F.col("log_norm") - F.col("target_logit")
    s = scored.select("step", "fact_id", "pos", "target", surprisal.alias("s"))
    vb, _ = checked_broadcast(vocab.select(F.col("token_id").alias("target"), "token"))
    s = s.join(vb, "target", "left")
    g = s.groupBy("step", "fact_id").agg(
        F.sum("s").alias("total_surprisal"), F.avg("s").alias("avg_surprisal"),
        F.array_sort(F.collect_list(F.struct("pos", "s", "token"))).alias("_p"))
    return g.select("fact_id", "total_surprisal", "avg_surprisal", F.exp("avg_surprisal").alias("perplexity"),
                    F.transform("_p", lambda x: x["s"]).alias("token_surprisals"),
                    F.transform("_p", lambda x: x["token"]).alias("tokens"), "step")


def run_fact_grid(spark: SparkSession, facts: DataFrame, scorer, vocab: DataFrame, tok_json: str, out_path: str,
                  variant: str = C.FACT_VARIANT) -> tuple[DataFrame, DataFrame]:
    """Compute and write the steps that are not finished; return (all results, quarantine). A step
    that fails is recorded in the log beside ``out_path`` and tried again by the next run."""
    checked = check_boundaries(tokenize_facts(facts, tok_json)).transform(_ckpt)
    grid_steps = spark.range(1).select(F.explode(fact_ops.steps_column()).alias("step"))
    fb, _ = checked_broadcast(checked.select("fact_id", "prefix", "suffix"))

    def compute(steps: DataFrame) -> DataFrame:
        return completion_stats(checked, steps, scorer, vocab).join(fb, "fact_id").select(
            "fact_id", "total_surprisal", "avg_surprisal", "perplexity", "token_surprisals", "tokens", "prefix", "suffix",
            F.lit(variant).alias("variant"), "step")

    results = run_steps(grid_steps, compute, out_path, STATS_SCHEMA)
    quarantine = checked.where(F.col("reason").isNotNull()).select("fact_id", "prefix", "suffix", "reason")
    return results, quarantine

