"""Hit context: decoded text around each hit, the context regex test, display and HTML."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint as _ckpt
from .. import constants as C
from ..functions.arrays import context_slices, matches_at
from ..functions.text import display_line, html_card, regex_search
from ..plans.strategy import checked_broadcast
from .decode import decode_arrays

KEY = ["shard", "sample_index", "token_offset"]


def context_ids_by_join(hits: DataFrame, corpus: DataFrame, context_len: int = C.DEFAULT_CONTEXT_LEN) -> DataFrame:
    """Cut context id slices for hits that were produced without the sample at hand
    (e.g. repaired or user-supplied hits): join on the sample key."""
    # hits are materialized once (the size check reads them), then broadcast when small
    hb, _ = checked_broadcast(hits.transform(_ckpt))
    j = corpus.select("shard", "sample_index", "token_ids").join(hb, ["shard", "sample_index"])
    # Q13: use the offset if the sequence is there, else the one before; otherwise keep the
    # given offset and say so in ``offset_verified``
    t, o, s = F.col("token_ids"), F.col("token_offset"), F.col("sequence")
    at_o = matches_at(t, o, s)
    at_prev = (o > 0) & matches_at(t, o - 1, s)
    actual = F.when(at_o, o).when(at_prev, o - 1).otherwise(o)
    j = j.withColumn("_o", actual).withColumn("offset_verified", at_o | at_prev)
    b, m, a = context_slices(F.col("token_ids"), F.col("_o"), F.size("sequence"), context_len)
    rest = [c for c in hits.columns if c != "token_offset"]
    return j.select(F.col("_o").alias("token_offset"), *rest, "offset_verified",
                    b.alias("before_ids"), m.alias("match_ids"), a.alias("after_ids"))


def hit_context(hits_with_ids: DataFrame, vocab: DataFrame, joiner: str = " ", byte_level: bool = False,
                vocab_bounded: bool = False, key: list[str] | None = None) -> DataFrame:
    """Decode before / match / after. With a word joiner the separator that stood between
    two parts in the text is kept on the outer part (``before`` ends with it, ``after`` starts
    with it), so ``before + match + after`` is the original text span."""
    d = decode_arrays(hits_with_ids, key or KEY, ["before_ids", "match_ids", "after_ids"], vocab, joiner, byte_level,
                      vocab_bounded=vocab_bounded)
    sep = F.lit(joiner)
    before = F.when(F.size("before_ids") > 0, F.concat(F.col("before_ids_text"), sep)).otherwise(F.lit(""))
    after = F.when(F.size("after_ids") > 0, F.concat(sep, F.col("after_ids_text"))).otherwise(F.lit(""))
    rest = [c for c in hits_with_ids.columns if c not in ("before_ids", "match_ids", "after_ids", "words")]
    return d.select(*rest, before.alias("before"), F.coalesce(F.col("match_ids_text"), F.lit("")).alias("match"),
                    after.alias("after"))


def context_regex(ctx: DataFrame, pattern, search=regex_search) -> DataFrame:
    """P10: keep the context only where the whole context text matches ``pattern`` (anywhere, not
    necessarily at the hit); otherwise context is null and the hit stays. ``search``: the JVM's
    dialect, or ``py_regex_search`` for Python's, which also compiles a column's patterns once."""
    full = F.concat(F.col("before"), F.col("match"), F.col("after"))
    ok = search(full, pattern)
    rest = [c for c in ctx.columns if c not in ("before", "match", "after")]
    return ctx.select(*rest, ok.alias("context_ok"),
                      *[F.when(ok, F.col(c)).alias(c) for c in ("before", "match", "after")])


def display_hits(ctx: DataFrame) -> DataFrame:
    """One display string per hit (context must be present; recompute it with hit_context
    for hits whose regex test failed)."""
    return ctx.select(*KEY, display_line(F.col("shard"), F.col("sample_index"), F.col("token_offset"),
                                         F.col("before"), F.col("match"), F.col("after")).alias("display"))


def html_hits(ctx: DataFrame) -> tuple[DataFrame, DataFrame]:
    """HTML card per hit with context; hits without context go to a quarantine table with
    the reason (the original raised for them)."""
    has = F.col("match").isNotNull()
    good = ctx.where(has).select(*KEY, html_card(F.col("shard"), F.col("sample_index"), F.col("token_offset"),
                                                 F.col("before"), F.col("match"), F.col("after")).alias("html"))
    bad = ctx.where(~has).select(*KEY, F.lit("no context found for result").alias("reason"))
    return good, bad
