"""Named queries: each takes (spark, sf_dir) and returns a DataFrame over the given tables.

The registry is what ``__spark_entry__.queries()`` exposes; ``ORACLE`` holds the DuckDB SQL of
each key that has an exact SQL equivalent.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import checkpoint as _ckpt
from ..operators import find as find_ops
from ..sources.tables import read_table
from ..sources.wordcorpus import word_corpus
from . import char_cover, oracle_sql as Q
from .needles import passage_sequences
from .strategy import checked_broadcast

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def _search_input(spark: SparkSession, sf_dir: str):
    tc = word_corpus(spark, sf_dir)
    needles = passage_sequences(read_table(spark, sf_dir, "benchmark"), tc.vocab)
    return tc, needles


HIT_COLS = ["shard", "sample_index", "token_offset", "seq_ord", "sequence"]


@register("find_sequence", Q.with_ctes(Q.WORDS, Q.NEEDLES, Q.RAW_HITS, body=
    "SELECT shard, sample_index, token_offset, seq_ord, sequence FROM raw_hits"))
def find_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every occurrence of every sequence, before cross-sequence deduplication."""
    tc, needles = _search_input(spark, sf_dir)
    return find_ops.find_sequences(tc.corpus, needles, tc.token_counts).select(*HIT_COLS)


@register("find_sequences", Q.with_ctes(Q.WORDS, Q.NEEDLES, Q.RAW_HITS, body=
    "SELECT shard, sample_index, token_offset, seq_ord, sequence FROM hits"))
def find_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J6 (flagship): batch search of all sequences in one corpus pass, deduplicated by location."""
    tc, needles = _search_input(spark, sf_dir)
    hits = find_ops.find_sequences(tc.corpus, needles, tc.token_counts, mark_first=True)
    return find_ops.dedup_hits(hits).select(*HIT_COLS)


# ----------------------------------------------------------------------------------------------
# corpus operators
# ----------------------------------------------------------------------------------------------
from .. import constants as C  # noqa: E402
from ..functions.text import html_card  # noqa: E402,F401
from ..operators import context as ctx_ops  # noqa: E402
from ..operators import corpus_ops, decode, hist, postings as post_ops  # noqa: E402
from ..sources.corpus import contract_report  # noqa: E402

FIX_SPS = 100  # samples per shard of the word-token fixture


@register("scan_corpus", Q.with_ctes(Q.WORDS, body="SELECT shard, sample_index, token_ids FROM corpus"))
def scan_corpus(spark, sf_dir):
    """The corpus table, pruned to its three columns."""
    return word_corpus(spark, sf_dir).corpus.select("shard", "sample_index", "token_ids")


@register("corpus_contract", Q.with_ctes(Q.WORDS, body="""
SELECT shard, CAST(count(*) AS BIGINT) AS n_samples, CAST(0 AS BIGINT) AS n_bad_length,
  CAST(sum(CASE WHEN len(list_filter(token_ids, lambda x: x < 0 OR x > 65535)) > 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_bad_ids,
  min(sample_index) AS min_sample, max(sample_index) AS max_sample,
  CAST(sum(len(token_ids)) AS BIGINT) AS n_tokens,
  (min(sample_index) = 0 AND max(sample_index) = count(*) - 1 AND count(*) = 100
   AND sum(CASE WHEN len(list_filter(token_ids, lambda x: x < 0 OR x > 65535)) > 0 THEN 1 ELSE 0 END) = 0) AS ok
FROM corpus GROUP BY shard"""))
def corpus_contract(spark, sf_dir):
    """S3: per-shard contract report (sample count, dense indexes, ids inside uint16)."""
    return contract_report(word_corpus(spark, sf_dir).corpus, None, FIX_SPS)


WINDOW = 64


@register("window_contract", Q.with_ctes(Q.WORDS, f"""
win AS (SELECT shard, sample_index, token_ids[w * {WINDOW} + 1 : (w + 1) * {WINDOW}] AS token_ids
        FROM (SELECT shard, sample_index, token_ids, unnest(range(0, (len(token_ids) + {WINDOW - 1}) // {WINDOW})) AS w FROM corpus)),
rep AS (SELECT shard, CAST(count(*) AS BIGINT) AS n_samples, CAST(sum(CASE WHEN len(token_ids) <> {WINDOW} THEN 1 ELSE 0 END) AS BIGINT) AS n_bad_length,
  CAST(sum(CASE WHEN len(list_filter(token_ids, lambda x: x < 0 OR x > 65535)) > 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_bad_ids,
  min(sample_index) AS min_sample, max(sample_index) AS max_sample, CAST(sum(len(token_ids)) AS BIGINT) AS n_tokens
  FROM win GROUP BY shard)""", body="""
SELECT *, (min_sample = 0 AND max_sample = n_samples - 1 AND n_bad_length = 0 AND n_bad_ids = 0) AS ok FROM rep"""))
def window_contract(spark, sf_dir):
    """S3 on windows of a fixed length: the last window of most samples is too short."""
    corpus = word_corpus(spark, sf_dir).corpus
    at = F.sequence(F.lit(0), F.floor((F.size("token_ids") - 1) / WINDOW).cast("int"))
    windows = corpus.where(F.size("token_ids") > 0).select("shard", "sample_index", F.explode(
        F.transform(at, lambda w: F.slice("token_ids", w * WINDOW + 1, F.lit(WINDOW)))).alias("token_ids"))
    return contract_report(windows, WINDOW)


@register("shard_slice", Q.with_ctes(Q.WORDS, body="SELECT shard, sample_index, token_ids FROM corpus WHERE shard = 1"))
def shard_slice(spark, sf_dir):
    """One shard, by partition pruning."""
    return corpus_ops.shard_slice(word_corpus(spark, sf_dir).corpus, 1)


@register("position_slice", Q.with_ctes(Q.WORDS, body="SELECT shard, sample_index, token_ids[11:20] AS tokens FROM corpus"))
def position_slice(spark, sf_dir):
    """Tokens 10..19 of every sample."""
    return corpus_ops.position_slice(word_corpus(spark, sf_dir).corpus, 10, 20)


@register("separated_stream", Q.with_ctes(Q.WORDS, body="""
SELECT shard, sample_index, list_concat([65535], token_ids) AS tokens,
  CAST(coalesce(sum((len(token_ids) + 1) * 2) OVER (PARTITION BY shard ORDER BY sample_index
       ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS byte_offset
FROM corpus"""))
def separated_stream(spark, sf_dir):
    """K2: separator-prefixed samples with their byte offsets inside the shard stream."""
    return corpus_ops.separated_stream(word_corpus(spark, sf_dir).corpus)


@register("postings", Q.with_ctes(Q.WORDS, Q.NEEDLES, Q.RAW_HITS, body="""
SELECT tok AS token_id, shard, sample_index, list(pos ORDER BY pos) AS positions FROM occ
GROUP BY tok, shard, sample_index"""))
def postings(spark, sf_dir):
    """K4: positional postings, one row per (token, sample)."""
    tc = word_corpus(spark, sf_dir)
    return post_ops.build_postings(tc.corpus, f"{tc.root}/postings_by_token").select("token_id", "shard", "sample_index", "positions")


@register("token_stats", Q.with_ctes(Q.WORDS, Q.NEEDLES, Q.RAW_HITS, body="""
SELECT tok AS token_id, count(*) AS n, count(DISTINCT (shard, sample_index)) AS n_samples FROM occ GROUP BY tok"""))
def token_stats(spark, sf_dir):
    """K4: occurrences and containing samples per token."""
    return word_corpus(spark, sf_dir).token_stats.select("token_id", "n", "n_samples")


@register("pair_postings", Q.with_ctes(Q.WORDS, Q.NEEDLES, Q.RAW_HITS, body="""
SELECT tok AS token_id, token_ids[pos + 2] AS next_id, shard, sample_index, list(pos ORDER BY pos) AS positions FROM occ
WHERE pos + 1 < len(token_ids) GROUP BY tok, token_ids[pos + 2], shard, sample_index"""))
def pair_postings(spark, sf_dir):
    """K4: positional postings of pairs of neighbouring tokens."""
    tc = word_corpus(spark, sf_dir)
    return post_ops.build_pair_postings(tc.corpus, f"{tc.root}/pair_postings").select(
        "token_id", "next_id", "shard", "sample_index", "positions")


# ----------------------------------------------------------------------------------------------
# vocabulary lookups on the search input
# ----------------------------------------------------------------------------------------------
NEEDLE_TOKENS = """
nt AS (SELECT seq_ord, seq, generate_subscripts(seq, 1) AS i, unnest(seq) AS t FROM needles)"""


@register("ids_to_tokens", Q.with_ctes(Q.WORDS, Q.NEEDLES, NEEDLE_TOKENS, body="""
SELECT nt.seq_ord, nt.seq, list(v.token ORDER BY nt.i) AS tokens
FROM nt JOIN vocab v ON v.token_id = nt.t GROUP BY nt.seq_ord, nt.seq"""))
def ids_to_tokens(spark, sf_dir):
    """Id sequences -> token strings."""
    tc, needles = _search_input(spark, sf_dir)
    return decode.ids_to_tokens(needles, ["seq_ord"], "seq", tc.vocab).select("seq_ord", "seq", "tokens")


@register("decode_tokens", Q.with_ctes(Q.WORDS, Q.NEEDLES, NEEDLE_TOKENS, body="""
SELECT nt.seq_ord, array_to_string(list(v.token ORDER BY nt.i), ' ') AS text
FROM nt JOIN vocab v ON v.token_id = nt.t GROUP BY nt.seq_ord"""))
def decode_tokens(spark, sf_dir):
    """Id sequences -> text."""
    tc, needles = _search_input(spark, sf_dir)
    d = decode.decode_arrays(needles, ["seq_ord"], ["seq"], tc.vocab, tc.joiner)
    return d.select("seq_ord", F.col("seq_text").alias("text"))


# ----------------------------------------------------------------------------------------------
# hits
# ----------------------------------------------------------------------------------------------
def _raw_hits(spark, sf_dir, mark_first=False):
    """``mark_first``: for queries that take the hits deduplicated by location."""
    tc, needles = _search_input(spark, sf_dir)
    return tc, find_ops.find_sequences(tc.corpus, needles, tc.token_counts, mark_first=mark_first)


@register("sample_lookup", Q.with_ctes(Q.WORDS, Q.NEEDLES, Q.RAW_HITS, body="""
SELECT c.shard, c.sample_index, c.token_ids FROM corpus c
WHERE EXISTS (SELECT 1 FROM hits h WHERE h.shard = c.shard AND h.sample_index = c.sample_index)"""))
def sample_lookup(spark, sf_dir):
    """The samples that contain a hit."""
    tc, raw = _raw_hits(spark, sf_dir)
    return corpus_ops.sample_lookup(tc.corpus, raw)


@register("first_occurrence", Q.with_ctes(Q.WORDS, Q.NEEDLES, Q.RAW_HITS, body="""
SELECT seq_ord, shard, sample_index, min(token_offset) AS first_offset, count(*) AS n_occurrences
FROM raw_hits GROUP BY seq_ord, shard, sample_index"""))
def first_occurrence(spark, sf_dir):
    """First offset of each sequence in each sample."""
    _, raw = _raw_hits(spark, sf_dir)
    return find_ops.first_occurrence(raw)


@register("sequence_counts", Q.with_ctes(Q.WORDS, Q.NEEDLES, Q.RAW_HITS, body="""
SELECT seq_ord, count(*) AS n_hits, count(DISTINCT (shard, sample_index)) AS n_samples
FROM raw_hits GROUP BY seq_ord"""))
def sequence_counts(spark, sf_dir):
    """Hits and samples per sequence."""
    _, raw = _raw_hits(spark, sf_dir)
    return find_ops.sequence_counts(raw)


@register("dedup_hits", Q.with_ctes(Q.WORDS, Q.NEEDLES, Q.RAW_HITS, body="""
SELECT shard, sample_index, token_offset, min(seq_ord) AS seq_ord, count(*) AS n_candidates
FROM raw_hits GROUP BY shard, sample_index, token_offset"""))
def dedup_hits(spark, sf_dir):
    """One hit per location, earliest sequence first, with how many sequences hit there."""
    _, raw = _raw_hits(spark, sf_dir)
    return raw.groupBy(*find_ops.LOCATION).agg(F.min("seq_ord").alias("seq_ord"), F.count(F.lit(1)).alias("n_candidates"))


@register("repair_offsets", Q.with_ctes(Q.WORDS, Q.NEEDLES, Q.RAW_HITS, """
fo AS (SELECT seq_ord, shard, sample_index, min(token_offset) AS first_offset FROM raw_hits
       GROUP BY seq_ord, shard, sample_index),
rep AS (
  SELECT h.shard, h.sample_index + d.ds AS sample_index, h.token_offset + d.doff AS reported_offset,
         h.seq_ord, h.sequence
  FROM hits h, (VALUES (0, 0), (0, 1), (0, 7), (1, 0)) d(ds, doff)),
fixed AS (
  SELECT r.seq_ord, r.shard, r.sample_index, r.reported_offset, r.sequence,
    CASE WHEN c.token_ids[r.reported_offset + 1 : r.reported_offset + len(r.sequence)] = r.sequence
           THEN r.reported_offset
         WHEN r.reported_offset > 0
              AND c.token_ids[r.reported_offset : r.reported_offset - 1 + len(r.sequence)] = r.sequence
           THEN r.reported_offset - 1
         ELSE fo.first_offset END AS token_offset
  FROM rep r JOIN corpus c ON c.shard = r.shard AND c.sample_index = r.sample_index
  LEFT JOIN fo ON fo.seq_ord = r.seq_ord AND fo.shard = r.shard AND fo.sample_index = r.sample_index)""", body="""
SELECT seq_ord, shard, sample_index, CAST(token_offset AS INTEGER) AS token_offset, any_value(sequence) AS sequence,
       CAST(min(reported_offset) AS INTEGER) AS reported_offset
FROM fixed WHERE token_offset IS NOT NULL GROUP BY seq_ord, shard, sample_index, token_offset"""))
def repair_offsets(spark, sf_dir):
    """Reported offsets = true offset + {0, 1, 7}, and the right offset in the next sample;
    repair keeps, steps back, rescans, or drops."""
    tc, raw = _raw_hits(spark, sf_dir, mark_first=True)
    hits = find_ops.dedup_hits(raw)
    deltas = F.array(*[F.struct(F.lit(a).alias("ds"), F.lit(b).alias("doff")) for a, b in [(0, 0), (0, 1), (0, 7), (1, 0)]])
    rep = hits.select("*", F.explode(deltas).alias("d")).select(
        "shard", (F.col("sample_index") + F.col("d.ds")).cast("int").alias("sample_index"),
        (F.col("token_offset") + F.col("d.doff")).cast("int").alias("reported_offset"), "seq_ord", "sequence")
    return find_ops.repair_offsets(rep, tc.corpus).select(
        "seq_ord", "shard", "sample_index", "token_offset", "sequence", "reported_offset")


def _context(spark, sf_dir, context_len=C.DEFAULT_CONTEXT_LEN):
    tc, needles = _search_input(spark, sf_dir)
    corpus, vocab = tc.decodable
    raw = find_ops.find_sequences(corpus, needles, tc.token_counts, context_len=context_len, mark_first=True)
    return ctx_ops.hit_context(find_ops.dedup_hits(raw), vocab, tc.joiner)


@register("hit_context", Q.with_ctes(Q.WORDS, Q.NEEDLES, Q.RAW_HITS, Q.CONTEXT, body="SELECT * FROM ctx"))
def hit_context(spark, sf_dir):
    """P15 + J8: decoded 50-token context on each side of every deduplicated hit."""
    return _context(spark, sf_dir).select(*HIT_COLS, "before", "match", "after")


@register("context_regex", Q.with_ctes(Q.WORDS, Q.NEEDLES, Q.RAW_HITS, Q.CONTEXT, f"""
rx AS (SELECT *, regexp_matches(before || match || after, {Q.literal_boundary_pattern('match')}) AS context_ok FROM ctx)""",
    body="""
SELECT shard, sample_index, token_offset, seq_ord, sequence, context_ok,
  CASE WHEN context_ok THEN before END AS before, CASE WHEN context_ok THEN match END AS match,
  CASE WHEN context_ok THEN after END AS after
FROM rx"""))
def context_regex(spark, sf_dir):
    """P10: context kept only where it matches the word-boundary pattern of the matched text
    (taken literally); the hit stays either way."""
    c = _context(spark, sf_dir).select(*HIT_COLS, "before", "match", "after")
    from ..functions.pyregex import py_boundary_pattern, py_regex_search
    return ctx_ops.context_regex(c, py_boundary_pattern(F.col("match"), literal=True), py_regex_search)


@register("display_hits", Q.with_ctes(Q.WORDS, Q.NEEDLES, Q.RAW_HITS, Q.CONTEXT, body="""
SELECT shard, sample_index, token_offset,
  printf('Shard: %d, Sample: %d, Offset: %d', shard, sample_index, token_offset) || chr(10) ||
  printf('Context: ...%s**%s**%s...', before, match, after) || chr(10) || repeat('-', 40) AS display
FROM ctx"""))
def display_hits(spark, sf_dir):
    """One display string per hit."""
    return ctx_ops.display_hits(_context(spark, sf_dir))


def _html_escape_sql(c):
    out = c
    for a, b in [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")]:
        a_sql = a.replace("'", "''")
        out = f"replace({out}, '{a_sql}', '{b}')"
    return out


@register("html_hits", Q.with_ctes(Q.WORDS, Q.NEEDLES, Q.RAW_HITS, Q.CONTEXT, body=f"""
SELECT shard, sample_index, token_offset,
  printf('{{tpl}}', shard, sample_index, token_offset, {_html_escape_sql('before')}, {_html_escape_sql('match')},
         {_html_escape_sql('after')}) AS html
FROM ctx""".replace("{tpl}", __import__("tokenlens.functions.text", fromlist=["HTML_CARD"]).HTML_CARD.replace("'", "''"))))
def html_hits(spark, sf_dir):
    """HTML card per hit with context (hits without context are quarantined)."""
    good, _bad = ctx_ops.html_hits(_context(spark, sf_dir))
    return good


@register("hit_steps", Q.with_ctes(Q.WORDS, Q.NEEDLES, Q.RAW_HITS, body="""
SELECT shard, sample_index, token_offset, seq_ord, sequence,
  CAST(shard AS BIGINT) * 100 + sample_index AS global_idx,
  (CAST(shard AS BIGINT) * 100 + sample_index) // 1024 AS train_step,
  ((CAST(shard AS BIGINT) * 100 + sample_index) // 1024 // 1000 + 1) * 1000 AS first_checkpoint,
  (CAST(shard AS BIGINT) * 100 + sample_index) >= 97280000 AS already_seen
FROM hits"""))
def hit_steps(spark, sf_dir):
    """Training step provenance of each hit."""
    _, raw = _raw_hits(spark, sf_dir, mark_first=True)
    return corpus_ops.hit_steps(find_ops.dedup_hits(raw).select(*HIT_COLS), FIX_SPS)


# ----------------------------------------------------------------------------------------------
# histograms
# ----------------------------------------------------------------------------------------------
SLOTS = """
slots AS (SELECT CAST(unnest(range(0, (SELECT greatest(95, max(shard) + 1) FROM corpus))) AS INTEGER) AS shard),
lab AS (
  SELECT DISTINCT CASE WHEN li = 0 THEN 'len4' ELSE 'len2' END AS label, CAST(li AS INTEGER) AS label_ord,
         shard, sample_index, token_offset
  FROM raw_hits JOIN (SELECT seq_ord, li FROM needles) USING (seq_ord)),
labels AS (SELECT DISTINCT CASE WHEN li = 0 THEN 'len4' ELSE 'len2' END AS label, CAST(li AS INTEGER) AS label_ord FROM needles),
stk AS (
  SELECT l.label, l.label_ord, s.shard, CAST(count(h.shard) AS BIGINT) AS n_hits
  FROM labels l CROSS JOIN slots s
  LEFT JOIN lab h ON h.label = l.label AND h.shard = s.shard
  GROUP BY l.label, l.label_ord, s.shard),
stacked AS (
  SELECT *, CAST(coalesce(sum(n_hits) OVER (PARTITION BY shard ORDER BY label_ord
         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS bottom FROM stk)"""


def _labelled(spark, sf_dir):
    """Per-label result sets: one label per needle length; each label deduplicates its own hits. Labels come to
    the hits by broadcast (checked), so hits are shuffled once, by location."""
    tc, needles = _search_input(spark, sf_dir)
    needles = needles.select("seq_ord", "seq", "r").transform(_ckpt)
    raw = find_ops.find_sequences(tc.corpus, needles, tc.token_counts)
    rank = F.col("r").cast("int")
    label = F.when(rank == 0, F.lit("len4")).otherwise(F.lit("len2")).alias("label")
    ranks, _ = checked_broadcast(needles.select("seq_ord", "r"))
    lab = raw.join(ranks, "seq_ord").select(label, rank.alias("label_ord"), "shard", "sample_index", "token_offset").distinct()
    return tc, lab, needles.select(label, rank.alias("label_ord")).distinct()


@register("shard_histogram", Q.with_ctes(Q.WORDS, Q.NEEDLES, Q.RAW_HITS, SLOTS, body="""
SELECT s.shard, CAST(count(h.shard) AS BIGINT) AS n_hits FROM slots s LEFT JOIN hits h ON h.shard = s.shard
GROUP BY s.shard"""))
def shard_histogram(spark, sf_dir):
    """A1 + J11: hits per shard, zero-filled."""
    tc, raw = _raw_hits(spark, sf_dir, mark_first=True)
    return hist.shard_histogram(find_ops.dedup_hits(raw), hist.shard_count(tc.corpus))


@register("stacked_histogram", Q.with_ctes(Q.WORDS, Q.NEEDLES, Q.RAW_HITS, SLOTS, body="SELECT * FROM stacked"))
def stacked_histogram(spark, sf_dir):
    """A2 + W2 + U3: hits per (label, shard) with stack bases."""
    tc, lab, labels = _labelled(spark, sf_dir)
    return hist.stacked_histogram(lab, hist.shard_count(tc.corpus), labels)


@register("hit_totals", Q.with_ctes(Q.WORDS, Q.NEEDLES, Q.RAW_HITS, SLOTS, body="""
SELECT l.label, l.label_ord, CAST(count(h.label) AS BIGINT) AS n_hits
FROM labels l LEFT JOIN lab h ON h.label = l.label GROUP BY l.label, l.label_ord
UNION ALL SELECT NULL, NULL, CAST(count(*) AS BIGINT) FROM lab"""))
def hit_totals(spark, sf_dir):
    """A3: hits per label and in total."""
    _, lab, labels = _labelled(spark, sf_dir)
    return hist.hit_totals(lab, labels)


@register("stack_headroom", Q.with_ctes(Q.WORDS, Q.NEEDLES, Q.RAW_HITS, SLOTS, body="""
SELECT CAST(coalesce(max(h), 0) AS BIGINT) AS max_height, CAST(coalesce(max(h), 0) AS DOUBLE) * CAST(1.15 AS DOUBLE) AS y_limit
FROM (SELECT shard, sum(n_hits) AS h FROM stacked GROUP BY shard)"""))
def stack_headroom(spark, sf_dir):
    """A4: tallest stack and axis limit with 15% headroom."""
    tc, lab, labels = _labelled(spark, sf_dir)
    return hist.stack_headroom(hist.stacked_histogram(lab, hist.shard_count(tc.corpus), labels))


# ----------------------------------------------------------------------------------------------
# surprisal on the logits stand-in
# ----------------------------------------------------------------------------------------------
from ..operators import facts as fact_ops  # noqa: E402
from ..operators import surprisal as sur  # noqa: E402
from ..session import shared_dir  # noqa: E402
from .logits import SUFFIX_START, conversation_facts, logits_table  # noqa: E402

LOGITS = """
lg AS (SELECT CAST(vec_id // 8 AS BIGINT) AS text_id, CAST(vec_id % 8 AS INTEGER) AS pos,
              CAST(label AS INTEGER) AS token_id, CAST(embedding AS DOUBLE[]) AS logits FROM embeddings),
sh AS (SELECT text_id, pos, token_id, lag(logits) OVER (PARTITION BY text_id ORDER BY pos) AS prev FROM lg),
sm AS (SELECT *, list_max(prev) AS m FROM sh WHERE prev IS NOT NULL),
ts AS (SELECT text_id, pos, token_id,
              -(prev[token_id + 1] - (m + ln(list_sum(list_transform(prev, lambda x: exp(x - m)))))) AS surprisal
       FROM sm)"""


def _r(c):
    return F.round(c, 6)


def _ra(c):
    return F.transform(c, lambda x: F.round(x, 6))


@register("token_surprisal", Q.with_ctes(LOGITS, body="SELECT text_id, pos, token_id, round(surprisal, 6) AS surprisal FROM ts"))
def token_surprisal(spark, sf_dir):
    """W3 + A7: per-token surprisal from the previous position's logits."""
    s = sur.token_surprisal(logits_table(spark, sf_dir))
    return s.select("text_id", "pos", "token_id", _r("surprisal").alias("surprisal"))


@register("fact_stats", Q.with_ctes(LOGITS, f"""
st AS (SELECT text_id, sum(surprisal) AS tot, avg(surprisal) AS av,
              list(surprisal ORDER BY pos) AS sl, list('<' || token_id || '>' ORDER BY pos) AS tl
       FROM ts WHERE pos >= {SUFFIX_START} GROUP BY text_id)""", body="""
SELECT text_id, round(tot, 6) AS total_surprisal, round(av, 6) AS avg_surprisal, round(exp(av), 6) AS perplexity,
       list_transform(sl, lambda x: round(x, 6)) AS token_surprisals, tl AS tokens
FROM st"""))
def fact_stats(spark, sf_dir):
    """A5 + A6: total / mean surprisal, perplexity and per-token lists over the suffix."""
    lt = logits_table(spark, sf_dir)
    s = sur.token_surprisal(lt)
    starts = lt.select("text_id").distinct().select("text_id", F.lit(SUFFIX_START).alias("suffix_start"))
    st = sur.completion_stats(s, starts)
    return st.select("text_id", _r("total_surprisal").alias("total_surprisal"), _r("avg_surprisal").alias("avg_surprisal"),
                     _r("perplexity").alias("perplexity"), _ra(F.col("token_surprisals")).alias("token_surprisals"), "tokens")


@register("last_position", Q.with_ctes(LOGITS, body="SELECT text_id, max(pos) AS pos, arg_max(logits, pos) AS logits FROM lg GROUP BY text_id"))
def last_position(spark, sf_dir):
    """Logits at each text's last position."""
    return sur.last_position(logits_table(spark, sf_dir))


@register("next_token_topn", Q.with_ctes(LOGITS, """
lp AS (SELECT text_id, arg_max(logits, pos) AS logits FROM lg GROUP BY text_id),
lz AS (SELECT text_id, logits, list_max(logits) AS m FROM lp),
le AS (SELECT text_id, m + ln(list_sum(list_transform(logits, lambda x: exp(x - m)))) AS lse,
              unnest(logits) AS logit, generate_subscripts(logits, 1) - 1 AS token_id FROM lz),
rk AS (SELECT *, row_number() OVER (PARTITION BY text_id ORDER BY logit DESC, token_id) AS rank FROM le)""", body="""
SELECT text_id, CAST(rank AS INTEGER) AS rank, CAST(token_id AS INTEGER) AS token_id, round(logit, 6) AS logit,
       round(exp(logit - lse), 6) AS prob
FROM rk WHERE rank <= 5"""))
def next_token_topn(spark, sf_dir):
    """T2 + A8: five most likely next tokens after each text, with softmax probabilities."""
    lp = sur.last_position(logits_table(spark, sf_dir))
    t = lp.select("text_id", F.explode(sur.top_n(F.col("logits"), 5)).alias("e"))
    return t.select("text_id", F.col("e.rank").cast("int").alias("rank"), F.col("e.token_id").cast("int").alias("token_id"),
                    _r(F.col("e.logit")).alias("logit"), _r(F.col("e.prob")).alias("prob"))


# ----------------------------------------------------------------------------------------------
# facts, checkpoints, grid
# ----------------------------------------------------------------------------------------------
FACTS_SQL = """
fc AS (SELECT conv_id, turn, text, substring(text, 1, CAST(floor(length(text) / 2) AS INTEGER)) AS prefix,
              substring(text, CAST(floor(length(text) / 2) AS INTEGER) + 1) AS suffix FROM conversations),
ws AS (SELECT conv_id, turn, generate_subscripts(string_split(text, ' '), 1) AS wpos,
              unnest(string_split(text, ' ')) AS w FROM fc),
wst AS (SELECT conv_id, turn, wpos, w,
               CAST(coalesce(sum(length(w) + 1) OVER (PARTITION BY conv_id, turn ORDER BY wpos
                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INTEGER) AS start FROM ws),
spans AS (SELECT conv_id, turn, CAST(row_number() OVER (PARTITION BY conv_id, turn ORDER BY wpos) - 1 AS INTEGER) AS pos,
                 start, CAST(start + length(w) AS INTEGER) AS "end" FROM wst WHERE length(w) > 0),
bc AS (
  SELECT f.conv_id, f.turn, CAST(length(f.prefix) AS INTEGER) AS plen,
         max(CASE WHEN s.start < length(f.prefix) AND length(f.prefix) < s."end" THEN s.pos END) AS straddle_pos,
         min(CASE WHEN s.start >= length(f.prefix) THEN s.pos END) AS suffix_start,
         CAST(count(s.pos) AS INTEGER) AS n_tokens
  FROM fc f LEFT JOIN spans s ON s.conv_id = f.conv_id AND s.turn = f.turn
  GROUP BY f.conv_id, f.turn, f.prefix),
chk AS (
  SELECT conv_id, turn, plen AS prefix_len, n_tokens,
    CASE WHEN straddle_pos IS NOT NULL THEN 'prefix and suffix straddle a token boundary'
         WHEN suffix_start IS NULL THEN 'no suffix tokens'
         WHEN suffix_start = 0 THEN 'suffix starts at token 0: prefix is empty' END AS reason,
    suffix_start AS ss
  FROM bc)"""


def _boundary(spark, sf_dir):
    facts = conversation_facts(spark, sf_dir)
    spans = fact_ops.word_spans(facts, ["conv_id", "turn"])
    return fact_ops.boundary_check(facts, spans, ["conv_id", "turn"])


@register("boundary_check", Q.with_ctes(FACTS_SQL, body="""
SELECT conv_id, turn, prefix_len, n_tokens, CAST(CASE WHEN reason IS NULL THEN ss END AS INTEGER) AS suffix_start, reason
FROM chk"""))
def boundary_check(spark, sf_dir):
    """Suffix start and token-boundary validation of each (prefix, suffix) fact."""
    return _boundary(spark, sf_dir)


@register("fact_errors", Q.with_ctes(FACTS_SQL, body="SELECT conv_id, turn, reason FROM chk WHERE reason IS NOT NULL"))
def fact_errors(spark, sf_dir):
    """Quarantine of facts that cannot be scored, with the reason."""
    return _boundary(spark, sf_dir).where(F.col("reason").isNotNull()).select("conv_id", "turn", "reason")


GRID_SQL = """
grid AS (SELECT f.conv_id, f.turn, '6.9b' AS variant, CAST(s.step AS INTEGER) AS step
         FROM conversations f, (SELECT unnest(range(40000, 96000, 1000)) AS step) s)"""


@register("facts_steps_grid", Q.with_ctes(GRID_SQL, body="SELECT * FROM grid"))
def facts_steps_grid(spark, sf_dir):
    """S9 + S10 + J9: every fact at checkpoints 40,000 .. 95,000."""
    facts = conversation_facts(spark, sf_dir).select("conv_id", "turn")
    return fact_ops.fact_grid(facts)


@register("resume_steps", Q.with_ctes(GRID_SQL, body="SELECT * FROM grid WHERE step >= 68000"))
def resume_steps(spark, sf_dir):
    """J10 + K6: steps below 68,000 are written as finished results; the plan then yields only
    the grid rows whose step has no result on disk."""
    from ..session import fingerprint
    facts = conversation_facts(spark, sf_dir).select("conv_id", "turn")
    grid = fact_ops.fact_grid(facts)
    path = f"{shared_dir(spark)}/tokenlens/fact_steps/{fingerprint(spark, sf_dir + '/conversations.parquet')}"
    fact_ops.write_step_results(grid.where(F.col("step") < 68000), path)
    done = fact_ops.read_step_results(spark, path, "conv_id long, turn long, variant string, step int")
    return fact_ops.remaining_steps(grid, done).select("conv_id", "turn", "variant", "step")


@register("validate_checkpoints", """
SELECT vec_id, ['70m', '160m', '410m', '1.4b', '2.8b', '6.9b', '12b', '7b', '1b', '3b'][label + 1] AS variant,
  CAST(vec_id * 250 AS BIGINT) AS revision,
  CASE WHEN ['70m', '160m', '410m', '1.4b', '2.8b', '6.9b', '12b', '7b', '1b', '3b'][label + 1]
            NOT IN ('70m', '160m', '410m', '1.4b', '2.8b', '6.9b', '12b')
         THEN 'Invalid model variant: ' || ['70m', '160m', '410m', '1.4b', '2.8b', '6.9b', '12b', '7b', '1b', '3b'][label + 1]
       WHEN NOT (vec_id * 250 BETWEEN 0 AND 143000 AND (vec_id * 250) % 1000 = 0)
         THEN 'Invalid revision: ' || (vec_id * 250) || '. (Should be a number from 0 to 143000 divisible by 1000).'
  END AS reason
FROM embeddings""")
def validate_checkpoints(spark, sf_dir):
    """variant/revision domain check over candidate checkpoints drawn from a table."""
    e = read_table(spark, sf_dir, "embeddings")
    names = F.array(*[F.lit(v) for v in C.MODEL_VARIANTS + ["7b", "1b", "3b"]])
    cands = e.select("vec_id", F.try_element_at(names, F.col("label") + 1).alias("variant"),
                     (F.col("vec_id") * 250).cast("long").alias("revision"))
    return fact_ops.validate_checkpoints(cands).select("vec_id", "variant", "revision", "reason")


@register("doc_address", Q.with_ctes(Q.WORDS, """
names AS (SELECT CAST(s AS INTEGER) AS shard, 'tokenized.' || s AS file_name
          FROM (SELECT unnest(range(0, (SELECT greatest(95, max(shard) + 1) FROM corpus))) AS s)),
fmap AS (SELECT CAST(row_number() OVER (ORDER BY file_name) - 1 AS INTEGER) AS file_index, shard FROM names)""", body="""
SELECT CAST(f.file_index AS BIGINT) * 100 + c.sample_index AS doc_ix, f.file_index, c.shard, c.sample_index
FROM corpus c JOIN fmap f USING (shard)"""))
def doc_address(spark, sf_dir):
    """P14 + T5: documents numbered over lexicographically sorted index files, decoded back to
    (shard, sample_index)."""
    tc = word_corpus(spark, sf_dir)
    fmap = corpus_ops.file_index_to_shard(spark, hist.shard_count(tc.corpus))
    # one row per shard: a bounded broadcast
    docs = tc.corpus.join(F.broadcast(fmap.select("file_index", "shard")), "shard").select(
        (F.col("file_index").cast("long") * FIX_SPS + F.col("sample_index")).alias("doc_ix"))
    return corpus_ops.doc_address(docs, fmap, FIX_SPS).select("doc_ix", "file_index", "shard", "sample_index")


# ----------------------------------------------------------------------------------------------
# cover search on the word vocabulary, and text search end to end
# ----------------------------------------------------------------------------------------------
from ..functions.text import default_regex as _default_regex  # noqa: E402
from ..operators import cover as cov  # noqa: E402
from . import search as srch  # noqa: E402


def _targets(spark, sf_dir):
    tc = word_corpus(spark, sf_dir)
    t = srch.word_targets(srch.passage_targets(read_table(spark, sf_dir, "benchmark"))).transform(_ckpt)
    return tc, t


@register("prefix_index", Q.with_ctes(Q.WORDS, body="""
SELECT left(token, i) AS affix, token_id FROM (SELECT token, token_id, unnest(range(1, length(token) + 1)) AS i FROM vocab)"""))
def prefix_index(spark, sf_dir):
    """Every prefix of every vocabulary token."""
    return srch.affix_table(word_corpus(spark, sf_dir), "prefix")


@register("suffix_index", Q.with_ctes(Q.WORDS, body="""
SELECT right(token, i) AS affix, token_id FROM (SELECT token, token_id, unnest(range(1, length(token) + 1)) AS i FROM vocab)"""))
def suffix_index(spark, sf_dir):
    """P6 + K5: every suffix of every vocabulary token (written once, reused)."""
    return srch.affix_table(word_corpus(spark, sf_dir), "suffix").select("affix", "token_id")


@register("default_regex", Q.with_ctes(Q.LENS, Q.TARGETS, body="SELECT qid, '(?U)\\b' || target || '\\b' AS pattern FROM targets"))
def default_regex(spark, sf_dir):
    """The default pattern of every query (word boundaries, query not escaped)."""
    _, t = _targets(spark, sf_dir)
    return t.select("qid", _default_regex(F.col("target")).alias("pattern"))


@register("single_token_cover", Q.with_ctes(Q.WORDS, Q.LENS, Q.TARGETS, Q.COVER, body="SELECT qid, seq FROM k1"))
def single_token_cover(spark, sf_dir):
    """Single tokens containing the query."""
    tc, t = _targets(spark, sf_dir)
    return cov.single_token_cover(t, tc.vocab, srch.affix_table(tc, "suffix"), tc.joiner).select("qid", "seq")


@register("first_token_candidates", Q.with_ctes(Q.WORDS, Q.LENS, Q.TARGETS, Q.COVER, body="SELECT qid, i, token_id FROM firsts"))
def first_token_candidates(spark, sf_dir):
    """First tokens ending with the query's leading part."""
    tc, t = _targets(spark, sf_dir)
    return cov.first_token_candidates(t, tc.vocab, tc.joiner, srch.affix_table(tc, "suffix")).select("qid", "i", "token_id")


@register("tail_paths", Q.with_ctes(Q.WORDS, Q.LENS, Q.TARGETS, f"""
tws2 AS (SELECT qid, max_depth, tws, generate_subscripts(tws, 1) AS j FROM targets),
tstart AS (SELECT qid, max_depth, tws, j,
                  CAST(length(array_to_string(tws[1:j - 1], ' ')) + CASE WHEN j > 1 THEN 1 ELSE 0 END AS INTEGER) AS start
           FROM tws2),
tpath AS (
  SELECT s.qid, s.start, CAST(len(s.tws) - s.j + 1 AS INTEGER) AS depth,
         list(v.token_id ORDER BY x.j) AS seq, count(*) AS nt, count(v.token_id) AS nk, max(s.max_depth) AS md
  FROM tstart s JOIN tws2 x ON x.qid = s.qid AND x.j >= s.j
  LEFT JOIN vocab v ON v.token = x.tws[x.j] AND x.tws[x.j] <> ''
  GROUP BY s.qid, s.start, s.j, s.tws)""", body="""
SELECT qid, start, depth, seq FROM tpath WHERE nt = nk AND depth <= md - 1
UNION ALL SELECT qid, CAST(length(target) AS INTEGER), 0, CAST([] AS INTEGER[]) FROM targets"""))
def tail_paths(spark, sf_dir):
    """J2 + J3: token paths from each split point to the end of the query (bounded loop of joins)."""
    tc, t = _targets(spark, sf_dir)
    return cov.shared_tails(t, tc.vocab, None, tc.joiner).select("qid", "start", "depth", "seq")


@register("char_tail_paths", char_cover.TAILS_SQL)
def char_tail_paths(spark, sf_dir):
    """J2 + J3 with merges: all paths over a character vocabulary, no merge pair inside."""
    t, vocab, merges = char_cover.char_cover_input(spark, sf_dir)
    return cov.shared_tails(t, vocab, merges).select("qid", "start", "depth", "seq")


@register("char_cover_candidates", char_cover.COVERS_SQL)
def char_cover_candidates(spark, sf_dir):
    """U1 + J1 + J4 with merges: first tokens, which may overhang, and tails without a merge at the seam."""
    t, vocab, merges = char_cover.char_cover_input(spark, sf_dir)
    return cov.cover_candidates(t, vocab, merges).select("qid", "seq")


@register("cover_candidates", Q.with_ctes(Q.WORDS, Q.LENS, Q.TARGETS, Q.COVER, body="SELECT qid, seq FROM cand"))
def cover_candidates(spark, sf_dir):
    """U1 + A9 + J4: all distinct covering candidates of every query."""
    tc, t = _targets(spark, sf_dir)
    return cov.cover_candidates(t, tc.vocab, None, tc.joiner, sfx=srch.affix_table(tc, "suffix")).select("qid", "seq")


@register("regex_candidates", Q.with_ctes(Q.WORDS, Q.LENS, Q.TARGETS, Q.COVER, body="SELECT qid, seq, decoded FROM rx"))
def regex_candidates(spark, sf_dir):
    """Candidates whose decoded text matches the query's default pattern."""
    tc, t = _targets(spark, sf_dir)
    c = cov.cover_candidates(t, tc.vocab, None, tc.joiner, sfx=srch.affix_table(tc, "suffix"))
    d = cov.decode_sequences(c, tc.joiner, False).join(t.select("qid", "target"), "qid")
    from ..functions.text import regex_search
    return d.where(regex_search(F.col("decoded"), _default_regex(F.col("target")))).select("qid", "seq", "decoded")


@register("minimal_cover", Q.with_ctes(Q.WORDS, Q.LENS, Q.TARGETS, Q.COVER, body="SELECT qid, seq FROM mini"))
def minimal_cover(spark, sf_dir):
    """P11 + P9 + P12: round trip, regex and minimality filters: the sequences to search."""
    tc, t = _targets(spark, sf_dir)
    return srch.minimal_covers(tc, t)


@register("top_sequences", Q.with_ctes(Q.WORDS, Q.LENS, Q.TARGETS, Q.COVER, body="""
SELECT qid, CAST(rk AS INTEGER) AS rank, seq, toks AS tokens, decoded FROM (
  SELECT *, row_number() OVER (PARTITION BY qid ORDER BY len(seq), seq) AS rk FROM mini) WHERE rk <= 10"""))
def top_sequences(spark, sf_dir):
    """T4: the first ten minimal sequences of every query, with tokens and decoded text."""
    tc, t = _targets(spark, sf_dir)
    m = srch.minimal_covers(tc, t, with_text=True)
    w = Window.partitionBy("qid").orderBy(F.size("seq"), F.col("seq"))
    top = m.select("qid", "seq", "toks", "decoded", F.row_number().over(w).alias("rank")).where(F.col("rank") <= 10)
    return top.select("qid", F.col("rank").cast("int").alias("rank"), "seq", F.col("toks").alias("tokens"), "decoded")


@register("search_text", Q.with_ctes(Q.WORDS, Q.LENS, Q.TARGETS, Q.COVER, Q.OCC, Q.SEARCH, body="""
SELECT qid, shard, sample_index, token_offset, sequence, context_ok,
  CASE WHEN context_ok THEN before END AS before, CASE WHEN context_ok THEN match END AS match,
  CASE WHEN context_ok THEN after END AS after
FROM qrx"""))
def search_text(spark, sf_dir):
    """J12 + T1: every benchmark chunk searched as text: covers, hits, context, regex, sorted."""
    tc, t = _targets(spark, sf_dir)
    return srch.search_text(tc, t).select("qid", "shard", "sample_index", "token_offset", "sequence", "context_ok",
                                          "before", "match", "after")


# ----------------------------------------------------------------------------------------------
# byte-level BPE corpus (rows-only checks: DuckDB cannot tokenize)
# ----------------------------------------------------------------------------------------------
from ..operators.encode import encode_texts  # noqa: E402
from ..sources.bpecorpus import bpe_corpus  # noqa: E402
from . import bpe_search as bpe  # noqa: E402


def _bpe_targets(spark, sf_dir):
    tc, merges, tj = bpe_corpus(spark, sf_dir)
    q = srch.passage_targets(read_table(spark, sf_dir, "benchmark"))
    return tc, merges, tj, bpe.bpe_targets(q, tj).transform(_ckpt)


@register("load_vocab")
def load_vocab(spark, sf_dir):
    """Vocabulary and merge rank read from the tokenizer file, with each token's corpus
    frequency (tokens the corpus never uses have n = 0)."""
    tc, merges, _ = bpe_corpus(spark, sf_dir)
    return tc.vocab.join(tc.token_stats, "token_id", "left").select(
        "token", "token_id", "token_bytes", "is_special", F.coalesce("n", F.lit(0)).alias("n"))


@register("encode_documents")
def encode_documents(spark, sf_dir):
    """P4 + K1: the BPE token corpus of ``documents`` (batch encode job)."""
    return bpe_corpus(spark, sf_dir)[0].corpus


@register("encode_offsets")
def encode_offsets(spark, sf_dir):
    """P5: ids and character offsets of every conversation turn."""
    _, _, tj = bpe_corpus(spark, sf_dir)
    return encode_texts(read_table(spark, sf_dir, "conversations"), ["conv_id", "turn"], "text", tj, offsets=True)


@register("surface_form")
def surface_form(spark, sf_dir):
    """Surface form (joined token strings) of every query."""
    *_, t = _bpe_targets(spark, sf_dir)
    return t.select("qid", "target", "surface", "target_ids")


@register("merge_pruned_paths")
def merge_pruned_paths(spark, sf_dir):
    """J2 + J3: tails of every query's surface with merge pairs pruned at each step."""
    tc, merges, _, t = _bpe_targets(spark, sf_dir)
    return cov.shared_tails(t, tc.vocab, merges).select("qid", "start", "depth", "seq")


@register("roundtrip_filter")
def roundtrip_filter(spark, sf_dir):
    """P11 (+ P9, P12): minimal covers whose decoded text re-encodes to the same ids."""
    tc, merges, tj, t = _bpe_targets(spark, sf_dir)
    return bpe.bpe_minimal_covers(tc, merges, t, tj).select("qid", "seq", "decoded")


@register("search_text_bpe")
def search_text_bpe(spark, sf_dir):
    """J12 on the BPE corpus: every benchmark chunk (4 and 2 words) searched as text."""
    tc, merges, tj, t = _bpe_targets(spark, sf_dir)
    return bpe.bpe_search_text(tc, merges, t, tj)


# ----------------------------------------------------------------------------------------------
# fact statistics with the BPE tokenizer and the stand-in scorer (rows-only)
# ----------------------------------------------------------------------------------------------
from ..operators.scorer import bigram_scorer  # noqa: E402
from ..sources.facts import facts_table  # noqa: E402
from . import fact_stats as fstats  # noqa: E402


def _fact_run(spark, sf_dir):
    from ..session import fingerprint
    tc, _, tj = bpe_corpus(spark, sf_dir)
    vsize = int(tc.vocab.agg(F.max("token_id")).first()[0]) + 1
    facts = facts_table(spark)
    content = repr(sorted(tuple(r) for r in facts.collect()))   # the fixed facts
    out = f"{tc.root}/fact_stats/{fingerprint(spark, extra=f'bigram {vsize}: {content}')}"
    return fstats.run_fact_grid(spark, facts, bigram_scorer(tc.corpus, vsize), tc.vocab, tj, out)


@register("fact_stats_bpe")
def fact_stats_bpe(spark, sf_dir):
    """Entry point C: 34 facts x 56 checkpoints, scored by the corpus bigram stand-in, per-step
    JSON results with resume."""
    return _fact_run(spark, sf_dir)[0]


CHECKPOINTS_SQL = """
em AS (SELECT vec_id, CAST(vec_id // 8 AS BIGINT) AS text_id, vec_id % 8 AS pos, label, embedding FROM embeddings),
st AS (SELECT unnest([0, 1000, 2000, 3000, 4000]) AS step),
el AS (SELECT vec_id, label, generate_subscripts(embedding, 1) AS d, unnest(embedding) AS x FROM em),
sm AS (SELECT step, label, d, avg(CAST(x AS DOUBLE)) AS x FROM el JOIN st ON vec_id % 4 < step // 1000 GROUP BY step, label, d),
sn AS (SELECT step, label, ln(sum(exp(x))) AS z FROM sm GROUP BY step, label),
ps AS (SELECT text_id, label, lead(label) OVER (PARTITION BY text_id ORDER BY pos) AS target FROM em),
sc AS (SELECT sm.step, ps.text_id, CAST(count(*) AS BIGINT) AS n, sum(sn.z - sm.x) AS total_surprisal
       FROM ps JOIN sn ON sn.label = ps.label JOIN sm ON sm.step = sn.step AND sm.label = ps.label AND sm.d = ps.target + 1
       GROUP BY sm.step, ps.text_id)"""


def _checkpoint_run(spark, sf_dir):
    """Checkpoint ``1000 k`` has seen k of four quarters of the vectors; its logits after a token are
    the mean of that label's vectors. Checkpoint 0 has seen nothing: a finished step without rows."""
    from ..operators.scorer import checkpoint_scorer
    from ..operators.step_log import run_steps
    from ..session import fingerprint
    vectors = read_table(spark, sf_dir, "embeddings")
    sums = (vectors.select(F.pmod("vec_id", F.lit(4)).alias("quarter"), F.col("label").cast("int").alias("token_id"),
                           F.posexplode("embedding").alias("d", "x"))
            .groupBy("quarter", "token_id", "d").agg(F.sum(F.col("x").cast("double")).alias("s"), F.count("x").alias("n")))
    seen = F.transform(F.sequence(F.col("quarter") + 1, F.lit(4)), lambda k: (k * 1000).cast("int"))
    means = (sums.withColumn("step", F.explode(seen)).groupBy("step", "token_id", "d").agg((F.sum("s") / F.sum("n")).alias("x")))
    states = (means.groupBy("step", "token_id").agg(F.array_sort(F.collect_list(F.struct("d", "x"))).alias("v"))
              .select("step", "token_id", F.col("v.x").alias("logits"))).transform(_ckpt)
    w = Window.partitionBy("text_id").orderBy("pos")
    texts = logits_table(spark, sf_dir).select(F.col("text_id").alias("fact_id"), "pos", "token_id", F.lead("token_id").over(w).alias("target"))
    score = checkpoint_scorer(states)

    def compute(steps):
        wanted = F.array(*[F.lit(r.step) for r in steps.collect()])                               # five steps
        positions = texts.where(F.col("target").isNotNull()).select("*", F.explode(wanted).alias("step"))
        scored = score(positions).where(F.col("target_logit").isNotNull())
        return scored.groupBy("step", F.col("fact_id").alias("text_id")).agg(
            F.count(F.lit(1)).alias("n"), F.sum(F.col("log_norm") - F.col("target_logit")).alias("total_surprisal"))

    out = f"{shared_dir(spark)}/tokenlens/checkpoint_scores/{fingerprint(spark, sf_dir.rstrip('/') + '/embeddings.parquet')}"
    steps = spark.createDataFrame([(1000 * k,) for k in range(5)], "step int")
    return run_steps(steps, compute, out, "step int, text_id long, n long, total_surprisal double"), out


@register("checkpoint_scores", Q.with_ctes(CHECKPOINTS_SQL, body="SELECT step, text_id, n, round(total_surprisal, 6) AS total_surprisal FROM sc"))
def checkpoint_scores(spark, sf_dir):
    """F2 + K6: surprisal of every text under dense checkpoints, each loaded once for its positions."""
    return _checkpoint_run(spark, sf_dir)[0].select("step", "text_id", "n", _r(F.col("total_surprisal")).alias("total_surprisal"))


@register("checkpoint_log", Q.with_ctes(CHECKPOINTS_SQL, body="""
SELECT st.step, 'done' AS status, CAST(count(sc.text_id) AS BIGINT) AS n_rows FROM st LEFT JOIN sc USING (step) GROUP BY st.step"""))
def checkpoint_log(spark, sf_dir):
    """K6 + P21: the commit log of the same run, the empty step included."""
    from ..operators.step_log import read_log
    return read_log(spark, _checkpoint_run(spark, sf_dir)[1]).select("step", "status", "n_rows")


@register("boundary_check_bpe")
def boundary_check_bpe(spark, sf_dir):
    """P19 with tokenizer offsets: conversation turns split at their middle character."""
    _, _, tj = bpe_corpus(spark, sf_dir)
    from ..functions.ranking import dense_ids
    facts = conversation_facts(spark, sf_dir).select(F.struct("conv_id", "turn").alias("key"), "prefix", "suffix")
    facts = dense_ids(facts, "key", "fact_id").drop("key")
    return fstats.check_boundaries(fstats.tokenize_facts(facts, tj)).select("fact_id", "suffix_start", "reason")


# ----------------------------------------------------------------------------------------------
# streaming (rows-only)
# ----------------------------------------------------------------------------------------------
@register("standing_search", Q.with_ctes(Q.WORDS, Q.NEEDLES, Q.RAW_HITS, body=
    "SELECT shard, sample_index, token_offset, seq_ord, sequence FROM hits"))
def standing_search(spark, sf_dir):
    """The benchmark chunks as a standing search over the corpus shard files, processed
    incrementally (files of about 64 MB per micro-batch) with a streaming checkpoint."""
    from ..session import fingerprint
    from ..streaming.standing_search import BATCH_BYTES, run_standing_search
    tc, needles = _search_input(spark, sf_dir)
    key = fingerprint(spark, tc.corpus_path, f"{sf_dir.rstrip('/')}/benchmark.parquet", extra="standing:v2")
    base = f"{tc.root}/standing/{key}"
    return run_standing_search(spark, tc.corpus_path, needles, f"{base}/hits", f"{base}/checkpoint",
                               tc.token_stats, max_bytes_per_trigger=BATCH_BYTES)


# ----------------------------------------------------------------------------------------------
# remaining inventory rows
# ----------------------------------------------------------------------------------------------
from ..functions.arrays import is_subsequence as _is_subsequence  # noqa: E402


@register("suffix_groups", Q.with_ctes(Q.WORDS, body="""
SELECT affix, list(token_id ORDER BY token_id) AS token_ids
FROM (SELECT right(token, i) AS affix, token_id FROM (SELECT token, token_id, unnest(range(1, length(token) + 1)) AS i FROM vocab))
GROUP BY affix"""))
def suffix_groups(spark, sf_dir):
    """A10: token ids grouped by suffix (the nested form of the suffix index)."""
    return cov.affix_groups(srch.affix_table(word_corpus(spark, sf_dir), "suffix").select("affix", "token_id"))


@register("is_subsequence", Q.with_ctes(Q.WORDS, Q.NEEDLES, """
pairs AS (
  SELECT s.seq_ord AS short_ord, l.seq_ord AS long_ord, s.seq AS short_seq, l.seq AS long_seq
  FROM needles s JOIN needles l
    ON s.li = 1 AND l.li = 0 AND s.item_id = l.item_id AND (l.chunk = s.chunk // 2 OR l.chunk = s.chunk // 2 + 1))""", body="""
SELECT short_ord, long_ord,
  len(long_seq) >= len(short_seq) AND len(list_filter(range(0, len(long_seq) - len(short_seq) + 1),
      lambda i: long_seq[i + 1 : i + len(short_seq)] = short_seq)) > 0 AS is_sub
FROM pairs"""))
def is_subsequence(spark, sf_dir):
    """Contiguous-subsequence test: each 2-word chunk against the 4-word chunk that contains it
    and the one after it (an equi-join on passage and chunk index)."""
    _, needles = _search_input(spark, sf_dir)
    n = needles.withColumnRenamed("item_id", "item")
    short = n.where(F.col("r") == 1).select(F.col("seq_ord").alias("short_ord"), F.col("seq").alias("short_seq"), "item",
                                           F.explode(F.array(F.floor(F.col("chunk") / 2), F.floor(F.col("chunk") / 2) + 1)).alias("lc"))
    long_ = n.where(F.col("r") == 0).select(F.col("seq_ord").alias("long_ord"), F.col("seq").alias("long_seq"), "item",
                                           F.col("chunk").alias("lc"))
    j = short.join(long_, ["item", "lc"])
    return j.select("short_ord", "long_ord", _is_subsequence(F.col("short_seq"), F.col("long_seq")).alias("is_sub"))


@register("find_sequences_indexed", Q.with_ctes(Q.WORDS, Q.NEEDLES, Q.RAW_HITS, body=
    "SELECT shard, sample_index, token_offset, seq_ord, sequence FROM hits"))
def find_sequences_indexed(spark, sf_dir):
    """J5 strategy 2: the same batch search through the positional postings (anchor positions
    from the index, verified against the samples) -- equal to ``find_sequences``."""
    tc, needles = _search_input(spark, sf_dir)
    post = post_ops.build_postings(tc.corpus, f"{tc.root}/postings_by_token")
    pairs = post_ops.build_pair_postings(tc.corpus, f"{tc.root}/pair_postings")
    hits = find_ops.find_sequences(tc.corpus, needles, tc.token_counts, postings=post, strategy="postings", pairs=pairs)
    return find_ops.dedup_hits(hits).select(*HIT_COLS)
