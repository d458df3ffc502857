"""DuckDB SQL for the correctness check: the same results computed by plain SQL over the given
tables. CTE fragments below rebuild the derived fixtures (word corpus, needles) in SQL."""

# Word-token corpus of `documents`: shard = doc_id // 100, sample = doc_id % 100.
WORDS = """
words AS (
  SELECT doc_id, generate_subscripts(string_split(text, ' '), 1) - 1 AS pos,
         unnest(string_split(text, ' ')) AS word
  FROM documents),
vocab AS (
  SELECT token, CAST(dense_rank() OVER (ORDER BY token) - 1 AS INTEGER) AS token_id
  FROM (SELECT DISTINCT word AS token FROM words)),
corpus AS (
  SELECT CAST(w.doc_id // 100 AS INTEGER) AS shard, CAST(w.doc_id % 100 AS INTEGER) AS sample_index,
         list(v.token_id ORDER BY w.pos) AS token_ids,
         list(w.word ORDER BY w.pos) AS words
  FROM words w JOIN vocab v ON w.word = v.token
  GROUP BY w.doc_id)"""

LENS = """
lens AS (SELECT * FROM (VALUES (0, 4), (1, 2)) t(li, k))"""

NEEDLES = LENS + """,
bw AS (
  SELECT item_id, generate_subscripts(string_split(text, ' '), 1) - 1 AS pos,
         unnest(string_split(text, ' ')) AS word
  FROM benchmark),
chunks AS (
  SELECT li, item_id, pos // k AS chunk, list(v.token_id ORDER BY pos) AS seq, count(*) = count(v.token_id) AS known
  FROM lens, bw LEFT JOIN vocab v ON bw.word = v.token
  GROUP BY li, k, item_id, pos // k),
needles AS (
  SELECT seq_ord, seq, li, item_id, chunk
  FROM (SELECT *, row_number() OVER (ORDER BY li, item_id, chunk) - 1 AS seq_ord FROM chunks) WHERE known)"""

OCC = """
occ AS (
  SELECT shard, sample_index, token_ids, words, CAST(generate_subscripts(token_ids, 1) - 1 AS INTEGER) AS pos,
         unnest(token_ids) AS tok
  FROM corpus)"""

RAW_HITS = OCC + """,
raw_hits AS (
  SELECT o.shard, o.sample_index, CAST(o.pos AS INTEGER) AS token_offset, n.seq_ord, n.seq AS sequence,
         o.token_ids, o.words
  FROM occ o JOIN needles n ON o.tok = n.seq[1]
  WHERE o.token_ids[o.pos + 1 : o.pos + len(n.seq)] = n.seq),
hits AS (
  SELECT * FROM raw_hits
  QUALIFY row_number() OVER (PARTITION BY shard, sample_index, token_offset ORDER BY seq_ord) = 1)"""


def with_ctes(*parts: str, body: str) -> str:
    return "WITH " + ",".join(parts) + "\n" + body


# Word characters as Java's \b sees them (letters, decimal digits, underscore).
W = "[\\p{L}\\p{Nd}_]"
NW = "[^\\p{L}\\p{Nd}_]"


def literal_boundary_pattern(col: str) -> str:
    """DuckDB pattern equivalent to Java ``\\b\\Q<col>\\E\\b`` (RE2's ``\\b`` is ASCII-only)."""
    return (
        f"(CASE WHEN {col} = '' THEN '{W}' ELSE"
        f" CASE WHEN regexp_matches({col}, '^{W}') THEN '(^|{NW})' ELSE '{W}' END"
        f" || '\\Q' || {col} || '\\E' ||"
        f" CASE WHEN regexp_matches({col}, '{W}$') THEN '($|{NW})' ELSE '{W}' END END)"
    )


CONTEXT = """
ctx AS (
  SELECT shard, sample_index, token_offset, seq_ord, sequence,
    array_to_string(words[greatest(token_offset - 50, 0) + 1 : token_offset], ' ')
      || CASE WHEN token_offset > 0 THEN ' ' ELSE '' END AS before,
    array_to_string(words[token_offset + 1 : token_offset + len(sequence)], ' ') AS match,
    CASE WHEN len(words) > token_offset + len(sequence) THEN ' ' ELSE '' END
      || array_to_string(words[token_offset + len(sequence) + 1 : token_offset + len(sequence) + 50], ' ') AS after
  FROM hits)"""


def java_boundary_sql(col: str) -> str:
    """DuckDB pattern for Java ``(?U)\\b<col>\\b`` with ``col`` unescaped, for queries whose only
    metacharacter is '.': a '.' at either end consumes one character, and the boundary is then
    decided by what that character is."""
    nl_nw = "[^\\p{L}\\p{Nd}_\\n]"
    first = f"substring({col}, 1, 1)"
    last = f"right({col}, 1)"
    pre = (f"CASE WHEN {first} = '.' THEN '(?:(?:^|{NW}){W}|{W}{nl_nw})'"
           f" WHEN regexp_matches({first}, '{W}') THEN '(?:^|{NW})' ELSE '{W}' END")
    suf = (f"CASE WHEN {last} = '.' THEN '(?:{W}(?:$|{NW})|{nl_nw}{W})'"
           f" WHEN regexp_matches({last}, '{W}') THEN '(?:$|{NW})' ELSE '{W}' END")
    body = (f"substring({col}, CASE WHEN {first} = '.' THEN 2 ELSE 1 END,"
            f" length({col}) - (CASE WHEN {first} = '.' THEN 1 ELSE 0 END) - (CASE WHEN {last} = '.' THEN 1 ELSE 0 END))")
    return f"({pre} || {body} || {suf})"


TARGETS = """
tw AS (
  SELECT item_id, generate_subscripts(string_split(text, ' '), 1) - 1 AS pos,
         unnest(string_split(text, ' ')) AS word
  FROM benchmark),
tchunks AS (
  SELECT li, item_id, pos // k AS chunk, array_to_string(list(word ORDER BY pos), ' ') AS target,
         CAST(count(*) + 3 AS INTEGER) AS max_depth, list(word ORDER BY pos) AS tws
  FROM lens, tw GROUP BY li, k, item_id, pos // k),
targets AS (SELECT row_number() OVER (ORDER BY li, item_id, chunk) - 1 AS qid, target, max_depth, tws FROM tchunks)"""

COVER = """
k1 AS (SELECT t.qid, [v.token_id] AS seq FROM targets t JOIN vocab v ON contains(v.token, t.target) WHERE t.target <> ''),
tw2 AS (SELECT qid, generate_subscripts(tws, 1) AS j, unnest(tws) AS w FROM targets),
tl AS (
  SELECT tw2.qid, list(v.token_id ORDER BY tw2.j) AS tail_ids, count(*) AS nt, count(v.token_id) AS nk
  FROM tw2 LEFT JOIN vocab v ON v.token = tw2.w AND tw2.w <> ''
  WHERE tw2.j >= 2 GROUP BY tw2.qid),
firsts AS (
  SELECT t.qid, CAST(length(t.tws[1]) AS INTEGER) AS i, v.token_id
  FROM targets t JOIN vocab v ON t.tws[1] <> '' AND ends_with(v.token, t.tws[1])),
multi AS (
  SELECT f.qid, list_concat([f.token_id], coalesce(tl.tail_ids, [])) AS seq
  FROM firsts f LEFT JOIN tl ON tl.qid = f.qid
  WHERE coalesce(tl.nt, 0) = coalesce(tl.nk, 0)),
cand AS (SELECT DISTINCT qid, seq FROM (SELECT * FROM k1 UNION ALL SELECT * FROM multi)),
cexp AS (SELECT qid, seq, generate_subscripts(seq, 1) AS i, unnest(seq) AS tid FROM cand),
cdec AS (
  SELECT c.qid, c.seq, array_to_string(list(v.token ORDER BY c.i), ' ') AS decoded, list(v.token ORDER BY c.i) AS toks
  FROM cexp c JOIN vocab v ON v.token_id = c.tid GROUP BY c.qid, c.seq),
rx AS (
  SELECT d.qid, d.seq, d.decoded, d.toks, t.target FROM cdec d JOIN targets t USING (qid)
  WHERE regexp_matches(d.decoded, """ + java_boundary_sql("t.target") + """)),
mini AS (
  SELECT qid, seq, decoded, toks, target FROM rx
  WHERE NOT list_bool_or(list_transform(range(1, len(toks) + 1),
        lambda d: contains(array_to_string(list_filter(toks, lambda x, i: i <> d), ' '), target))))"""

SEARCH = """
sq AS (SELECT DISTINCT seq FROM mini),
shits AS (
  SELECT o.shard, o.sample_index, o.pos AS token_offset, s.seq, o.words
  FROM occ o JOIN sq s ON o.tok = s.seq[1]
  WHERE o.token_ids[o.pos + 1 : o.pos + len(s.seq)] = s.seq),
qh AS (
  SELECT m.qid, m.target, h.shard, h.sample_index, h.token_offset, h.seq AS sequence, h.words
  FROM shits h JOIN mini m ON m.seq = h.seq
  QUALIFY row_number() OVER (PARTITION BY m.qid, h.shard, h.sample_index, h.token_offset ORDER BY len(h.seq), h.seq) = 1),
qctx AS (
  SELECT qid, target, shard, sample_index, token_offset, sequence,
    array_to_string(words[greatest(token_offset - 50, 0) + 1 : token_offset], ' ')
      || CASE WHEN token_offset > 0 THEN ' ' ELSE '' END AS before,
    array_to_string(words[token_offset + 1 : token_offset + len(sequence)], ' ') AS match,
    CASE WHEN len(words) > token_offset + len(sequence) THEN ' ' ELSE '' END
      || array_to_string(words[token_offset + len(sequence) + 1 : token_offset + len(sequence) + 50], ' ') AS after
  FROM qh),
qrx AS (SELECT *, regexp_matches(before || match || after, """ + java_boundary_sql("target") + """) AS context_ok FROM qctx)"""
