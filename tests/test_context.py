from pyspark.sql import functions as F

from conftest import corpus_df
from tokenlens.operators import context as co
from tokenlens.operators.decode import decode_arrays, ids_to_tokens


def _vocab(spark, words):
    return spark.createDataFrame([(w, i, w.encode()) for i, w in enumerate(words)], "token string, token_id int, token_bytes binary")


def test_context_clipped_and_joined(spark):
    words = ["a", "b", "c", "d", "e", "f"]
    c = corpus_df(spark, [(0, 0, [0, 1, 2, 3, 4, 5])])
    hits = spark.createDataFrame([(0, 0, 0, 0, [0, 1]), (0, 0, 4, 1, [4, 5])],
                                 "shard int, sample_index int, token_offset int, seq_ord long, sequence array<int>")
    ids = co.context_ids_by_join(hits, c, context_len=2)
    ctx = {r.token_offset: (r.before, r.match, r.after) for r in co.hit_context(ids, _vocab(spark, words), " ").collect()}
    assert ctx[0] == ("", "a b", " c d")
    assert ctx[4] == ("c d ", "e f", "")


def test_regex_annotates_but_keeps_hit(spark):
    ctx = spark.createDataFrame([(0, 0, 0, "x ", "cat", " y"), (0, 0, 1, "con", "cat", "")],
                                "shard int, sample_index int, token_offset int, before string, match string, after string")
    out = {r.token_offset: r for r in co.context_regex(ctx, F.lit("(?U)\\bcat\\b")).collect()}
    assert out[0].context_ok and out[0].match == "cat"
    assert not out[1].context_ok and out[1].match is None        # the hit stays, context is null


def test_unescaped_query_metacharacters(spark):
    from tokenlens.functions.text import default_regex, regex_search
    df = spark.createDataFrame([("a+b",), ("aab",)], "t string")
    # the query is not escaped: 'a+b' is a regex
    got = {r.t: r.m for r in df.select("t", regex_search(F.col("t"), default_regex(F.lit("a+b"))).alias("m")).collect()}
    assert got == {"a+b": False, "aab": True}
    lit = {r.t: r.m for r in df.select("t", regex_search(F.col("t"), default_regex(F.lit("a+b"), literal=True)).alias("m")).collect()}
    assert lit == {"a+b": True, "aab": False}


def test_display_and_html_escaping(spark):
    ctx = spark.createDataFrame([(1, 2, 3, "<b>&", "x'y", "\"z\""), (1, 2, 4, None, None, None)],
                                "shard int, sample_index int, token_offset int, before string, match string, after string")
    d = co.display_hits(ctx.where("match is not null")).first().display
    assert d.splitlines()[0] == "Shard: 1, Sample: 2, Offset: 3" and "**x'y**" in d and d.endswith("-" * 40)
    good, bad = co.html_hits(ctx)
    h = good.first().html
    assert "&lt;b&gt;&amp;" in h and "x&#x27;y" in h and "&quot;z&quot;" in h
    assert bad.count() == 1


def test_byte_level_decode_keeps_split_characters(spark):
    v = spark.createDataFrame([("a", 0, b"a"), ("x1", 1, "é".encode()[:1]), ("x2", 2, "é".encode()[1:])],
                              "token string, token_id int, token_bytes binary")
    df = spark.createDataFrame([(0, [0, 1, 2]), (1, [1, 0])], "k int, ids array<int>")
    out = {r.k: r.ids_text for r in decode_arrays(df, ["k"], ["ids"], v, "", byte_level=True).collect()}
    assert out[0] == "aé"
    assert out[1] == "�a"
    toks = {r.k: r.tokens for r in ids_to_tokens(df, ["k"], "ids", v).collect()}
    assert toks[0] == ["a", "x1", "x2"]


def test_context_offset_verification(spark):
    words = ["a", "b", "c", "d"]
    c = corpus_df(spark, [(0, 0, [0, 1, 2, 3])])
    hits = spark.createDataFrame([(0, 0, 1, 0, [1, 2]), (0, 0, 2, 1, [1, 2]), (0, 0, 3, 2, [0, 1])],
                                 "shard int, sample_index int, token_offset int, seq_ord long, sequence array<int>")
    got = {r.seq_ord: (r.token_offset, r.offset_verified) for r in co.context_ids_by_join(hits, c, 1).collect()}
    assert got == {0: (1, True), 1: (1, True), 2: (3, False)}


def test_context_len_zero_skips_context(spark):
    from conftest import SF001
    from tokenlens.plans import registry as R, search as S
    tc, t = R._targets(spark, SF001)
    h = S.search_text(tc, t.limit(20), context_len=0)
    assert "before" not in h.columns and h.count() >= 0
