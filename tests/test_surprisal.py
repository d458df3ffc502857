import numpy as np
from pyspark.sql import functions as F

from tokenlens.operators import surprisal as sur


def _logits(spark):
    rng = np.random.default_rng(0)
    rows = []
    for text in range(3):
        for pos in range(5):
            rows.append((text, pos, int(rng.integers(0, 6)), [float(x) for x in rng.normal(size=6) * 3]))
    return rows, spark.createDataFrame(rows, "text_id long, pos int, token_id int, logits array<double>")


def _ls(x):
    x = np.asarray(x)
    m = x.max()
    return x - (m + np.log(np.exp(x - m).sum()))


def test_token_surprisal_and_stats(spark):
    rows, df = _logits(spark)
    got = {(r.text_id, r.pos): r.surprisal for r in sur.token_surprisal(df).collect()}
    by = {(t, p): (tok, lg) for t, p, tok, lg in rows}
    for (t, p), s in got.items():
        assert p >= 1
        assert abs(s - (-_ls(by[(t, p - 1)][1])[by[(t, p)][0]])) < 1e-9
    starts = df.select("text_id").distinct().withColumn("suffix_start", F.lit(2))
    st = {r.text_id: r for r in sur.completion_stats(sur.token_surprisal(df), starts).collect()}
    for t in range(3):
        ss = [got[(t, p)] for p in range(2, 5)]
        assert abs(st[t].total_surprisal - sum(ss)) < 1e-9
        assert abs(st[t].perplexity - np.exp(np.mean(ss))) < 1e-9
        assert st[t].token_surprisals == ss
        assert st[t].tokens == [f"<{by[(t, p)][0]}>" for p in range(2, 5)]


def test_softmax_and_top_n(spark):
    df = spark.createDataFrame([([1.0, 3.0, 3.0, -2.0, 0.5],)], "logits array<double>")
    r = df.select(sur.softmax(F.col("logits")).alias("p"), sur.top_n(F.col("logits"), 3).alias("t")).first()
    p = np.exp(_ls([1.0, 3.0, 3.0, -2.0, 0.5]))
    assert np.allclose(r.p, p)
    assert [(e.rank, e.token_id) for e in r.t] == [(1, 1), (2, 2), (3, 0)]     # ties -> smaller id first
    assert abs(r.t[0].prob - p[1]) < 1e-12


def test_last_position(spark):
    rows, df = _logits(spark)
    last = {r.text_id: (r.pos, r.logits) for r in sur.last_position(df).collect()}
    assert all(v[0] == 4 for v in last.values())
    assert last[1][1] == [lg for t, p, _, lg in rows if t == 1 and p == 4][0]
