import math

from pyspark.sql import functions as F

from conftest import corpus_df
from tokenlens.operators.scorer import bigram_counts, bigram_scorer
from tokenlens.plans import fact_stats as fs

V = 5


def dense_scorer(corpus):
    """Same bigram model, as full logit vectors (the generic scorer contract)."""
    counts = bigram_counts(corpus)

    def score(positions):
        rows = {(r.shard, r.prev, r.next): r.c for r in counts.collect()}
        out = []
        for p in positions.collect():
            seen = [s for s in range(10) if s < p.step // 1000]
            out.append((p.step, p.fact_id, p.pos, p.token_id, p.target,
                        [math.log1p(sum(rows.get((s, p.token_id, v), 0) for s in seen)) for v in range(V)]))
        return positions.sparkSession.createDataFrame(
            out, "step int, fact_id int, pos int, token_id int, target int, logits array<double>")
    return score


def test_sparse_and_dense_scorers_agree(spark):
    corpus = corpus_df(spark, [(0, 0, [1, 2, 1, 2, 3]), (1, 0, [1, 3, 4]), (2, 0, [1, 2])])
    checked = spark.createDataFrame([(0, [4, 1, 2], 2, None, ["a", "b", "c"]), (1, [1, 3], 1, None, ["x", "y"])],
                                    "fact_id int, ids array<int>, suffix_start int, reason string, tokens array<string>")
    vocab = spark.createDataFrame([(f"t{i}", i) for i in range(V)], "token string, token_id int")
    steps = spark.createDataFrame([(1000,), (3000,)], "step int")
    a = {(r.step, r.fact_id): r for r in fs.completion_stats(checked, steps, bigram_scorer(corpus, V), vocab).collect()}
    b = {(r.step, r.fact_id): r for r in fs.completion_stats(checked, steps, dense_scorer(corpus), vocab).collect()}
    assert a.keys() == b.keys() == {(1000, 0), (1000, 1), (3000, 0), (3000, 1)}
    for k in a:
        assert abs(a[k].total_surprisal - b[k].total_surprisal) < 1e-9
        assert a[k].tokens == b[k].tokens
    # step 1000 has seen shard 0 only: P(2 | 1) = (1 + 2) / (5 + 2)
    assert abs(a[(1000, 0)].total_surprisal - (math.log(7) - math.log1p(2))) < 1e-9
    # step 3000 has seen shards 0-2: P(3 | 1) = (1 + 1) / (5 + 4)
    assert abs(a[(3000, 1)].total_surprisal - (math.log(9) - math.log1p(1))) < 1e-9
    assert a[(3000, 1)].tokens == ["t3"]


def test_fact_grid_quarantine_and_resume(spark, tmpdir_path):
    from conftest import SF001
    from tokenlens.sources.bpecorpus import bpe_corpus
    tc, _, tj = bpe_corpus(spark, SF001)
    facts = spark.createDataFrame([(0, "The capital of France is", " Paris"), (1, "", "Paris"), (2, "Hello wor", "ld")],
                                  "fact_id int, prefix string, suffix string")
    out = tmpdir_path + "/facts"
    res, bad = fs.run_fact_grid(spark, facts, bigram_scorer(tc.corpus, 2000), tc.vocab, tj, out)
    reasons = {r.fact_id: r.reason for r in bad.collect()}
    assert reasons[1].startswith("suffix starts at token 0")
    assert 0 not in reasons
    rows = res.where("fact_id = 0").collect()
    assert len(rows) == 56 and all(r.tokens and r.perplexity > 1 for r in rows)
    again, _ = fs.run_fact_grid(spark, facts, bigram_scorer(tc.corpus, 2000), tc.vocab, tj, out)
    assert again.count() == res.count()


def _steps(spark, *steps):
    return spark.createDataFrame([(s,) for s in steps], "step int")


def test_a_failing_step_leaves_the_others_and_is_tried_again(spark, tmpdir_path):
    from tokenlens.operators.step_log import read_log, run_steps
    out, calls, broken = tmpdir_path + "/steps", [], {3}

    def compute(steps):
        asked = sorted(r.step for r in steps.collect())
        calls.append(asked)

        def rows(batches):
            for b in batches:
                if broken & set(b["step"]):
                    raise ValueError("no checkpoint")
                yield b[b["step"] != 2].assign(x=1.5)          # step 2 finishes without rows
        return steps.mapInPandas(rows, "step int, x double")

    schema = "step int, x double"
    got = run_steps(_steps(spark, 1, 2, 3, 4, 5), compute, out, schema)
    assert sorted(r.step for r in got.collect()) == [1, 4, 5]
    log = {r.step: (r.status, r.n_rows) for r in read_log(spark, out).collect()}
    assert log == {1: ("done", 1), 2: ("done", 0), 3: ("failed", 0), 4: ("done", 1), 5: ("done", 1)}
    assert "no checkpoint" in read_log(spark, out).where("step = 3").first().error
    # the next run takes up the failed step and new ones only, not the empty one
    broken.clear()
    calls.clear()
    got = run_steps(_steps(spark, 1, 2, 3, 4, 5, 6), compute, out, schema)
    assert calls == [[3, 6]] and sorted(r.step for r in got.collect()) == [1, 3, 4, 5, 6]
    calls.clear()
    assert run_steps(_steps(spark, 1, 2, 6), compute, out, schema).count() == 5 and calls == []


def test_only_empty_steps(spark, tmpdir_path):
    from tokenlens.operators.step_log import read_log, run_steps
    out = tmpdir_path + "/steps"
    got = run_steps(_steps(spark, 1, 2), lambda s: s.where("false").selectExpr("step", "1.0D AS x"), out, "step int, x double")
    assert got.count() == 0 and read_log(spark, out).where("status = 'done' and n_rows = 0").count() == 2


def test_a_checkpoint_is_loaded_once_for_its_positions(spark):
    from tokenlens.operators.scorer import checkpoint_scorer, matrix_state
    loads = spark.sparkContext.accumulator(0)

    def load(rows):
        loads.add(1)
        return matrix_state(rows)

    states = spark.createDataFrame([(s, t, [float(s + t * v) / 7 for v in range(4)]) for s in (1, 2) for t in range(3)],
                                   "step int, token_id int, logits array<double>")
    rows = [(s, f, p, (f + p) % 4, (f * p) % 5) for s in (1, 2, 3) for f in range(20) for p in range(30)]
    positions = spark.createDataFrame(rows, "step int, fact_id int, pos int, token_id int, target int")

    def check(scored):
        got = {(r.step, r.fact_id, r.pos): (r.target_logit, r.log_norm) for r in scored.collect()}
        assert len(got) == len(rows)
        for s, f, p, t, want in rows:
            if s == 3 or t == 3 or want == 4:               # no state, unknown token, target outside
                assert got[s, f, p] == (None, None)
                continue
            logits = [float(s + t * v) / 7 for v in range(4)]
            assert abs(got[s, f, p][0] - logits[want]) < 1e-12
            assert abs(got[s, f, p][1] - math.log(sum(map(math.exp, logits)))) < 1e-12

    check(checkpoint_scorer(states, load)(positions))
    assert loads.value == 2
    check(checkpoint_scorer(states, load, rows_per_group=100, block=7)(positions))
    assert loads.value == 2 + 2 * 6                       # 600 positions a step: six parts of it
    assert checkpoint_scorer(states, load)(positions.limit(0)).count() == 0
