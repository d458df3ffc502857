from pyspark.sql import functions as F

from tokenlens import constants as C
from tokenlens.operators import facts as fo


def test_boundary_rules(spark):
    facts = spark.createDataFrame([
        (1, "The capital of France is", " Paris"),     # ok: suffix starts at a word
        (2, "The capi", "tal of France"),              # straddles a word
        (3, "", "Paris"),                              # suffix at token 0
        (4, "Only prefix", ""),                        # no suffix tokens
    ], "fact_id int, prefix string, suffix string").withColumn("text", F.concat("prefix", "suffix"))
    spans = fo.word_spans(facts, ["fact_id"])
    got = {r.fact_id: (r.suffix_start, r.reason) for r in fo.boundary_check(facts, spans, ["fact_id"]).collect()}
    assert got[1] == (5, None)
    assert got[2][1].startswith("prefix and suffix straddle")
    assert got[3][1].startswith("suffix starts at token 0")
    assert got[4][1] == "no suffix tokens"


def test_grid_and_resume(spark, tmpdir_path):
    facts = spark.createDataFrame([(1,), (2,)], "fact_id int")
    grid = fo.fact_grid(facts)
    steps = sorted({r.step for r in grid.collect()})
    assert steps[0] == 40000 and steps[-1] == 95000 and len(steps) == 56 and grid.count() == 112
    path = tmpdir_path + "/steps"
    fo.write_step_results(grid.where("step < 50000"), path)
    done = fo.read_step_results(spark, path, "fact_id int, variant string, step int")
    rem = fo.remaining_steps(grid, done)
    assert rem.count() == 112 - 20 and rem.agg(F.min("step")).first()[0] == 50000
    # rewriting one step replaces only that step
    fo.write_step_results(grid.where("step = 40000 and fact_id = 1"), path)
    assert fo.read_step_results(spark, path, "fact_id int, variant string, step int").count() == 19


def test_validate_checkpoints(spark):
    c = spark.createDataFrame([("6.9b", 40000), ("6.9b", 143500), ("7b", 1000), ("70m", 144000)], "variant string, revision int")
    got = {(r.variant, r.revision): r.reason for r in fo.validate_checkpoints(c).collect()}
    assert got[("6.9b", 40000)] is None
    assert got[("6.9b", 143500)].startswith("Invalid revision: 143500")
    assert got[("7b", 1000)] == "Invalid model variant: 7b"
    assert got[("70m", 144000)].startswith("Invalid revision")
    assert C.FIRST_REPEATED_SEQ_IDX == 97_280_000
