import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF001 = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (SparkSession.builder.master("local[4]").appName("tokenlens-tests")
         .config("spark.sql.shuffle.partitions", "4")
         .config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false")
         .config("spark.sql.session.timeZone", "UTC")
         .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
         .getOrCreate())
    s.sparkContext.setLogLevel("ERROR")
    # the tests set their own shared folder only when the session names none
    if not s.conf.get("spark.checkpoint.dir", None):
        d = tempfile.mkdtemp(prefix="tokenlens-test-ckpt-")
        s.conf.set("spark.checkpoint.dir", d)
    from tokenlens.session import apply_runtime_conf, shared_dir
    apply_runtime_conf(s)
    shared_dir(s)
    yield s
    s.stop()


@pytest.fixture()
def tmpdir_path():
    return tempfile.mkdtemp(prefix="tokenlens-t-")


def corpus_df(spark, rows):
    """rows: list of (shard, sample_index, [ids])"""
    from tokenlens import schemas
    return spark.createDataFrame([(s, i, t) for s, i, t in rows],
                                 "shard int, sample_index int, token_ids array<int>").select(
        *[f.name for f in schemas.CORPUS.fields if f.name != "shard"], "shard").select("shard", "sample_index", "token_ids")


def seqs_df(spark, seqs):
    return spark.createDataFrame([(i, s) for i, s in enumerate(seqs)], "seq_ord long, seq array<int>")
