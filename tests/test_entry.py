"""Contract of the driver entry module, and a DuckDB comparison of every key at sf0.001."""

import duckdb
import pytest

import __spark_entry__ as E
from conftest import SF001

TABLES = ["documents", "benchmark", "embeddings", "conversations"]


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert df.columns == ["shard", "sample_index", "token_offset", "seq_ord", "sequence"]


def test_every_oracle_has_a_query():
    assert set(E.oracle_sql()) <= set(E.queries())


FAST = ["find_sequences", "hit_context", "context_regex", "repair_offsets", "stacked_histogram", "token_surprisal",
        "boundary_check", "doc_address", "search_text", "tail_paths"]


@pytest.mark.parametrize("name", FAST)
def test_matches_duckdb(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF001}/{t}.parquet')")
    from tools.oracle_check import digest
    df = E.queries()[name](spark, SF001)
    rows = [tuple(r) for r in df.collect()]
    res = con.sql(E.oracle_sql()[name])
    orows = res.fetchall()
    assert sorted(df.columns) == sorted(res.columns)
    assert len(rows) == len(orows)
    assert digest(df.columns, rows) == digest(res.columns, orows)
