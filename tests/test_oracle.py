"""Every registered query against its DuckDB oracle on the sf0.001 tables
(rows-only queries must run and return rows)."""

import pytest

import __spark_entry__ as E
from oracle_check import compare

SMOKE = "/root/testdata/sf0.001"
NAMES = sorted(E.queries())


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, duck, name):
    r = compare(spark, duck, name, SMOKE)
    assert r["status"] in ("match", "rows-only"), r
    assert r["spark_rows"] > 0


def test_entry(spark):
    df = E.entry(spark)
    assert df.columns == ["doc_id", "text", "n_chunks", "n_fallback"]
    assert df.count() > 0
