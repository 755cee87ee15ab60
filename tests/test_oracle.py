"""Every registered query against its DuckDB oracle (sf0.001 by default; SOSRANK_ORACLE_SF to change)."""

import os

import pytest

from __spark_entry__ import entry
from sosrank.plans.registry import oracle_sql, queries
from tests.helpers import SF_SMALL
from tests.oracle import compare, duck

SF = os.environ.get("SOSRANK_ORACLE_SF", SF_SMALL)


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(queries()))
def test_query_matches_oracle(spark, con, name):
    res = compare(spark, con, SF, name, queries()[name], oracle_sql().get(name))
    assert res["status"] in ("ok", "rows-only"), res


def test_every_query_has_an_oracle():
    assert set(queries()) == set(oracle_sql())


def test_entry_smoke(spark):
    df = entry(spark)
    rows = df.collect()
    assert len(rows) >= 1
    assert df.columns == ["name", "grp", "total_contests", "raw_pct", "adj_pct", "gap", "avg_mult", "rank_in_grp",
                          "percentile", "tag"]
