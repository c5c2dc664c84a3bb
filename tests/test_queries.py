"""Every registered query against its SQL, and the shape of its plan."""

import duckdb
import pytest
from check_queries import compare, connect

import __spark_entry__ as entry
from catalog.oracles import ORACLES
from catalog.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables():
    return connect(SF)


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, tables: duckdb.DuckDBPyConnection, name):
    ok, note = compare(spark, tables, SF, QUERIES[name], ORACLES.get(name))
    assert ok or note == "no rows", note


@pytest.mark.parametrize("name", [n for n in QUERIES if not n.startswith(("r1_sync_st", "r2_", "s1_", "j1_reuse_from_tree"))])
def test_no_query_forms_pairs(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_every_oracle_has_a_query():
    assert set(ORACLES) == set(QUERIES)


def test_entry(spark):
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())
    assert entry.entry(spark).count() > 0


def test_path_queries_read_no_text(spark):
    plan = QUERIES["p8_skip_dirs"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    schema = plan.split("ReadSchema: ")[1].split("\n")[0]
    assert "text" not in schema and "doc_id" in schema
