"""Every registered query against its SQL, and plan rules, on the smallest data folder."""
import os

import oracle
import pytest

import __spark_entry__ as entry

FOLDER = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
QUERIES, SQL = entry.queries(), entry.oracle_sql()
# nothing of this kind occurs among a thousandth of the rows
SPARSE = {"kb_by_binary", "similarity_mutual_best"}

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")


@pytest.fixture(scope="module")
def con():
    return oracle.connect(FOLDER)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    if name in SQL:
        msg = oracle.compare(spark, con, FOLDER, name, QUERIES[name], SQL[name])
        assert msg is None or (name in SPARSE and "no rows" in msg), msg
    else:
        assert QUERIES[name](spark, FOLDER).count() > 0


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "reach" in df.columns


@pytest.mark.parametrize("name", ["function_overview", "graph_resolve_callees", "graph_vtable_slots", "context_callees",
                                  "knowledge_gather", "verify_compare_traces", "runs_coverage", "traces_risk", "scan_assign_shards"])
def test_no_nested_loops(spark, name):
    df = QUERIES[name](spark, FOLDER)
    plan = df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "simple")
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan
    if name.startswith(("function", "graph", "context_call")):
        assert "text#" not in plan
