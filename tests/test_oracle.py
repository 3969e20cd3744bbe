"""Every registered query against its check text, and plain runs of the others."""

import pytest
from compare import connect, difference, duck_rows, spark_rows

from storyloom.plans.catalog import load

QUERIES, ORACLES = load()


@pytest.fixture(scope="module")
def con(folder):
    return connect(folder)


IN_PYTHON = {
    "redact_json", "decode_body", "charset_learned", "extract_html", "extract_main", "extract_route", "language_id",
    "knn_deep", "knn_every_row", "knn_exact", "knn_ivf", "knn_ivf_all_cells", "retry_twice", "search_hybrid", "stages_end_to_end",
}
PYTHON_NODES = ("MapInPandas", "MapInArrow", "ArrowEvalPython", "BatchEvalPython", "FlatMap")


def check_plan(df, key):
    """No cross joins anywhere, and Python only in the operators that need it."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    if key not in IN_PYTHON:
        assert not any(node in plan for node in PYTHON_NODES)


@pytest.mark.parametrize("key", sorted(ORACLES))
def test_equal(spark, folder, con, key):
    df = QUERIES[key](spark, folder)
    check_plan(df, key)
    assert difference(spark_rows(df), duck_rows(con, ORACLES[key])) is None


@pytest.mark.parametrize("key", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, folder, key):
    df = QUERIES[key](spark, folder)
    check_plan(df, key)
    assert df.count() > 0


def test_names():
    assert set(ORACLES) <= set(QUERIES)
    assert not [k for k in QUERIES if "pipeline" in k or k.startswith("op")]
