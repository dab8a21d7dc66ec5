"""Every registered query gives rows at the smallest scale and equals its SQL."""

import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1] / "tools"))
import check_oracle  # noqa: E402

from mnemospark.workload import catalog  # noqa: E402

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test data")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for t in check_oracle.TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, con, name):
    result = check_oracle.compare(spark, con, name, SF)
    assert result.startswith(("ok", "rows")), result
    assert int(result.split()[1]) > 0


def test_risk_sends_no_table_of_orders_through_the_driver(spark):
    plan = catalog.QUERIES["risk_score"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [question_id" in plan and "BroadcastHashJoin [question_id" not in plan
