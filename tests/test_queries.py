"""Every registered query against its SQL twin (the driver's check) on the
smallest data set, plus the flagship entry point."""
import pytest

import __spark_entry__ as E
from tests.oracle_check import compare, duck

SF = "/root/testdata/sf0.001"
OWN = E.QUERIES  # the optional subpackage has its own tests
NAMES = sorted(n for n in E.oracle_sql() if n in OWN)


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, con, name):
    info = compare(spark, SF, name, E.queries()[name], E.oracle_sql()[name], con)
    assert info["ok"], info


def test_every_query_runs(spark):
    for name, q in OWN.items():
        if name not in NAMES:
            assert q(spark, SF).count() > 0, name


def test_entry(spark):
    df = E.entry(spark)
    assert df.columns == ["step", "bleu"] and df.count() == 3


def test_plans_have_no_unbounded_single_partition_steps(spark):
    """Scale check on every registered plan: a single-partition exchange may
    only carry partial aggregates or counts (one row per task), and no plan may contain
    a cartesian product or a nested-loop join."""
    for name, q in OWN.items():
        lines = q(spark, SF)._jdf.queryExecution().executedPlan().toString().split("\n")
        for i, line in enumerate(lines):
            assert "CartesianProduct" not in line and "BroadcastNestedLoopJoin" not in line, (name, line)
            if "Exchange SinglePartition" in line:
                nxt = lines[i + 1]
                per_task = "__task" in nxt  # row counts of the tasks, for dense positions
                assert "Aggregate" in nxt and ("partial_" in nxt or per_task), (name, line, nxt)


def test_ter_matches_sql(spark, con):
    from tests.ter_sql import TER
    info = compare(spark, SF, "ter", E.queries()["ter"], TER, con)
    assert info["ok"], info
    full = f'SELECT s.*, t.ter AS "TER" FROM ({E.oracle_sql()["summary_wide"]}) s JOIN ({TER}) t USING (step)'
    info = compare(spark, SF, "summary_full", E.queries()["summary_full"], full, con)
    assert info["ok"], info
