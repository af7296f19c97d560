"""Every registered query of the keyed-table engine against its SQL oracle."""

import pytest
from conftest import SF
from oracle import differences

from loam.plans import ORACLES, QUERIES


def test_all_have_oracles():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    assert differences(spark, QUERIES[name], ORACLES[name], SF) == ""


def test_entry(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).columns == ["key", "value"]


def test_key_filter_reaches_the_scan(spark, tmp_path):
    """Point lookups and ranges over a stored log and its state filter in the scan, below the fold."""
    from loam.operators import fold, lookup
    from loam.plans.keyed import log
    from loam.sources.changelog import append, replay

    append(log(spark, SF), f"{tmp_path}/log")
    stored = replay(spark, f"{tmp_path}/log")
    for df, pushed in ((lookup.get(stored, "7"), "EqualTo(key,7)"), (lookup.between(fold.state(stored), "12", "70"), "GreaterThanOrEqual(key,12)")):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert pushed in plan.split("PushedFilters")[1].split("ReadSchema")[0]


def test_value_filter_stays_above_the_fold(spark):
    """Filtering the state by value must not let an overwritten version through."""
    from loam.operators import fold

    rows = spark.createDataFrame([(0, 0, "a", "x"), (1, 0, "a", "y")], "seq long, op int, key string, value string")
    assert fold.state(rows).where("value = 'x'").count() == 0
