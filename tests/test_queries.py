"""Every registered query against its SQL, and the shape of its plan."""

import re

import pytest

import __spark_entry__ as contract
from fleetframe import plans
from tests.compare import compare, connect

NAMES = sorted(plans.QUERIES)
SCANS = {"ttl_replay", "interval_gate", "purge_replay", "render_parse"}


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


def test_every_query_has_sql():
    assert set(plans.QUERIES) == set(plans.ORACLE)
    assert set(plans.QUERIES) <= set(contract.queries())


@pytest.mark.parametrize("name", NAMES)
def test_same_as_sql(spark, con, sf_dir, name):
    difference, _ = compare(
        spark, con, name, contract.queries()[name], contract.oracle_sql()[name], sf_dir
    )
    assert difference is None


@pytest.mark.parametrize("name", NAMES)
def test_plan(spark, sf_dir, name):
    """No pairwise joins, and Python only in the parser and the two sequential scans."""
    df = contract.queries()[name](spark, sf_dir)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not re.search("CartesianProduct|NestedLoopJoin", plan)
    assert bool(re.search("Python|InArrow|InPandas", plan)) == (name in SCANS)


@pytest.mark.parametrize("name", [
    "namespace_ok", "lookup", "param_parse", "param_lists", "spec_validate", "state_diff", "node_ips", "ttl_status",
    "render", "render_parse", "install_plan", "include_exclude", "expired_entries", "label_overlay",
])
def test_one_pass(spark, sf_dir, name):
    """Rejects and variants come with the rows: every table is read once, every document parsed once."""
    plan = contract.queries()[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    scans = re.findall(r"\[file:[^\]]*/(\w+)\.parquet\]", plan)
    assert scans and len(scans) == len(set(scans))
    assert plan.count("InArrow") == (name == "render_parse")


def test_entry(spark):
    assert contract.entry(spark).count() > 0
