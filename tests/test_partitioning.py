"""Operators give the same rows whatever the partitioning and order of their input."""

import pytest
from pyspark.sql import functions as F

from fleetframe.operators import capacity, catalog, inventory, ttl, versions
from fleetframe.operators.ordering import enumerate_rows, join_text
from fleetframe.plans import capacities, inventories
from fleetframe.plans import versions as version_queries
from fleetframe.plans.views import table, view


def listed(df):
    return sorted(map(str, df.collect()))


CASES = {
    "overlay": ("v_def", lambda df: catalog.overlay_last_wins(df, ["name"])),
    "enumerate": ("v_def", lambda df: enumerate_rows(df, ["source_ord", "pos"], ["name"])),
    "join_text": ("v_def", lambda df: join_text(
        df.withColumn("t", F.col("pos").cast("string")), ["name"], ["source_ord", "pos"], "t")),
    "conditions": ("v_condition", lambda df: inventory.condition_report(
        inventory.normalize_conditions(df), ["cluster"], ["ord"])),
    "latest": ("v_feed", lambda df: versions.latest_release(df, "tool-", ["repo"]).good),
}


@pytest.mark.parametrize("name", CASES)
def test_views(spark, sf_dir, name):
    source, run = CASES[name]
    df = view(spark, sf_dir, source)
    want = listed(run(df))
    for n in (1, 4, 64):
        assert listed(run(df.orderBy(F.rand(n)).repartition(n))) == want


def test_other_inputs(spark, sf_dir):
    nodes, artifacts = capacities.nodes(spark, sf_dir), version_queries.artifacts(spark, sf_dir)
    log, services = table(spark, sf_dir, "events"), inventories.services(spark, sf_dir)
    runs = [
        (nodes, lambda df: capacity.cluster_capacity(df, ["cluster"]).good),
        (nodes, lambda df: capacity.guess_environment(df, ["cluster"])),
        (artifacts, lambda df: versions.version_index(versions.artifact_versions(df).good).good),
        (log, lambda df: ttl.ttl_replay(df, ["user_id"], "ts", 86400, ["event_id"])),
        (services.withColumn("ports", F.array(F.struct(
            F.lit("http").alias("name"), F.lit(1).alias("port"), F.lit(2).alias("node_port")))),
         lambda df: inventory.loadbalancer_endpoints(df, scope=["cluster"])),
    ]
    for df, run in runs:
        want = listed(run(df))
        for n in (1, 64):
            assert listed(run(df.orderBy(F.rand(n)).repartition(n))) == want
