"""Staged install plans on hand-made specs."""

from decimal import Decimal

import pytest

from fleetframe.operators import installs as I
from fleetframe.plans.states import resources

SPEC = ("name STRING, {0} STRING, supported_namespaces ARRAY<STRING>, cpu STRING, memory STRING, "
        "parameters ARRAY<STRUCT<name: STRING, default: STRING>>, manifests ARRAY<STRUCT<api_version: STRING, kind: STRING, name: STRING>>")


def plan(spark, requests, demos=None, installed=(), live=()):
    """Rows of each request: (item, stage, name, value, action, error)."""
    size = [("size", "1")]
    demos = demos or [("d", "s", [], None, None, size, [("v1", "ConfigMap", "cm")])]
    stacks = [("s", "r", [], "1", "1Gi", size, [("apps/v1", "Deployment", "app")], ["a", "b"]),
              ("norelease", "gone", None, None, None, [], [], []), ("all", "r", ["ns"], None, None, [], None, [])]
    frame = I.demo_install_plan(
        spark.createDataFrame([(i, 1, "ops", *r) for i, r in enumerate(requests)],
                              "id INT, cluster INT, operator_namespace STRING, demo STRING, namespace STRING, accepted BOOLEAN, "
                              "skip_release BOOLEAN, stack_parameters ARRAY<STRING>, parameters ARRAY<STRING>"),
        spark.createDataFrame(demos, SPEC.format("stack")),
        spark.createDataFrame(stacks, SPEC.format("release") + ", operators ARRAY<STRING>"),
        spark.createDataFrame([("r", [(0, "a", "1.0"), (1, "b", "2.0"), (2, "c", "3.0")])],
                              "name STRING, products ARRAY<STRUCT<pos: INT, name: STRING, version: STRING>>"),
        spark.createDataFrame([(1, Decimal(500), Decimal(2**40))], "cluster INT, cpu_millis DECIMAL(38,3), memory_bytes DECIMAL(38,3)"),
        spark.createDataFrame([(1, "ops", *r) for r in installed], "cluster INT, operator_namespace STRING, release STRING, version STRING"),
        resources(spark),
        spark.createDataFrame([(1, *o) for o in live],
                              "cluster INT, group STRING, version STRING, kind STRING, name STRING, namespace STRING, resource_version STRING"),
        "example.com", "fleet", "Acme", scope=["cluster"])
    out = {}
    for r in frame.orderBy("id", "stage", "ord").collect():
        out.setdefault(r.id, []).append(r)
    return [out[i] for i in range(len(requests))]


def head(rows):
    return next((r.action, r.stage, r.value, r.error, r.detail) for r in rows if r.item == "request")


def test_whole_plan(spark):
    (rows,) = plan(spark, [("d", "default", True, False, ["size=2", "size=3"], None)],
                   installed=[("a-operator", "1.0"), ("c-operator", "9")], live=[("apps", "v1", "Deployment", "app", "d", "77")])
    assert head(rows) == ("install", "done", "d", None, None)
    found = {(r.item, r.stage, r.name): (r.value, r.action, r.namespace) for r in rows if r.item != "request"}
    assert found == {
        ("warning", "stack_prerequisites", "InsufficientCpu"): ("1000 > 500", None, None),
        ("operator", "release", "a"): (None, "skip_same", None), ("operator", "release", "b"): ("2.0", "install", None),
        **{("parameter", "stack_parameters", k): (v, None, None) for k, v in (("DEMO", "d"), ("NAMESPACE", "d"), ("STACK", "s"), ("size", "3"))},
        **{("parameter", "demo_parameters", k): (v, None, None) for k, v in (("DEMO", "d"), ("NAMESPACE", "d"), ("STACK", "s"), ("size", "1"))},
        ("manifest", "stack_manifests", "app"): (None, "patch_merge", "d"), ("manifest", "demo_manifests", "cm"): (None, "apply", "d"),
    }
    labels = {r.name: r.labels for r in rows if r.labels}
    assert labels["app"] == {"example.com/managed-by": "fleet", "example.com/demo": "d", "example.com/vendor": "Acme", "example.com/stack": "s"}
    assert "example.com/stack" not in labels["cm"]


def test_first_error_of_every_stage(spark):
    one = [("v1", "ConfigMap", "cm")]
    demos = [("d", "s", [], None, None, [("size", "1")], one), ("nostack", "x", [], None, None, [], one), ("closed", "s", ["other"], "lots", "1", [], one),
             ("bad", "s", None, "1", "many", [], one), ("stackclosed", "all", [], None, None, [], one), ("gone", "norelease", [], None, None, [], one),
             ("kind", "s", [], None, None, [("size", "1")], [("v1", "ConfigMap", "cm"), (None, "Job", "j"), ("v9", "Odd", "o")])]
    ask = lambda demo, stack=(), own=(), skip=False: (demo, "ns1", False, skip, list(stack), list(own))
    rows = plan(spark, [
        ask("nodemo"), ask("nostack", ["bad"]), ask("closed"), ask("bad"), ask("stackclosed"), ask("gone"), ask("gone", skip=True),
        ask("d", ["size"], ["x=1"]), ask("d", [], ["", "x=1"]), ask("d", [], ["size=2", "x=1", "y=1"]), ask("kind")], demos)
    assert [head(r)[1:] for r in rows] == [
        ("demo", "ns1", "NoSuchDemo", "nodemo"), ("stack", "ns1", "NoSuchStack", "x"),
        ("demo_prerequisites", "ns1", "UnsupportedNamespace", "other"),
        ("demo_prerequisites", "ns1", "ParseMemoryResourceRequirements", "many"),
        ("stack_prerequisites", "ns1", "UnsupportedNamespace", "ns"), ("release", "ns1", "NoSuchRelease", "gone"), ("done", "ns1", None, None),
        ("stack_parameters", "ns1", "InvalidEqualSignCount", None), ("demo_parameters", "ns1", "EmptyInput", None),
        ("demo_parameters", "ns1", "InvalidParameter", "x, expected size"), ("demo_manifests", "ns1", "ObjectType", "j")]
    assert [len(r) for r in rows[:4]] == [1, 1, 1, 1] and {r.item for r in rows[7]} == {"request", "warning", "operator"}
    assert [(r.name, r.action, r.error) for r in rows[10] if r.stage == "demo_manifests" and r.item == "manifest"] == [
        ("cm", "apply", None), ("j", None, "ObjectType"), ("o", None, "UnknownKind")]


def test_conflict_ends_before_parameters(spark):
    (rows,) = plan(spark, [("d", "ns1", False, False, ["broken"], [])], installed=[("b-operator", "1.9")])
    assert head(rows) == ("fail", "release", "ns1", "OperatorConflict", "b")
    assert {(r.name, r.action) for r in rows if r.item == "operator"} == {("a", "install"), ("b", "error_conflict")}
    assert {r.stage for r in rows} == {"release", "stack_prerequisites"}


def test_each_table_is_read_once(spark, sf_dir):
    import re

    from fleetframe import plans

    plan_text = plans.QUERIES["demo_install_plan"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    scans = re.findall(r"\[file:[^\]]*/(\w+)\.parquet\]", plan_text)
    # supplier is the table of two views: stacks and nodes.
    assert sorted(scans) == ["customer", "events", "nation", "orders", "part", "supplier", "supplier"]
