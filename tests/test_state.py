import pytest
from pyspark.sql import functions as F

from fleetframe.operators import state as S
from fleetframe.schemas import operator_names

KEY = ("cluster", "namespace", "release")


def test_installed_operators(spark):
    releases = spark.createDataFrame(
        [("c", "n", "hive-operator", "1.0.0", 0), ("c", "n", "hive-operator", "2.0.0", 1),
         ("c", "n", "other", "1.0.0", 2), ("c", "m", "hive-operator", "3.0.0", 3)],
        "cluster STRING, namespace STRING, name STRING, version STRING, pos INT")
    rows = S.installed_operators(releases, operator_names(spark), ["cluster"]).collect()
    assert {(r.namespace, r.version, r.pos) for r in rows} == {("n", "2.0.0", 0), ("m", "3.0.0", 3)}


def releases(spark):
    return spark.createDataFrame([("c", "n", "have", "1.0.0")], "cluster STRING, namespace STRING, release STRING, version STRING")


def requests(spark, rows):
    return spark.createDataFrame([("c", "n", *r) for r in rows], "cluster STRING, namespace STRING, release STRING, version STRING")


@pytest.mark.parametrize("release, version, install, upsert, target", [
    ("new", None, "install", "install", "0.0.0-dev"), ("new", "3.0.0", "install", "install", "3.0.0"),
    ("have", "1.0.0", "skip_same", "skip_same", None), ("have", None, "skip_unspecified", "skip_unspecified", None),
    ("have", "2.0.0", "error_conflict", "replace", "2.0.0"),
])
def test_install_plan(spark, release, version, install, upsert, target):
    asked = requests(spark, [(release, version)])
    a = S.install_plan(asked, releases(spark), "install", KEY).first()
    b = S.install_plan(asked, releases(spark), "upsert", KEY).first()
    assert (a.action, b.action, b.target_version) == (install, upsert, target)


def test_uninstall_plan(spark):
    rows = S.uninstall_plan(requests(spark, [("new", None), ("have", None)]), releases(spark), KEY).collect()
    assert {r.release: r.action for r in rows} == {"new": "not_installed", "have": "uninstall"}


@pytest.mark.parametrize("include, exclude, guard, want", [
    ([], [], True, {"full": {"uninstall hive", "install hive"}, "bare": set()}),
    ([], [], False, {"full": {"uninstall hive", "install hive"},
                     "bare": {f"{a} {p}" for a in ("install", "uninstall") for p in ("hive", "opa", "trino")}}),
    (["trino"], ["hive"], True, {"full": {"install trino"}, "bare": {"install trino"}}),
    (["trino"], [], False, {"full": {"uninstall hive", "install hive", "install trino"},
                            "bare": {"uninstall hive", "uninstall opa", "uninstall trino", "install trino"}}),
])
def test_upgrade_plan(spark, include, exclude, guard, want):
    asked = spark.createDataFrame([("full", "r"), ("bare", "r")], "cluster STRING, release STRING")
    products = spark.createDataFrame([("r", p, "1.0.0") for p in ("hive", "opa", "trino")],
                                     "release STRING, product STRING, version STRING")
    have = spark.createDataFrame([("full", "hive-operator"), ("full", "kafka-operator"), ("bare", "grafana")],
                                 "cluster STRING, name STRING")
    rows = S.upgrade_plan(asked, products, have, ("hive", "opa", "trino", "kafka"), include, exclude, guard, ["cluster"]).collect()
    got = {c: {f"{r.action} {r.product}" for r in rows if r.cluster == c} for c in ("full", "bare")}
    assert got == want


def resources(spark):
    return spark.createDataFrame(
        [("", "v1", "ConfigMap", "Namespaced", ["list"]), ("apps", "v1", "Deployment", "Namespaced", ["list"]),
         ("batch", "v1", "Job", "Namespaced", ["get"]), ("", "v1", "Node", "Cluster", ["list"])],
        "group STRING, version STRING, kind STRING, scope STRING, verbs ARRAY<STRING>")


def test_identity_and_diff(spark):
    objs = spark.createDataFrame(
        [("v1", "ConfigMap", "a", "own"), ("apps/v1", "Deployment", "b", None), ("v1", "Node", "n", "own"),
         (None, "X", "c", None), ("v9", "ConfigMap", "d", None)],
        "api_version STRING, kind STRING, name STRING, namespace STRING")
    good, rejects = S.object_identity(objs, resources(spark), F.lit("target"))
    assert {(r.name, r.group, r.version, r.namespace) for r in good.collect()} == {
        ("a", "", "v1", "target"), ("b", "apps", "v1", "target"), ("n", "", "v1", None)}
    assert {(r.name, r.error) for r in rejects.collect()} == {("c", "ObjectType"), ("d", "UnknownKind")}
    live = spark.createDataFrame(
        [("", "v1", "ConfigMap", "a", "target", "7"), ("apps", "v1", "Deployment", "b", "elsewhere", "8"),
         ("", "v1", "Node", "n", None, "9")],
        "group STRING, version STRING, kind STRING, name STRING, namespace STRING, resource_version STRING")
    on = ("group", "version", "kind", "name")
    rows = {r.name: (r.action, r.live_version) for r in S.diff_objects(good, live, "manifest", on).collect()}
    assert rows == {"a": ("patch_merge", "7"), "b": ("apply", None), "n": ("patch_merge", "9")}
    assert {r.action for r in S.diff_objects(good, live, "crd", on).collect()} == {"replace", "create"}


def test_labels_and_teardown(spark):
    objs = spark.createDataFrame(
        [("", "v1", "ConfigMap", "a", "n", {"x": "1"}), ("batch", "v1", "Job", "b", "n", {"x": "1"}),
         ("", "v1", "Node", "c", None, {"x": "1"}), ("", "v1", "ConfigMap", "d", "m", {"x": "1"}),
         ("", "v1", "ConfigMap", "e", "n", {"x": "2"}), ("", "v1", "ConfigMap", "f", "n", None)],
        "group STRING, version STRING, kind STRING, name STRING, namespace STRING, labels MAP<STRING, STRING>")
    pick = lambda ns: sorted(r.name for r in S.select_by_label(objs, resources(spark), "x", "1", ns).collect())
    assert pick("n") == ["a"] and pick(None) == ["c"]
    labelled = {r.name: r.labels for r in S.add_labels(objs, {"x": "9", "y": "1"}).collect()}
    assert labelled["a"] == {"x": "9", "y": "1"} and labelled["f"] == {"x": "9", "y": "1"}


def test_group_suffix(spark):
    crds = spark.createDataFrame(
        [("a.example.tech", "n1"), ("xexample.tech", "n2"), ("example.org", "n3"), ("b.example.tech", None)], "group STRING, name STRING")
    assert sorted(r.name for r in S.select_by_group_suffix(crds, "example.tech").collect()) == ["n1", "n2"]


def test_release_of_unknown_version_exists(spark):
    have = spark.createDataFrame([("a", None)], "release STRING, version STRING")
    want = spark.createDataFrame([("a", "1.0.0"), ("b", "1.0.0")], "release STRING, version STRING")
    assert {r.release: r.action for r in S.install_plan(want, have, "upsert", ["release"]).collect()} == {"a": "replace", "b": "install"}
    assert {r.release: r.action for r in S.uninstall_plan(want, have, ["release"]).collect()} == {"a": "uninstall", "b": "not_installed"}
