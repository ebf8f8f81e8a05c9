import json

import pytest
from pyspark.sql import functions as F

from fleetframe.operators.catalog import overlay_last_wins, resolve_refs
from fleetframe.operators.inventory import endpoints, node_ips, product_objects
from fleetframe.operators.state import object_identity
from fleetframe.operators.versions import explode_index
from fleetframe.schemas import product_kinds
from fleetframe.sources import objects as O, registry as G, yaml_docs as Y

DEMOS = """
demos:
  warehouse:
    description: Real-time analysis
    documentation: https://my.corp/post.html
    platformStack: warehouse-stack
    labels: [mycorp, dashboards]
    manifests:
      - plainYaml: https://my.corp/tables.yaml
      - helmChart: https://my.corp/chart.yaml
    parameters:
      - {name: adminPassword, description: Secret, default: admin}
  small:
    description: Small
    platformStack: other
    supportedNamespaces: [a]
    resourceRequests: {cpu: 500m, memory: 4Gi, pvc: 1Gi}
"""
STACKS = """
stacks:
  warehouse-stack:
    description: Internal
    platformRelease: 23.10 # stays text
    platformOperators: [commons, trino]
"""
RELEASES = """
releases:
  "23.10":
    releaseDate: 2022-11-10
    description: Internal release
    products:
      trino: {operatorVersion: 0.8.0}
      commons: {operatorVersion: 0.4.0}
      airflow: {operatorVersion: 0.1.0}
  second:
    releaseDate: soon
    description: d
    products: {}
"""


def put(tmp_path, name, text):
    path = tmp_path / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)
    return str(path)


def test_catalogs(spark, tmp_path):
    first = put(tmp_path, "a/demos.yaml", DEMOS)
    second = put(tmp_path, "b/demos.yaml", "demos:\n  warehouse: {description: New, platformStack: s2}\n  extra: {description: E, platformStack: s}\n")
    rows, rejects = Y.read_demos(spark, [first, second], "platform")
    assert rejects.count() == 0
    merged = overlay_last_wins(rows, ["name"], Y.ORDER_COLUMNS).orderBy(*Y.ORDER_COLUMNS).collect()
    assert [(r.name, r.description, r.stack) for r in merged] == [
        ("warehouse", "New", "s2"), ("small", "Small", "other"), ("extra", "E", "s")]
    demo = {(r.name, r.source_ord): r for r in rows.collect()}
    full, small = demo[("warehouse", 0)], demo[("small", 0)]
    assert [tuple(m) for m in full.manifests] == [("plainYaml", "https://my.corp/tables.yaml"), ("helmChart", "https://my.corp/chart.yaml")]
    assert full.supported_namespaces == [] and full.labels == ["mycorp", "dashboards"] and full.resource_requests is None
    assert full.parameters[0].default == "admin" and small.resource_requests.cpu == "500m"
    assert small.documentation is None and small.manifests == [] and small.parameters == []


def test_references_from_files(spark, tmp_path):
    demos = Y.read_demos(spark, put(tmp_path, "d.yaml", DEMOS), "platform").good
    stacks = Y.read_stacks(spark, put(tmp_path, "s.yaml", STACKS), "platform").good
    releases = Y.read_release_catalog(spark, put(tmp_path, "r.yaml", RELEASES)).good
    rows = resolve_refs(demos, stacks, releases).orderBy("pos").collect()
    assert [(r.demo, r.release, r.product, r.version) for r in rows] == [
        ("warehouse", "23.10", "trino", "0.8.0"), ("warehouse", "23.10", "commons", "0.4.0")]
    days = {r.name: (r.release_date, str(r.release_day)) for r in releases.collect()}
    assert days == {"23.10": ("2022-11-10", "2022-11-10"), "second": ("soon", "None")}


def test_bad_documents(spark, tmp_path):
    put(tmp_path, "y/good.yaml", "demos: {a: {description: d, platformStack: s}}")
    put(tmp_path, "y/broken.yaml", "demos: [")
    put(tmp_path, "y/wrong.yaml", "stacks: {}")
    put(tmp_path, "y/empty.yaml", "")
    good, rejects = Y.read_yaml_documents(spark, str(tmp_path / "y"), "demos", partitions=3)
    assert [r.name for r in good.collect()] == ["a"]
    assert sorted(r.file.rsplit("/", 1)[1] for r in rejects.collect()) == ["broken.yaml", "wrong.yaml"]
    with pytest.raises(Exception, match="rejected row"):
        Y.read_yaml_documents(spark, str(tmp_path / "y"), "demos", on_error="fail").good.collect()


def test_charts_indexes_and_values(spark, tmp_path):
    chart = Y.read_chart_files(spark, put(tmp_path, "c.yaml", """
releaseName: postgresql-superset
name: postgresql
repo: {name: bitnami, url: https://charts.example.com/bitnami/}
version: 16.7.21
options: {auth: {username: superset}}
""")).good.first()
    assert (chart.release_name, chart.repo.name, chart.version) == ("postgresql-superset", "bitnami", "16.7.21")
    assert json.loads(chart.options) == {"auth": {"username": "superset"}}
    index = Y.read_chart_index(spark, put(tmp_path, "i.yaml", """
apiVersion: v1
entries:
  a-operator: [{name: a-operator, version: 1.0.0, digest: x}, {name: a-operator, version: 1.1.0}]
  b-operator: []
""")).good
    rows = explode_index(index).collect()
    assert [(r.chart, r.pos, r.version) for r in rows] == [("a-operator", 0, "1.0.0"), ("a-operator", 1, "1.1.0")]


def test_manifests(spark, tmp_path):
    docs = Y.read_yaml_documents(spark, put(tmp_path, "m.yaml", """
apiVersion: apps/v1
kind: Deployment
metadata: {name: web, namespace: own, labels: {app: x}}
---
apiVersion: v1
kind: Node
metadata: {name: n}
---
metadata: {name: typeless}
""")).good
    resources = spark.createDataFrame([("apps", "v1", "Deployment", "Namespaced"), ("", "v1", "Node", "Cluster")],
                                      "group STRING, version STRING, kind STRING, scope STRING")
    good, rejects = object_identity(Y.manifest_objects(docs), resources, F.lit("target"))
    assert {(r.name, r.group, r.namespace) for r in good.collect()} == {("web", "apps", "target"), ("n", "", None)}
    assert [(r.name, r.error) for r in rejects.collect()] == [("typeless", "ObjectType")]


def export(tmp_path, kind, cluster, objs):
    lines = [json.dumps({"pos": i, "snapshot_ts": "2024-01-01T00:00:00Z", **o}) for i, o in enumerate(objs)]
    put(tmp_path, f"kind={kind}/cluster_id={cluster}/snapshot_date=2024-01-01/part.json", "\n".join(lines))


def meta(name, product=None, owner=None, namespace="n"):
    labels = {"app.kubernetes.io/name": product, "app.kubernetes.io/instance": owner} if product else {}
    return {"name": name, "namespace": namespace, "labels": labels}


@pytest.fixture(scope="module")
def exported(tmp_path_factory):
    path = tmp_path_factory.mktemp("export")
    export(path, "Service", "c1", [
        {"metadata": meta("foo-web", "hive", "foo"), "spec": {"type": "NodePort", "ports": [{"name": "http", "port": 80, "nodePort": 30080}]}},
        {"metadata": meta("lb", "hive", "bar", "m"), "spec": {"type": "LoadBalancer", "ports": [{"port": 1}]},
         "status": {"loadBalancer": {"ingress": [{"ip": "1.1.1.1"}]}}}])
    export(path, "Service", "c2", [{"metadata": meta("x")}])
    export(path, "Listener", "c1", [{"metadata": meta("listener-baz-0", "hive", "baz"),
                                     "status": {"ingressAddresses": [{"address": "h", "ports": {"https": 443}}]}}])
    export(path, "Endpoints", "c1", [{"metadata": meta("foo-web"), "subsets": [{"addresses": [{"nodeName": "n1"}]}]}])
    export(path, "Node", "c1", [{"metadata": meta("n1", namespace=None), "spec": {"providerID": "kind://x"},
                                 "status": {"allocatable": {"cpu": "2"}, "addresses": [{"type": "InternalIP", "address": "10.0.0.1"}]}}])
    export(path, "HiveCluster", "c1", [
        {"apiVersion": "hive.example.com/v1alpha1", "kind": "HiveCluster", "metadata": meta(n, namespace=ns),
         "status": {"conditions": [{"type": "Available", "status": "True"}]}} for n, ns in (("foo", "n"), ("bar", "m"), ("baz", "n"))])
    export(path, "StatefulSet", "c1", [{"metadata": meta("s"), "status": {"conditions": [{"type": "A", "status": "B"}]}}])
    return str(path)


def test_object_export_to_endpoints(spark, exported):
    read = lambda kind: O.read_objects(spark, exported, kind)
    products = product_objects(read("HiveCluster").drop("product", "owner"), product_kinds(spark, "example.com")).good
    assert products.count() == 3 and products.filter(F.size("conditions") == 1).count() == 3
    owners = products.withColumnRenamed("name", "owner")
    good, rejects = endpoints(owners, read("Listener"), read("Service"), read("Endpoints"), node_ips(read("Node")).good)
    assert {(r.owner, r.endpoint, r.url) for r in good.collect()} == {
        ("foo", "web-http", "http://10.0.0.1:30080"), ("bar", "lb-1", "1.1.1.1:1"), ("baz", "0-https", "https://h:443")}
    assert rejects.count() == 0


def test_object_scan(spark, exported):
    assert O.read_objects(spark, exported, "Service").count() == 3
    assert O.read_objects(spark, exported, "Service", ["c2"]).count() == 1
    assert O.read_objects(spark, exported, "Service", namespace="m").count() == 1
    assert O.read_objects(spark, exported, "NeverExported").count() == 0
    assert O.read_objects(spark, exported, "StatefulSet").first().conditions[0].type == "A"
    plan = O.read_objects(spark, exported, "Service", ["c2"])._jdf.queryExecution().executedPlan().toString()
    pruned = plan.split("PartitionFilters")[1].split("PushedFilters")[0]
    assert "= Service" in pruned and "= c2" in pruned


def test_object_stream(spark, exported, tmp_path):
    out = []
    stream = O.read_objects(spark, exported, "Service", streaming=True)
    (stream.writeStream.foreachBatch(lambda df, _: out.extend(df.collect())).trigger(availableNow=True)
     .option("checkpointLocation", str(tmp_path / "check")).start().awaitTermination())
    assert len(out) == 3


def test_releases(spark, tmp_path):
    rows = [{"name": "a", "version": "1", "namespace": "n", "status": "failed", "lastUpdated": "2024-01-02 03:04:05.6 +0000 UTC"},
            {"name": "b", "version": "1", "namespace": "n", "status": "deployed", "lastUpdated": "never"}]
    put(tmp_path, "cluster_id=c/r.json", "\n".join(map(json.dumps, rows)))
    got = {r.name: r for r in O.read_releases(spark, str(tmp_path), ["c"]).collect()}
    assert got["a"].status == "failed" and got["a"].updated_at.hour == 3 and got["b"].updated_at is None
    assert got["b"].last_updated == "never"


def page(n, start=0):
    return json.dumps([{"digest": f"d{start + i}", "tags": [{"name": f"1.0.{start + i}"}]} for i in range(n)])


def test_pages_and_audit(spark, tmp_path):
    for repo, counts in {"whole": [20, 20, 3], "exact": [20, 0], "cut": [20, 20], "inside": [19, 20, 1], "gap": [20, None, 5]}.items():
        for i, n in enumerate(counts):
            if n is not None:
                put(tmp_path, f"charts/{repo}/{i + 1}.json", page(n, i * 100))
    put(tmp_path, "charts/bad/1.json", "{not json")
    good, rejects = G.read_artifact_pages(spark, str(tmp_path))
    assert [r.repository for r in rejects.collect()] == ["charts/bad"]
    first = good.filter("repository = 'charts/whole' AND page = 2").orderBy("pos").first()
    assert (first.pos, first.digest, first.tags[0].name) == (0, "d100", "1.0.100")
    problems = {r.repository.split("/")[1]: r.problem for r in G.audit_pages(good).collect()}
    assert problems == {"whole": None, "exact": None, "cut": "UnfinishedListing", "inside": "ShortPageInside", "gap": "MissingPage"}
    repos = spark.range(100).withColumn("registry", F.lit("full")).union(spark.range(3).withColumn("registry", F.lit("ok")))
    assert {r.registry: r.maybe_cut for r in G.audit_repositories(repos, ["registry"]).collect()} == {"full": True, "ok": False}


def test_feed(spark, tmp_path):
    path = put(tmp_path, "feed.json", '[{"name": "b", "prerelease": false, "draft": true}, {"name": "a", "prerelease": true, "draft": false}]')
    assert [(r.pos, r.name, r.draft) for r in G.read_feed(spark, path).good.orderBy("pos").collect()] == [(0, "b", True), (1, "a", False)]


def test_sink(spark, tmp_path):
    df = spark.createDataFrame([(1, ["a"])], "id INT, l ARRAY<STRING>")
    for fmt in ("json", "parquet"):
        G.write_result(df, str(tmp_path / fmt), fmt)
        assert spark.read.format(fmt).load(str(tmp_path / fmt)).first().l == ["a"]
    assert G.to_json_rows(df).first().json == '{"id":1,"l":["a"]}'
    with pytest.raises(ValueError):
        G.write_result(df, str(tmp_path / "x"), "yaml")


def test_unreadable_and_empty_feeds(spark, tmp_path):
    put(tmp_path, "bad.json", "not json")
    put(tmp_path, "empty.json", "[]")
    good, rejects = G.read_feed(spark, str(tmp_path))
    assert [(r.pos, r.name) for r in good.collect()] == [(None, None)]
    assert [r.error for r in rejects.collect()] == ["ParseFeed"]


def test_repository_names_keep_their_slashes(spark, tmp_path):
    folder = tmp_path / "pages" / "charts" / "deep" / "tool"
    folder.mkdir(parents=True)
    (folder / "1.json").write_text('[{"digest": "d", "tags": []}]')
    good, _ = G.read_artifact_pages(spark, str(tmp_path / "pages"))
    assert [(r.repository, r.page) for r in good.collect()] == [("charts/deep/tool", 1)]


def test_absent_yaml_values(spark):
    frame = spark.createDataFrame([("a: null\nb: ~\nc:\nd: 'null'\ne: 1.10\n",)], "text STRING")
    row = json.loads(Y.parse_yaml(frame).good.first().json)
    assert row == {"a": None, "b": None, "c": None, "d": "null", "e": "1.10"}
