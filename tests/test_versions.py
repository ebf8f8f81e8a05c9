import random

import pytest
from pyspark.sql import functions as F

from fleetframe.functions.channels import channel_of_tag, channel_of_version
from fleetframe.functions.locations import cache_key, chart_source_kind, crd_url, path_or_url
from fleetframe.functions.semver import is_semver, semver_key, sort_versions
from fleetframe.operators import versions as V
from fleetframe.schemas import operator_names

CHAIN = [
    "0.0.0-pr10", "0.0.0-pr9", "0.6.0", "0.10.0", "1.0.0-alpha", "1.0.0-alpha.1", "1.0.0-alpha.beta",
    "1.0.0-beta", "1.0.0-beta.2", "1.0.0-beta.11", "1.0.0-rc.1", "1.0.0", "1.0.0+1", "1.0.0+2", "1.0.0+10",
    "1.0.0+a", "1.0.0+a.1", "1.2.0", "23.1.0", "18446744073709551615.0.0",
]
INVALID = ["latest", "1.2", "01.1.1", "1.0.0-01", "1.0.0-", "1.0.0+", "1.0.0-a..b", "", "1.2.3.4",
           "18446744073709551616.0.0", "1.0.0\n", " 1.0.0"]


def texts(spark, values, name="v"):
    return spark.createDataFrame([(v,) for v in values], f"{name} STRING")


def test_version_order(spark):
    mixed = CHAIN[:]
    random.Random(3).shuffle(mixed)
    got = texts(spark, mixed).repartition(7).orderBy(semver_key(F.col("v"))).collect()
    assert [r.v for r in got] == CHAIN


def test_invalid_versions(spark):
    rows = texts(spark, INVALID + [None]).select("v", is_semver(F.col("v")), semver_key(F.col("v"))).collect()
    assert all(r[1] is False and r[2] is None for r in rows), rows


def brute_key(v):
    head, _, build = v.partition("+")
    core, _, pre = head.partition("-")
    ids = [(0, int(x), "") if x.isdigit() else (1, 0, x) for x in pre.split(".")] if pre else []
    return [int(x) for x in core.split(".")], not pre, ids


def test_order_agrees_with_python(spark):
    rnd = random.Random(5)
    one = lambda: ".".join(str(rnd.randrange(3)) for _ in range(3)) + rnd.choice(
        ["", "", "-" + ".".join(rnd.choice(["a", "b", "1", "2", "10", "a1", "-"]) for _ in range(rnd.randrange(1, 4)))])
    values = list({one() for _ in range(300)})
    got = [r.v for r in texts(spark, values).orderBy(semver_key(F.col("v"))).collect()]
    assert [brute_key(v) for v in got] == sorted(map(brute_key, values))


def test_sort_one_array(spark):
    df = spark.createDataFrame([(["0.10.0", "0.6.0", "23.1.0", "0.0.0-pr9", "0.0.0-pr10"],)], "a ARRAY<STRING>")
    assert df.select(sort_versions(F.col("a"), "fail")).first()[0] == [
        "0.0.0-pr10", "0.0.0-pr9", "0.6.0", "0.10.0", "23.1.0"]
    bad = spark.createDataFrame([(["1.0.0", "latest"],)], "a ARRAY<STRING>")
    assert bad.select(sort_versions(F.col("a"))).first()[0] == ["1.0.0"]
    with pytest.raises(Exception, match="latest"):
        bad.select(sort_versions(F.col("a"), "fail")).collect()


@pytest.mark.parametrize("version, by_version, by_tag", [
    ("0.0.0-nightly", "dev", "stable"), ("0.0.0-pr123", "test", "test"), ("0.0.0-dev", "dev", "dev"),
    ("1.2.3", "stable", "stable"), (None, "dev", None), ("1.2.3-dev", "dev", "stable"),
])
def test_channels(spark, version, by_version, by_tag):
    row = texts(spark, [version]).select(channel_of_version(F.col("v")), channel_of_tag(F.col("v"))).first()
    assert tuple(row) == (by_version, by_tag)


def artifacts(spark, rows):
    return spark.createDataFrame(rows, "repository STRING, tags ARRAY<STRUCT<name STRING>>")


def test_artifact_versions(spark):
    good, rejects = V.artifact_versions(artifacts(spark, [
        ("charts/a/b", [("25.3.0-amd64",), ("latest",)]), ("charts/a/b", [("25.3.0-arm64",)]),
        ("charts/a/b", None), ("charts/a/b", []), ("noslash", [("1.0.0",)])]))
    assert [tuple(r) for r in good.select("project", "chart", "version").collect()] == [
        ("charts", "a/b", "25.3.0")] * 2
    assert [r.error for r in rejects.collect()] == ["UnexpectedRepositoryName"]


def listing(spark, on_error="quarantine"):
    tags = ["25.3.0-amd64", "25.3.0-arm64", "24.11.0", "0.0.0-dev", "0.0.0-pr7", "latest"]
    rows = V.artifact_versions(artifacts(spark, [("c/airflow-operator", [(t,)]) for t in tags])).good
    return V.version_index(rows, on_error=on_error)


def test_matrix_and_report(spark):
    good, rejects = listing(spark)
    assert [r.version for r in rejects.collect()] == ["latest"]
    matrix = V.version_matrix(operator_names(spark, ["airflow", "druid"]), good)
    assert {(r.operator, r.channel): r.versions for r in V.version_lists(matrix).collect()} == {
        ("airflow", "stable"): "24.11.0, 25.3.0, 25.3.0", ("airflow", "test"): "0.0.0-pr7",
        ("airflow", "dev"): "0.0.0-dev", ("druid", "stable"): "", ("druid", "test"): "", ("druid", "dev"): ""}
    report = V.version_report(matrix, channels=("stable",)).orderBy("operator").collect()
    assert [(r.operator, r.stable) for r in report] == [("airflow", "24.11.0, 25.3.0, 25.3.0"), ("druid", "")]


def test_long_lists_continue_in_parts(spark):
    index = spark.createDataFrame(
        [("stable", "a-operator", f"1.{i}.0", 3) for i in range(5)],
        "channel STRING, chart STRING, version STRING, copies LONG").withColumn("key", semver_key(F.col("version")))
    matrix = V.version_matrix(operator_names(spark, ["a"]), index)
    rows = V.version_lists(matrix, copies_per_item=2, items_per_part=3).filter("channel = 'stable'").orderBy("part")
    cells = [r.versions for r in rows.collect()]
    assert len(cells) == 4
    assert ", ".join(cells).split(", ") == [f"1.{i}.0" for i in range(5) for _ in range(3)]


def test_strict_index_fails(spark):
    with pytest.raises(Exception, match="InvalidVersion"):
        listing(spark, "fail").good.collect()


def test_latest_and_outdated(spark):
    feed = spark.createDataFrame(
        [(1, "tool-2.0.0", False, True), (2, "other-9.0.0", False, False), (3, "tool-tool-1.4.0", False, False),
         (4, "tool-1.5.0", False, False)], "pos INT, name STRING, prerelease BOOLEAN, draft BOOLEAN")
    latest = V.latest_release(feed.withColumn("tool", F.lit("t")), "tool-", ["tool"]).good
    assert latest.first().latest == "1.4.0"
    have = spark.createDataFrame([("t", "1.3.9"), ("t", "1.4.0"), ("t", "1.10.0")], "tool STRING, version STRING")
    assert [r.version for r in V.outdated(have, latest, ["tool"]).collect()] == ["1.3.9"]
    states = {r.version: r.state for r in V.outdated(have, latest, ["tool"], False).collect()}
    assert states == {"1.3.9": "out-of-date", "1.4.0": "up-to-date", "1.10.0": "up-to-date"}
    assert V.latest_release(feed.filter("draft"), "tool-").rejects.first().error == "FindLatestRelease"


def test_locations(spark):
    kinds = {"oci://registry.example.com/charts": "Oci", "https://repo.example.com/stable": "Repo",
             "http://example.com/charts": "Repo", "./charts/my-chart": "Local", "/absolute/chart": "Local"}
    rows = texts(spark, kinds).select("v", chart_source_kind(F.col("v")).alias("k"), path_or_url(F.col("v")).alias("p"))
    for r in rows.collect():
        assert r.k == kinds[r.v] and r.p == ("Url" if r.k == "Repo" else "Path")


def test_urls_and_keys(spark):
    df = spark.createDataFrame([("hive", "1.2.3"), ("hive", "0.0.0-dev")], "p STRING, v STRING")
    got = [r[0] for r in df.select(crd_url(F.col("p"), F.col("v"), "https://x/%s/%s")).collect()]
    assert got == ["https://x/hive/1.2.3", "https://x/hive/main"]
    key = texts(spark, ["https://x.y/z?q=1"]).select(cache_key(F.col("v"))).first()[0]
    assert key.startswith("https---x-y-z-q-1-") and len(key) == len("https---x-y-z-q-1-") + 64


def test_feed_without_release_is_rejected(spark):
    feed = spark.createDataFrame([(1, 0, "tool-1.0.0", True, False), (2, 0, "tool-2.0.0", False, False)],
                                 "repo INT, pos INT, name STRING, draft BOOLEAN, prerelease BOOLEAN")
    good, rejects = V.latest_release(feed, "tool-", ["repo"])
    assert [(r.repo, r.latest) for r in good.collect()] == [(2, "2.0.0")]
    assert [(r.repo, r.error) for r in rejects.collect()] == [(1, "FindLatestRelease")]


def test_no_url_without_version(spark):
    rows = spark.createDataFrame([("a", None), (None, "1.0.0"), ("a", "1.0.0")], "p STRING, v STRING")
    urls = [r.u for r in rows.select(crd_url(F.col("p"), F.col("v"), "%s/%s").alias("u")).collect()]
    assert urls == [None, None, "a/1.0.0"]
