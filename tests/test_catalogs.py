import random

import pytest
from pyspark.sql import functions as F

from fleetframe.functions import specs
from fleetframe.functions.maps import overlay_map, text_map
from fleetframe.operators import catalog as C
from fleetframe.operators.ordering import enumerate_rows, join_text, range_number
from fleetframe.sources.registry import with_source_order


def test_overlay_last_wins_first_position(spark):
    df = spark.createDataFrame(
        [("x", 1, 0, 0), ("y", 2, 0, 1), ("x", 3, 1, 0), ("z", 4, 1, 1)],
        "name STRING, value INT, source_ord INT, pos INT")
    merged = C.overlay_last_wins(df, ["name"])
    rows = merged.orderBy("source_ord", "pos").collect()
    assert [(r.name, r.value) for r in rows] == [("x", 3), ("y", 2), ("z", 4)]
    again = C.overlay_last_wins(merged, ["name"])
    assert sorted(again.collect()) == sorted(merged.collect())
    swapped = df.withColumn("source_ord", 1 - F.col("source_ord"))
    assert {r.name: r.value for r in C.overlay_last_wins(swapped, ["name"]).collect()}["x"] == 1


def test_source_order(spark):
    a = spark.createDataFrame([("x", 1)], "name STRING, v INT")
    b = spark.createDataFrame([("x", "d")], "name STRING, extra STRING")
    rows = with_source_order([a, b, a]).orderBy("source_ord").collect()
    assert [(r.source_ord, r.v, r.extra) for r in rows] == [(0, 1, None), (1, None, "d"), (2, 1, None)]


@pytest.mark.parametrize("by", [["g"], ["g", "h"], []])
def test_numbering_of_hot_groups(spark, by):
    rows = [(None if i % 11 == 0 else 0 if i < 700 else i % 5, i % 2, (i * 7919) % 1009, i) for i in range(2000)]
    df = spark.createDataFrame(rows, "g INT, h INT, o INT, id INT").repartition(9)
    plain = enumerate_rows(df, ["o", "id"], by, "n")
    split = enumerate_rows(df, ["o", "id"], by, "n", rows_per_task=50)
    assert sorted(map(str, plain.collect())) == sorted(map(str, split.collect()))
    down = enumerate_rows(df, [F.col("o").desc(), "id"], by, "n", rows_per_task=50)
    assert sorted(map(str, down.collect())) == sorted(
        map(str, enumerate_rows(df, [F.col("o").desc(), "id"], by, "n").collect()))


def test_numbering_by_histogram(spark):
    """Against a plain sort: struct keys, nulls last, ties of a third of all rows; no group in one task."""
    rows = [(i % 3 if i % 2 else None, [i % 4, i % 3], None if i % 5 == 0 else i % 7, i) for i in range(3000)]
    df = spark.createDataFrame(rows, "g INT, k ARRAY<INT>, o INT, id INT").repartition(7).withColumn(
        "s", F.struct("k", F.lit("x").alias("t")))
    order = ["s", F.col("o").desc_nulls_last(), F.col("id").asc_nulls_first()]
    got = enumerate_rows(df, order, ["g"], "n", rows_per_task=100)
    assert "InMemory" not in got._jdf.queryExecution().toString() and len(got.inputFiles()) == 0
    want = {}
    ranked = sorted(rows, key=lambda r: (r[1], r[2] is None, -(r[2] or 0), r[3]))
    for g in {r[0] for r in rows}:
        want |= {r[3]: i + 1 for i, r in enumerate(r for r in ranked if r[0] == g)}
    assert {r.id: r.n for r in got.collect()} == want
    sizes = df.groupBy(range_number(df, order, 3000, 100).alias("range")).count().collect()
    assert len(sizes) > 20 and max(r["count"] for r in sizes) < 400
    assert enumerate_rows(df.limit(0), order, ["g"], "n").isEmpty()


def test_text_of_hot_groups(spark):
    df = spark.createDataFrame([("a", i) for i in range(25)] + [("b", 1)], "g STRING, i INT").withColumn(
        "t", F.col("i").cast("string"))
    rows = join_text(df.repartition(5), ["g"], ["i"], "t", items_per_part=10, rows_per_task=5)
    cells = {(r.g, r.part): r.t for r in rows.collect()}
    assert cells[("b", 0)] == "1" and len(cells) == 4
    assert ", ".join(cells[("a", p)] for p in range(3)) == ", ".join(map(str, range(25)))


def test_describe_and_lookup(spark):
    specs_ = spark.createDataFrame([("a", 1), ("b", 2)], "name STRING, v INT")
    assert C.describe(specs_, "b").collect()[0].v == 2 and C.describe(specs_, "c").isEmpty()
    asked = spark.createDataFrame([("a",), ("c",)], "name STRING")
    good, rejects = C.lookup(asked, specs_)
    assert [r.name for r in good.collect()] == ["a"]
    assert [(r.name, r.error) for r in rejects.collect()] == [("c", "NoSuchSpec")]


def catalogs(spark):
    demos = spark.createDataFrame([("d1", "s1"), ("d2", "s2"), ("d3", "gone")], "name STRING, stack STRING")
    stacks = spark.createDataFrame(
        [("s1", "r1", ["b", "zz"]), ("s2", "r1", []), ("s3", "lost", [])],
        "name STRING, release STRING, operators ARRAY<STRING>")
    releases = spark.createDataFrame(
        [("r1", [(0, "b", "2.0.0"), (1, "a", "1.0.0")])],
        "name STRING, products ARRAY<STRUCT<pos INT, name STRING, version STRING>>")
    return demos, stacks, releases


def test_references(spark):
    rows = C.resolve_refs(*catalogs(spark)).orderBy("demo", "pos").collect()
    assert [(r.demo, r.product, r.version) for r in rows] == [
        ("d1", "b", "2.0.0"), ("d2", "b", "2.0.0"), ("d2", "a", "1.0.0")]
    assert sorted(map(tuple, C.dangling_refs(*catalogs(spark)).collect())) == [
        ("NoSuchRelease", "s3", "lost"), ("NoSuchStack", "d3", "gone")]


@pytest.mark.parametrize("include, exclude, kept", [
    ([], ["b"], "ac"), (["b", "zz"], ["b"], ""), (["c", "a"], [], "ac"), ([], [], "abc"), (["zz"], [], "")])
def test_include_exclude(spark, include, exclude, kept):
    df = spark.createDataFrame([(x,) for x in "abc"], "product STRING")
    frame = lambda names: spark.createDataFrame([(x,) for x in names], "product STRING")
    assert "".join(sorted(r.product for r in C.filter_products(df, include, exclude).collect())) == kept
    by_table = C.filter_products(df, frame(include), frame(exclude))
    assert "".join(sorted(r.product for r in by_table.collect())) == kept
    lists = df.withColumn("i", F.lit(include).cast("array<string>")).withColumn(
        "e", F.lit(exclude).cast("array<string>"))
    kept_rows = lists.filter(C.included(F.col("product"), F.col("i"), F.col("e"))).collect()
    assert "".join(sorted(r.product for r in kept_rows)) == kept
    dropped = C.filter_products(df, [p for p in "abc" if p not in kept] or ["none"], [])
    assert dropped.count() + len(kept) == 3


def test_namespaces(spark):
    specs_ = spark.createDataFrame([("any", []), ("some", ["a", "b"])], "name STRING, supported_namespaces ARRAY<STRING>")
    asked = spark.createDataFrame([("any", "x"), ("some", "b"), ("some", "x")], "name STRING, namespace STRING")
    good, rejects = C.supports_namespace(asked, specs_)
    assert good.count() == 2
    assert [(r.name, r.supported) for r in rejects.collect()] == [("some", "a, b")]


def test_explode_and_join_lists(spark):
    demos, stacks, releases = catalogs(spark)
    rows = C.explode_products(releases).orderBy("pos").collect()
    assert [(r.release, r.product) for r in rows] == [("r1", "b"), ("r1", "a")]
    texts = {r.name: r.operators for r in C.join_lists(stacks, ["operators"]).collect()}
    assert texts == {"s1": "b, zz", "s2": "", "s3": ""}
    params = spark.createDataFrame([("d", [("p", "text", "1")])],
                                   "name STRING, parameters ARRAY<STRUCT<name STRING, description STRING, default STRING>>")
    assert C.explode_parameters(params).first().asDict() == {
        "spec": "d", "pos": 0, "name": "p", "description": "text", "default": "1"}


DEFAULTS = "request STRING, name STRING, default STRING, pos INT"
GIVEN = "request STRING, name STRING, value STRING, pos INT"


def test_parameter_overlay(spark):
    defaults = spark.createDataFrame(
        [("r", "a", "1", 0), ("r", "b", "2", 1), ("q", "param1", "Default value 1", 0), ("n", "x", "0", 0)], DEFAULTS)
    given = spark.createDataFrame(
        [("r", "a", "9", 0), ("r", "a", "8", 1), ("q", "param2", "value2", 0), ("q", "param1", "v", 1)], GIVEN)
    good, rejects = C.overlay_parameters(defaults, given)
    assert sorted((r.request, r.name, r.value) for r in good.collect()) == [
        ("n", "x", "0"), ("r", "a", "8"), ("r", "b", "2")]
    bad = rejects.collect()
    assert [(r.request, r.parameter, r.expected) for r in bad] == [("q", "param2", "param1")]
    with pytest.raises(Exception, match="InvalidParameter"):
        C.overlay_parameters(defaults, given, on_error="fail").good.collect()


def test_overlay_with_random_order(spark):
    rnd = random.Random(2)
    rows = [(f"r{rnd.randrange(6)}", f"k{rnd.randrange(4)}", str(rnd.random()), i) for i in range(200)]
    defaults = [(f"r{r}", f"k{k}", "d", k) for r in range(7) for k in range(4)]
    want = {(r, k): d for r, k, d, _ in defaults}
    want.update({(r, k): v for r, k, v, _ in rows})
    rnd.shuffle(rows)
    good = C.overlay_parameters(spark.createDataFrame(defaults, DEFAULTS),
                                spark.createDataFrame(rows, GIVEN).repartition(7)).good
    assert {(r.request, r.name): r.value for r in good.collect()} == want


def test_context(spark):
    df = spark.createDataFrame([({"STACK": "user", "DEMO": "user", "a": "1"},)], "p MAP<STRING, STRING>")
    full = df.select(C.add_context(F.col("p"), F.lit("ns"), F.lit("st"), F.lit("de"))).first()[0]
    assert full == {"a": "1", "STACK": "st", "DEMO": "de", "NAMESPACE": "ns"}
    stack_only = df.select(C.add_context(F.col("p"), F.lit("ns"), F.lit("st"))).first()[0]
    assert stack_only == {"a": "1", "DEMO": "user", "STACK": "st", "NAMESPACE": "ns"}
    assert df.select(overlay_map(F.lit(None).cast("map<string,string>"), text_map({"k": "v"}))).first()[0] == {"k": "v"}


def test_release_branch(spark):
    releases = spark.createDataFrame(
        [("c", "25.3", 0, 0), ("c", "24.11", 0, 1), ("c", "dev", 0, 2)],
        "catalog STRING, name STRING, source_ord INT, pos INT")
    asked = spark.createDataFrame(
        [(0, "c", None), (1, "c", "dev"), (2, "c", "99"), (3, "c", "24.11"), (4, "none", None)],
        "id INT, catalog STRING, requested STRING")
    good, rejects = C.release_branch(asked, releases)
    assert {r.id: r.branch for r in good.collect()} == {0: "release-25.3", 1: "main", 3: "release-24.11"}
    assert {r.id: r.error for r in rejects.collect()} == {2: "NoSuchRelease", 4: "LatestRelease"}


def test_effective_namespace(spark):
    df = spark.createDataFrame([("default", True), ("default", False), ("own", True)], "ns STRING, yes BOOLEAN")
    got = [r[0] for r in df.select(C.effective_namespace(F.col("ns"), F.lit("demo"), F.col("yes"))).collect()]
    assert got == ["demo", "default", "own"]


def test_values(spark):
    docs = spark.createDataFrame(
        [("ok", '{"trino-operator": {"a": "1", "deep": {"x": ["y"]}}, "listener-operator": {"preset": "mine"}}'),
         ("flat", '{"trino-operator": "text"}'), ("list", '["a"]'), ("empty", "{}")], "file STRING, json STRING")
    good, rejects = C.values_entries(docs)
    assert {(r.file, r.chart, r.error) for r in rejects.collect()} == {
        ("flat", "trino-operator", "InvalidEntryType"), ("list", None, "InvalidValueType")}
    operators = spark.createDataFrame([("trino",), ("listener",), ("hive",)], "operator STRING")
    rows = {r.operator: r["values"] for r in C.attach_values(operators, good, F.lit("stable-nodes")).collect()}
    assert rows["trino"]["a"] == "1" and rows["trino"]["deep"] == '{"x":["y"]}'
    assert rows["listener"] == {"preset": "stable-nodes"} and rows["hive"] == {}


@pytest.mark.parametrize("text, name, value, error", [
    ("param=value", "param", "value", None), (" param=value ", "param", "value", None),
    ("param", None, None, "InvalidEqualSignCount"), ("param=", None, None, "EmptyValue"),
    ("=", None, None, "EmptyName"), ("param=value=invalid", None, None, "InvalidEqualSignCount"),
    ("==", None, None, "InvalidEqualSignCount"), ("", None, None, "EmptyInput"), (" \n", None, None, "EmptyInput"),
    (None, None, None, "EmptyInput"),
])
def test_parameter_text(spark, text, name, value, error):
    df = spark.createDataFrame([(text,)], "t STRING")
    assert tuple(df.select(specs.parameter(F.col("t"))).first()[0]) == (name, value, error)


def test_parameter_lists(spark):
    df = spark.createDataFrame([(0, "param1=value1 param2=value2"), (1, "a=1  b=2"), (2, "a=1 b"), (3, " ")], "id INT, t STRING")
    good, rejects = specs.parse_parameter_lists(df, "t")
    assert [(r.id, r.pos, r.name, r.value) for r in good.orderBy("id", "pos").collect()] == [
        (0, 0, "param1", "value1"), (0, 1, "param2", "value2")]
    assert {r.id: r.error for r in rejects.collect()} == {1: "EmptyInput", 2: "InvalidEqualSignCount", 3: "EmptyInput"}


@pytest.mark.parametrize("text, name, version, error", [
    ("airflow", "airflow", None, None), ("zookeeper=1.2.3", "zookeeper", "1.2.3", None), ("", None, None, "EmptyInput"),
    ("airflow=", None, None, "MissingVersion"), ("airflow=1.2.3=", None, None, "InvalidEqualSignCount"),
    ("airflow=23.7", None, None, "ParseVersion"), ("nosuch=1.2.3", None, None, "InvalidName"),
])
def test_operator_specs(spark, text, name, version, error):
    good, rejects = specs.parse_operator_specs(spark.createDataFrame([(text,)], "t STRING"), "t")
    if error:
        assert [r.error for r in rejects.collect()] == [error] and good.isEmpty()
        with pytest.raises(Exception, match=error):
            specs.parse_operator_specs(spark.createDataFrame([(text,)], "t STRING"), "t", on_error="fail").good.collect()
    else:
        row = good.select("name", "version", specs.format_operator_spec(F.col("name"), F.col("version")).alias("s")).first()
        assert (row.name, row.version, row.s) == (name, version, text)


def test_namespace_of_unknown_spec_is_rejected(spark):
    requests = spark.createDataFrame([("a", "x"), ("b", "x")], "name STRING, namespace STRING")
    known = spark.createDataFrame([("a", None)], "name STRING, supported_namespaces ARRAY<STRING>")
    good, rejects = C.supports_namespace(requests, known)
    assert [r.name for r in good.collect()] == ["a"]
    assert [(r.name, r.error) for r in rejects.collect()] == [("b", "NoSuchSpec")]
