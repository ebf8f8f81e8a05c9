"""Operators that take a whole table of selectors, suffixes or pages, against all pairs."""

import random

import pytest

from fleetframe.operators import inventory as I, state as S
from fleetframe.sources import objects as O
from fleetframe.sources.registry import page_gaps


def test_selector_table(spark):
    rng = random.Random(2)
    objs = [(i, None if i % 17 == 0 else {k: str(rng.randrange(n)) for k, n in (("a", 2), ("b", 5), ("c", 30)) if rng.random() < 0.8}) for i in range(300)]
    wanted = [(i, {k: str(rng.randrange(n + 1)) for k, n in (("a", 2), ("b", 5), ("c", 30), ("d", 1)) if rng.random() < (0.5 if k != "d" else 0.05)}) for i in range(250)]
    wanted += [(900, None), (901, {}), (902, {"a": "1"}), (903, {"a": "1", "nosuch": "1"})]
    good, rejects = I.match_selectors(
        spark.createDataFrame(objs, "id INT, labels MAP<STRING, STRING>").repartition(5),
        spark.createDataFrame(wanted, "selector INT, wanted MAP<STRING, STRING>").repartition(3), ["id"])
    want = {(i, s) for i, have in objs for s, need in wanted if need and have is not None and need.items() <= have.items()}
    got = [tuple(r) for r in good.collect()]
    assert set(got) == want and len(got) == len(want) > 500
    assert {r.selector for r in rejects.collect()} == {s for s, need in wanted if not need}
    with pytest.raises(Exception, match="EmptySelector"):
        I.match_selectors(spark.createDataFrame(objs[1:3], "id INT, labels MAP<STRING, STRING>"),
                          spark.createDataFrame(wanted[-3:], "selector INT, wanted MAP<STRING, STRING>"), ["id"], on_error="fail").good.collect()


def test_selectors_in_tiles(spark):
    """Hot labels are cut into tiles, nothing is broadcast, and each pair comes once: alike selectors, an object held by two labels, repeated and null keys."""
    objs = [(i if i % 10 else None, {"a": "1", "b": str(i % 3), **({"c": str(i % 4)} if i % 2 else {})}) for i in range(60)] + [(5, {"a": "1", "b": None})] * 2
    wanted = [(i, [{"a": "1"}, {"a": "1", "b": "2"}, {"b": "0", "c": "3"}, {"c": "1", "b": "1", "a": "1"}, {"c": "2"}, {"b": None}][i % 6]) for i in range(50)]
    want = sorted((str(i), s) for i, have in objs for s, need in wanted if None not in need.values() and need.items() <= have.items())
    for rows in (3, 10**6):
        good = I.match_selectors(
            spark.createDataFrame(objs, "id INT, labels MAP<STRING, STRING>").repartition(5),
            spark.createDataFrame(wanted, "selector INT, wanted MAP<STRING, STRING>"), ["id"], rows_per_tile=rows).good
        assert sorted((str(r.id), r.selector) for r in good.collect()) == want and len(want) > 500
        assert "Broadcast" not in good._jdf.queryExecution().executedPlan().toString()


def _written(df):
    """Rows that the exchanges of a collected frame wrote."""
    todo, found = [df._jdf.queryExecution().executedPlan()], {}
    while todo:
        node = todo.pop()
        kind = node.getClass().getSimpleName()
        if kind == "ShuffleExchangeExec":
            found[node.id()] = node.metrics().get("shuffleRecordsWritten").get().value()
        more = [node.executedPlan()] if kind == "AdaptiveSparkPlanExec" else [node.plan()] if kind.endswith("QueryStageExec") else [
            node.child()] if kind == "ReusedExchangeExec" else [node.children().apply(i) for i in range(node.children().size())]
        todo += more
    assert found
    return sum(found.values())


def test_selectors_move_as_packed_keys(spark):
    """Exchanges hold a key for each tile of its group and no more: tiles are as many as the objects that match, and hold packed keys."""
    objs = [(i, "z", {"a": "1", "own": str(i)}) for i in range(1500)] + [(i, None, {"b": "1"}) for i in range(1500)] + [(None, "z", {"a": "1", "b": "1"})] * 3
    wanted = [(i, {"a": "1"}) for i in range(1200)] + [(5000 + i, {"a": "1", "b": "1"}) for i in range(1000)] + [(None, {"b": "1"})]
    good = I.match_selectors(
        spark.createDataFrame(objs, "id INT, zone STRING, labels MAP<STRING, STRING>").repartition(4),
        spark.createDataFrame(wanted, "selector INT, wanted MAP<STRING, STRING>").repartition(2), ["id", "zone"], rows_per_tile=50).good
    got = [tuple(r) for r in good.collect()]
    want = [(i, z, s) for i, z, have in objs for s, need in wanted if need.items() <= have.items()]
    assert len(got) == 1503 * 1200 + 3 * 1000 + 1503 and sorted(got, key=str) == sorted(want, key=str)
    assert _written(good) < 40_000


def test_selectors_that_come_again(spark):
    """Labels without a value match nothing; a name of several selectors with known labels picks nothing; runs end anywhere."""
    objs = [(i, {"a": "1", "b": None if i % 2 else "2"}) for i in range(20)] + [(99, {}), (98, None)]
    wanted = [(1, {"a": "1"}), (2, {"a": "1", "b": None}), (3, {"b": "2"}), (3, {"b": "2"}), (4, {"a": "1"}), (4, {"nosuch": "1"}), (5, {"a": "2"})]
    wanted += [(100 + i, {"b": "2", "a": "1"}) for i in range(I.RUN + 1)]
    good = I.match_selectors(spark.createDataFrame(objs, "id INT, labels MAP<STRING, STRING>"),
                             spark.createDataFrame(wanted, "selector INT, wanted MAP<STRING, STRING>"), ["id"]).good
    assert sorted(map(tuple, good.collect())) == sorted(
        [(i, s) for i in range(20) for s in (1, 4)] + [(i, 100 + s) for i in range(0, 20, 2) for s in range(I.RUN + 1)])


def test_longest_suffix(spark):
    crds = [(1, "a.example.com", "x"), (2, "xexample.com", "y"), (3, "example.com", None), (4, "org", "z"), (5, "b.example.com", "w"), (6, None, "v")]
    suffixes = ["com", "example.com", ".example.com", "b.example.com", "nothing", None, "com"]
    frame = spark.createDataFrame(crds, "id INT, group STRING, name STRING")
    got = S.longest_group_suffix(frame, spark.createDataFrame([(s,) for s in suffixes], "suffix STRING"), ["id"])
    assert {r.id: r.suffix for r in got.collect()} == {1: ".example.com", 2: "example.com", 5: "b.example.com"}
    assert S.longest_group_suffix(frame, spark.createDataFrame([], "suffix STRING"), ["id"]).isEmpty()


def test_page_gaps(spark):
    rows = [("whole", p, i) for p in (1, 2, 3) for i in range(2)] + [("late", 4, 0), ("late", 5, None), ("late", 9, 0), ("late", 9, 0), ("late", 9, 1)]
    rows += [("odd", None, 0), ("odd", 1, 0), ("odd", 3, 0), ("odd", 0, 0), (None, 2, 0)]
    got = page_gaps(spark.createDataFrame(rows, "repository STRING, page INT, pos INT").repartition(4)).collect()
    assert {tuple(r) for r in got} == {
        ("late", 1, 3, "MissingPages", None), ("late", 6, 8, "MissingPages", None), ("late", 9, 9, "DoubledPage", 2),
        ("odd", 2, 2, "MissingPages", None), (None, 1, 1, "MissingPages", None)}


def test_bad_lines(spark, tmp_path):
    folder = tmp_path / "kind=Node" / "cluster_id=c1" / "snapshot_date=2024-01-01"
    folder.mkdir(parents=True)
    good = '{"pos": 1, "metadata": {"name": "n"}, "spec": {"providerID": "p"}}'
    bad = ['{"pos": 2, "metadata"', "plain text", '{"pos": "x"}', '{"pos": 3, "metadata": 7}']
    (folder / "a.json").write_text("\n".join([good, *bad[:2], "", good.replace('"n"', '"m"')]))
    (folder / "b.json").write_text("\n".join(bad[2:]))
    nodes, rejects = O.read_objects_checked(spark, str(tmp_path), "Node")
    assert sorted(r.name for r in nodes.collect()) == ["m", "n"] and O.read_objects(spark, str(tmp_path), "Node").count() == 2
    found = rejects.collect()
    assert {r.line for r in found} == set(bad) and {r.file.rsplit("/", 1)[1] for r in found} == {"a.json", "b.json"}
    assert {(r.cluster_id, r.snapshot_date, r.block_start, r.error) for r in found} == {("c1", "2024-01-01", 0, "ParseLine")}
    assert rejects.select("cluster_id").count() == 4 and O.read_objects_checked(spark, str(tmp_path), "Node", ["c2"]).rejects.isEmpty()
    with pytest.raises(Exception, match="ParseLine"):
        O.read_objects_checked(spark, str(tmp_path), "Node", on_error="fail").good.collect()
