import json

import pytest

from fleetframe.operators import templates as R


def docs(spark, rows):
    return spark.createDataFrame([(i, t, p) for i, (t, p) in enumerate(rows)], "id INT, text STRING, params MAP<STRING, STRING>")


def test_render(spark):
    good, rejects = R.render_templates(docs(spark, [
        ("a {{ X }} b {{Y}}{{ X }}", {"X": "1", "Y": "{{ X }}"}), ("no placeholder {{", {}), ("{{ GONE }} {{ X }}", {"X": "1"}),
        ("", None), ("{{ X }}", {"X": ""}), ("$1 \\ {{ X }}", {"X": "$0 \\"}), ("{{\nX\n}}", {"X": "line"}), ("{{ X }}", None)]))
    assert {r.id: r.rendered for r in good.collect()} == {
        0: "a 1 b {{ X }}1", 1: "no placeholder {{", 3: "", 4: "", 5: "$1 \\ $0 \\", 6: "line"}
    assert {r.id: r.error for r in rejects.collect()} == {2: "UnknownPlaceholder: GONE", 7: "UnknownPlaceholder: X"}
    with pytest.raises(Exception, match="GONE"):
        R.render_templates(docs(spark, [("{{ GONE }}", {})]), on_error="fail").good.collect()


def test_render_and_parse(spark):
    good, rejects = R.render_and_parse(docs(spark, [
        ("name: {{ N }}\n---\nb: [1, 23.10]\n", {"N": "x"}), ("{{ GONE }}", {}), ("a: [", {}), ("v: {{ N }}", {"N": "[un: closed"}),
        ("base: &b {k: v}\nuse: *b\nday: 2022-11-10\n", {})]))
    rows = {(r.id, r.doc_pos): json.loads(r.json) for r in good.collect()}
    assert rows == {(0, 0): {"name": "x"}, (0, 1): {"b": ["1", "23.10"]},
                    (4, 0): {"base": {"k": "v"}, "use": {"k": "v"}, "day": "2022-11-10"}}
    assert {r.id: r.stage for r in rejects.collect()} == {1: "template", 2: "yaml", 3: "yaml"}


def test_long_texts_are_whole(spark):
    text = "word {{ X }} " * 50_000
    row = R.render_templates(docs(spark, [(text, {"X": "y"})])).good.first()
    assert row.rendered == "word y " * 50_000
