"""The WARC round trip: pages of odd rows against brute force, and what the conversion reads and moves."""

import hashlib

import pytest

from fleetframe.llm import archives

PAGES = "page_id long, url string, html string"


def expected(rows):
    body = {k: (html or "").encode() for k, (_, _, html) in enumerate(rows)}
    order = lambda page: archives.NULL_ID if page is None else page
    first = {}
    for k, (page, _, _) in enumerate(rows):
        first[body[k]] = min(first.get(body[k], order(page)), order(page))
    out = []
    for k, (page, _, _) in enumerate(rows):
        again = len(body[k]) >= archives.MIN_SHARED_BYTES and order(page) > first[body[k]]
        holder = first[body[k]] if again and first[body[k]] != archives.NULL_ID else None
        out.append((page, len(body[k]), hashlib.sha256(body[k]).hexdigest(), "revisit" if again else "response", holder, 0 if again else len(body[k])))
    return sorted(out, key=str)


def test_copies_in_many_files(spark, tmp_path):
    """Copies of other files, of the same page and of a page without id; short, empty and null payloads."""
    common, orphan = "<p>é common</p>\n" * 20, "<p>held by no page</p>" * 9
    rows = [(i, f"http://h/{i}" if i % 5 else None, common if i % 3 == 0 else f"<p>{i}</p>" * (i % 30)) for i in range(200)]
    rows += [(7, "x", common), (7, "x", common), (None, "y", orphan), (None, None, orphan), (3, "z", orphan), (-4, "n", common), (5, "e", None), (None, "e", "")]
    path = str(tmp_path / "t")
    spark.createDataFrame(rows, PAGES).repartition(9).write.parquet(f"{path}/pages.parquet")
    found = sorted(map(tuple, archives.op7_arc_to_warc(spark, path).collect()), key=str)
    assert found == expected(rows)


def test_records_refer_to_records(spark, tmp_path):
    page = "<p>same</p>" * 20
    archives.write_arc(spark.createDataFrame([(i, "u", page) for i in range(40)], PAGES).repartition(5), f"{tmp_path}/arc", 2)
    archives.convert_arc(spark, f"{tmp_path}/arc", f"{tmp_path}/warc")
    found = archives.read_warc(spark, f"{tmp_path}/warc").collect()
    holder, = (r for r in found if r["record_type"] == "response")
    assert holder["page_id"] == 0 and len({r["record_id"] for r in found}) == 40
    assert {r["refers_to_record"] for r in found if r["page_id"]} == {holder["record_id"]}
    ids = {r["page_id"]: f"<urn:uuid:{r['record_id']}>" for r in archives.read_arc(spark, f"{tmp_path}/arc").collect()}
    assert ids == {r["page_id"]: r["record_id"] for r in found}


@pytest.mark.parametrize("rows", [[], [(1, "u", None)]])
def test_few_pages(spark, tmp_path, rows):
    archives.write_arc(spark.createDataFrame(rows, PAGES), f"{tmp_path}/arc")
    archives.convert_arc(spark, f"{tmp_path}/arc", f"{tmp_path}/warc")
    assert [r["page_id"] for r in archives.read_warc(spark, f"{tmp_path}/warc").collect()] == [r[0] for r in rows]


def test_payloads_are_read_once_and_not_moved(spark, tmp_path, monkeypatch):
    """The frame written as WARC scans the archives once, and no exchange carries a payload."""
    written, write = [], archives._write
    monkeypatch.setattr(archives, "_write", lambda frame, *rest: (written.append(frame), write(frame, *rest)))
    page = "<p>same</p>" * 20
    archives.write_arc(spark.createDataFrame([(i, "u", page) for i in range(8)], PAGES).repartition(2), f"{tmp_path}/arc")
    archives.convert_arc(spark, f"{tmp_path}/arc", f"{tmp_path}/warc")
    plan = written[-1]._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(" binaryFile") == 1
    assert "payload#" not in plan


def test_many_files_in_a_task(spark, tmp_path, monkeypatch):
    """Files that meet in one task keep their own revisits."""
    monkeypatch.setattr(archives, "FILE_TASKS", 1)
    rows = [(i, f"u{i}", f"<p>{i % 7}</p>" * 20) for i in range(90)]
    path = str(tmp_path / "t")
    spark.createDataFrame(rows, PAGES).repartition(12).write.parquet(f"{path}/pages.parquet")
    assert sorted(map(tuple, archives.op7_arc_to_warc(spark, path).collect()), key=str) == expected(rows)


def test_archives_take_the_gzip_level(spark, tmp_path, monkeypatch):
    html = "<p>same</p>" * 2000
    sizes = []
    for level in (archives.GZIP_LEVEL, "NO_COMPRESSION"):
        monkeypatch.setattr(archives, "GZIP_LEVEL", level)
        archives.write_arc(spark.createDataFrame([(1, "u", html)], PAGES), f"{tmp_path}/{level}")
        sizes.append(max(f.stat().st_size for f in (tmp_path / level).glob("part-*")))
    assert sizes[0] < len(html) / 9 < len(html) < sizes[1]
