"""Merkle manifest against SQL, brute force and tampering."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from fleetframe.llm import merkle, registry
from tests.compare import compare, connect

from . import corpora
from .test_operators import DOCS, con_of

NAME = "op12_dag_descent"


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(row):
    return digest("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def climb(nodes):
    """Last node, and for each node (place, siblings) level by level."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for p, i in enumerate(at):
            run = nodes[i // 8 * 8:i // 8 * 8 + 8]
            paths[p].append((i % 8, run[:i % 8] + run[i % 8 + 1:]))
        nodes = [digest("".join(nodes[i:i + 8])) for i in range(0, len(nodes), 8)]
        at = [i // 8 for i in at]
    return nodes[0], paths


def brute_force(rows):
    groups = {}
    for doc, text, lang, source, n in rows:
        lowered = text
        if doc is not None and zlib.crc32(str(doc).encode()) % 3 == 0 and text is not None:
            lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
        groups.setdefault(lang, []).append(
            (doc is not None, doc, leaf_of((doc, source, lang, n, text)), leaf_of((doc, source, lang, n, lowered))))
    langs = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in langs:
        groups[g].sort(key=lambda r: (r[0], r[1] or 0, r[2]))
        trees[g] = climb([r[2] for r in groups[g]])
    root, tops = climb([trees[g][0] for g in langs])
    out = []
    for g, top in zip(langs, tops):
        for (_, doc, leaf, shown), path in zip(groups[g], trees[g][1]):
            node = shown
            for place, others in path + top:
                node = digest("".join(others[:place]) + node + "".join(others[place:]))
            proof = digest("".join("".join(others) for _, others in path + top))
            out.append((doc, leaf, trees[g][0], root, proof, node, node == root))
    return out


def listed(rows):
    return sorted(map(str, rows))


def result(df):
    return listed((r["doc_id"], r["leaf"], r["subroot"], r["root"], r["proof_sha256"], r["folded_root"], r["verified"]) for r in df.collect())


@pytest.mark.parametrize("sizes", [(1,), (9, 1, 8), (65, 64, 513, 0, 7, 2, 3, 1, 1, 70)])
def test_same_as_brute_force(spark, tmp_path, sizes):
    """Lone leaves, full runs, runs of one, more languages than a run, repeated rows, null fields."""
    rows, k = [], 0
    for g, size in enumerate(sizes):
        for i in range(size):
            k += 1
            rows.append((None if k % 50 == 3 else k * 7 % 1009, None if k % 11 == 0 else "" if k % 13 == 0 else f"Été {k % 5} TEXT",
                         None if g == 2 else ("", "en", "", "de", "é", "zh", "a", "b", "c", "d")[g], "s" if k % 3 else None, k if k % 7 else None))
    rows += rows[:3] if len(rows) > 1 else []
    spark.createDataFrame(rows, DOCS).selectExpr("*", "1 AS grp", "2 AS idx", "'x' AS digest", "3 AS path").repartition(4).write.parquet(
        f"{tmp_path}/documents.parquet")
    got = registry.QUERIES[NAME](spark, str(tmp_path))
    want = brute_force(rows)
    assert result(got) == listed(want)
    assert len(rows) == 1 or {r[-1] for r in want} == {True, False}


def test_same_as_sql(spark, sf_dir, tmp_path):
    difference, _ = compare(spark, connect(sf_dir), NAME, registry.QUERIES[NAME], registry.ORACLE[NAME], sf_dir)
    assert difference is None
    rows = corpora.corpus()
    spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    difference, _ = compare(spark, con_of(tmp_path), NAME, registry.QUERIES[NAME], registry.ORACLE[NAME], str(tmp_path))
    assert difference is None


def test_any_change_shows(spark):
    """A proof leads to the root from its own leaf only, whichever level is changed."""
    docs = spark.createDataFrame([(i, f"text {i}", "en", "s", 6) for i in range(600)], DOCS)
    out = merkle.manifest(docs).filter("doc_id = 77").select("leaf", "root", "proof").collect()[0]
    proof = [(s["digit"], s["others"]) for s in out["proof"]]
    assert len(proof) == 4
    kind = "leaf string, proof array<struct<digit: int, others: string>>"
    bad = [[(d, o[:-1] + ("0" if o[-1] != "0" else "1")) if i == k and o else (d, o) for i, (d, o) in enumerate(proof)] for k in range(4)]
    bad += [[((d + 1) % 8, o) if i == 0 else (d, o) for i, (d, o) in enumerate(proof)]]
    rows = [(out["leaf"], proof)] + [(out["leaf"], p) for p in bad if p != proof] + [("0" * 64, proof)]
    roots = [r[0] for r in spark.createDataFrame(rows, kind).select(merkle.folded(F.col("leaf"), F.col("proof"))).collect()]
    assert roots[0] == out["root"] and out["root"] not in roots[1:] and len(roots) >= 5


def test_records_are_by_content(spark):
    """Equal subtrees share one record, and requests that share digits travel as one row."""
    docs = spark.createDataFrame([(1, "same", "en", "s", 4)] * 4096, DOCS)
    leaves = merkle.leaf_rows(docs).withColumn("idx", F.monotonically_increasing_id())
    nodes = spark.range(4096).select(F.lit("=en").alias("grp"), F.col("id").alias("idx"), F.lit(leaves.first()["leaf"]).alias("digest"))
    tree = merkle.build(nodes)
    assert [level.count() for level in tree.runs] == [512, 64, 8, 1, 1]
    assert all(merkle.records(level).count() == 1 for level in tree.runs[:4])


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    got = registry.QUERIES[NAME](spark, str(tmp_path))
    assert got.isEmpty() and got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
