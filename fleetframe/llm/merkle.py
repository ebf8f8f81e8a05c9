"""Merkle manifest of a dataset, proofs found by descent through content-addressed records.

Leaves are digests of rows, ordered within their language; every ``FANOUT`` consecutive nodes
become the digest of their digests until one is left, and the languages' last nodes are joined
in the same way. What is stored is one record for each inner node: its digest and those of its
children. Requests for leaves descend from the root: the digits of a leaf's rank choose a child
at every level, the children not chosen are collected, and at the end the segments are reversed
into a proof that leads from the leaf to the root. Requests with the same leading digits travel
as one row, so a level moves as many rows as the tree has nodes there, and none meets in one key.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..operators.ordering import enumerate_rows
from ..sizing import shared_table

FANOUT = 8
DIGEST_CHARS = 64
TAMPER_MODULUS = 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Tree(NamedTuple):
    runs: list[DataFrame]
    """For each level, runs of nodes (grp, idx) with their digest and ``children``; ``done`` where one node is left."""
    roots: DataFrame
    """(grp, depth, digest): the node left in each group."""


def digest_of(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def encoded(value: Column) -> Column:
    """``-`` for a null, else the UTF-8 byte count, a colon and the value."""
    text = value.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_rows(docs: DataFrame) -> DataFrame:
    """One narrow row for each document: group of its language, id, leaf, and the leaf of what a client presents.

    A third of the documents, by the checksum of the id, is presented with its letters lower-cased.
    """
    fields = {c: F.col(c) for c in FIELDS}
    leaf = lambda f: digest_of(F.concat(*[encoded(f[c]) for c in FIELDS]))
    changed = leaf(fields | {"text": F.translate(F.col("text").cast("string"), UPPER, LOWER)})
    tampered = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % TAMPER_MODULUS == 0, F.lit(False))
    lang = F.col("lang").cast("string")
    return docs.select(
        F.when(lang.isNull(), "").otherwise(F.concat(F.lit("="), lang)).alias("grp"), "doc_id",
        leaf(fields).alias("leaf"), F.when(tampered, changed).alias("changed"),
    )


def build(nodes: DataFrame) -> Tree:
    """Tree over (grp, idx, digest), idx from 0 in each group; each level is written.

    Only a group with one node has a first run of one, so no count of a group is needed.
    """
    runs, roots = [], None
    while True:
        level = shared_table(
            nodes.groupBy("grp", F.floor(F.col("idx") / FANOUT).alias("idx"))
            .agg(F.array_sort(F.collect_list(F.struct("idx", "digest"))).alias("nodes"))
            .select(
                "grp", "idx", F.col("nodes.digest").alias("children"),
                ((F.col("idx") == 0) & (F.size("nodes") == 1)).alias("done"),
            )
            .withColumn("digest", F.when(F.col("done"), F.col("children")[0]).otherwise(digest_of(F.array_join("children", ""))))
        )
        left = level.filter("done").select("grp", F.lit(len(runs)).alias("depth"), "digest")
        roots = left if roots is None else roots.unionByName(left)
        runs.append(level)
        nodes = level.filter("NOT done").select("grp", "idx", "digest")
        if nodes.isEmpty():
            return Tree(runs, roots)


def segment(children: Column, digit: Column) -> Column:
    """What a level adds to a path: the children not chosen, and the place of the one that was."""
    others = F.filter(children, lambda _, i: i != digit)
    return F.struct(digit.cast("int").alias("digit"), F.array_join(others, "").alias("others"))


def records(level: DataFrame) -> DataFrame:
    """Children by digest; equal content has one record."""
    return level.filter("NOT done").groupBy("digest").agg(F.first("children").alias("children"))


def descend(tree: Tree, starts: DataFrame) -> DataFrame:
    """(grp, idx, children, path, ...) of the lowest inner nodes, from ``starts`` (grp, depth, digest, path, ...).

    ``path`` holds the segments from the top down. A group whose only node is a leaf keeps its start,
    with null children.
    """
    extra = [c for c in starts.columns if c not in ("grp", "depth", "digest", "path")]
    begin = lambda k: starts.filter(F.col("depth") == k).select("grp", F.lit(0).cast("long").alias("idx"), "digest", "path", *extra)
    nothing = F.lit(None).cast("array<string>")
    lone = begin(0).select("grp", "idx", nothing.alias("children"), "path", *extra)
    front = None
    for k in range(len(tree.runs) - 1, 0, -1):
        front = begin(k) if front is None else front.unionByName(begin(k))
        found = front.join(records(tree.runs[k - 1]), "digest").select("grp", "idx", "children", "path", *extra)
        if k == 1:
            return found.unionByName(lone)
        front = found.select("*", F.posexplode("children").alias("digit", "digest")).select(
            "grp", (F.col("idx") * FANOUT + F.col("digit")).alias("idx"), "digest",
            F.concat("path", F.array(segment(F.col("children"), F.col("digit")))).alias("path"), *extra,
        )
    return lone


def requested(homes: DataFrame, requests: DataFrame) -> DataFrame:
    """Requests (grp, idx, ...) with the path from the root to their leaf."""
    node = homes.withColumnsRenamed({"grp": "_grp", "idx": "_idx"})
    digit = F.col("idx") % FANOUT
    last = F.when(F.col("children").isNull(), F.col("path")).otherwise(
        F.concat("path", F.array(segment(F.col("children"), digit)))
    )
    on = (F.col("grp") == F.col("_grp")) & (F.floor(F.col("idx") / FANOUT) == F.col("_idx"))
    return requests.join(node, on).withColumn("path", last).drop("_grp", "_idx", "children")


def folded(leaf: Column, proof: Column) -> Column:
    """Root that a leaf and the segments of its proof, from the leaf up, lead to."""
    cut = lambda s: s["digit"] * DIGEST_CHARS
    return F.aggregate(proof, leaf, lambda node, s: digest_of(F.concat(
        F.substring(s["others"], F.lit(1), cut(s)), node,
        F.substring(s["others"], cut(s) + 1, F.length(s["others"])),
    )))


def manifest(docs: DataFrame) -> DataFrame:
    """Each document with its leaf, subroot, root, ``proof`` (segments from the leaf up) and what verifying it gives.

    Null fields have their own mark, a null language is a group of its own that sorts first, and null
    ids sort first; a null id is never tampered with. Equal rows have equal leaves at neighbouring
    ranks. A text of any length is one leaf. An empty table gives no rows. Columns beside the five
    fields are ignored.
    """
    leaves = shared_table(leaf_rows(docs))
    order = [F.col("doc_id").asc_nulls_first(), "leaf"]
    ranked = shared_table(enumerate_rows(leaves, order, ["grp"], "rank").withColumn("idx", F.col("rank") - 1).drop("rank"))
    tree = build(ranked.select("grp", "idx", F.col("leaf").alias("digest")))
    groups = shared_table(enumerate_rows(tree.roots, ["grp"], [], "rank"))
    top = build(groups.select(F.lit("").alias("grp"), (F.col("rank") - 1).alias("idx"), "digest"))
    none = F.lit(None).cast("array<struct<digit: int, others: string>>")
    start = top.roots.withColumns({"root": F.col("digest"), "path": F.coalesce(none, F.array().cast("array<struct<digit: int, others: string>>"))})
    subroots = requested(
        descend(top, start), groups.select(F.lit("").alias("grp"), (F.col("rank") - 1).alias("idx"),
                                           F.col("grp").alias("group"), "depth", "digest"),
    ).select(F.col("group").alias("grp"), "depth", "digest", F.col("digest").alias("subroot"), "root", "path")
    placed = requested(descend(tree, shared_table(subroots)), ranked)
    proof = placed.withColumn("proof", F.reverse("path")).drop("path", "grp", "idx")
    verified = proof.withColumn("folded_root", folded(F.coalesce("changed", "leaf"), F.col("proof")))
    return verified.withColumn("verified", F.col("folded_root") == F.col("root")).drop("changed")


def op12_dag_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaves, roots and checked proofs of all documents."""
    out = manifest(spark.read.parquet(f"{sf_dir}/documents.parquet").select(*FIELDS))
    proof = digest_of(F.array_join(F.col("proof.others"), ""))
    return out.select("doc_id", "leaf", "subroot", "root", proof.alias("proof_sha256"), "folded_root", "verified")


def crc32_sql(codes: str) -> str:
    """crc32 of a list of byte values, bit by bit."""
    return (f"xor(list_reduce(list_concat([4294967295::BIGINT], {codes}), lambda c, b: list_reduce("
            "[xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda d, z: CASE WHEN d & 1 = 1 THEN xor(d >> 1, 3988292384) ELSE d >> 1 END)), 4294967295)")


def _levels_sql(name: str, first: str, levels: int) -> str:
    parts = [f"{name}0 AS MATERIALIZED ({first})"]
    for k in range(levels):
        parts.append(f"{name}r{k} AS MATERIALIZED (SELECT g, i // {FANOUT} AS r, list(d ORDER BY i) AS ds FROM {name}{k} GROUP BY g, i // {FANOUT})")
        parts.append(f"{name}{k + 1} AS MATERIALIZED (SELECT g, r AS i, CASE WHEN r = 0 AND len(ds) = 1 THEN ds[1] "
                     f"ELSE sha256(array_to_string(ds, '')) END AS d FROM {name}r{k})")
    return ",\n".join(parts)


def _walk_sql(walk: str, name: str, first: str, levels: int) -> str:
    """Siblings and recomputed digests, level by level up."""
    parts = [f"{walk}0 AS ({first})"]
    for k in range(levels):
        before, after = f"array_to_string(ds[1:(i % {FANOUT})], '')", f"array_to_string(ds[(i % {FANOUT} + 2):], '')"
        parts.append(
            f"{walk}{k + 1} AS (SELECT w.* EXCLUDE (i, cur, proof), i // {FANOUT} AS i, proof || {before} || {after} AS proof, "
            f"CASE WHEN r = 0 AND len(ds) = 1 THEN cur ELSE sha256({before} || cur || {after}) END AS cur "
            f"FROM {walk}{k} w JOIN {name}r{k} x ON w.g = x.g AND w.i // {FANOUT} = x.r)")
    return ",\n".join(parts)


def _leaf_sql(text: str) -> str:
    field = lambda c: f"coalesce(strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR, '-')"
    return f"sha256({' || '.join(field(c) for c in ('doc_id', 'source', 'lang', 'n_chars', text))})"


_LEVELS, _TOP_LEVELS = 8, 3
SQL = f"""
WITH leaves AS MATERIALIZED (SELECT doc_id, CASE WHEN lang IS NULL THEN '' ELSE '=' || lang END AS g, {_leaf_sql('text')} AS leaf,
  CASE WHEN doc_id IS NOT NULL AND {crc32_sql("list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)")} % {TAMPER_MODULUS} = 0
    THEN {_leaf_sql(f"translate(text, '{UPPER}', '{LOWER}')")} END AS changed FROM documents),
ranked AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM leaves),
{_levels_sql('lv', "SELECT g, i, leaf AS d FROM ranked", _LEVELS)},
{_levels_sql('tv', f"SELECT '' AS g, row_number() OVER (ORDER BY lv{_LEVELS}.g) - 1 AS i, d FROM lv{_LEVELS}", _TOP_LEVELS)},
{_walk_sql('low', 'lv', "SELECT *, coalesce(changed, leaf) AS cur, '' AS proof FROM ranked", _LEVELS)},
numbered AS (SELECT g, d, row_number() OVER (ORDER BY g) - 1 AS i FROM lv{_LEVELS}),
{_walk_sql('high', 'tv', f"SELECT low{_LEVELS}.* EXCLUDE (g, i), '' AS g, n.i, n.d AS subroot FROM low{_LEVELS} JOIN numbered n ON n.g = low{_LEVELS}.g", _TOP_LEVELS)}
SELECT doc_id, leaf, subroot, tv{_TOP_LEVELS}.d AS root, sha256(proof) AS proof_sha256, cur AS folded_root, cur = tv{_TOP_LEVELS}.d AS verified
FROM high{_TOP_LEVELS}, tv{_TOP_LEVELS}
"""
