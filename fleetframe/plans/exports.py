"""Queries that write a table in an export layout and read it back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.maps import text_map
from ..schemas import LABEL_INSTANCE, LABEL_NAME
from ..sizing import shared_dir
from ..sources import objects as O, registry as G
from .views import table


def _folder(spark):
    return f"{shared_dir(spark)}/export-{uuid.uuid4().hex}"


def exported_nodes(spark, sf):
    """Node objects as JSON lines by kind, cluster and date (A6, A2)."""
    key = F.col("s_suppkey")
    text = lambda c: c.cast("string")
    rows = table(spark, sf, "supplier").select(
        F.lit("Node").alias("kind"), F.concat(F.lit("c"), text(F.col("s_nationkey"))).alias("cluster_id"),
        F.lit("2024-01-01").alias("snapshot_date"), key.cast("int").alias("pos"),
        F.lit("v1").alias("apiVersion"),
        F.struct(F.col("s_name").alias("name"), text_map({LABEL_NAME: "trino", LABEL_INSTANCE: text(key % 7)}).alias("labels"),
                 text(key * 3).alias("resourceVersion")).alias("metadata"),
        F.struct(F.when(key % 4 == 0, F.array(F.struct(F.lit("busy").alias("key")))).alias("taints"),
                 F.concat(F.lit("kind://"), text(key)).alias("providerID")).alias("spec"),
        F.struct(text_map({"cpu": text(key % 9)}).alias("allocatable")).alias("status"))
    path = _folder(spark)
    rows.write.partitionBy("kind", "cluster_id", "snapshot_date").json(path)
    # Beside them lines that an export cut off, or whose position is no number.
    cut = F.when(key % 9 == 4, F.concat(F.lit('{"pos": '), text(key), F.lit(', "metadata": {"name": "'), "s_name")).when(
        key % 9 == 7, F.concat(F.lit('{"pos": "at '), text(key), F.lit('"}')))
    rows.withColumn("s_suppkey", F.col("pos").cast("long")).withColumn("s_name", F.col("metadata.name")).select(
        "kind", "cluster_id", "snapshot_date", cut.alias("value")).filter(F.col("value").isNotNull()).write.mode(
        "append").partitionBy("kind", "cluster_id", "snapshot_date").text(path)
    nodes, rejects = O.read_objects_checked(spark, path, "Node")
    return nodes.select(
        "cluster_id", "pos", "name", "product", "owner", "resource_version", F.size("taints").alias("taints"),
        "provider_id", F.try_element_at("allocatable", F.lit("cpu")).alias("cpu"),
    ).unionByName(rejects.select("cluster_id", "line", "error"), allowMissingColumns=True)


def exported_releases(spark, sf):
    """Helm releases as JSON lines by cluster, some without a readable time (A6, A5)."""
    key = F.col("o_orderkey")
    rows = table(spark, sf, "orders").select(
        F.concat(F.lit("c"), (F.col("o_custkey") % 25).cast("string")).alias("cluster_id"), key.cast("int").alias("pos"),
        F.concat(F.lit("rel-"), key.cast("string")).alias("name"), F.lit("ns").alias("namespace"),
        F.concat((key % 6).cast("string"), F.lit(".0.0")).alias("version"),
        F.when(key % 5 == 0, "unknown").otherwise(F.lit("2022-09-15 09:52:59.123 +0000 UTC")).alias("lastUpdated"))
    path = _folder(spark)
    rows.write.partitionBy("cluster_id").json(path)
    bad = rows.filter(F.col("pos") % 1000 == 17).select("cluster_id", F.concat(F.lit("[truncated "), F.col("name")).alias("value"))
    bad.write.mode("append").partitionBy("cluster_id").text(path)
    good, rejects = O.read_releases_checked(spark, path)
    return good.select(
        "cluster_id", "pos", "name", "namespace", "version", "last_updated", F.unix_seconds("updated_at").alias("updated"),
    ).unionByName(rejects.select("cluster_id", "line", "error"), allowMissingColumns=True)


def exported_pages(spark, sf):
    """Registry pages of twenty artifacts, of nested repositories, and a page that cannot be read (A6, A3, A4)."""
    key = F.col("p_partkey")
    repository = F.concat(F.lit("charts/deep/"), F.lower(F.replace("p_brand", F.lit("#"), F.lit("-"))))
    rows = table(spark, sf, "part").select(
        repository.alias("repository"), (F.floor(key / 500) + 1).cast("int").alias("page"),
        F.struct(F.concat(F.lit("d"), key.cast("string")).alias("digest"),
                 F.array(F.struct(F.concat(key.cast("string"), F.lit(".0.0")).alias("name"))).alias("tags")).alias("a"), key.alias("id"))
    pages = rows.groupBy("repository", "page").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("id", "a"))), lambda x: x["a"]).alias("list"))
    # One value for each page: a JSON array, but for the second page of one brand.
    cut = (F.col("page") == 2) & F.col("repository").endswith("-13")
    value = F.when(cut, "no list").otherwise(F.to_json("list"))
    path = _folder(spark)
    # Many pages in each file, one row each.
    G.write_result(pages.select("repository", "page", value.alias("value")), path)
    good, rejects = G.parse_artifact_pages(spark.read.schema("repository STRING, page INT, value STRING").json(path))
    return good.select("repository", "page", "pos", "digest", F.get("tags", F.lit(0))["name"].alias("tag")).unionByName(
        rejects.select("repository", "page", "error"), allowMissingColumns=True)


QUERIES = {"exported_nodes": exported_nodes, "exported_releases": exported_releases, "exported_pages": exported_pages}

ORACLE = {
    "exported_nodes": """
        SELECT 'c' || CAST(s_nationkey AS STRING) AS cluster_id, CAST(s_suppkey AS INT) AS pos, s_name AS name, 'trino' AS product,
               CAST(s_suppkey % 7 AS STRING) AS owner, CAST(s_suppkey * 3 AS STRING) AS resource_version,
               CASE WHEN s_suppkey % 4 = 0 THEN 1 END AS taints, 'kind://' || CAST(s_suppkey AS STRING) AS provider_id,
               CAST(s_suppkey % 9 AS STRING) AS cpu, NULL AS line, NULL AS error FROM {supplier}
        UNION ALL SELECT 'c' || CAST(s_nationkey AS STRING), NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL,
               CASE s_suppkey % 9 WHEN 4 THEN '{"pos": ' || CAST(s_suppkey AS STRING) || ', "metadata": {"name": "' || s_name
                 ELSE '{"pos": "at ' || CAST(s_suppkey AS STRING) || '"}' END, 'ParseLine'
        FROM {supplier} WHERE s_suppkey % 9 IN (4, 7)""",
    "exported_releases": """
        SELECT 'c' || CAST(o_custkey % 25 AS STRING) AS cluster_id, CAST(o_orderkey AS INT) AS pos,
               'rel-' || CAST(o_orderkey AS STRING) AS name, 'ns' AS namespace,
               CAST(o_orderkey % 6 AS STRING) || '.0.0' AS version,
               CASE WHEN o_orderkey % 5 = 0 THEN 'unknown' ELSE '2022-09-15 09:52:59.123 +0000 UTC' END AS last_updated,
               CASE WHEN o_orderkey % 5 <> 0 THEN CAST(1663235579 AS BIGINT) END AS updated, NULL AS line, NULL AS error FROM {orders}
        UNION ALL SELECT 'c' || CAST(o_custkey % 25 AS STRING), NULL, NULL, NULL, NULL, NULL, NULL,
               '[truncated rel-' || CAST(o_orderkey AS STRING), 'ParseLine' FROM {orders} WHERE o_orderkey % 1000 = 17""",
    "exported_pages": """
        WITH p AS (SELECT 'charts/deep/' || lower(replace(p_brand, '#', '-')) AS repository,
                          CAST(p_partkey // 500 + 1 AS INT) AS page, p_partkey FROM {part})
        SELECT repository, page,
               CAST(row_number() OVER (PARTITION BY repository, page ORDER BY p_partkey) - 1 AS INT) AS pos,
               'd' || CAST(p_partkey AS STRING) AS digest, CAST(p_partkey AS STRING) || '.0.0' AS tag, NULL AS error
        FROM p WHERE NOT (page = 2 AND ends_with(repository, '-13'))
        UNION ALL SELECT DISTINCT repository, page, NULL, NULL, NULL, 'ParseArtifacts' FROM p
        WHERE page = 2 AND ends_with(repository, '-13')""",
}
